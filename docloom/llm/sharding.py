"""Fixed virtual slots: records hash into thousands of slots, a versioned map assigns slots to shards.

A record's slot depends on its id, its text and, of repeated rows, on which copy it is; it never changes. Only the
slot-to-shard map is edited: ``rebalanced`` moves the fewest slots it can to even out bytes, ``grown`` moves slots
into a new shard alone. Every edit gives a new version. A map is kept as a table with a folder for each version: a run that
is given its path loads it, edits it for the bytes it finds, and adds a version if that moved any slot.

The law is ``bytes``: sizes alone decide, so documents of equal text may lie in different shards, and a hot id or text
is spread over all slots. Nulls: a null id is an id like any other, a null text has no bytes. Repeated rows each get a
place of their own: they are counted first and dealt to slots by their number. Texts of any length count whole. Further
columns are not looked at, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SLOTS = 4096
ROW_BYTES = 16
#: Copies of a repeated row are numbered in runs of this many.
COPIES = 4096


@dataclass(frozen=True)
class SlotMap:
    """shards[slot] of each version, the last one current. Its size is fixed by the number of slots."""

    shard_count: int
    versions: tuple[tuple[int, ...], ...] = field(default=())

    @staticmethod
    def even(shard_count: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(shard_count, (tuple(i * shard_count // slots for i in range(slots)),))

    @property
    def current(self) -> tuple[int, ...]:
        return self.versions[-1]

    def edited(self, shards: list[int], shard_count: int | None = None) -> SlotMap:
        return SlotMap(shard_count or self.shard_count, (*self.versions, tuple(shards)))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.001) -> SlotMap:
        """Move or swap slots between the heaviest shard and lighter ones until their loads differ by
        at most ``tolerance`` of the mean or no exchange of one or two slots helps."""
        shards, weight = list(self.current), [slot_bytes.get(i, 0) for i in range(len(self.current))]
        load, own = [0] * self.shard_count, [set() for _ in range(self.shard_count)]
        for slot, shard in enumerate(shards):
            load[shard] += weight[slot]
            if weight[slot]:
                own[shard].add(slot)
        target = sum(load) / self.shard_count
        for _ in range(8 * len(shards)):
            top = max(range(self.shard_count), key=load.__getitem__)
            low = min(range(self.shard_count), key=load.__getitem__)
            gap = load[top] - load[low]
            if gap <= max(1, tolerance * target):
                break
            best = min(((abs(gap - 2 * weight[s]), s, -1) for s in own[top]), default=None)
            if best is None or best[0] > gap / 8:
                others = sorted((weight[s], s) for s in own[low])
                for s in own[top]:
                    for w, o in others:
                        if (d := abs(gap - 2 * (weight[s] - w))) < (best[0] if best else gap):
                            best = (d, s, o)
            if best is None or best[0] >= gap:
                break
            _, s, o = best
            for slot, a, b in ((s, top, low), (o, low, top)):
                if slot >= 0:
                    own[a].discard(slot)
                    own[b].add(slot)
                    load[a] -= weight[slot]
                    load[b] += weight[slot]
                    shards[slot] = b
        return self.edited(shards)

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """One more shard, filled to the mean from the heaviest shards; no other slot moves."""
        shards, new = list(self.current), self.shard_count
        load = [0] * (new + 1)
        for slot, shard in enumerate(shards):
            load[shard] += slot_bytes.get(slot, 0)
        mean = sum(load) / (new + 1)
        for slot in sorted(range(len(shards)), key=lambda i: (-slot_bytes.get(i, 0), i)):
            w = slot_bytes.get(slot, 0)
            if shards[slot] != new and load[shards[slot]] - w >= mean * 0.999 and load[new] + w <= mean * 1.001:
                load[shards[slot]] -= w
                load[new] += w
                shards[slot] = new
        return self.edited(shards, new + 1)

    def save(self, spark: SparkSession, path: str, known: int = 0) -> None:
        """Add all versions but the first ``known``, which are there already."""
        self.frame(spark).filter(F.col("version") >= known).coalesce(1).write.partitionBy("version").mode("append").parquet(path)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(v, s, shard) for v, version in enumerate(self.versions) for s, shard in enumerate(version)]
        return spark.createDataFrame(rows, "version int, vslot int, shard int")


def load_map(spark: SparkSession, path: str) -> SlotMap:
    rows = spark.read.parquet(path).select("version", "vslot", "shard").collect()  # slots x versions rows
    versions: dict[int, list[int]] = {}
    for v, _, shard in sorted(tuple(r) for r in rows):
        versions.setdefault(v, []).append(shard)
    kept = tuple(tuple(versions[v]) for v in sorted(versions))
    return SlotMap(max(kept[-1]) + 1, kept)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, vslot): a row's bytes and its fixed virtual slot; copy numbers repeated rows."""
    rows = common.texts(docs).select(
        "doc_id",
        (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count("*").alias("n"))
    zero, most = F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")
    few = counted.filter(F.col("n") <= COPIES).withColumn("start", zero)
    # Of rows that occur more often, runs of COPIES numbers are dealt out before they are numbered one by one.
    many = counted.filter(F.col("n") > COPIES)
    last = F.col("n") - 1
    many = many.withColumn("start", F.explode(F.sequence(zero, last, F.lit(COPIES**3))))
    for step in (COPIES**2, COPIES):
        end = F.least(last, F.col("start") + (COPIES - 1) * step)
        many = many.withColumn("start", F.explode(F.sequence("start", end, F.lit(step).cast("long"))))
    many = many.repartition(common.partitions(docs.sparkSession), "doc_id", "text_hash", "start")
    copy = F.explode(F.sequence("start", F.least(last, F.col("start") + most)))
    copies = few.unionByName(many).withColumn("copy", copy)
    slot = F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(slots)).cast("int")
    return copies.select("doc_id", "size", "text_crc32", "copy", slot.alias("vslot"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; as many rows reach the driver as there are slots."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def place(rows: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Each slotted row with its shard and its gapless place there.

    A place is the number of rows in the shard's earlier slots plus the row's rank in its slot, so no
    window is wider than one slot.
    """
    seen, before = [0] * slot_map.shard_count, []
    for slot, shard in enumerate(slot_map.current):
        before.append((slot, shard, seen[shard]))
        seen[shard] += counts.get(slot, 0)
    spark = rows.sparkSession
    where = F.broadcast(spark.createDataFrame(before, "vslot int, shard int, before long"))  # one row per slot
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return rows.withColumn("rank", rank).join(where, "vslot").withColumn("slot", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def shard_by_bytes(docs: DataFrame, shard_count: int = 40, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows placed by the map kept at ``map_path`` (an even one if there is none yet) edited for bytes, and the map with all
    its versions; the edit is kept there."""
    spark = docs.sparkSession
    rows = common.stored(slotted(docs, slots), "slotted")
    sizes = slot_sizes(rows)
    kept = map_path is not None and common.exists(spark, map_path)
    old = load_map(spark, map_path) if kept else SlotMap.even(shard_count, slots)
    if len(old.current) != slots or old.shard_count != shard_count:
        raise ValueError(f"the map at {map_path} has {len(old.current)} slots and {old.shard_count} shards")
    new = old.rebalanced({s: b for s, (b, _) in sizes.items()})
    slot_map = new if new.current != old.current else old
    if map_path is not None and (not kept or slot_map is not old):
        slot_map.save(spark, map_path, len(old.versions) if kept else 0)
    return place(rows, slot_map, {s: n for s, (_, n) in sizes.items()}), slot_map


def op10_fixed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``bytes``; vslot is the fixed virtual slot. The map is kept where
    ``spark.docloom.slotmap`` names a path, so that the next run edits it; else it ends with the run."""
    placed, slot_map = shard_by_bytes(common.table(spark, sf_dir, "documents"), map_path=spark.conf.get("spark.docloom.slotmap", None))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
        F.lit(len(slot_map.versions) - 1).alias("map_version"),
    )
