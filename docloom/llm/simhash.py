"""SimHash near-dedup with bit-sliced comparison.

A document's 64-bit fingerprint holds the majority bit of its 3-word shingles' XXH64. Fingerprints within
``RADIUS`` bits are linked. Equal fingerprints form one class before any comparison, so copies cost one row.
With four 16-bit blocks and a radius of two, linked fingerprints agree in two blocks at least: each class
goes to the six cells of its block pairs. A cell of more than ``CELL`` classes is dealt out as pairs of
salted sub-blocks, each a bounded task of its own. Within a cell, bit planes lie vertically, 64 fingerprints
a machine word; carry-save counters add up many distances at once, and words whose distances all exceed the
radius are abandoned. A cell returns a spanning forest of its links, never all pairs; large-star/small-star
rounds join the forests into components.

``deduplicated`` finds near-copies of a given Jaccard similarity, which two of 64 bits are too few for: it compares
1024-bit fingerprints of 5-word shingle sets in the same way, in cells of equal bands of minimum hashes of those sets.
A pair shares a band with a chance that depends on its Jaccard similarity alone, wherever the change lies: at 0.8 with
1 - (1 - 0.8^5)^16, 99.8 of 100. Pairs within a wide radius are then held against the similarity by their whole sets.
Cells with the same members are one cell, so a pair that shares many bands is compared once. A cell of n classes beyond
``CELL`` takes n / ``CELL`` copies of each: its tasks are bounded, their number grows with the square of the cell.

Nulls: a null text is an empty one (fingerprint zero), a null id takes part, and a component without any id
has a null component_id. Repeated rows fall into one class. Texts of any length are read whole. Further columns are
not looked at, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK_BITS = 16
CELL = 2048
#: Small cells are compared together up to this many rows: a link found across cells is a link too.
JOINT = 512
#: The general near-dedup: shingle words, Jaccard similarity, bits and lanes of the wide fingerprint, and bands of minima.
WORDS, SIMILARITY = 5, 0.8
WIDE, LANES = 1024, 8192
BANDS, BAND_ROWS = 16, 5
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    digest, out = xxhash.xxh64_digest, np.zeros(len(texts), np.uint64)
    hashed, counts, rows = [], [], []
    for row, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z alone change, and exactly 0x20 and 0x09-0x0D divide
        if not words:
            continue
        if len(words) < size:
            hashed.append(digest(b" ".join(words), SEED))
            counts.append(1)
        else:
            shingles = zip(*(words[i:] for i in range(size)), strict=False)
            hashed.append(b"".join([digest(b" ".join(s), SEED) for s in shingles]))
            counts.append(len(words) - size + 1)
        rows.append(row)
    if rows:
        bits = np.unpackbits(np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8), axis=1)
        n = np.array(counts)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long; row tells rows of one id apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            fp = fingerprints_of(common.as_bytes(batch, "text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp)], ["doc_id", "row", "fp"])

    rows = common.texts(docs)
    return rows.withColumn("row", common.row_hash(rows)).mapInArrow(each, "doc_id long, row long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """[bits, words] of fingerprints [n, bits / 64]: bit i of word w of plane b is bit b of fingerprint
    64 w + i."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


class CarrySave:
    """Bit-sliced counters of 64 distances a word. Planes are added eight at a time through a tree of
    carry-save adders; what is carried out of it ripples into the upper counters."""

    def __init__(self, n: int, radius: int) -> None:
        self.radius, self.width = radius, max(4, (radius + 1).bit_length())
        self.counters = [np.zeros(n, np.uint64) for _ in range(self.width)]
        self.over = np.zeros(n, np.uint64)

    def keep(self, rows: np.ndarray) -> None:
        self.counters, self.over = [c[rows] for c in self.counters], self.over[rows]

    def add(self, x: list[np.ndarray]) -> None:
        def pair(low, a, b):
            half = low ^ a
            return half ^ b, low & a | half & b

        ones, twos, fours = self.counters[:3]
        ones, t0 = pair(ones, x[0], x[1])
        ones, t1 = pair(ones, x[2], x[3])
        twos, f0 = pair(twos, t0, t1)
        ones, t0 = pair(ones, x[4], x[5])
        ones, t1 = pair(ones, x[6], x[7])
        twos, f1 = pair(twos, t0, t1)
        fours, carry = pair(fours, f0, f1)
        self.counters[:3] = ones, twos, fours
        for k in range(3, self.width):
            self.counters[k], carry = self.counters[k] ^ carry, self.counters[k] & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Bits of the distances that exceed the radius."""
        more, equal = self.over.copy(), np.full_like(self.over, ALL)
        for k in reversed(range(self.width)):
            if self.radius >> k & 1:
                equal &= self.counters[k]
            else:
                more |= equal & self.counters[k]
                equal &= ~self.counters[k]
        return more


def sliced_links(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, position) of all fingerprints of ``planes`` within the radius; padding positions included.

    After each eight planes, words whose 64 distances all exceed the radius are abandoned.
    """
    query, word = np.divmod(np.arange(len(queries) * planes.shape[1]), planes.shape[1])
    count = CarrySave(len(query), radius)
    for b in range(0, len(planes), 8):
        byte = queries[:, b // 64] >> np.uint64(b % 64)
        asks = [np.where(byte >> np.uint64(k) & np.uint64(1), ALL, np.uint64(0)) for k in range(8)]
        count.add([planes[b + k][word] ^ asks[k][query] for k in range(8)])
        if b + 8 > radius and (b % 64 == 56 or len(planes) == 64):
            alive = np.flatnonzero(count.beyond() != ALL)
            if len(alive) < len(query):
                query, word = query[alive], word[alive]
                count.keep(alive)
    near = np.unpackbits((~count.beyond()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(near)
    return query[at], 64 * word[at] + bit


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` after the links (i, j): the first position of each component."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= similarity * (len(both) - shared)


def forest(fps: np.ndarray, radius: int = RADIUS, sets: list[np.ndarray] | None = None, similarity: float = 0) -> np.ndarray:
    """For each fingerprint the position of the first one it is connected with inside this array.

    With ``sets``, only pairs of at least ``similarity`` are links. Each round takes one open pair of each row; pairs
    that are connected already need no look at their sets, so a group of copies costs about one look a row.
    """
    fps = fps.reshape(len(fps), -1)
    planes, label = bit_planes(fps), np.arange(len(fps))
    for start in range(0, len(fps), JOINT):
        i, j = sliced_links(fps[start : start + JOINT], planes, radius)
        i, j = (i + start)[j < len(fps)], j[j < len(fps)]
        if sets is None:
            label = _joined(label, i, j)
            continue
        i, j = i[i > j], j[i > j]
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            taken = np.unique(i, return_index=True)[1]
            links = np.array([alike(sets[a], sets[b], similarity) for a, b in zip(i[taken].tolist(), j[taken].tolist(), strict=True)])
            label = _joined(label, i[taken[links]], j[taken[links]])
            i, j = np.delete(i, taken), np.delete(j, taken)
    return label


def dealt(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """(cell, id, b1, b2) of (cell, id): cells of one row are left out, of cells with the same members (by 128 bits of
    their ids' hashes) one stays, and a cell of more than ``cell`` rows is dealt out as pairs of salted sub-blocks."""
    members = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
    busy = rows.groupBy("cell").agg(F.count("*").alias("count"), *members).filter("count > 1")
    busy = busy.groupBy("count", "m1", "m2").agg(F.min("cell").alias("cell"))
    busy = common.stored(busy.select("cell", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "cells")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = rows.join(busy, "cell").select("cell", "id", own.alias("own"), other.alias("other"))
    return pairs.select("cell", "id", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))


def compared(rows: DataFrame, radius: int, similarity: float = 0) -> DataFrame:
    """(a, b): ids whose links span all components of the cells of (cell, b1, b2, id, fp); fp is the
    fingerprint's bytes. Only whole cells are held, and small ones are compared together. With a similarity
    there is a further column ``shingles``, and only pairs whose sets have it are links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)]))
            size = np.diff(np.append(start, len(ids)))
            a, b, held = [], [], []

            def flush():
                rows = np.concatenate(held)
                own, first = np.unique(ids[rows], return_index=True)
                own_sets = [np.frombuffer(sets[r], "<u4") for r in rows[first].tolist()] if similarity else None
                root = forest(fps[rows[first]], radius, own_sets, similarity)
                linked = np.flatnonzero(root != np.arange(len(own)))
                a.append(own[linked])
                b.append(own[root[linked]])
                held.clear()

            n = 0
            for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                if held and n + k > JOINT:
                    flush()
                    n = 0
                held.append(np.arange(s, s + k))
                n += k
            if held:
                flush()
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (a, b)], ["a", "b"])

        key = ids = fps = sets = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("cell", "b1", "b2")], axis=1)
            wide = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(batch.num_rows, -1)
            own = batch.column("id").to_numpy()
            bag = np.empty(batch.num_rows, object)
            if similarity:
                bag[:] = batch.column("shingles").to_pylist()
            held = (more, own, wide, bag)
            key, ids, fps, sets = held if key is None else (np.concatenate(x) for x in zip((key, ids, fps, sets), held, strict=True))
            if np.any(key[0] != key[-1]):
                cut = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1  # the last cell may go on
                yield found(key[:cut], ids[:cut], fps[:cut], sets[:cut])
                key, ids, fps, sets = key[cut:], ids[cut:], fps[cut:], sets[cut:]
        if key is not None:
            yield found(key, ids, fps, sets)

    rows = rows.repartition("cell", "b1", "b2").sortWithinPartitions("cell", "b1", "b2")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def links(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links of 64-bit fingerprints ``fp`` within two bits, by cells of two 16-bit blocks in common."""
    block = [F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(4)]
    pairs = list(itertools.combinations(range(4), 2))
    keys = F.array(*(F.lit(k << 32) + F.shiftleft(block[a], BLOCK_BITS) + block[b] for k, (a, b) in enumerate(pairs)))
    rows = dealt(classes.select(F.col("fp").alias("id"), F.explode(keys).alias("cell")), cell)
    # The fingerprint is its own id; its bytes in reverse are little-endian, and a distance is the same in any order.
    return compared(rows.withColumn("fp", F.unhex(F.lpad(F.hex("id"), 16, "0"))), RADIUS)


def connected(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of an edge is connected with.

    Alternating large-star and small-star; each half-round is written to the shared folder. Minima are
    written before they are joined back, so that a vertex with many edges meets a splittable join.
    """

    def rewired(pairs: DataFrame) -> DataFrame:
        """pairs (u, v), with the smallest v of each u."""
        pairs = common.stored(pairs, "edges")
        least = common.stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        return pairs.join(least, "u")

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    e = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(e)
    while True:
        both = rewired(e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = rewired(large)
        star = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = common.stored(star.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        if (now := state(e)) == was:
            break
        was = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def components(fps: DataFrame, links_of=links) -> DataFrame:
    """(fp, component_id, keep) of each distinct class ``fp``: the smallest id of its component (nulls
    last), and with it the one row that stands for it."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = common.stored(fps.groupBy("fp").agg(F.min(row).alias("first")), "classes")
    roots = connected(links_of(classes)).withColumnRenamed("v", "fp")
    rooted = common.stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = common.stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "least")
    return rooted.drop("first").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep"))


def op3_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = common.stored(fingerprints(common.table(spark, sf_dir, "documents")), "fingerprints")
    found = common.stored(components(fps), "components")
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signs(shingles: np.ndarray, units: np.ndarray, n: int, bits: int) -> np.ndarray:
    """[n, bits / 8] bytes: signs of projections of each unit's set of shingles. The set is sketched into
    ``LANES`` lanes, and a Hadamard transform of the lanes, their signs mixed, gives the projections."""
    if len(shingles):
        order = np.lexsort((shingles, units))
        shingles, units = shingles[order], units[order]
        new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (units[1:] != units[:-1])])
        shingles, units = shingles[new], units[new]
    out = []
    edges = np.searchsorted(units, np.arange(0, n + 256, 256))
    for start, a, b in zip(range(0, n, 256), edges, edges[1:], strict=False):
        rows = min(256, n - start)
        x = wordhash.sketches(shingles[a:b], units[a:b] - start, rows, LANES)
        x *= np.where(wordhash.mixed(np.arange(LANES, dtype=np.uint64) + np.uint64(9)) & np.uint64(1), 1, -1).astype(np.float32)
        h = 1
        while h < LANES:
            y = x.reshape(rows, -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(rows, LANES)
            h *= 2
        taken = np.argsort(wordhash.mixed(np.arange(LANES, dtype=np.uint64)))[:bits]
        out.append(np.packbits(x[:, taken] > 0, axis=1, bitorder="little"))
    return np.concatenate(out) if out else np.zeros((0, bits // 8), np.uint8)


def _bands(shingles: np.ndarray, units: np.ndarray, n: int) -> list[np.ndarray]:
    """The ``BANDS`` band keys of each unit: hashes of ``BAND_ROWS`` minima each; a unit without shingles has none."""
    out = [np.zeros(0, np.int64)] * n
    if not len(shingles):
        return out
    order = np.argsort(units, kind="stable")
    shingles, units = shingles[order], units[order]
    start = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
    factors = wordhash.mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    keys, each = np.empty((len(start), BANDS), np.uint64), np.empty_like(shingles)
    for band in range(BANDS):
        key = np.full(len(start), band + 1, np.uint64)
        for factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            np.multiply(shingles, factor, out=each)
            key = wordhash.mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(each, start))
        keys[:, band] = key
    for unit, own in zip(units[start].tolist(), keys.view(np.int64), strict=True):
        out[unit] = own
    return out


def banded(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp, keys) of (doc_id, text, row): fp names the sequence of words, keys are the bands of its
    ``words``-word shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            texts = [t.lower() for t in common.as_bytes(batch, "text")]
            same = [xxhash.xxh3_64_intdigest(b" ".join(t.split()), SEED) for t in texts]
            keys = _bands(*wordhash.shingle_hashes(*wordhash.word_hashes(texts), words), len(texts))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fp", "keys"])

    return rows.mapInArrow(each, "doc_id long, row long, fp long, keys array<long>")


def shingled(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, fp, shingles) of (id, text): the ``WIDE``-bit SimHash of the set of ``words``-word shingles, and the set as
    sorted 32-bit hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            hashed, units = wordhash.shingle_hashes(*wordhash.word_hashes([t.lower() for t in common.as_bytes(batch, "text")]), words)
            wide = _signs(hashed, units, batch.num_rows, WIDE)
            order = np.argsort(units, kind="stable")
            edges = np.searchsorted(units[order], np.arange(batch.num_rows + 1))
            sets = [np.unique((hashed[order[a:b]] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(sets, pa.binary())], ["id", "fp", "shingles"])

    return rows.select("id", "text").mapInArrow(each, "id long, fp binary, shingles binary")


def wide_radius(similarity: float) -> int:
    """Differing bits of two sets of that similarity (of equal size, the farthest), and four standard deviations more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * p + 4 * np.sqrt(WIDE * p * (1 - p)))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the row with the smallest id (nulls last), then
    the smallest hash of id and text. Of repeated rows one stays, of those that differ in further columns the one with
    the smallest hash of all columns.

    Groups are connected pairs of ``similarity`` or more (Jaccard, sets of ``words``-word shingles, by their 32-bit
    hashes); texts of equal words are one class from the start. Only texts that share a band are shingled again, and
    whole rows are shuffled once.
    """
    key = common.unused(docs, "row")
    keyed = docs.withColumn(key, common.row_hash(docs))
    found = common.texts(docs)
    found = common.stored(banded(found.withColumn("row", common.row_hash(found)), words), "fingerprints")
    one = found.groupBy("fp").agg(F.min(F.struct("doc_id", "row", "keys")).alias("x"))
    sample = common.stored(one.select("fp", "x.row", "x.keys"), "signatures")
    repeated = common.stored(found.groupBy("row").count().filter("count > 1").select(F.col("row").alias(key)), "repeated")
    rows = common.unrepeated(keyed, key, repeated)

    def links_of(classes: DataFrame) -> DataFrame:
        cells = common.stored(dealt(sample.select(F.col("fp").alias("id"), F.explode("keys").alias("cell"))), "dealt")
        near = cells.select(F.col("id").alias("fp")).distinct().join(sample, "fp").select(F.col("fp").alias("id"), "row")
        near = common.stored(near, "near")
        texts = rows.select(F.col(key).alias("row"), F.coalesce(rows["text"], F.lit("")).alias("text")).join(near.hint("merge"), "row")
        return compared(cells.join(common.stored(shingled(texts, words), "shingled"), "id"), wide_radius(similarity), similarity)

    kept = common.stored(components(found.select("doc_id", "row", "fp"), links_of).select(F.col("keep").alias(key)).distinct(), "kept")
    return rows.join(kept.hint("merge"), key, "left_semi").drop(key)
