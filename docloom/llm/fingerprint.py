"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (its lines). Each paragraph hashes to a wide vector, and a text's
fingerprint is the sum of the vectors modulo powers of two: equal multisets of paragraphs give equal sums in
any order, and paragraphs are inserted or deleted by adding or subtracting theirs. The vector has two parts:
``LANES`` words of a hash of the whole paragraph, modulo 2^64, for equality, and ``SKETCH`` lanes modulo 2^32
in which each 3-word shingle of the paragraph adds +1 or -1 to one lane, so that inner products of two sums
estimate how much their texts share.

Nulls: a null text is an empty one (one empty paragraph); rows with a null id come first in the order of ids.
Rows of equal id follow one another by their texts' hashes, so that a hot id is divided too. Repeated rows follow one
another: each but the last has its own text as the next one. Texts of any length are read whole. Texts without a word
are alike 1 if equal, else 0. An only document is its own next one. Further columns are not looked at. Empty input gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

LANES = 32
SKETCH = 1024
SHINGLE = 3


@dataclass(frozen=True)
class Fingerprint:
    """strong: uint64[LANES]; sketch: int32[SKETCH]. Sums wrap."""

    strong: np.ndarray
    sketch: np.ndarray

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.sketch - other.sketch)

    def hexdigest(self) -> str:
        return hashlib.sha256(self.strong.tobytes()).hexdigest()

    def likeness(self, other: Fingerprint) -> float:
        """Twice the shared part over both parts, from 0 to 1; equal fingerprints are alike 1."""
        if np.array_equal(self.strong, other.strong):
            return 1.0
        a, b = self.sketch.astype(np.float64), other.sketch.astype(np.float64)
        both = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / both))) if both else 0.0


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    """The fingerprint of each text; its paragraphs' vectors are summed as they are made."""
    if not texts:
        return []
    digests, counts, lines, owner = [], [], [], []
    for i, text in enumerate(texts):
        own = text.split(b"\n")
        digests += [hashlib.shake_128(p).digest(8 * LANES) for p in own]
        counts.append(len(own))
        lines += own
        owner += [i] * len(own)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    strong = np.add.reduceat(np.frombuffer(b"".join(digests), "<u8").reshape(-1, LANES), starts, axis=0)
    words, line = wordhash.word_hashes(lines)
    shingles, line = wordhash.shingle_hashes(words, line, SHINGLE)
    sketch = wordhash.sketches(shingles, np.array(owner)[line], len(texts), SKETCH).astype(np.int32)
    return [Fingerprint(s, k) for s, k in zip(strong, sketch, strict=True)]


def in_order_with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, ahead, key, hash, copies, doc_id, text), a partition per bucket of the order of (id, text hash),
    each bucket followed by the first row of the next one (``ahead``; of the first one after the last).

    Bucket borders come from a range partitioning of the ids and hashes alone: a border per shuffle partition. Each
    text is shuffled once. Repeated rows are one row with their number as ``copies``.
    """
    spark = docs.sparkSession
    rows = common.texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))
    named = rows.withColumn("row", F.xxhash64("key", "hash"))
    repeated = common.stored(named.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    rows = common.unrepeated(named, "row", repeated.select("row")).join(repeated, "row", "left").fillna(1, ["copies"]).drop("row")
    ranged = rows.select("key", "hash").repartitionByRange(common.partitions(spark), "key", "hash")
    mins = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "hash")).alias("x")).select("x.*").collect()
    borders = sorted((r["key"], r["hash"]) for r in mins)
    n = len(borders)
    if not n:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("ahead"), "key", "hash", "copies", "doc_id", "text"), 0
    border = np.array(borders, [("key", np.int64), ("hash", np.int64)])

    @F.pandas_udf("bucket int, first boolean")
    def bucket(key: pd.Series, hashed: pd.Series) -> pd.DataFrame:
        own = np.empty(len(key), border.dtype)
        own["key"], own["hash"] = key.to_numpy(), hashed.to_numpy()
        at = np.searchsorted(border, own, "right") - 1
        return pd.DataFrame({"bucket": at.astype(np.int32), "first": border[at] == own})

    place = rows.withColumn("at", bucket("key", "hash"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("at.bucket") - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("ahead"))
    dealt = place.select("key", "hash", "copies", "doc_id", "text", F.explode(F.when(F.col("at.first"), F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.bucket", "to.ahead", "key", "hash", "copies", "doc_id", "text")
    return dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "ahead", "key", "hash"), n


def compare_next(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: its last half replaced by the first of the next document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document whose next one has not come yet
        for batch in common.slices(batches, "text", 2 << 20):
            ahead, copies = batch.column("ahead").to_pylist(), batch.column("copies").to_pylist()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            prints = fingerprints([t.encode() for t in texts])
            todo = []  # (copies, id, text, fingerprint, edited text, the next one's fingerprint)
            for i, text in enumerate(texts):
                if held is not None:
                    half = len(held[1]) // 2
                    todo.append((1, *held, held[1][: len(held[1]) - half] + text[:half], prints[i]))
                held = None if ahead[i] else (ids[i], text, prints[i])
                if not ahead[i] and copies[i] > 1:
                    half = len(text) // 2
                    todo.append((copies[i] - 1, *held, text[: len(text) - half] + text[:half], prints[i]))
            if not todo:
                continue
            edited = [t[4].encode() for t in todo]
            changed = fingerprints(edited)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([t[1] for t in todo], pa.int64()),
                "n_chars": pa.array([len(t[2]) for t in todo], pa.int64()),
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [t[3].hexdigest() for t in todo],
                "edited_fingerprint": [c.hexdigest() for c in changed],
                "near_edited": [t[3].likeness(c) for t, c in zip(todo, changed, strict=True)],
                "near_next": [t[3].likeness(t[5]) for t in todo],
                "copies": pa.array([t[0] for t in todo], pa.int64()),
            })

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    found = in_order_with_next(docs)[0].mapInArrow(each, schema)
    return found.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, strong, sketch): the vectors as little-endian bytes, for later sums and differences."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            prints = fingerprints(common.as_bytes(batch, "text"))
            vectors = [pa.array([v.tobytes() for v in vs], pa.binary()) for vs in ([p.strong for p in prints], [p.sketch for p in prints])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *vectors], ["doc_id", "strong", "sketch"])

    return common.texts(docs).mapInArrow(each, "doc_id long, strong binary, sketch binary")


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(common.table(spark, sf_dir, "documents"))
