"""Packing documents into token sequences by first-fit decreasing.

Documents are tokenised, closed with an end id and cut into full sequences and one remainder. Remainders
go to random groups of about ``GROUP`` pieces; in each group, pieces in falling length take the first
sequence with room, found in a tournament tree over the sequences' free capacity. Groups are independent,
so a task holds one group's lengths only, never texts.

Nulls: a null text is an empty one (the end id alone), a null id stays null. Repeated rows are packed each
on its own. A text of any length is cut into full sequences. Further columns are not looked at, whatever their names. Ties:
remainders of equal length are taken in the order in which they were cut. Empty input gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
GROUP = 4096
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Longer texts go through ``tokenizers`` itself, whose merging of one very long word is not quadratic.
FAST_CHARS = 1 << 20
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _plain_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file, to that byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def encoder(name: str):
    """A function from a text to its ids (uint32) by the vocabulary file ``name``.

    The file's vocabulary is read as merge ranks for the faster of the installed BPE libraries; ids are
    those of ``tokenizers`` with add_special_tokens=False: no token is added, and an added token's string in a text has
    that token's id.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:  # a file of an installed package, present on each executor
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    plain = _plain_bytes()
    ranks = {bytes(plain[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cache
    def whole() -> Tokenizer:
        """Loaded for the first very long text only, as it takes much memory."""
        return Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if len(text) > FAST_CHARS:
            return np.array(whole().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Equal lengths are taken in their given order."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)  # room[1] is the winner of all bins: the largest free capacity
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, at = int(lengths[i]), 1
        while at < leaves:
            at += at
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at >>= 1
            a, b = room[2 * at], room[2 * at + 1]
            best = a if a > b else b
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: full sequences first, then the remainder if any. With ``keep_ids`` also the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([END_ID], np.uint32)
        for batch in common.slices(batches, "text"):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4", copy=False)
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].tobytes()
                    for k, v in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece), strict=True):
                        rows[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = {k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True) if keep_ids or k != "ids"}
            yield pa.RecordBatch.from_pydict(columns)

    return common.texts(docs).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence and offset. A full piece is a sequence of its own."""
    rows = common.stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full, rest = rows.filter(F.col("length") == length), rows.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("piece", F.lit(20)), F.lit(groups)))

    def fit(pdf):
        pdf = pdf.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 32) + bins, offset=offsets)[["piece", "sequence_id", "offset"]]

    lengths = rest.select("piece", "grp", "length")
    placed = lengths.groupBy("grp").applyInPandas(fit, "piece long, sequence_id long, offset long")
    done = full.withColumn("sequence_id", F.col("piece") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return rest.drop("grp").join(placed, "piece").unionByName(done)


def op4_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(pieces(common.table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
