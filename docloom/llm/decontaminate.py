"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (A-Z lower-cased, ASCII punctuation and white space runs as one space). An
item of n bytes allows ``RATE`` * n edits; it is split into one piece more than that, so that any passage
within the budget holds a piece unchanged. A piece's first ``GRAM`` bytes are looked up at every place of a text, a
batch of texts at a time: by a bit table, then in the sorted grams, then by the piece's last bytes. Myers'
bit-parallel distance verifies the passages around the pieces found: those of an item that overlap in a text are one
passage, verified in one pass, so that a text that repeats an item's words costs no more than its length.

The index of pieces takes a few bytes for each byte of the items; one pass over the documents serves
``BLOCK_BYTES`` of distinct items, a larger benchmark takes a pass for each block. Items of equal normalised text are
one, their ids are joined to the matches.

Nulls: a null text is an empty one; items without a word are left out; null ids stay null. Items under 1 / ``RATE``
bytes have a budget of no edit: they match unchanged, as whole words. Repeated rows each give their matches, of
documents and of items. Texts and items of any length are read whole. Further columns are not looked at, whatever
their names. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

RATE = 0.05
GRAM = 10
BITS = 22
BLOCK_BYTES = 32 << 20
#: Pieces found that are held at once, before those of one alignment become one.
HITS = 1 << 20

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """Words and one space around each."""
    words = text.translate(_PLAIN).split()
    return b" ".join([b"", *words, b""]) if words else b""


def budget(n: int) -> int:
    """Edits that an item of ``n`` bytes allows. Its pieces then have ``GRAM`` bytes at least, or are the whole item."""
    return int(RATE * n)


def edit_distance_within(pattern: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of ``pattern`` to any part of ``text``, if at most ``most``: Myers' bit
    vectors, a Python integer of as many bits as the pattern has bytes."""
    m = len(pattern)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        xv = e | minus
        xh = (((e & plus) + plus) ^ plus) | e
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
    return best if best <= most else None


def _eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number; what is beyond the end is zero."""
    padded = np.frombuffer(buffer + bytes(16), np.uint8)
    return np.ndarray((len(buffer) + 8,), "<u8", padded, strides=(1,)).copy()


def _grams(eights: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A hash of the ``size`` (8 to 16) bytes, or of fewer than 8, at each place."""
    first = eights[at]
    if size < 8:
        return wordhash.mixed((first & np.uint64((1 << 8 * size) - 1)) + np.uint64(size))
    last = eights[size - 8 :][at]
    return wordhash.mixed(first * np.uint64(0x9E3779B97F4A7C15) + last)


@dataclass(frozen=True)
class Table:
    """The pieces that are looked up by ``size`` bytes, in the order of their grams."""

    size: int
    bits: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    start: np.ndarray  # of the piece in its item
    length: np.ndarray
    tail: np.ndarray  # the last bytes of the piece, eight or as many as the gram has


@dataclass(frozen=True)
class Index:
    """Normalised items and the tables of their pieces."""

    items: list[bytes]
    keys: list[int]
    tables: list[Table]

    @staticmethod
    def of(items: list[bytes], keys: list[int]) -> Index:
        item, start, length = [], [], []
        for i, text in enumerate(items):
            k = budget(len(text)) + 1
            cuts = np.arange(k + 1) * len(text) // k
            item.append(np.full(k, i))
            start.append(cuts[:-1])
            length.append(np.diff(cuts))
        item, start, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (item, start, length))
        where = np.cumsum([0, *(len(t) for t in items)])
        eights, gram = _eights(b"".join(items)), np.minimum(length, GRAM)
        tables = []
        for size in np.unique(gram).tolist():
            own = np.flatnonzero(gram == size)
            at = where[item[own]] + start[own]
            grams = _grams(eights, at, size)
            order = np.argsort(grams, kind="stable")
            own, grams = own[order], grams[order]
            wide = min(8, size)
            tail = eights[where[item[own]] + start[own] + length[own] - wide] & np.uint64((1 << 8 * wide) - 1)
            bits = np.zeros(1 << BITS, bool)
            bits[grams >> np.uint64(64 - BITS)] = True
            tables.append(Table(size, bits, grams, item[own].astype(np.int32), start[own].astype(np.int32), length[own].astype(np.int32), tail))
        return Index(items, keys, tables)

    def found(self, buffer: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, start) of pieces found in ``buffer``, about ``HITS`` at a time. A piece longer than its gram and last
        bytes may differ between them."""
        eights = _eights(buffer)
        for table in self.tables:
            hashed = _grams(eights, slice(0, len(eights) - 8), table.size)
            places = np.flatnonzero(table.bits[hashed >> np.uint64(64 - BITS)])
            lows, highs = np.searchsorted(table.grams, hashed[places], "left"), np.searchsorted(table.grams, hashed[places], "right")
            hits = np.cumsum(highs - lows)
            cuts = np.searchsorted(hits, np.arange(0, hits[-1] + HITS, HITS)) if len(hits) else []
            for i, j in zip([0, *cuts], [*cuts, len(places)], strict=True):
                low, count = lows[i:j], highs[i:j] - lows[i:j]
                row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(places[i:j], count)
                wide = min(8, table.size)
                last = place + table.length[row] - wide
                inside = last < len(eights)
                row, place, last = row[inside], place[inside], last[inside]
                same = eights[last] & np.uint64((1 << 8 * wide) - 1) == table.tail[row]
                row, place = row[same], place[same]
                if len(row):
                    yield place, table.item[row].astype(np.int64), table.start[row]

    def windows(self, texts: list[bytes], buffer: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): the parts of ``buffer``, ``texts`` with a zero byte after each, in which a piece stands so that
        the item could lie there within its budget. Those of one item that overlap are one, so a text is covered once by
        the windows of an item, however often its pieces are found."""
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        size = np.array([len(t) for t in self.items], np.int64)
        spare = np.array([budget(n) for n in size.tolist()], np.int64)
        span = len(buffer) + 1
        lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, item, start in self.found(buffer):
            owner = np.searchsorted(begin, place, "right") - 1
            first = place - start
            low = np.maximum(first - spare[item], begin[owner]) + item * span
            high = np.minimum(first + size[item] + spare[item], begin[owner + 1] - 1) + item * span
            low, high = _spans(low, high)
            lows.append(low)
            highs.append(high)
        low, high = _spans(np.concatenate(lows), np.concatenate(highs))
        if not len(low):
            return
        reach = np.maximum.accumulate(high)
        new = np.concatenate([[True], low[1:] > reach[:-1]])
        head = np.flatnonzero(new)
        low, high = low[head], np.maximum.reduceat(high, head)
        item = low // span
        low, high = low - item * span, high - item * span
        owner = np.searchsorted(begin, low, "right") - 1
        yield from zip(owner.tolist(), item.tolist(), low.tolist(), high.tolist(), strict=True)

    def matches(self, texts: list[bytes], one: bool = False) -> list[dict[int, int]]:
        """For each normalised text the least edits by which each item was found, of those within their budget; with ``one``
        no more than one item of a text, and any edits within the budget.

        An item's windows in a text are disjoint, and Myers' distance passes over each once: time grows with the text.
        """
        out: list[dict[int, int]] = [{} for _ in texts]
        buffer = b"\x00".join([*texts, b""])
        for owner, i, low, high in self.windows(texts, buffer):
            found, item = out[owner], self.items[i]
            if found.get(i) == 0 or (one and found):
                continue
            if buffer.find(item, low, high) >= 0:
                found[i] = 0
                continue
            k = budget(len(item)) if i not in found else found[i] - 1
            if k and (d := edit_distance_within(item, buffer[low:high], k)) is not None:
                found[i] = d
        return out


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different ``low`` in order, with its largest ``high``."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[head], np.maximum.reduceat(high, head) if len(head) else high


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, key, item): each item's normalised text and its hash; items without a word are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([normalised(t) for t in common.as_bytes(batch, "text")], pa.binary())], ["item_id", "item"])

    rows = common.texts(benchmark, item_id, text).select(F.col("doc_id").alias("item_id"), "text").mapInArrow(each, "item_id long, item binary")
    rows = rows.filter(F.length("item") > 0)
    return common.stored(rows.select("item_id", F.xxhash64("item").alias("key"), "item"), "items")


def indexes(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """An index for each block of about ``block_bytes`` of distinct items."""
    distinct = common.stored(items.groupBy("key").agg(F.first("item").alias("item")), "distinct")
    size = distinct.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("b")).first()["b"]
    n = -(-size // block_bytes)
    for block in range(n):
        rows = sorted((r["key"], bytes(r["item"])) for r in distinct.filter(F.pmod("key", F.lit(n)) == block).collect())
        yield Index.of([t for _, t in rows], [k for k, _ in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits): each document and item that share a passage within the item's budget."""
    rows, items = common.texts(docs), items_of(benchmark)
    out = rows.select("doc_id", F.lit(0).cast("long").alias("key"), F.lit(0).alias("edits")).filter("false")
    for index in indexes(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # a few times block_bytes

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in common.slices(batches, "text"):
                found = own.matches([normalised(t) for t in common.as_bytes(batch, "text")])
                hits = [(doc, own.keys[i], d) for doc, each in zip(batch.column("doc_id").to_pylist(), found, strict=True) for i, d in each.items()]
                columns = list(zip(*hits, strict=True)) if hits else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "key", "edits"])

        out = out.unionByName(rows.mapInArrow(find, "doc_id long, key long, edits int"))
    return out.join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay as they are."""
    for index in indexes(items_of(benchmark), block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in common.slices(batches, "text"):
                yield batch.filter(pa.array([not x for x in own.matches([normalised(t) for t in common.as_bytes(batch, "text")], one=True)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
