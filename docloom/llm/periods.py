"""Periodic runs of words by internal pattern matching.

The texts of a batch are one array of word numbers, each text closed with a number of its own. Refining by doubling gives
each position a class by its first 2^k words, for each k up to the longest repeated block; a class is an interval of the suffix array.
A wavelet matrix over the suffix array answers how many occurrences of a block start in a window, and where the first ones
are (range successor). Dyadic blocks, of 2^k words at each multiple of 2^k, are asked for in the windows of distances [2^k, 2^(k+1))
beside them, the smallest blocks for shorter distances too. One or two occurrences are candidate periods; three or more are an
arithmetic progression of difference p, and then the stretches of period p about the block and about its occurrences
must end alike, which leaves their distances, and p. Each candidate is extended both ways by the classes, exactly.

A run of period q and of three periods or more holds a dyadic block of 2^k <= q < 2^(k+1) words (or the smallest block) in its
first 2^k words, whose copy one period on is in the run, so no run is missed; a multiple of a run's period gives the same
stretch and gives way to the smaller period.

Texts are read in batches of about ``BATCH`` bytes, a longer text alone: memory is some 60 bytes a word and 4 more for each
doubling of the longest repeated block. Nothing is shuffled. Nulls: a null text has no words, a null id stays null. Repeated
rows and equal texts each give a row. Ties: runs are listed by start, then period. Further columns, whatever their names, stay as they are or
are not looked at. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_LENGTH = 24
#: Runs have so many periods at least; the search relies on three.
REPEATS = 3
BATCH = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
BLANK = r"[\x20\x09-\x0D]+"


class Classes:
    """Classes of the positions of ``words`` by their first 2^k words: of each position the place in the suffix array
    where its class begins. The last word of ``words`` occurs once, as does one in or behind each block that must not be matched."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        new = np.concatenate([[True], words[order][1:] != words[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, step = [], 1
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(open_):
            self.levels.append(rank.astype(np.int32))
            key = rank[open_] * n + rank[open_ + step]
            order = np.argsort(key, kind="stable")
            at, key = open_[order], key[order]
            old, place = rank[at], np.arange(len(at))
            head = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
            rank = rank.copy()
            rank[at] = old + head - group
            open_ = at[np.bincount(head, minlength=len(at))[head] > 1]
            step += step
        self.suffixes = np.argsort(rank, kind="stable")

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            n += np.where(rank[i + n] == rank[j + n], 1 << k, 0)
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - n - (1 << k), j - n - (1 << k)
            n += np.where((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)]), 1 << k, 0)
        return n


class Wavelet:
    """A wavelet matrix of the numbers 0 to n-1 in any order; queries are whole arrays at a time."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, (len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # of each level, from the top bit: zeros before each place
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=count[1:])
            self.zeros.append(count)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places [low, high) are less than x."""
        total, over = np.zeros(len(x), np.int64), x >= self.n
        wide, x = high - low, np.where(over, 0, x)
        for level, zero in enumerate(self.zeros):
            one = x >> (self.bits - 1 - level) & 1 == 1
            a, b = zero[low], zero[high]
            total += np.where(one, b - a, 0)
            low, high = np.where(one, zero[-1] + low - a, a), np.where(one, zero[-1] + high - b, b)
        return np.where(over, wide, total)

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of places [low, high)."""
        value = np.zeros(len(k), np.int64)
        for zero in self.zeros:
            a, b = zero[low], zero[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, zero[-1] + low - a, a), np.where(one, zero[-1] + high - b, b)
            value = value * 2 + one
        return value


def _candidates(classes: Classes, tree: Wavelet, k: int, windows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from the dyadic blocks of 2^k words and their occurrences at distances in ``windows``."""
    rank, n = classes.levels[k], tree.n
    block = np.arange(0, n, 1 << k)
    low = rank[block].astype(np.int64)
    count = np.bincount(rank, minlength=n)[low]
    block, low, high = (x[count > 1] for x in (block, low, low + count))
    places, periods = [], []
    for nearest, beyond in windows:
        before = tree.below(low, high, block + nearest)
        found = tree.below(low, high, block + beyond) - before
        hit = np.flatnonzero(found)
        at, count = block[hit], found[hit]
        first = tree.nth(low[hit], high[hit], before[hit])
        places.append(at)
        periods.append(first - at)
        more = np.flatnonzero(count > 1)
        second = tree.nth(low[hit[more]], high[hit[more]], before[hit[more]] + 1)
        i, j, m, p = at[more], first[more], count[more], second - first[more]
        places.append(i[m == 2])
        periods.append((second - i)[m == 2])
        i, j, p = i[m > 2], j[m > 2], p[m > 2]
        ends = classes.ahead(j, j + p) - classes.ahead(i, i + p) + j - i
        starts = j - i - classes.behind(j, j + p) + classes.behind(i, i + p)
        places += [i, i, i]
        periods += [p, starts, ends]
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``min_length`` words and ``REPEATS`` periods at least, by start and period; period is
    a run's smallest. ``words`` is as ``Classes`` takes it."""
    none = np.zeros(0, np.int64)
    least = max(0, (min_length // 3).bit_length() - 1)
    if len(words) <= min_length:
        return none, none, none
    classes = Classes(words)
    if len(classes.levels) <= least:  # no block of the smallest size occurs twice
        return none, none, none
    tree = Wavelet(classes.suffixes)
    places, periods = [], []
    for k in range(least, len(classes.levels)):
        windows = [(1 << k, 2 << k)] if k > least else [(1, 1 << k), (1 << k, 2 << k)]
        at, period = _candidates(classes, tree, k, windows)
        places.append(at)
        periods.append(period)
    at, period = np.concatenate(places), np.concatenate(periods)
    at, period = at[period > 0], period[period > 0]
    inside = at + period < len(words)
    at, period = at[inside], period[inside]
    start, end = at - classes.behind(at, at + period), at + period + classes.ahead(at, at + period)
    keep = end - start >= np.maximum(min_length, REPEATS * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def batch_runs(texts: pa.Array, min_length: int = MIN_LENGTH) -> tuple[list[list[dict[str, int]]], pa.Array, np.ndarray]:
    """Of each text its runs, its words without the repeats of runs, joined by spaces, and the number of its words."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, owner = split.flatten(), np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # blanks at an end give an empty word
    flat, owner = flat.filter(pa.array(real)), owner[real]
    count = np.bincount(owner, minlength=len(texts))
    number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shifted = np.arange(len(flat)) + owner  # one closing number after each text
    words = np.empty(len(flat) + len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    words[first[1:] - 1] = len(flat) + np.arange(len(texts))
    words[shifted] = number
    start, end, period = find_runs(words, min_length)
    text = np.searchsorted(first, start, "right") - 1
    runs: list[list[dict[str, int]]] = [[] for _ in range(len(texts))]
    for t, s, e, q in zip(text.tolist(), (start - first[text]).tolist(), (end - first[text]).tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": e - s, "period": q})
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, end, -1)
    stay = np.cumsum(covered)[shifted] == 0
    kept = np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(texts)))]).astype(np.int32)
    return runs, pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stay))), " "), count


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, text): the runs of words of each text, by start and period, and the text's words without
    what each run holds after its first period, joined by one space."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", BATCH):
            runs, left, count = batch_runs(batch.column("text"), min_length)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(runs, kinds), left], ["doc_id", "n_words", "runs", "text"])

    return common.texts(docs).mapInArrow(each, f"doc_id long, n_words long, runs {RUNS}, text string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first; null without runs."""
    none = F.lit(None).cast(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    more = lambda best, run: best["length"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.reduce(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document, by crc32 of its id, the words from some place on repeat the first ones there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = common.texts(docs).withColumn("h", h)
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int"))
    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, a tenth of them with a planted one."""
    found = with_runs(planted(common.table(spark, sf_dir, "documents"))).withColumn("top", most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
