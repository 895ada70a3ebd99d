"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Counting: the counts of all training words, over the whole corpus, are a table. The model's outputs are a text end, the
``VOCABULARY`` most frequent words and ``TAILS`` classes, by their last bytes, of all other words. A word of a class
has the class's probability after its context, times its share of the class by smoothed counts, so that every
word has a score of its own and texts get whole probabilities.

Training: an output's score after two others is (q1[w1] + q2[w2]) . r[w] + b[w], b starting as the log frequency.
Each shard, of about ``SHARD_TOKENS`` tokens, makes one pass of stochastic gradient steps on the noise-contrastive
objective, against noise words drawn from the frequencies and shared by a batch; the shards' parameters are
averaged, weighted by their tokens. All training documents take part.

Scoring: with E1 = exp(q1 r') and E2 = exp(q2 r' + b), the normaliser of every context pair is an entry of the
matrix product E1 E2', made once a worker, so that log-probabilities are normalised. The counts of the most
frequent words, ``HEAD`` or so, reach each task; rarer words are joined to the count table by word.

Nulls: a null text is an empty one (its end alone); a null id counts as the empty text in the fold. Repeated rows
are counted and scored each on its own. Texts of any length are read whole. Further columns are not looked at,
whatever their names. A corpus without training rows scores every known count as zero. Empty input gives an empty
result.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
HEAD = 32768
VOCABULARY = 2046
TAILS, SUFFIX = 1024, 3
SHARD_TOKENS = 8_000_000
DIMENSIONS = 24
NOISE = 32
BATCH = 4096
RATE = 0.1
FLUSH = 300_000
#: Outputs: the text end, the classes from 1 on, the words from FIRST on.
END, FIRST = 0, 1 + TAILS


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased A-Z, divided at 0x20 and 0x09-0x0D: what ``bytes`` methods do."""
    return text.lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): the count of every word, and of text ends under the null word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes | None] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in common.slices(batches, "text"):
            for text in common.as_bytes(batch, "text"):
                held.update(words_of(text))
            held[None] += batch.num_rows
            if len(held) >= FLUSH:
                yield rows()
        if held:
            yield rows()

    return train.select("text").mapInArrow(each, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_of(word: bytes) -> int:
    """The class of a word that is no output of its own."""
    return 1 + zlib.crc32(word[-SUFFIX:]) % TAILS


@dataclass(frozen=True)
class Counts:
    """What the driver keeps of the count table: totals, the words of the head with their counts, and for each class
    the tokens and distinct words of those that are no outputs."""

    tokens: int
    kinds: int
    ends: int
    words: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray

    @property
    def known(self) -> int:
        return min(VOCABULARY, len(self.words))

    @property
    def outputs(self) -> int:
        return FIRST + self.known

    @property
    def tail_mass(self) -> np.ndarray:
        """Smoothed counts of the words of each class, and one for any unseen word."""
        return self.tail_tokens + self.tail_kinds + 1

    @property
    def frequency(self) -> np.ndarray:
        c = np.concatenate([[self.ends], self.tail_tokens, self.counts[: self.known]]) + 1.0
        return c / c.sum()


def head_of(counts: DataFrame, head: int = HEAD) -> Counts:
    """Totals, classes, and about ``head`` words of the highest counts.

    Counts are taken by classes of one percent, so that neither the class sizes nor the words that reach the
    driver grow with the corpus or its partitions; of the class that exceeds ``head``, as many words as are missing
    are taken by their hashes.
    """
    total = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    words = counts.filter("word is not null").withColumn("level", F.floor(F.ln("c") * 100).cast("int"))
    held, whole, part = 0, F.lit(False), F.lit(False)
    for level, n in sorted(((r["level"], r["count"]) for r in words.groupBy("level").count().collect()), reverse=True):
        if held + n > head:
            part = (F.col("level") == level) & (F.pmod(F.xxhash64("word"), F.lit(n)) < head - held)
            break
        held, whole = held + n, F.col("level") >= level
    top = words.filter(whole | part).select("word", "c").collect()
    top = sorted((-r["c"], r["word"].encode()) for r in top)
    suffix = F.substring(F.col("word").cast("binary"), -SUFFIX, SUFFIX)
    tails = words.groupBy((F.crc32(suffix) % TAILS).alias("tail")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # TAILS rows
    tail_tokens, tail_kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in tails:
        tail_tokens[r["tail"]], tail_kinds[r["tail"]] = r["c"], r["n"]
    for c, w in top[:VOCABULARY]:  # outputs of their own
        tail_tokens[tail_of(w) - 1] += c
        tail_kinds[tail_of(w) - 1] -= 1
    return Counts(total["tokens"] or 0, total["kinds"], total["ends"] or 0, [w for _, w in top], np.array([-c for c, _ in top], np.int64), tail_tokens, tail_kinds)


def outputs_of(words: list[list[bytes]], place: np.ndarray, known: int) -> np.ndarray:
    """The output of each word; ``place`` is its place in the head or -1, and the first ``known`` are outputs."""
    out = place + FIRST
    tail = np.flatnonzero((place < 0) | (place >= known))
    flat = [w for ws in words for w in ws] if len(tail) else []
    out[tail] = [tail_of(flat[i]) for i in tail.tolist()]
    return out


@dataclass
class Parameters:
    q1: np.ndarray
    q2: np.ndarray
    r: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(frequency: np.ndarray, dimensions: int = DIMENSIONS) -> Parameters:
        random = np.random.default_rng(1)
        q1, q2, r = (random.normal(0, 0.1, (len(frequency), dimensions)).astype(np.float32) for _ in range(3))
        return Parameters(q1, q2, r, np.log(frequency).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.q1.ravel(), self.q2.ravel(), self.r.ravel(), self.b])

    @staticmethod
    def of(flat: np.ndarray, outputs: int, dimensions: int = DIMENSIONS) -> Parameters:
        n = outputs * dimensions
        return Parameters(*(flat[i * n : (i + 1) * n].reshape(outputs, dimensions) for i in range(3)), flat[3 * n :])


def _add_rows(to: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """to[index] += values, where an index may occur again."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    to[index[first]] += np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Stochastic steps on the noise-contrastive objective, with per-parameter step sizes (Adagrad)."""

    def __init__(self, start: Parameters, frequency: np.ndarray, seed: int = 3) -> None:
        self.p = Parameters(*(x.copy() for x in (start.q1, start.q2, start.r, start.b)))
        self.squares = [np.full_like(x, 1e-6) for x in (self.p.q1, self.p.q2, self.p.r, self.p.b)]
        self.cumulated, self.random = np.cumsum(frequency), np.random.default_rng(seed)
        self.offset = np.log(NOISE * frequency).astype(np.float32)

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE)), len(p.b) - 1)
        h, out, against = p.q1[w1] + p.q2[w2], p.r[w], p.r[noise]
        true = np.einsum("ij,ij->i", h, out) + p.b[w] - self.offset[w]
        false = h @ against.T + (p.b - self.offset)[noise]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        grads = [np.zeros_like(x) for x in (p.q1, p.q2, p.r, p.b)]
        dh = up[:, None] * out + down @ against
        _add_rows(grads[0], w1, dh)
        _add_rows(grads[1], w2, dh)
        _add_rows(grads[2], w, up[:, None] * h)
        np.add.at(grads[2], noise, down.T @ h)
        grads[3] += np.bincount(w, up, len(p.b)).astype(np.float32)
        np.add.at(grads[3], noise, down.sum(axis=0))
        for x, g, s in zip((p.q1, p.q2, p.r, p.b), grads, self.squares, strict=True):
            g /= len(w)
            s += g * g
            x += RATE * g / np.sqrt(s)


def contexts(index: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w1, w2, w, text) of every token of texts whose words' outputs are ``index``: ``texts`` has the number
    of words of each. Each text is followed by its end; ends stand before its first word."""
    n = len(texts)
    ends = np.cumsum(texts + 3) - 1  # two ends before, one after
    stream = np.full(int((texts + 3).sum()), END, np.int64)
    inside = np.ones(len(stream), bool)
    inside[ends] = False
    inside[ends - texts - 1] = inside[ends - texts - 2] = False
    stream[inside] = index
    inside[ends] = True
    at = np.flatnonzero(inside)
    return stream[at - 1], stream[at - 2], stream[at], np.repeat(np.arange(n), texts + 1)


def train(docs: DataFrame, counts: Counts) -> Parameters:
    """Parameters averaged over shards of (text); each shard sends its parameters once."""
    frequency, outputs, known = counts.frequency, counts.outputs, counts.known
    start = Parameters.start(frequency)
    places = {w: i for i, w in enumerate(counts.words[:known])}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, get, seen = Trainer(start, frequency), places.get, 0
        for batch in common.slices(batches, "text", 1 << 20):
            words = [words_of(t) for t in common.as_bytes(batch, "text")]
            lengths = np.array([len(w) for w in words])
            place = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, int(lengths.sum()))
            w1, w2, w, _ = contexts(outputs_of(words, place, known), lengths)
            for at in range(0, len(w), BATCH):
                trainer.step(w1[at : at + BATCH], w2[at : at + BATCH], w[at : at + BATCH])
            seen += len(w)
        if seen:
            flat = trainer.p.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], ["i", "v", "n"])

    shards = docs.select("text").coalesce(max(1, -(-counts.tokens // SHARD_TOKENS)))
    mean = shards.mapInArrow(each, "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
    found = mean.toArrow()  # as many rows as the model has parameters
    if not found.num_rows:
        return start
    flat = np.zeros(found.num_rows, np.float32)
    flat[found["i"].to_numpy()] = found["v"].to_numpy()
    return Parameters.of(flat, outputs)


@functools.lru_cache(maxsize=1)
def _normalisers(flat: bytes, outputs: int) -> np.ndarray:
    """The natural logarithm of the normaliser of each pair of first and second context, by blocks of the product."""
    p = Parameters.of(np.frombuffer(flat, np.float32), outputs)
    two = p.q2 @ p.r.T
    two += p.b
    top2 = two.max(axis=1, keepdims=True)
    np.exp(np.subtract(two, top2, out=two), out=two)
    z = np.empty((outputs, outputs), np.float32)
    for at in range(0, outputs, 512):
        one = p.q1[at : at + 512] @ p.r.T
        top1 = one.max(axis=1, keepdims=True)
        block = np.exp(one - top1) @ two.T
        z[at : at + 512] = np.log(np.maximum(block, 1e-30)) + top1 + top2.T
    return z


def log_probabilities(p: Parameters, z: np.ndarray, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 of each output's probability after its two contexts."""
    out = np.empty(len(w))
    for at in range(0, len(w), 1 << 16):
        a, b, c = (x[at : at + (1 << 16)] for x in (w1, w2, w))
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", p.q1[a] + p.q2[b], p.r[c]) + p.b[c] - z[a, b]
    return out / np.log(10)


def scored(docs: DataFrame, counts: Counts, table: DataFrame, p: Parameters) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, n_known, base_score, score) of (doc_id, text, held_out)."""
    flat, outputs, own = p.flat().astype(np.float32).tobytes(), counts.outputs, counts.known
    known = {w: i for i, w in enumerate(counts.words)}
    log_count = np.log10(counts.counts + 1.0)
    total, mass = np.log10(counts.tokens + counts.kinds + 1.0), np.log10(counts.tail_mass)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, get = _normalisers(flat, outputs), known.get
        model = Parameters.of(np.frombuffer(flat, np.float32), outputs)
        logs = np.append(log_count, 0.0)  # the last for words outside the head, whose counts are joined later
        for batch in common.slices(batches, "text", 2 << 20):
            words = [words_of(t) for t in common.as_bytes(batch, "text")]
            lengths, n = np.array([len(w) for w in words]), len(words)
            place = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(n), lengths)
            outside = place < 0
            base = np.bincount(owner, logs[place], n) + np.log10(counts.ends + 1.0) - (lengths + 1) * total
            index = outputs_of(words, place, own)
            w1, w2, w, text = contexts(index, lengths)
            score = np.bincount(text, log_probabilities(model, z, w1, w2, w), n)
            in_tail = index < FIRST
            score += np.bincount(owner[in_tail], logs[place[in_tail]] - mass[index[in_tail] - 1], n)
            tails = [[] for _ in range(n)]
            ends = np.cumsum(lengths)
            for i in np.unique(owner[outside]).tolist():
                rest = outside[ends[i] - lengths[i] : ends[i]]
                tails[i] = [{"word": k.decode(), "n": v} for k, v in Counter([words[i][j] for j in np.flatnonzero(rest).tolist()]).items()]
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
            n_known = np.bincount(owner[~outside], minlength=n) + (counts.ends > 0)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:string,n:long>>"
    rows = common.stored(docs.mapInArrow(each, schema).withColumn("uid", F.monotonically_increasing_id()), "scored")
    found = rows.select("uid", F.inline("tail")).join(table.filter("word is not null"), "word")
    found = found.groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("log", F.lit(0.0))
    joined = rows.drop("tail").join(found, "uid", "left")
    return joined.select("uid", "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents")).withColumn("held_out", common.fold_of("doc_id", FOLDS) == HELD_OUT)
    training = docs.filter(~F.col("held_out"))
    table = common.stored(word_counts(training), "counts")
    counts = head_of(table)
    found = scored(docs, counts, table, train(training, counts))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
