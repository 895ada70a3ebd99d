"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Training works on labelled sentences. Those of clean documents are labelled clean; of a toxic document, the sentences
that hold one of the words that set toxic documents apart are labelled toxic, the others are left out. A sentence is a
bag of strings, its words: the machine is a multiple-instance one, a sentence's margin being that of its worst word. In
each round the worst word of each toxic sentence is its witness, and the squared-hinge machine separates witnesses
from the words of clean sentences, those that score highest among them; the next round takes new witnesses.

The kernel of two words is the gap-weighted count of their common subsequences of three letters (weight ``DECAY`` per
letter spanned), normalised; words stand in Nyström landmarks, half of them witnesses. As the kernel is a product of
subsequence weights, the machine folds into one table over letter triples: a word's margin is the weighted sum of the
table over its triples. Inserted characters and gaps only lower some weights. A text scores by its worst words through
a logistic curve fitted on the training documents, without those whose label its text contradicts.

Words are the letters between white space: digits and punctuation in between are dropped ("i.d.i.o.t"), runs of three
or more single letters are read as a word too, and longer words are read in overlapping windows.

Only a bounded sample of labelled rows reaches the driver for fitting: in hash order of their ids, ``SAMPLE`` documents
of each class at most, and of these, in the same order, all that fit into ``SAMPLE_BYTES`` / 2 of text a class. Every
document is scored whole. Nulls: a null text is an empty one, a null label or an unlabelled document is not trained on,
a null id counts as the empty text in the fold. Repeated rows score alike; of several texts of a labelled id the
smallest is trained on, and of several labels the largest. Empty texts get the lowest score the curve gives. Without both
classes in the training rows every score is 0. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 3, 1
DECAY = 0.7
LANDMARKS = 128
MARKS = 400
MARKS_EACH = 3
SAMPLE = 1500
SAMPLE_BYTES = 8 << 20
NEGATIVES = 6000
VARIANTS = 4
MINED = 1500
WIDTH = 16
THRESHOLD = 0.7
WORST = 3
LIFT = 2.4
#: Letters a-z, and 32 codes for the low bits of the bytes that follow in longer code points; these bits
#: are the same for capital and small accented Latin letters, and differ between those letters.
LETTERS = 26 + 32
ROUNDS = 4
TRIM = 0.15
_DROP, _GAP = -1, -2

_CODES = np.full(256, _DROP, np.int8)
for _b in range(26):
    _CODES[97 + _b] = _CODES[65 + _b] = _b
for _b in range(0x80, 0xC0):
    _CODES[_b] = 26 + (_b & 31)
_CODES[[9, 10, 11, 12, 13, 32]] = _GAP


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes [n, WIDTH] padded with -1, length, text, sentence) of every word window of the texts. Sentences end at line
    ends and at one of ``.!?`` before white space; they are numbered throughout."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    codes = _CODES[buffer]
    ends = buffer == 10
    ends[:-1] |= np.isin(buffer[:-1], (33, 46, 63)) & (codes[1:] == _GAP)
    number = np.cumsum(ends)
    kept = np.flatnonzero(codes != _DROP)
    codes = codes[kept]
    letter = np.concatenate([[False], codes >= 0, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[::2], edge[1::2]
    text, sentence = np.searchsorted(offsets, kept[start], "right") - 1, number[kept[start]]
    size = end - start
    if len(start):
        single = np.concatenate([[False], (size == 1) & (codes[start] < 26), [False]])
        runs = np.flatnonzero(single[1:] != single[:-1])
        spelled = [
            (codes[start[g]], text[g[0]], sentence[g[0]])
            for a, b in zip(runs[::2], runs[1::2], strict=True)
            if b - a >= 3
            for g in np.split(np.arange(a, b), np.flatnonzero(np.diff(text[a:b])) + 1)
            if len(g) >= 3
        ]
        if spelled:
            letters, owners, within = zip(*spelled, strict=True)
            begin = len(codes) + np.cumsum([0, *(len(c) for c in letters[:-1])])
            codes = np.concatenate([codes, *letters])
            start, size = np.concatenate([start, begin]), np.concatenate([size, [len(c) for c in letters]])
            text, sentence = np.concatenate([text, owners]), np.concatenate([sentence, within])
    long = np.flatnonzero(size > WIDTH)
    if len(long):
        extra = [(start[i] + at, min(WIDTH, size[i] - at), text[i], sentence[i]) for i in long for at in range(WIDTH // 2, size[i] - WIDTH // 2, WIDTH // 2)]
        old = (start, np.minimum(size, WIDTH), text, sentence)
        start, size, text, sentence = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip(old, zip(*extra, strict=True), strict=True))
    out = np.full((len(start), WIDTH), -1, np.int8)
    for k in range(WIDTH):
        rows = np.flatnonzero(size > k)
        out[rows, k] = codes[start[rows] + k]
    return out, size, text, sentence


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the distinct rows, and for each row which of them it equals."""
    halves = np.ascontiguousarray(codes).view(np.uint64).reshape(-1, 2)
    key = halves[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + halves[:, 1] * np.uint64(0x94D049BB133111EB)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse


def self_kernel(codes: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """K(s, s) for rows of one length: weighted prefix sums of letter matches, as batched matrix products."""
    n = codes.shape[1]
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(decay**2)
    i = np.arange(n)
    fade = np.where(i[:, None] >= i, decay ** np.maximum(i[:, None] - i, 0), 0).astype(np.float32)
    inner = same
    for _ in range(2):
        prefix = fade @ inner @ fade.T
        inner = np.zeros_like(same)
        inner[:, 1:, 1:] = same[:, 1:, 1:] * prefix[:, :-1, :-1]
    return inner.sum(axis=(1, 2))


def triples(codes: np.ndarray, decay: float = DECAY) -> Iterator[tuple[np.ndarray, float]]:
    """(table index, weight) of each letter triple of rows of one length."""
    wide = codes.astype(np.int32)
    n = wide.shape[1]
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            pair = (wide[:, i] * LETTERS + wide[:, j]) * LETTERS
            for k in range(j + 1, n):
                yield pair + wide[:, k], decay ** (k - i + 1)


def embedded(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence weights [words, k], and the k table indexes that occur in the words."""
    found = [(rows, index, weight) for n in np.unique(size[size >= 3]) for rows in [np.flatnonzero(size == n)] for index, weight in triples(codes[rows, :n])]
    seen = np.unique(np.concatenate([np.zeros(0, np.int32), *(index for _, index, _ in found)]))
    out = np.zeros((len(codes), len(seen)), np.float32)
    for rows, index, weight in found:
        out[rows, np.searchsorted(seen, index)] += np.float32(weight)  # a row occurs once
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-12), seen


def inserted(codes: np.ndarray, size: np.ndarray, each: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Variants of words with one random letter put in, as further positives; words of full width have none."""
    random, rows = np.random.default_rng(11), []
    for word in (list(c[:n]) for c, n in zip(codes, size, strict=True) if 4 <= n < WIDTH):
        for _ in range(each):
            at = int(random.integers(1, len(word)))
            rows.append([*word[:at], int(random.integers(0, 26)), *word[at:]])
    out = np.full((len(rows), WIDTH), -1, np.int8)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out, np.array([len(r) for r in rows], np.int64)


def spread(phi: np.ndarray, most: int) -> np.ndarray:
    """Rows that between them stand for all: pivots of an incomplete Cholesky decomposition."""
    left, basis, picked = np.ones(len(phi)), np.zeros((0, phi.shape[1]), np.float32), []
    while len(picked) < min(most, len(phi)) and left.max() > 1e-3:
        picked.append(i := int(np.argmax(left)))
        new = phi[i] - (phi[i] @ basis.T) @ basis
        basis = np.vstack([basis, new / np.linalg.norm(new)])
        left = left - (phi @ basis[-1]) ** 2
        left[picked] = -1
    return np.array(picked, np.int64)


@dataclass(frozen=True)
class Model:
    """table: the folded machine; a text scores by the logistic ``weights`` of its ``margins``."""

    table: np.ndarray
    bias: float
    weights: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: its ``WORST`` largest word margins, the logarithm of its number of words, and 1. Words
        that a text lacks count as empty ones."""
        worst, n = np.full((len(texts), WORST), self.bias), np.zeros(len(texts))
        codes, size, text, _ = words_of(texts)
        if len(codes):
            first, inverse = distinct(codes)
            value = self.word_margins(codes[first], size[first])[inverse]
            high = np.flatnonzero(value > self.bias)
            high = high[np.lexsort((-value[high], text[high]))]
            place = np.arange(len(high)) - np.searchsorted(text[high], text[high])
            top = place < WORST
            worst[text[high[top]], place[top]] = value[high[top]]
            n = np.bincount(text, minlength=len(texts))
        return np.column_stack([worst, np.log1p(n) / 10, np.ones(len(texts))])

    def word_margins(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = np.full(len(codes), self.bias)
        for n in range(3, WIDTH + 1):
            rows = np.flatnonzero(size == n)
            for part in (rows[i : i + 8192] for i in range(0, len(rows), 8192)):
                own = codes[part, :n]
                raw = np.zeros(len(part), np.float32)
                for index, weight in triples(own):
                    raw += self.table[index] * np.float32(weight)
                value[part] += raw / np.sqrt(self_kernel(own))
        return value

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.weights, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps, classes weighted alike."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x1.shape[1])
    ridge = penalty * np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge, xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], w[-1]


def curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, trim: float = TRIM) -> np.ndarray:
    """Logistic weights by damped Newton steps, with a small ridge. Twice more without the documents whose own label
    has a probability under ``trim``: labels that contradict their texts would flatten the curve."""
    kept = np.ones(len(x), bool)
    for _ in range(3):
        w, own, label = np.zeros(x.shape[1]), x[kept], toxic[kept]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), own.T @ (label - p) - ridge * w)
            w = w + np.clip(step, -3, 3)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        kept = np.where(toxic > 0, p, 1 - p) >= trim
        if toxic[kept].all() or not toxic[kept].any():
            break
    return w


@dataclass(frozen=True)
class Bags:
    """The sentences of labelled documents as bags of their distinct words."""

    codes: np.ndarray  # of each distinct word
    size: np.ndarray
    word: np.ndarray  # of each place: a word in a sentence of a document
    sentence: np.ndarray
    doc: np.ndarray


def bags_of(texts: list[bytes]) -> Bags:
    held, before = [], 0
    for at in range(0, len(texts), 100):  # a few texts at a time
        codes, size, text, sentence = words_of(texts[at : at + 100])
        usable = size >= 3
        codes, size, text, sentence = codes[usable], size[usable], text[usable], sentence[usable]
        first, inverse = distinct(codes)
        place = np.unique(np.stack([sentence, inverse.astype(np.int64), text], axis=1), axis=0) if len(codes) else np.zeros((0, 3), np.int64)
        held.append((codes[first[place[:, 1]]], size[first[place[:, 1]]], place[:, 0] + before, place[:, 2] + at))
        before += int(sentence.max()) + 1 if len(sentence) else 0
    codes, size, sentence, doc = (np.concatenate(x) for x in zip(*held, strict=True))
    first, word = distinct(codes)
    return Bags(codes[first], size[first], word, sentence, doc)


def marks_of(bags: Bags, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, in clean): the words that occur in toxic documents far more often than by chance, strongest first, and
    the number of clean documents that hold each word."""
    pairs = np.unique(bags.word.astype(np.int64) * len(toxic) + bags.doc)
    word, doc = np.divmod(pairs, len(toxic))
    in_toxic = np.bincount(word[toxic[doc] > 0], minlength=len(bags.size))
    in_clean = np.bincount(word[toxic[doc] == 0], minlength=len(bags.size))
    expected = toxic.sum() * (in_toxic + in_clean) / len(toxic)
    lift = (in_toxic - expected) / np.sqrt(expected + 1)
    marks = np.flatnonzero((in_toxic >= 2) & (in_toxic > 4 * (in_clean + 0.25) * toxic.sum() / (len(toxic) - toxic.sum())))
    marks = marks[np.argsort(-lift[marks], kind="stable")]
    if len(marks):  # marks far weaker than the strongest are chance
        marks = marks[lift[marks] >= max(LIFT, 0.1 * lift[marks[0]])]
    return marks, in_clean


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """The machine from whole texts and their labels."""
    none = Model(np.zeros(LETTERS**3, np.float32), 0.0, np.array([*[0.0] * (WORST + 1), -30.0]))
    if not toxic.any() or toxic.all():
        return none
    bags = bags_of(texts)
    marks, in_clean = marks_of(bags, toxic)
    if not len(marks):
        return none
    # Sentences labelled toxic, and of each document's the strongest marks as the first witnesses.
    rank = np.full(len(bags.size), len(bags.size))
    rank[marks] = np.arange(len(marks))
    hit = np.flatnonzero((toxic[bags.doc] > 0) & (rank[bags.word] < len(bags.size)))
    labelled = np.isin(bags.sentence, bags.sentence[hit])
    hit = hit[np.lexsort((rank[bags.word[hit]], bags.doc[hit]))]
    place = np.arange(len(hit)) - np.searchsorted(bags.doc[hit], bags.doc[hit])
    witnesses = marks[np.unique(rank[bags.word[hit[place < MARKS_EACH]]])][:MARKS]
    clean = np.flatnonzero(in_clean > 0)
    order = clean[np.argsort(-in_clean[clean], kind="stable")]
    shuffled = np.random.default_rng(7).permutation(clean)
    negatives = np.unique(np.concatenate([order[: NEGATIVES // 2], shuffled[: NEGATIVES // 2]]))

    marked = embedded(bags.codes[witnesses], bags.size[witnesses])[0]
    pool = np.concatenate([witnesses[spread(marked, LANDMARKS // 2)], order[: LANDMARKS // 4], shuffled[: LANDMARKS // 4]])
    phi, seen = embedded(bags.codes[pool], bags.size[pool])
    columns = np.vstack([phi.T, np.zeros((1, len(pool)), np.float32)])
    column = np.full(LETTERS**3, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    def features(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(pool)), np.float32)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            own = codes[rows, :n]
            raw = np.zeros((len(rows), len(pool)), np.float32)
            for index, weight in triples(own):
                raw += columns[column[index]] * np.float32(weight)
            out[rows] = raw / np.sqrt(self_kernel(own))[:, None]
        return out.astype(np.float64) @ root

    in_toxic_sentence = np.flatnonzero(labelled & (toxic[bags.doc] > 0) & (in_clean[bags.word] == 0))
    negative = features(bags.codes[negatives], bags.size[negatives])
    for turn in range(ROUNDS):
        own = bags.codes[witnesses], bags.size[witnesses]
        positive = np.concatenate([features(*own), features(*inserted(*own))])
        x = np.concatenate([positive, negative])
        w, bias = svm(x, np.where(np.arange(len(x)) < len(positive), 1.0, -1.0))
        table = np.zeros(LETTERS**3, np.float32)
        table[seen] = (root @ w) @ phi
        machine = Model(table, float(bias), np.zeros(WORST + 2))
        if turn == ROUNDS - 1:
            break
        # Clean words that score highest join the negatives; the worst word of each toxic sentence is its witness.
        margin = machine.word_margins(bags.codes, bags.size)
        hard = np.setdiff1d(clean[np.argsort(-margin[clean], kind="stable")[:MINED]], negatives)
        negatives = np.concatenate([negatives, hard])
        negative = np.concatenate([negative, features(bags.codes[hard], bags.size[hard])])
        worst = in_toxic_sentence[np.lexsort((-margin[bags.word[in_toxic_sentence]], bags.sentence[in_toxic_sentence]))]
        worst = worst[np.concatenate([[True], np.diff(bags.sentence[worst]) > 0])] if len(worst) else worst
        new = np.unique(bags.word[worst])
        new = new[margin[new] > 0]
        new = new[np.argsort(-margin[new], kind="stable")][:MARKS]
        witnesses = np.unique(np.concatenate([witnesses[rank[witnesses] < MARKS // 4], new]))[:MARKS]
    margin = np.concatenate([machine.margins(texts[i : i + 100]) for i in range(0, len(texts), 100)])
    return Model(table, float(bias), curve(margin, toxic))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of the labelled documents outside the held-out fold, in hash order by class."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna()
    rows = rows.filter(common.fold_of("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", F.lit(6)))
    picked = [rows.filter(c).orderBy("place", "doc_id").limit(SAMPLE) for c in ("toxic > 0", "toxic <= 0")]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 x SAMPLE rows at most
    found = common.texts(docs).join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("place").alias("place"))
    found = common.stored(found, "labelled")
    held, kept = {True: 0, False: 0}, []
    for r in sorted(found.select("doc_id", "toxic", "place", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["place"], r["doc_id"])):
        if held[r["toxic"] > 0] + r["n"] <= SAMPLE_BYTES // 2:
            held[r["toxic"] > 0] += r["n"]
            kept.append(r["doc_id"])
    texts = found.filter(F.col("doc_id").isin(kept)).select("doc_id", "text", "toxic").collect() if kept else []  # SAMPLE_BYTES
    texts.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in texts], np.array([float(r["toxic"] > 0) for r in texts])


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    texts, toxic = training_rows(docs, labels)
    return fit(texts, toxic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(common.as_bytes(batch, "text")))], ["doc_id", "score"])

    return common.texts(docs).mapInArrow(each, "doc_id long, score double")


def op6_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, common.table(spark, sf_dir, "labels")))
    held_out = common.fold_of("doc_id", FOLDS) == HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are."""
    model = fitted(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            yield batch.filter(pa.array(model.scores(common.as_bytes(batch, "text")) < threshold))

    return docs.mapInArrow(clean, docs.schema)
