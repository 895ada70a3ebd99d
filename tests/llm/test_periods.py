"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import as_dir, frame

from docloom.llm import periods


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fast_runs(words):
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    start, end, period = periods.find_runs(np.array([*(number[w] for w in words), len(number)], np.int64))
    return list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True))


def periodic(r, letters):
    """Nested repeats with breaks, prefixes of periods and shared words between them."""
    out = []
    for _ in range(r.randint(1, 5)):
        unit = [r.choice(letters) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 2)):
            unit = unit * r.randint(1, 4) + [r.choice(letters) for _ in range(r.randint(0, 3))]
        out += (unit * r.randint(1, 9))[: r.randint(1, 400)] + [r.choice(letters) for _ in range(r.randint(0, 4))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_nested_repeats(seed):
    r = random.Random(seed)
    words = periodic(r, "ab" if seed % 2 else "abcdef")
    assert fast_runs(words) == brute_runs(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120))
def test_two_letters(words):
    assert fast_runs(words) == brute_runs(words)


@pytest.mark.parametrize("words", ["a" * 23, "a" * 24, "a" * 500, "ab" * 12, "abcdefgh" * 3, ("abcdefgh" * 3)[:-1], "abcdefghi" * 3, "a" * 30 + "b" + "a" * 30, ("a" * 7 + "b") * 40, ""])
def test_borders(words):
    assert fast_runs(list(words)) == brute_runs(list(words))


def test_runs_do_not_cross_texts():
    runs, left, count = periods.batch_runs(pa.array(["a " * 20, None, "", "a " * 30, " \t\x0b", "a " * 23 + "b"]))
    assert [len(r) for r in runs] == [0, 0, 0, 1, 0, 0] and count.tolist() == [20, 0, 0, 30, 0, 24]
    assert left.to_pylist() == ["a " * 19 + "a", "", "", "a", "", "a " * 23 + "b"]


def brute_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(periodic(r, ["ab", "ä", "c\xa0d", "x"])) for _ in range(60)]
    texts += [" ".join(r.choices("abcdefgh", k=r.randint(0, 200))).replace(" a ", " \n\ta\x0b") for _ in range(120)] + ["", None, " \n ", *[texts[0]] * 5]
    ids = [*range(len(texts) - 6), None, 7, 7, 7, 3, 3]
    docs = frame(spark, texts, ids).withColumn("runs", F.lit(1)).withColumn("words", F.lit(2)).withColumn("h", F.lit(3))
    got = periods.op12_periodic_runs(spark, as_dir(tmp_path, documents=docs)).collect()
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got), key=repr) == sorted((brute_row(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)


def test_query_over_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = periods.op12_periodic_runs(spark, sf).filter("n_runs > 0").collect()
    assert got and all(tuple(r[c] for c in COLUMNS) == brute_row(r["doc_id"], docs[r["doc_id"]]) for r in got if len(docs[r["doc_id"]]) < 8000)


def test_a_very_long_text():
    unit = [f"w{i}" for i in range(50_000)]
    runs, _, count = periods.batch_runs(pa.array([" ".join(unit * 4), "word " * 300_000]))
    assert runs == [[{"start": 0, "length": 200_000, "period": 50_000}], [{"start": 0, "length": 300_000, "period": 1}]] and count.tolist() == [200_000, 300_000]


def test_nothing(spark):
    assert periods.with_runs(frame(spark, [])).collect() == []
