"""Line dedup against brute force and its SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import as_dir, frame

from docloom.llm import lines
from rows import rows

_TO_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(documents, least=10):
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate(_TO_LOWER)
    owners = collections.defaultdict(set)
    for i, text in documents:
        for s in (text or "").split("\n"):
            owners[key(s)].add(i)
    out = collections.Counter()
    for i, text in documents:
        own = (text or "").split("\n")
        kept = [s for s in own if not key(s) or len(owners[key(s)]) < least]
        out[i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def documents():
    r = random.Random(3)
    said = ["", " ", "Shared Line", "\tshared line\r", "ÄRGER", "ärger", "a\x0bb", "\xa0shared line", *(f"line {i}" for i in range(30))]
    found = [(i, "\n".join(r.choices(said, k=r.randint(1, 12)))) for i in range(120)]
    found += [(7, found[7][1])] * 12 + [(500 + i, "hot\nhot\nown %d" % i) for i in range(60)]
    found += [(None, "null id\nhot")] * 11 + [(900, None), (901, ""), (902, "\n\n"), (903, "hot"), (904, "\n".join(f"x {i % 700}" for i in range(20_000)) + "\nhot")]
    return found + [(1000 + i, f"seldom\n{i}") for i in range(9)] + [(2000 + i, f"at the threshold\n{i}") for i in range(10)]


@pytest.mark.parametrize("hot", [lines.HOT, 3], ids=["all hot", "few hot"])
def test_against_brute_force(spark, documents, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    ids, texts = zip(*documents, strict=True)
    docs = frame(spark, list(texts), list(ids)).repartition(5)
    got = lines.op11_line_dedup(spark, as_dir(tmp_path, documents=docs)).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in got) == brute(documents)


def test_same_as_sql(spark, sf, duck):
    assert rows(lines.op11_line_dedup(spark, sf).toPandas()) == rows(duck.sql(lines.OP11_SQL).df())


def test_texts_and_clashing_columns(spark):
    docs = frame(spark, [f"common\nown {i}" for i in range(12)])
    for name in ("row", "dropped", "lines", "n_lines", "h", "a", "b", "i", "position"):
        docs = docs.withColumn(name, F.lit("x"))
    got = lines.without_common_lines(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {(r["text"], r["n_lines"], r["_n_lines"], r["n_dropped"]) for r in got.collect()} == {(f"own {i}", "x", 2, 1) for i in range(12)}


def test_nothing(spark):
    assert lines.without_common_lines(frame(spark, [])).collect() == []
