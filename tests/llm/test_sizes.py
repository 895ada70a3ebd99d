"""Every operator on a text over 4 MiB, op8 with clashing columns, op5 with a page over a whole run."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_llm import as_dir, frame

from docloom.llm import decontaminate, fingerprint, lines, lm, packing, periods, quotes, secrets, sharding, simhash, toxicity, trie, warc

CLASH = ("key", "uid", "text_hash", "bucket", "row", "dropped", "lines", "runs", "words", "path", "sizes", "shard", "level", "target", "target_id", "passage", "score", "h", "n", "id")


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(8)
    known = [f"w{i}" for i in range(4000)]
    text = "\n".join(" ".join(r.choices(known, k=12)) for _ in range(80_000))
    assert len(text) > 4 << 20
    return text


@pytest.fixture(scope="module")
def tables(spark, long_text, tmp_path_factory):
    docs = frame(spark, [long_text, long_text + " more", "short text here", None, ""]).select("*", *(F.lit(1).alias(c) for c in CLASH))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    item = " ".join(long_text.split()[100_000:100_020])
    bench = spark.createDataFrame([(1, item), (2, "nowhere to be found in any of these")], "item_id long, text string")
    return as_dir(tmp_path_factory.mktemp("long"), documents=docs, labels=labels, benchmark=bench)


@pytest.mark.parametrize("run", [lm.op1_log_bilinear, fingerprint.op2_multiset_hash, simhash.op3_simhash_bitsliced, toxicity.op6_subsequence_svm, secrets.op7_secret_links, sharding.op10_fixed_slots, lines.op11_line_dedup, periods.op12_periodic_runs], ids=lambda f: f.__name__)
def test_a_row_for_each_document(spark, tables, run):
    assert sorted(r["doc_id"] for r in run(spark, tables).select("doc_id").collect()) == [0, 1, 2, 3, 4]


def test_pieces_and_passages_of_a_long_text(spark, tables, long_text):
    got = packing.op4_pack_ffd(spark, tables).filter("doc_id = 0").toPandas()
    assert got["length"].sum() == got["doc_tokens"].iloc[0] and len(got) > 1000
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.op9_pigeonhole_edits(spark, tables).collect()) == [(0, 1, 0), (1, 1, 0)]


def test_near_copies_of_a_long_text(spark, tables):
    assert {r["doc_id"]: r["component_id"] for r in simhash.op3_simhash_bitsliced(spark, tables).collect()}[1] == 0


def test_mails_with_clashing_columns(spark, tmp_path, long_text):
    said = [(1, 0, "user", long_text[:20_000]), (1, 1, "assistant", "short answer to all of it"), (1, 2, "user", "thanks"), (2, 0, None, None)]
    plain = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    wide = plain.select("*", *(F.lit("x").alias(c) for c in CLASH))
    rows = lambda d: sorted(map(repr, d.collect()))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = quotes.op8_quote_links(spark, as_dir(tmp_path / "b", conversations=wide))
    assert rows(got) == rows(quotes.op8_quote_links(spark, as_dir(tmp_path / "a", conversations=plain)))
    assert {(r["turn"], r["parent_turn"], r["depth"]) for r in got.filter("conv_id = 1").collect()} == {(0, None, 0), (1, 0, 1), (2, 1, 2)}
    nodes = trie.op13_prefix_trie(spark, str(tmp_path / "b")).collect()
    assert {(r["depth"], r["n_convs"]) for r in nodes} >= {(0, 2), (1, 1)}


def test_a_page_over_a_whole_run(spark, tmp_path):
    html = ["<p>" + "x" * (17 << 20), "<p>" + "x" * (17 << 20), "small", None]
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.op5_warc_merge(spark, as_dir(tmp_path, pages=pages)).collect()}
    for i, h in enumerate(html):
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(h or ""), hashlib.sha256((h or "").encode()).hexdigest())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in range(4)] == [("response", None), ("revisit", 0), ("response", None), ("response", None)]
