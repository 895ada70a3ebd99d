"""Operators on small hand-made tables: nulls, empty inputs, ties, cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import diff, directory, ir, records, security
from docloom.storage import stored


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_query_and_null_text(spark):
    docs = spark.createDataFrame([(1, "Hello World\nsecond"), (2, None), (3, "")], "doc_id long, text string")
    nodes = ir.text_nodes(docs)
    assert values(ir.select_nodes(nodes, ("Run",), "WORLD").select("doc_id", "node_id")) == [(1, 2)]
    assert ir.select_nodes(nodes, ("Paragraph",)).count() == 4
    assert values(ir.collected_text(ir.paragraphs(docs))) == [(1, "Hello World\nsecond"), (2, ""), (3, "")]


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("b", "d", 1)], "parent string, child string, ord int")
    roots = spark.createDataFrame([("a",)], "root string")
    found = ir.closure(edges, roots, stored).select("node", "depth")
    assert values(found) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_substreams_and_offsets(spark):
    rows = spark.createDataFrame([(1, 0, "BOF", 8), (1, 1, "x", 2), (1, 2, "BOF", 8), (2, 0, "x", 1)], "s long, seq int, kind string, size int")
    found = records.offsets(records.substreams(rows, "s", F.col("kind") == "BOF", "kind"), "s", "size")
    assert values(found.select("s", "seq", "substream", "substream_kind", "offset")) == [(1, 0, 0, "BOF", 0), (1, 1, 0, "BOF", 12), (1, 2, 1, "BOF", 18), (2, 0, 0, "unknown", 0)]


def test_chains_and_islands(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 3, 9), (2, 0, 6)], "s long, pos int, sector int")
    assert values(records.chain_steps(rows, "s", "sector", ["pos"]).select("s", "step", "next", "is_terminal")) == [(1, 0, 6, False), (1, 1, 9, False), (1, 2, -2, True), (2, 0, -2, True)]
    assert values(records.shared_sectors(rows, "s", "sector")) == [(6, 2, 1)]
    assert values(records.islands(rows, "s", "pos")) == [(1, 0, 1, 2)]


def test_directory_cycles(spark):
    schema = "slot long, left long, right long, child long, state string, entry_type string"
    slots = spark.createDataFrame([(0, 1, None, None, "normal", "root"), (1, 0, None, 2, "normal", "stream"), (2, None, None, 0, "free", "stream"), (3, 3, None, None, "normal", "stream")], schema)
    assert values(directory.cycles_of_two(slots)) == [(0, 1, "sibling")]
    assert values(directory.cycles_of_three(slots)) == [(0, 1, 2)]
    assert directory.cycles_of_two(slots.filter("false")).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    text = lambda s: F.lit(s)
    assert [one(spark, S.column_letter(F.lit(i))) for i in (0, 25, 26, 701, 702, 18277)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, S.url_host(text("HTTP://user:p@Www.Example.ru:80/a@b?x"))) == "b"
    assert one(spark, S.url_host(text("http://u@host.cn.:8080/a"))) == "host.cn"
    assert one(spark, S.is_suspicious_url(text("http://evil.ru/x"))) is True
    assert one(spark, S.is_suspicious_url(text("http://example.com/x.ru"))) is False
    assert one(spark, S.is_suspicious_formula(text('=CONCAT("CALL(",A1)'))) is False
    assert one(spark, S.is_suspicious_formula(text('="unclosed CALL('))) is False
    assert one(spark, S.is_suspicious_formula(text("=SUM(CALL(1))"))) is True
    assert one(spark, S.dangerous_xlm(text("=FORMULA.FILL(1)"))) == ["FORMULA", "FORMULA.FILL"]
    assert one(spark, S.vba_procedure(text("  Private Static Sub AutoOpen()"))) == "AutoOpen"
    assert one(spark, S.suspicious_calls(text("' Shell"))) == []
    assert [r["name"] for r in one(spark, S.suspicious_calls(text("architecture = Chr(1)")))] == ["Chr"]
    assert one(spark, S.abbreviate(text("abcdef"), 3)) == "abc..."
    assert one(spark, S.abbreviate(text("abc"), 3)) == "abc"
    assert [one(spark, c) for c in S.dde(text('DDEAUTO "" "topic"'))] == ["DDEAUTO", "unknown", None, None]


def test_threat_ladder(spark):
    rank = lambda *n: one(spark, security.threat_rank(*(F.lit(x) for x in n)))
    assert [rank(1, 0, 0, 0, 0, 0, 0), rank(0, 0, 0, 1, 0, 5, 1), rank(0, 0, 0, 0, 0, 1, 1), rank(0, 0, 0, 0, 0, 0, 1), rank(0, 0, 0, 0, 0, 0, 0)] == [4, 3, 2, 1, 0]


def test_profile(spark):
    rows = spark.createDataFrame([(1, "SEC-001", "Critical", "m", None), (1, "SEC-010", "Low", "m", 3)], "doc_id long, rule_id string, severity string, message string, node_id long")
    assert values(security.with_profile(rows, disabled=("SEC-001",), severities={"SEC-010": "High"}).select("rule_id", "severity")) == [("SEC-010", "High")]


def test_diff_needs_another_summary(spark):
    schema = "key string, node_type string, summary string, content_sig string, style_sig string"
    left = spark.createDataFrame([("a", "P", "s", "1", None), ("b", "P", "s", "1", "x"), ("c", "P", "s", "1", "x")], schema)
    right = spark.createDataFrame([("a", "P", "s", "2", None), ("b", "P", "t", "1", "y"), ("d", "P", "s", "1", "x")], schema)
    assert [(r["key"], r["change"], r["kind"]) for r in diff.diff(left, right).orderBy("key").collect()] == [("b", "modified", "Style"), ("c", "removed", None), ("d", "added", None)]
