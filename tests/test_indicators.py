"""Indicator reports, dominant anomalies, queries with all conditions and shapes, with results written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.operators import indicators, trees


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_report(spark):
    docs = spark.createDataFrame([(1, "docx", "zip-ooxml"), (2, "rtf", "rtf")], "doc_id long, format string, container string")
    found = spark.createDataFrame([(1, "macros", "p"), (1, "dde", "b"), (1, "dde", "a"), (1, "dde", None), (9, "activex", "x")], "doc_id long, key string, e string")
    rows = indicators.report(docs, found).orderBy("doc_id", "place").collect()
    assert [r.key for r in rows[:11]] == [k for k, *_ in indicators.INDICATORS] and len(rows) == 22
    got = {(r.doc_id, r.key): (r.value, r.risk, r.evidence) for r in rows}
    assert got[1, "format-container"] == ("docx/zip-ooxml", "None", []) and got[1, "macros"] == ("1", "Critical", ["p"]) and got[1, "dde"] == ("2", "High", ["a", "b"])
    assert all(v == ("absent", "None", []) for (d, k), v in got.items() if d == 2 and k != "format-container")
    assert next(r.reason for r in rows if r.key == "activex") == "No ActiveX controls detected"


def test_dominant_class_and_its_ties(spark):
    schema = "doc_id long, shared_sectors long, high_overlaps long, other_overlaps long, cycles long, unreachable long, invalid_starts long, idle_mini_fat long"
    rows = [(1, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 1, 1, 0, 0), (3, 0, 1, 1, 1, 0, 1, 0), (4, 1, 0, 0, 0, 0, 1, 2), (5, 0, 0, 0, 0, 0, 0, 1), (6, 0, 0, 0, 2, 2, 1, 3)]
    assert values(indicators.dominant_anomaly(spark.createDataFrame(rows, schema))) == [(1, "none", 0), (2, "cycle", 3), (3, "shared-sector", 5), (4, "shared-sector", 4), (5, "mini-fat", 2), (6, "cycle", 6)]


def test_query_conditions(spark):
    nodes = [(1, 0, "Document", {}), (1, 1, "Run", {"text": "Hello World"}), (1, 2, "Cell", {"formula": "WORLD(1)", "value": "x"}), (1, 3, "Cell", {"value": 'String("world")'}), (1, 4, "Hyperlink", {"target": "http://world"}),
             (1, 5, "Shape", {"paragraphs": "the\nworld"}), (1, 6, "Slide", {"text": "world"}), (2, 0, "Document", {}), (2, 1, "Run", {})]
    rows = spark.createDataFrame(nodes, "doc_id long, node_id long, node_type string, attrs map<string,string>")
    docs = spark.createDataFrame([(1, "docx", True, False), (2, "rtf", False, None)], "doc_id long, format string, has_macros boolean, has_external_refs boolean")
    ask = lambda **k: [r[:2] for r in values(indicators.query(rows, docs, **k))]
    assert ask(contains="wOrLd") == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5)]
    assert ask(types=("Document",), form="docx", has_macros=True, has_external_refs=False) == [(1, 0)]
    assert ask(types=("Document", "Run"), has_macros=False) == [(1, 1), (2, 0), (2, 1)]
    assert ask(types=("Document",), has_external_refs=True) == [] and ask(contains="d\n") == [(1, 5)]
    with pytest.raises(ValueError):
        indicators.query(rows, docs, contains="  ")


def test_shapes(spark):
    shapes = spark.createDataFrame([(1, 1, "Picture", "m", ["s2", "o1", "s1", "o2", "s2"]), (1, 2, "Chart", "c", None), (1, 3, "Other", "o1", []), (1, 4, "Other", None, None), (2, 5, "Other", "m", None)], "doc_id long, node_id long, shape_type string, media_target string, related_targets array<string>")
    parts = spark.createDataFrame([(1, 10, "MediaAsset", "m"), (1, 11, "MediaAsset", "m"), (1, 12, "ChartData", "c"), (1, 13, "OleObject", "o1"), (1, 14, "OleObject", "o2"), (1, 15, "SmartArtPart", "s1"), (1, 16, "SmartArtPart", "s2"), (1, 17, "Theme", "m")], "doc_id long, node_id long, node_type string, path string")
    assert values(indicators.linked_shapes(shapes, parts)) == sorted([
        (1, 1, "OleObject", 11, None, 14, [15, 16]), (1, 2, "Chart", None, 12, None, []), (1, 3, "OleObject", None, None, 13, []), (1, 4, "Other", None, None, None, []), (2, 5, "Other", None, None, None, []),
    ], key=repr)


def test_one_node_as_json(spark):
    rows = spark.range(1).select(F.lit("n").alias("node"), F.lit(1).alias("zz"), F.lit(None).cast("string").alias("aa"), F.struct(F.lit(2).alias("line")).alias("span"))
    assert trees.node_json(rows).first()["json"] == '{"aa":null,"span":{"line":2},"zz":1}'
    assert trees.node_json(rows, ("span", "aa")).first()["json"] == '{"zz":1}'
