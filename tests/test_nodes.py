"""Summaries, keys and signatures on literal nodes, with results written by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import fields
from docloom.operators import summaries
from docloom.storage import stored

NODES = {
    ("Document", (("format", "docx"), ("macros", "true"))): ("format=docx content_nodes=0 macros=true ole=0 external_refs=0 threat=None", None, None, None),
    ("Paragraph", (("text", "a" * 81), ("runs", "2"))): ('style=- runs=2 text="' + "a" * 80 + '..."', None, "a" * 81, None),
    ("Run", (("text", ""), ("bold", "true"), ("properties", "{}"))): ('text="" bold=true italic=- size=-', None, "", "{}"),
    ("Cell", (("ref", "B2"), ("value_kind", "Number"), ("value", "1.5"))): ("ref=B2 value=num:1.500000 formula=-", "Cell[B2]", "B2=n:1.5", "style=-"),
    ("Cell", (("ref", "B3"), ("formula", "A1+1"))): ("ref=B3 value=empty formula=A1+1 type=Normal", "Cell[B3]", "B3=empty;A1+1", "style=-"),
    ("DefinedName", (("name", "N"), ("scope", "sheet:2"))): ("name=N scope=sheet:2", "DefinedName[N]", "N", None),
    ("TableDefinition", (("name", "T"),)): ("name=- cols=0 ref=-", None, "T", None),
    ("Shape", (("type", "TextBox"),)): ('type=TextBox name=- text="" x=0 y=0 w=0 h=0 link=-', None, None, "type=TextBox has_text=false"),
    ("OleObject", (("prog_id", "P"),)): ("name=- prog_id=P linked=false size=0 hash=-", "OleObject[P]", "P", None),
    ("OleObject", (("prog_id", "P"), ("name", "n"))): ("name=n prog_id=P linked=false size=0 hash=-", "OleObject[n]", "P", None),
    ("PeoplePart", ()): ("people=0", "PeoplePart", None, None),
    ("Mystery", ()): ("unsupported=Mystery", None, None, None),
}


def test_literal_nodes(spark):
    rows = spark.createDataFrame([(i, k, dict(a)) for i, (k, a) in enumerate(NODES)], "node_id int, node_type string, attrs map<string,string>")
    got = summaries.snapshots(rows).orderBy("node_id").select("summary", "own_key", "content_sig", "style_sig").collect()
    assert [tuple(r) for r in got] == list(NODES.values())


def test_every_template_renders(spark):
    """Without attributes a type with a summary gives one, and none fails."""
    kinds = sorted({*summaries.SUMMARIES, *summaries.KEYED_BY, *summaries.SINGLE, *summaries.CONTENT, *summaries.STYLE})
    rows = spark.createDataFrame([(k, {}) for k in kinds], "node_type string, attrs map<string,string>")
    got = {r.node_type: r for r in summaries.snapshots(rows).collect()}
    assert all(got[k].summary is not None and "{" not in got[k].summary for k in kinds)
    assert all(got[k].own_key == k for k in summaries.SINGLE)
    assert not set(summaries.SINGLE) & set(summaries.KEYED_BY)


def test_local_keys(spark):
    nodes = [("Paragraph", {"text": "x"}), ("Paragraph", {"text": "x"}), ("Slide", {"number": "1"}), ("Slide", {"number": "1"}), ("Slide", {"number": "1"}), ("Shape", {"text": "t"}), ("Shape", {"text": "t"}), ("Table", {})]
    rows = spark.createDataFrame([(1, i, *n) for i, n in enumerate(nodes)], "doc_id int, node_id int, node_type string, attrs map<string,string>")
    got = [r.local_key for r in summaries.local_keys(summaries.snapshots(rows), ["doc_id"], ["node_id"]).orderBy("node_id").collect()]
    hashed = got[5]
    assert hashed.startswith("Shape[") and len(hashed) == 6 + 16 + 1
    assert got == ["Paragraph[1]", "Paragraph[2]", "Slide[1]", "Slide[1]#2", "Slide[1]#3", hashed, hashed + "#2", "Table[1]"]


def by_hand(keys):
    used, out = set(), []
    for key in keys:
        n, given = 1, key
        while given in used:
            n += 1
            given = f"{key}#{n}"
        used.add(given)
        out.append(given)
    return out


def test_keys_that_look_like_endings_of_others(spark):
    r = random.Random(2)
    groups = [["K", "K", "K#2"], ["K#2", "K", "K"], ["K", "K#3", "K", "K", "K"], ["K#2"] * 3, ["K#02", "K", "K"], ["a", None and "b", "a#2", "a", "a#2#2", "a#2", "a"]]
    groups = [[k for k in g if k] for g in groups] + [r.choices(["K", "K#2", "K#3", "K#2#2", "K#4", "L", "L#2", "#2", "#"], k=30) for _ in range(12)]
    rows = [(p, i, k) for p, g in enumerate(groups) for i, k in enumerate(g)] + [(None, i, "K") for i in range(3)]
    got = summaries.allotted(spark.createDataFrame(rows, "p int, i int, key string").repartition(3), "key", ["p"], ["i"], stored).collect()
    want = [(p, i, k) for p, g in enumerate(groups) for i, k in enumerate(by_hand(g))] + [(None, 0, "K"), (None, 1, "K#2"), (None, 2, "K#3")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_path_keys_of_shared_and_cyclic_nodes(spark):
    roots = spark.createDataFrame([("r", "Root")], "node string, local_key string")
    edges = spark.createDataFrame([("r", "a", "A"), ("r", "b", "B"), ("a", "c", "C"), ("b", "c", "C"), ("c", "a", "A"), ("x", "y", "Y")], "parent string, child string, local_key string")
    got = {(r.node, r.key) for r in summaries.path_keys(roots, edges, stored).collect()}
    assert got == {("r", "Root"), ("a", "Root/A"), ("b", "Root/B"), ("c", "Root/A/C"), ("c", "Root/B/C"), ("a", "Root/B/C/A")}
    with pytest.raises(ValueError):
        summaries.path_keys(roots, edges, stored, most=2)
    assert summaries.path_keys(roots.limit(0), edges, stored).count() == 0


def test_fields_with_blanks_and_backslashes_in_quotes(spark):
    texts = ['REF "c:\\a b.png" \\d', 'HYPERLINK "a\tb"', None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    word = [tuple(r) for r in rows.orderBy("i").select(*fields.word_field(F.col("t"))).collect()]
    rich = [tuple(r) for r in rows.orderBy("i").select(*fields.rtf_field(F.col("t"))).collect()]
    assert word == [("Ref", ["c:\\a b.png"], ["\\d"]), ("Hyperlink", ["a\tb"], ["\\t"]), (None, None, None), (None, [], [])]
    assert rich == [("Ref", ["c:", " b.png"], ["a", "d"]), ("Hyperlink", ["a\tb"], []), (None, None, None), (None, [], [])]


def test_a_field_is_split_once(spark):
    """the words of an instruction are parted once for each of its three results."""
    plan = spark.range(1).select(*(c.alias("x") for c in fields.word_field(F.col("id").cast("string"))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[ \\t\\r\\n]+") <= 3
