"""Nested JSON, walks, places and normal order on small hand-made tables."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from docloom.functions import formulas as X
from docloom.operators import coverage, formulas, ir, normal, trees
from docloom.operators.ranks import ranked
from docloom.plans import coverage as packages
from docloom.storage import stored

EDGES = "parent string, child string, ord int"


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_places_of_large_and_null_groups(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else None, i, "x") for i in range(500)] + [(f"g{i % 40}", i, "y") for i in range(300)]
    r.shuffle(rows)
    got = ranked(spark.createDataFrame(rows, "g string, i int, v string").repartition(7), ["g"], ["i"], stored).collect()
    seen = {}
    for g, i, _ in sorted(rows, key=lambda x: x[1]):
        seen.setdefault(g, []).append(i)
    assert {(x.g, x.i, x.place) for x in got} == {(g, i, n + 1) for g, found in seen.items() for n, i in enumerate(found)}
    assert ranked(spark.createDataFrame([], "g string, i int"), ["g"], ["i"], stored).count() == 0


def walk_by_stack(edges, root, skip=(), stop=()):
    children = {}
    for p, c, o in sorted(edges, key=lambda e: e[2]):
        children.setdefault(p, []).append(c)
    stack, seen = [root], []
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen.append(node)
        if node in stop:
            break
        if node not in skip:
            stack += reversed(children.get(node, []))
    return seen


def walked(spark, edges, root="A", **conditions):
    roots = spark.createDataFrame([(root,)], "root string")
    return [r.node for r in trees.visits(spark.createDataFrame(edges, EDGES), roots, stored, **conditions).orderBy("visit").collect()]


def test_a_shared_node_stands_at_its_first_place(spark):
    edges = [("A", "B", 0), ("A", "E", 1), ("A", "D", 2), ("B", "D", 0)]
    assert walked(spark, edges) == ["A", "B", "D", "E"]
    assert walked(spark, edges, skip=F.col("node") == "B") == ["A", "B", "E", "D"]
    assert walked(spark, edges, stop=F.col("node") == "D") == ["A", "B", "D"]


def test_walks_of_random_graphs_and_cycles(spark):
    r = random.Random(4)
    edges = [(f"n{i:02}", f"n{j:02}", k) for i in range(30) for k, j in enumerate(r.sample(range(i + 1, 40), min(3, 39 - i)))]
    edges += [(f"n{i:02}", "n00", 9) for i in range(0, 30, 4)]  # ways back to the root
    assert walked(spark, edges, "n00") == walk_by_stack(edges, "n00")
    assert walked(spark, [("A", "A", 0)]) == ["A"]


def test_a_chain_of_diamonds_stays_linear(spark):
    edges = [e for i in range(25) for e in ((f"d{i}", f"l{i}", 0), (f"d{i}", f"r{i}", 1), (f"l{i}", f"d{i + 1}", 0), (f"r{i}", f"d{i + 1}", 0))]
    got = walked(spark, edges, "d0")
    assert got == walk_by_stack(edges, "d0") and len(got) == 76


def test_closure_with_and_without_shared_nodes(spark):
    edges = [("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("b", "d", 1), ("x", "y", 0)]
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    want = [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("x", "x", 0), ("x", "y", 1)]
    for found in (edges, [*edges, ("c", "d", 0)]):
        frame = spark.createDataFrame(found, EDGES)
        assert values(ir.closure(frame.drop("ord"), roots, stored)) == want
        assert values(ir.closure(frame, roots, stored).drop("place")) == want


def test_nested_json(spark):
    node = lambda i, **kv: (i, kv.get("z"), (1, kv.get("name", i)), [(i, 2.5)], {"b": "2", "a": i}, ("f.xml", 3), kv.get("type", "Run"))
    schema = "node string, zone string, body struct<zz:int,aa:string>, items array<struct<n:string,m:double>>, map map<string,string>, span struct<file:string,line:int>, type string"
    nodes = spark.createDataFrame([node("r", z='q"\n\x01'), node("a"), node("b"), node("lone")], schema)
    edges = spark.createDataFrame([("r", "b", 1), ("r", "a", 0), ("a", "b", 0), ("c1", "c1", 0), ("bad", "gone", 0)], EDGES)
    nodes = nodes.unionByName(spark.createDataFrame([node("c1"), node("bad")], schema))
    roots = spark.createDataFrame([("r",), ("lone",), ("c1",), ("bad",), ("nobody",)], "root string")
    got = {r.root: r for r in trees.json_trees(nodes, edges, roots, stored, without=("span", "m"), most=6).collect()}
    own = lambda i, zone="null": f'"items":[{{"n":"{i}"}}],"map":{{"a":"{i}","b":"2"}},"type":"Run","zone":{zone}}}'
    body = lambda i: f'{{"body":{{"aa":"{i}","zz":1}},'
    b = body("b") + own("b")
    a = body("a") + f'"children":[{b}],' + own("a")
    assert got["r"].json == body("r") + f'"children":[{a},{b}],' + own("r", r'"q\"\n\u0001"') and json.loads(got["r"].json)
    assert got["lone"].json == body("lone") + own("lone") and got["lone"].error is None
    assert (got["c1"].json, got["c1"].error) == (None, "deeper than 6 levels")
    assert (got["bad"].error, got["nobody"].error) == ("missing node", "missing node")


def test_trees_of_levels_are_those_of_their_edges(spark):
    """levels as tables give the texts of nodes and edges; rows without a parent are left out, nulls of ord come first, and neither keys nor ``without`` are members."""
    rows = lambda found, keys: spark.createDataFrame(found, f"{keys}, zone string, span struct<line:int>, body struct<zz:int,ord:string>")
    own = lambda i: (f'z"{i}' if i % 2 else None, (i,), (i, "o"))
    top = [(i, *own(i)) for i in range(4)] + [(None, *own(9))]
    mid = [(10 + i, p, o, *own(i)) for i, (p, o) in enumerate([(0, 2), (0, None), (1, 1), (7, 0), (None, 0), (0, 1)])]
    low = [(p, (i % 3, str(i)), *own(i)) for i, p in enumerate([10, 10, 10, 10, 12, 13, 99, None, 15])]
    levels = [rows(top, "node int"), rows(mid, "node int, parent int, ord int"), rows(low, "parent int, ord struct<a:int,b:string>")]
    got = {r.node: r.json for r in trees.level_trees(levels, without=("span",)).collect()}
    nodes = [(f"a{n}", *v) for n, *v in top] + [(f"b{n}", *v) for n, _, _, *v in mid] + [(f"c{i}", *v) for i, (_, _, *v) in enumerate(low)]
    edges = [(f"a{p}", f"b{n}", -1 if o is None else o) for n, p, o, *_ in mid if p is not None]
    edges += [(f"b{p}", f"c{i}", (i % 3) * 100 + i) for i, (p, *_) in enumerate(low) if p is not None]
    want = trees.json_trees(rows(nodes, "node string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(f"a{n}",) for n, *_ in top], "root string"), stored, without=("span",)).collect()
    assert {f"a{k}": v for k, v in got.items()} == {r.root: r.json for r in want} and len(got) == 5
    whole = json.loads(got[0])
    assert [x["body"]["zz"] for x in whole["children"]] == [1, 5, 0] and [x["body"]["zz"] for x in whole["children"][2]["children"]] == [0, 3, 1, 2]
    assert list(whole) == ["body", "children", "zone"] and "children" not in json.loads(got[3]) and whole["body"] == {"ord": "o", "zz": 0}
    none = [df.limit(0) for df in levels[1:]]
    assert [json.loads(r.json) for r in trees.level_trees([levels[0].filter("node = 2"), *none]).collect()] == [{"body": {"ord": "o", "zz": 2}, "span": {"line": 2}, "zone": None}]


def test_levels_are_moved_once_by_their_parents(spark, sf):
    """lines are read and dealt once, by their order; beside them only orders, their texts and customers are, and nothing is written on the way."""
    from docloom.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["order_json_trees"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") == 4 and "docloom-step" not in plan


def test_children_in_their_rows(spark, sf):
    """a last level's own children, null, none, with members in any order and to leave out; documents with their texts are dealt once, by their ids."""
    top = spark.createDataFrame([(1, "x"), (2, "y")], "node int, zone string")
    low = spark.createDataFrame([(1, 1, [("b", 2, None), (None, 3, 1)]), (1, 0, None), (2, 0, []), (2, 1, [None])], "parent int, ord int, children array<struct<z:string,a:int,span:int>>")
    got = {r.node: r.json for r in trees.level_trees([top, low], without=("span",)).collect()}
    assert got == {1: '{"children":[{},{"children":[{"a":2,"z":"b"},{"a":3,"z":null}]}],"zone":"x"}', 2: '{"children":[{},{"children":[null]}],"zone":"y"}'}
    alone = trees.level_trees([spark.createDataFrame([(1, [(3,)]), (2, [])], "node int, children array<struct<a:int>>")]).collect()
    assert {r.node: r.json for r in alone} == {1: '{"children":[{"a":3}]}', 2: "{}"}
    from docloom.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["document_json_trees"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange hashpartitioning") == 2 and "docloom-step" not in plan  # ids, and ids with texts


def test_only_edges_to_inner_nodes_go_through_the_levels(spark):
    """of a broad tree the edges are written once, and a level's paths without those to nodes that have no children."""
    edges = [("r", f"m{i}", i) for i in range(3)] + [(f"m{i}", f"l{i}-{j}", j) for i in range(3) for j in range(20)] + [("r", "x", 9), ("away", "r", 0)]
    kept = []
    keep = lambda df: kept.append(stored(df)) or kept[-1]
    found, deep = trees.paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("r",), ("x",), ("lone",)], "root string"), keep)
    assert [df.count() for df in kept] == [65, 3, 3, 0] and deep.count() == 0
    got = {(r.root, r.node): (list(r.place), r.open) for r in found.collect()}
    assert len(got) == 67 and got["r", "l2-7"] == ([2, 7], False) and got["r", "m1"] == ([1], True) and got["r", "x"] == ([9], False)
    assert got["r", "r"] == ([], True) and got["x", "x"] == got["lone", "lone"] == ([], False)


def test_paths_longer_than_the_bound(spark):
    """Chains of one edge fewer and one more than the bound, with the last node a leaf."""
    edges = [(f"{c}{i}", f"{c}{i + 1}", 0) for c, n in (("a", 3), ("b", 4)) for i in range(n)] + [("b0", "s", 1)]
    roots = spark.createDataFrame([("a0",), ("b0",), ("b1",)], "root string")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(5)] + [("s",)], "node string")
    for most, late in ((2, {"a0", "b0", "b1"}), (3, {"b0"}), (4, set())):
        got = {r.root: r for r in trees.json_trees(nodes, spark.createDataFrame(edges, EDGES), roots, stored, most=most).collect()}
        assert {k for k, r in got.items() if r.error == f"deeper than {most} levels" and r.json is None} == late and len(got) == 3
        assert all(r.json.count("{") == {"a0": 4, "b0": 6, "b1": 4}[k] and r.error is None for k, r in got.items() if k not in late)


def test_the_region_tree_as_json(spark, sf):
    from docloom.plans import views as V

    edges = V.tree(spark, sf).filter("kind <> 'Order'").select("parent", "child", F.substring("child", 2, 20).cast("long").alias("ord"))
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.filter("parent like 'R%'").select("parent").distinct().toDF("node")).withColumn("id", F.col("node"))
    found = trees.json_trees(nodes, edges, nodes.filter("node like 'R%'").select(F.col("node").alias("root")), stored).collect()

    def size(tree):
        return 1 + sum(map(size, tree.get("children", ())))

    whole = [json.loads(r.json) for r in found]
    assert sum(map(size, whole)) == nodes.count() and all(list(t) == sorted(t) for t in whole)


def test_normal_order_of_lists(spark):
    nodes = [("d", "Document", {}), ("w", "Worksheet", {"name": "S"}), ("m", "MediaAsset", {"path": "b"}), ("x", "ExtensionPart", {"path": "a"}), ("m2", "MediaAsset", {"path": "a"}),
             ("sB", "Section", {"name": "B"}), ("sA", "Section", {"name": "A"}), ("z", "DefinedName", {"name": "Zeta"}), ("al", "DefinedName", {"name": "Alpha", "local_sheet_id": "2"}), ("al0", "DefinedName", {"name": "Alpha"}),
             ("p2", "PivotCache", {"cache_id": "2"}), ("p1", "PivotCache", {"cache_id": "1"}), ("B2", "Cell", {"row": "1", "column": "1"}), ("A1", "Cell", {"row": "0", "column": "0"}), ("s9", "Slide", {"number": "9"}), ("s10", "Slide", {"number": "10"})]
    lists = [("d", "content", ["sB", "sA"]), ("d", "shared_parts", ["x", "gone", "s10", "m", "s9", "m2"]), ("d", "defined_names", ["z", "al", "al0", "lost"]), ("d", "pivot_caches", ["p2", "p1"]), ("w", "cells", ["B2", "none", "A1"])]
    edges = [(1, p, c, slot, i) for p, slot, cs in lists for i, c in enumerate(cs)]
    found = normal.normalized(spark.createDataFrame([(1, *n) for n in nodes], "doc_id int, node_id string, node_type string, attrs map<string,string>"), spark.createDataFrame(edges, "doc_id int, parent_id string, child_id string, slot string, ord int"), stored)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault(r.slot, []).append(r.child_id)
    assert got == {"content": ["sB", "sA"], "shared_parts": ["s9", "s10", "m2", "m", "x", "gone"], "defined_names": ["lost", "al0", "al", "z"], "pivot_caches": ["p1", "p2"], "cells": ["A1", "B2", "none"]}


def test_patterns_by_key(spark):
    parts = spark.createDataFrame([(1, i, p, None, True) for i, p in enumerate(["a/B/c1.xml", "c1.xml", "a/b/d.xml", "A/b/", "a/b/*", "x"])], "doc_id int, ord int, path string, content_type string, seen boolean")
    known = spark.createDataFrame([("a/b/c*.xml", None, "1"), ("*.xml", None, "2"), ("a/b/d.xml", None, "3"), ("a/*", "t", "4"), ("X", None, "5"), ("a/b/*", None, "6")], "pattern string, expected string, parser string")
    got = {}
    for r in coverage.matched(parts, known).collect():
        got.setdefault(r.path, []).append(r.parser)
    assert {k: sorted(v) for k, v in got.items()} == {"a/B/c1.xml": ["1", "2", "4", "6"], "c1.xml": ["2"], "a/b/d.xml": ["2", "3", "4", "6"], "A/b/": ["4", "6"], "a/b/*": ["4", "6"], "x": ["5"]}
    plan = coverage.matched(parts, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_formula_edges(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "of:=B(1)+A(2)"), (1, 3, "of:=A(1)"), (2, 1, "{1}")], "doc_id int, ord int, formula string")
    assert values(formulas.diagnostics(formulas.scanned(rows))) == [
        (1, "ODF_FORMULA_UNSUPPORTED_FUNCTION", "Unsupported ODF formula functions detected: B, A"),
        (2, "ODF_FORMULA_ARRAY", "ODF array formula detected (not fully evaluated)"),
    ]
    call = lambda text: spark.range(1).select(X.dde_call(F.lit(text)).alias("x")).first()["x"]
    assert call('é;DDE("soffice";"t")').application == "soffice" and call("x_DDE(a)") is None and call("IF(1,'DDE(a)')") is None


def test_a_call_is_read_once(spark):
    """each step of a call's reading stands once in its expression, however many fields are taken from it."""
    call = spark.range(1).select(X.dde_call(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert call.count("regexp_extract_all(") == 2 and call.count("aggregate(") == 1


def _report(spark):
    parts = [(d, "f", i, f"a/{d}{i}.xml", i % 2 == 0, None if i == 1 else "t") for d in (1, 2) for i in range(3)] + [(3, "g", 0, "x", None, None)]
    known = [("f", i, f"a/*{i}.xml", "t" if i % 2 else None, "p") for i in range(150)]
    parts = spark.createDataFrame(parts, "doc_id long, format string, ord long, path string, seen boolean, content_type string")
    return parts, coverage.Report(parts, spark.createDataFrame(known, "format string, spec int, pattern string, expected string, parser string"))


def test_missing_patterns_are_neither_sorted_nor_written(spark):
    """F1, F2, F6, F8: a report's missing patterns, most of its lines, are made where a document's row lies; more than 63 patterns, and a format without any."""
    parts, report = _report(spark)
    names, kept = parts.select("doc_id", F.lit("n").alias("file"), F.lit("d").alias("display")).distinct(), []
    keep = lambda df: kept.append(stored(df)) or kept[-1]
    for lines, first, size in ((coverage.csv_lines(report, keep), 0, 162), (coverage.text_lines(report, names, keep), 1, 173)):
        found = {}
        for r in lines.collect():
            found.setdefault(r.doc_id, {})[r.line_no] = r.line
        assert all(sorted(x) == list(range(first, first + len(x))) for x in found.values())
        assert len(found[1]) == size and sum("missing part" in x for x in found[1].values()) == 144 and sum("missing part" in x for x in found[3].values()) == 0
    assert [df.count() for df in kept] == [21, 21]  # parts, matches and content types of three documents
    assert {r.doc_id: r.message.split("missing_patterns=")[1] for r in report.summaries().collect()} == {1: "144, unknown_content_types=1", 2: "144, unknown_content_types=1", 3: "0, unknown_content_types=1"}
    assert report.lacks().count() == 288


def _dealt(df):
    """How often a plan deals rows by document, and whether it deals any by ranges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(doc_id"), "rangepartitioning" in plan


def test_text_reports_sort_parts_where_they_lie(spark):
    """parts are dealt by document once and sorted there, and no line is made by a lambda; a document without names, names without a document."""
    _, report = _report(spark)
    kept = []
    keep = lambda df: kept.append(df) or stored(df)
    lines = coverage.text_lines(report, (F.concat(F.lit("n"), "doc_id"), F.col("format")), keep)
    assert _dealt(kept[0]) == (1, False)
    assert "lambda" not in lines._jdf.queryExecution().optimizedPlan().toString()
    whole = values(lines)
    names = spark.createDataFrame([(d, f"n{d}", "f") for d in (1, 2, 9)], "doc_id long, file string, display string")
    some = values(coverage.text_lines(report, names, keep))
    assert [r for r in some if r[0] < 3] == [r for r in whole if r[0] < 3] and len([r for r in whole if r[0] == 1]) == 173
    sums = "complete=0, pending=0, missing_patterns=0, unknown_content_types=1"
    own = [f"coverage summary: matched=0, {sums}", f"counts: {sums}", f"parts: {sums}", "", "Unknown Content Types:", "  no content-type entry for path x"]
    top = lambda file, form: ["Coverage Report", "===============", "", f"File: {file}", f"Format: {form}", ""]
    assert [r[1:] for r in some if r[0] == 3] == [*enumerate(own, 1)]
    assert [r[1:] for r in some if r[0] == 9] == [*enumerate(top("n9", "f"), 1)]
    assert [r[1:] for r in whole if r[0] == 3] == [*enumerate(top("n3", "g") + own, 1)]


def test_csv_reports_sort_parts_where_they_lie(spark):
    """as F1, and fields are quoted without a regular expression; a document of equal content types, with odd paths."""
    paths = ['a/"x",0.xml', "a/\n0.xml", "b,c", "b"]
    parts = spark.createDataFrame([(5, "f", i, p, None, "t" if i < 3 else None) for i, p in enumerate(paths)], "doc_id long, format string, ord long, path string, seen boolean, content_type string")
    known = spark.createDataFrame([("f", 1, "a/*.xml", "t", "p,q"), ("f", 2, "z", None, "r")], "format string, spec int, pattern string, expected string, parser string")
    kept = []
    lines = coverage.csv_lines(coverage.Report(parts, known), lambda df: kept.append(df) or stored(df))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert _dealt(kept[0]) == (1, False) and "lambda" not in plan and "RLIKE" not in plan
    said = [f'"pending part: {p} (content-type=t, parser=p,q)","{p}"' for p in ('a/""x"",0.xml', "a/\n0.xml")]
    assert [r[1:] for r in values(lines)] == [*enumerate([
        coverage.HEADER, *(f"parts,COVERAGE_PART,Warning,{x}" for x in said), *(f"part_rows,COVERAGE_PART_ROW,Info,{x}" for x in said),
        "missing,COVERAGE_MISSING,Warning,missing part for pattern z (expected parser=r),z",
        *(f"inventory,CONTENT_TYPE_INVENTORY,Info,{q}content-type: {p} => t{q},{q}{p}{q}" for p, q in (("a/\n0.xml", '"'), ('a/""x"",0.xml', '"'), ("b,c", '"'))),
        "unknown,CONTENT_TYPE_UNKNOWN,Warning,no content-type entry for path b,b", "histogram,CONTENT_TYPE_HISTOGRAM,Info,content-type-count: t => 3,t",
        'summary,COVERAGE_SUMMARY,Info,"coverage summary: matched=2, complete=0, pending=2, missing_patterns=1, unknown_content_types=1",',
    ])]


def test_package_parts_are_dealt_as_numbers(spark, sf):
    """lines are dealt once, ahead of any text, and grouped by numbers, which hash aggregates take."""
    plan = packages.package_parts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_ranks_move_rows_once(spark):
    """behind the sorted ranges rows are not dealt again, only one number a range is broadcast."""
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.array(F.col("id") % 2).alias("h"), "id")
    found = ranked(rows, ["g", "h"], ["id"], lambda df: stored(df.repartition(1)))
    assert all(r.place == r.id // 6 + 1 for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 1 and "rightHint=(strategy=broadcast)" in plan
