"""Functions and reports over package parts: nulls, empty tables, ties and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import parts as P
from docloom.functions import scalars as S
from docloom.operators import packages


def test_targets_against_a_plain_walk(spark):
    def walk(base, target):
        at = [p for p in base[: base.rfind("/") + 1].split("/") if p]
        for step in target.split("/"):
            if step == "..":
                at = at[:-1] if at else [".."]
            elif step not in ("", "."):
                at.append(step)
        return "/".join(at)

    steps = ["..", ".", "", "a", "b c"]
    cases = [(base, "/".join(("x", s, t, u))) for base in ("w/d.xml", "d.xml", "a/b/c/d.xml") for s in steps for t in steps for u in steps]
    got = spark.createDataFrame(cases, "base string, target string").select("base", "target", P.resolved_target(F.col("base"), F.col("target")).alias("r")).collect()
    assert [r["r"] for r in got] == [walk(*c) for c in cases]


def test_call_arguments(spark):
    rows = [("=call(a(b),\"\"\")\")", "a(b),\"\"\")\""), ("=CALL( x )", " x "), ("=R.CALL(1)", None), ("=CALL\n(\"(\",(1))", "\"(\",(1)"), (None, None), ("=CALL_(1)+Call(2)", "2")]
    got = spark.createDataFrame(rows, "f string, want string").select(P.call_arguments(F.col("f"), "CALL").alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_quoted_strings(spark):
    rows = [("a 'b", ["b"]), ("\"x\n\" '", ["x\n"]), (None, None), ("''\"\"", [])]
    got = spark.createDataFrame(rows, "t string, want array<string>").select(S.quoted_strings(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_probe_takes_the_first_rung_and_survives_nulls(spark):
    rows = [(1, "Book"), (1, "FILEHEADER"), (2, None), (3, "!_STRINGPOOL"), (3, "x"), (4, "current user"), (4, "current user")]
    found = {r["doc_id"]: (r["format"], r["signals"]) for r in packages.cfb_probes(spark.createDataFrame(rows, "doc_id long, path string")).collect()}
    assert found == {1: ("hwp", "cfb-signature,stream:FileHeader"), 2: ("ole", "cfb-signature"), 3: ("msi", "cfb-signature,stream:!_StringData"), 4: ("office-legacy", "cfb-signature,legacy-office-layout")}
    assert packages.cfb_probes(spark.createDataFrame([], "doc_id long, path string")).count() == 0


def test_chains_are_cut_once(spark):
    chains = spark.createDataFrame([(1, 0, 5), (1, 1, 99), (1, 2, 6), (2, 0, 5), (3, 0, 99)], "stream long, pos int, sector long")
    size = spark.createDataFrame([(1, 9), (2, 0), (3, 0)], "stream long, size long")
    assert sorted(map(tuple, packages.sanitized_chains(chains, 50, size).collect())) == [(1, 1, 2, "truncated"), (2, 1, 0, None), (3, 0, 1, "empty")]


def test_first_stream_of_a_name(spark):
    streams = spark.createDataFrame([(1, 2, "book"), (1, 1, "BOOK"), (2, 1, None)], "doc_id long, ord long, path string")
    wanted = spark.createDataFrame([(1, "Book"), (2, "Book"), (1, None)], "doc_id long, name string")
    assert sorted(map(tuple, packages.case_matches(wanted, streams).collect()), key=str) == [(1, "Book", "BOOK"), (1, None, None), (2, "Book", None)]


def test_properties_are_read_in_one_pass(spark):
    """the part is parsed once for all properties; nested elements give their text, empty ones null, the first of a name counts."""
    xml = '<c:p xmlns:c="c" xmlns:dc="d"><dc:title>a<b>c</b> </dc:title><dc:title>z</dc:title><dc:creator/><c:x><dc:subject>n</dc:subject></c:x></c:p>'
    found = spark.createDataFrame([(xml,), (None,)], "xml string").select(*P.core_properties(F.col("xml")))
    assert [list(r) for r in found.collect()] == [["ac ", None, None, None, None], [None] * 5]
    assert "concat(/*/*[name()='dc:title'], " in found._jdf.queryExecution().analyzed().toString()
