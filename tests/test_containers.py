"""Container guards, carried sheets, shared runs and document rows on small tables, with results written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import containers, coverage, overview
from docloom.operators.ranks import carried
from docloom.storage import stored

ENTRY = "doc_id long, ord long, name string, size long, packed long"


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_archives(spark):
    mb = 1 << 20
    rows = [(1, 0, "a.xml", 10, 10), (1, 1, "B.xml", 60 * mb, mb), (2, 0, "x", 40 * mb, 40 * mb), (2, 1, "y", 40 * mb, 40 * mb), (2, 2, "z", 40 * mb, 0), (2, 3, "w", 1, 1),
            (3, 0, "Doc.xml", 1, 1), (3, 1, "doc.XML", 1, 1), (4, 0, "a..b", 1, 1), (5, 0, "zero", 0, 0), (6, 0, "same", 1, 1), (6, 1, "same", 1, 1), (7, 0, "bomb", 1010, 10), (8, 0, "at", 1000, 10)]
    found = containers.archive_errors(spark.createDataFrame(rows, ENTRY)).filter("code is not null").select("doc_id", "ord", "code", "running")
    assert values(found) == [(1, 1, "file-too-large", 60 * mb + 10), (2, 2, "total-size", 120 * mb), (3, 1, "duplicate-name", 2), (4, 0, "path-traversal", 1), (6, 1, "duplicate-name", 2), (7, 0, "compression-ratio", 1010)]
    got = {r.doc_id: (r.code, r.message) for r in containers.refused_archives(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {
        1: ("file-too-large", "File too large: B.xml (62914560 bytes, max: 52428800 bytes)"), 2: ("total-size", "Total uncompressed size too large: 125829121 bytes (max: 104857600 bytes)"),
        3: ("duplicate-name", "Duplicate file name in archive (case-insensitive): doc.XML"), 4: ("path-traversal", "Path traversal: a..b"), 6: ("duplicate-name", "Duplicate file name in archive: same"),
        7: ("compression-ratio", "Suspicious compression ratio for bomb: 101.0:1 (max: 100.0:1)"),
    }
    many = spark.range(10_001).select(F.lit(9).cast("long").alias("doc_id"), F.col("id").alias("ord"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("packed"))
    assert values(containers.refused_archives(many)) == [(9, "too-many-files", "Too many files in archive: 10001 (max: 10000)")]
    assert containers.refused_archives(many.filter("false")).count() == 0


def test_relationships_and_types(spark):
    xml = '<Relationships>\n<Relationship Id="a" Type="t" Target="x>y"/><Relationship TargetMode="Odd" /><Relationship Id="a" Type="u" Target="z"/></Relationships>'
    rows = spark.createDataFrame([(1, "p.rels", xml), (2, "q.rels", None), (3, "r.rels", "<Relationships")], "doc_id int, path string, xml string")
    got = [(r.id, r.target, r.mode, r.error) for r in containers.relationship_entries(rows).orderBy("ord").collect()]
    assert got == [("a", "x>y", "Internal", None), (None, None, None, "p.rels relationship has invalid TargetMode: Odd"), ("a", "z", "Internal", "p.rels contains duplicate relationship Id: a")]
    types = spark.createDataFrame([(1, '<Types><Default Extension="bin" ContentType="a"/><Default Extension="BIN" ContentType="b"/><Override PartName="/X" ContentType="c"/><Override PartName="x" ContentType="d"/></Types>')], "doc_id int, xml string")
    assert [r.error for r in containers.content_type_entries(types).orderBy("ord").collect()] == [None, "[Content_Types].xml contains duplicate Default extension: bin", None, "[Content_Types].xml contains duplicate Override part: x"]


def test_sheets_interleaved_with_other_events(spark):
    e = lambda doc, seq, kind, name=None, sheet_kind=None, cell=None, formula=None: (doc, seq, kind, name, sheet_kind, "visible", cell, formula)
    rows = [e(1, 0, "cell", cell="A0", formula="=EXEC(0)"), e(1, 1, "sheet", "M1", "MacroSheet"), e(1, 2, "cell", cell="A1", formula="=EXEC(1)"), e(1, 3, "name"), e(1, 4, "cell", cell="A2", formula="=auto.open(2)"),
            e(1, 5, "sheet", "S", "Worksheet"), e(1, 6, "cell", cell="A1", formula="=EXEC(3)"), e(1, 7, "sheet", "M2", "MacroSheet"), e(1, 8, "name"), e(1, 9, "cell", cell="B1", formula="=HALT()+CALL(4)"), e(2, 3, "cell", cell="A1", formula="=EXEC(5)"), e(2, 1, "sheet", "M1", "MacroSheet"), e(3, 1, "sheet", "M", "MacroSheet")]
    events = spark.createDataFrame(rows, "doc_id int, seq int, kind string, name string, sheet_kind string, state string, cell string, formula string").repartition(6)
    paths = spark.createDataFrame([(1, "M1", "m1.xml"), (2, "M1", "n1.xml")], "doc_id int, sheet string, path string")
    cells = stored(containers.tracked_cells(events, paths, stored))
    assert values(containers.tracked_functions(cells).select("doc_id", "sheet", "path", "cell", "function", "arguments")) == [
        (1, "M1", "m1.xml", "A1", "EXEC", "1"), (1, "M2", None, "B1", "CALL", "4"), (1, "M2", None, "B1", "HALT", ""), (2, "M1", "n1.xml", "A1", "EXEC", "5"),
    ]
    assert values(containers.tracked_sheets(events, cells).drop("state")) == [(1, "M1", 1, 2, True), (1, "M2", 7, 1, False), (2, "M1", 1, 1, False), (3, "M", 1, 0, False)]


def test_values_carried_over_many_ranges(spark):
    rows = [("a" if i % 5 else None, i, f"v{i}" if i % 17 == 0 else None) for i in range(600)]
    got = {r.i: r.last for r in carried(spark.createDataFrame(rows, "g string, i int, v string").repartition(9), ["g"], ["i"], "v", stored, "last").collect()}
    seen, want = {}, {}
    for g, i, v in rows:
        seen[g] = v or seen.get(g)
        want[i] = seen[g]
    assert got == want


def test_shared_runs(spark):
    chain = lambda path, sectors: [(1, path, s, i) for i, s in enumerate(sectors)]
    rows = chain("a", [10, 11, 12, 13, 50, 51]) + chain("b", [7, 10, 11, 12, 13, 51, 50]) + chain("c", [12, 13]) + [(2, "x", 0, 0), (2, "VBA/m", 0, 4), (2, "x", 2, 1), (2, "VBA/m", 2, 5), (3, "x", 0, 0), (3, "y", 1, 0)]
    got = containers.shared_runs(spark.createDataFrame(rows, "doc_id int, path string, sector int, position int").repartition(3), stored)
    assert values(got) == [(1, ["a", "b", "c"], 12, 13, 2, "medium"), (1, ["a", "b"], 10, 11, 2, "medium"), (2, ["VBA/m", "x"], 0, 2, 2, "high")]


def test_one_row_for_each_document(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    counts = [spark.createDataFrame([(1, 2)], "doc_id long, macro_modules long"), spark.createDataFrame([(2, 1, 0, 3), (3, 0, 0, 1)], "doc_id long, ole_objects long, activex_controls long, external_refs long"), spark.createDataFrame([(9, 1, 1)], "doc_id long, dde_fields long, xlm_macros long")]
    indicators = spark.createDataFrame([(3, "Low"), (4, "High")], "doc_id long, severity string")
    found = overview.document_security(docs, counts, indicators)
    assert {r.doc_id: (r.has_macros, r.has_security_content, r.threat_level, r.threat_indicators) for r in found.collect()} == {
        1: (True, True, "Critical", 0), 2: (False, True, "High", 0), 3: (False, True, "Medium", 1), 4: (False, True, "High", 1), 5: (False, False, "None", 0),
    }


def test_summary_text(spark):
    schema = "doc_id long, file string, format string, title string, author string, modified string, application string, counts array<struct<node_type:string,n:long>>, chars long, words long, threat_level string, macro_modules long, ole_objects long, activex_controls long, external_refs long, dde_fields long, xlm_macros long, indicators array<struct<severity:string,kind:string,description:string>>"
    rows = [(1, None, "Rich Text Format (RTF)", None, None, None, None, [("Run", 2), ("Document", 1)], 5, 1, "None", 0, 0, 0, 0, 0, 0, []),
            (2, "a.docx", "Word Document", "T", None, None, "W", [("Document", 1)], 0, 0, "High", 1, 2, 0, 0, 0, 0, [("High", "OleObject", "OLE object found")])]
    got = {r.doc_id: r.text for r in overview.summary_text(spark.createDataFrame(rows, schema)).collect()}
    rest = "  External References: No\n  DDE Fields: No\n  ActiveX Controls: No\n  XLM Macros: No\n\n"
    assert got[1] == "Document Summary\n================\n\nFormat: Rich Text Format (RTF)\nNodes: 3\n\nStructure:\n  Run: 2\n  Document: 1\n\nText Statistics:\n  Characters: 5\n  Words: ~1\n\nSecurity:\n  Threat Level: NONE\n  VBA Macros: No\n  OLE Objects: No\n" + rest
    assert got[2] == "Document Summary\n================\n\nFile: a.docx\nFormat: Word Document\nNodes: 1\n\nMetadata:\n  Title: T\n  Application: W\n\nStructure:\n  Document: 1\n\nText Statistics:\n  Characters: 0\n  Words: ~0\n\nSecurity:\n  Threat Level: HIGH\n  VBA Macros: YES - DETECTED\n  OLE Objects: 2 found\n" + rest + "Threat Indicators:\n  [HIGH] OleObject: OLE object found\n"


def test_coverage_fields(spark):
    one = lambda text: spark.range(1).select(coverage.csv_field(F.lit(text)).alias("x")).first()["x"]
    assert [one(t) for t in ("plain", 'a "b"', "a,b", "a\nb")] == ["plain", '"a ""b"""', '"a,b"', '"a\nb"'] and one(None) == ""
