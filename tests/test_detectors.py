"""Detectors on literal inputs that hit every name and their near misses, with results written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import directory, ir, objects, records, sectors
from docloom.storage import stored


def mapped(spark, function, inputs):
    """function(text) of each input, in order."""
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, text string")
    return [r["x"] for r in rows.select("i", function(F.col("text")).alias("x")).orderBy("i").collect()]


def test_every_suspicious_call(spark):
    lines = [f"x = {name}(1)" for name in S.SUSPICIOUS_CALLS]
    got = mapped(spark, lambda c: S.suspicious_calls(c)["name"], lines)
    for name, found in zip(S.SUSPICIOUS_CALLS, got):
        also = {"WScript.Shell": {"Shell", "Wscript"}, "Scripting.FileSystemObject": {"FileSystemObject"}}.get(name, set())
        assert set(found) == {name} | also
    near = ["architecture", "MyShell", "Shell_2", "REM Shell", "' Shell", "remShellx = 1", "DeclareFunction", "Chrs(1)"]
    assert [len(x) for x in mapped(spark, S.suspicious_calls, near)] == [0] * len(near)
    assert mapped(spark, lambda c: F.size(S.suspicious_calls(c)), ["x = 1 ' Shell", 'y = "Shell"', "rem: Shell"]) == [1, 1, 0]


def test_every_xlm_name(spark):
    got = mapped(spark, S.dangerous_xlm, [f"={n}(A1)" for n in S.DANGEROUS_XLM])
    assert got == [["FORMULA", n] if n == "FORMULA.FILL" else [n] for n in S.DANGEROUS_XLM]
    assert mapped(spark, S.dangerous_xlm, ["=MYEXEC(1)", "=EXECUTE(1)", "=A1+RUN(1)", "HALT", "=SUM(halt)"]) == [[], [], ["RUN"], ["HALT"], ["HALT"]]


def test_auto_exec_names(spark):
    assert all(mapped(spark, S.is_auto_exec, [n.upper() for n in S.AUTO_EXEC]))
    assert not any(mapped(spark, S.is_auto_exec, ["AutoOpen2", "Workbook", ""]))


DDE = {
    'DDE "excel" "sheet1" "r1c1"': ("DDE", "excel", "sheet1", "r1c1"), 'DDEAUTO "" "topic"': ("DDEAUTO", "unknown", None, None), "dde": ("DDE", "unknown", None, None),
    'DDE "a""b" "unclosed': ("DDE", 'a"b', "unclosed", None), 'ddeauto "cmd" "" "x"': ("DDEAUTO", "cmd", None, "x"), 'DDEX "a"': ("", "a", None, None), 'DDE "a" "': ("DDE", "a", None, None),
}


def test_dde_instructions(spark):
    assert mapped(spark, lambda c: F.struct(*(x.alias(n) for x, n in zip(S.dde(c), "kati"))), DDE) == [tuple(v) for v in DDE.values()]
    assert mapped(spark, lambda c: S.normalized_dde(*S.dde(c)), ['DDE "a" "" "i"', "dde"]) == ["DDE app=a topic=<none> item=i", "DDE app=unknown topic=<none> item=<none>"]
    assert mapped(spark, S.quoted_parts, ['"a" "b', 'x"', '"a""', "none"]) == [["a", "b"], [], ['a"'], []]


URLS = {
    "http://evil.ru/x": True, "http://EVIL%2eRU/x": True, "http://evil.ru./": True, "http://a.example/x.ru": False, "http://bit.ly/x": True, "http://x.bit.ly:80": True, "http://notbit.ly/": False,
    "http://10.0.0.255/": True, "http://300.1.1.999/": False, "http://[::1]/x": True, "http://[2001:db8::2]:8080/": True, "http://0xC0A80101/": True, "http://0x1C0A80101/": False, "\\\\host\\share": True,
    "%5C%5Chost": True, "//cdn": True, "http://user@evil.cn@ok.example/": False, "http://a.example/%zz": False, "": False,
}


def test_suspicious_urls(spark):
    assert dict(zip(URLS, mapped(spark, S.is_suspicious_url, URLS))) == URLS
    assert mapped(spark, S.url_host, ["ftp://u:p@A.b.:21/x?y", "gopher://h/x", "http://[fe80::1]:1/"]) == ["a.b", "gopher", "fe80::1"]
    assert mapped(spark, S.percent_decoded, ["%41b%", "a%2", "%%41"]) == ["ab%", "a%2", "%a"]


def test_payloads(spark):
    cases = {"4D5A": "pe", "D0CF11E0": "office", "504B030414": "zip", "255044462D31": "pdf", "25504446": "script", "68690A": "script", "6800": "unknown", "": "unknown", "E9": "unknown"}
    assert mapped(spark, lambda c: S.payload_class(F.unhex(c)), cases) == list(cases.values())
    assert mapped(spark, lambda c: S.payload_class(F.unhex(F.lit("504B0304")), c), ["a.DOCX", "a.zip", None]) == ["office", "zip", "zip"]
    assert mapped(spark, S.media_type, ["a/b.PNG", "x.ogg", "x.webm", "png", "x.txt"]) == ["Image", "Audio", "Video", "Image", "Other"]
    assert mapped(spark, S.decoded_hex, ["6869", "686", "zz", ""]) == [b"hi", None, None, b""]


def test_paths(spark):
    assert mapped(spark, lambda c: S.cfb_entry_class(c, F.lit("stream")), ["worddocument", "Book", "PowerPoint Document", "x/PROJECT", "a/VBA/m", "x\x01Ole10Native", "Package", "a/contents", "other"]) == [
        "word-main-stream", "excel-main-stream", "powerpoint-main-stream", "vba-project-metadata", "vba-module-stream", "ole-native-payload", "package-payload", "embedded-contents", "stream"]
    assert mapped(spark, lambda c: S.cfb_entry_class(c, F.lit("storage")), ["ObjectPool/_1", "a/vba", "VBAx"]) == ["embedded-object-storage", "vba-storage", "storage"]
    assert mapped(spark, lambda c: S.artifact_kind(c, "ooxml"), ["word/embeddings/a.bin", "word/embeddings/a.xlsx", "xl/media/x", "ppt/activeX/a.dat", "media/x"]) == ["OleObject", None, "MediaAsset", "ActiveXControl", None]
    assert mapped(spark, lambda c: S.artifact_kind(c, "odf"), ["Object 1", "Object 1/", "Pictures/a", "Objects"]) == ["OleObject", None, "MediaAsset", None]
    assert mapped(spark, S.node_id, ["node_ff", "12", "node_", "x1"]) == [255, 12, None, None]
    assert mapped(spark, S.looks_external, ["//x", "\\\\x", "http:x", "a/b:c", "media/x"]) == [True, True, True, False, False]
    assert mapped(spark, S.quoted_strings, ["a 'b c' \"d\"", "none"]) == [["b c", "d"], []]


NODE = "doc_id long, node_id long, format string, node_type string, path string, name string, class_id string, prog_id string, ref_type string, target string, linked boolean, hidden boolean, number long"


@pytest.fixture(scope="module")
def nodes(spark):
    row = lambda i, fmt, kind, **x: (x.get("doc", 1), i, fmt, kind, x.get("path"), x.get("name"), x.get("cls"), x.get("prog"), x.get("ref"), x.get("target"), x.get("linked", False), x.get("hidden", False), x.get("n", 0))
    return spark.createDataFrame([
        row(1, "docx", "OleObject", path="word/embeddings/a.bin", prog="Excel.Sheet"), row(2, "docx", "OleObject", name="x.OCX", linked=True), row(3, "docx", "ActiveXControl", name="ctl"),
        row(4, "docx", "Hyperlink", target="https://x.example"), row(5, "docx", "Hyperlink", target="#here"), row(6, "docx", "Slide", hidden=True, n=7), row(7, "docx", "Worksheet", hidden=True, name="S"),
        row(8, "docx", "Slide"), row(9, "odt", "ExternalReference", doc=2, ref="Image", target="http://x/a", path="content.xml"), row(10, "odt", "OleObject", doc=2, path="Object 1"), row(11, "rtf", "OleObject", doc=3),
    ], NODE)


def test_object_rules(nodes):
    got = sorted((r["rule_id"], r["severity"], r["message"], r["node_id"]) for r in objects.rule_findings(nodes).collect())
    assert got == [
        ("SEC-005", "High", "OLE object: Excel.Sheet", 1), ("SEC-005", "High", "OLE object: unknown", 2), ("SEC-005", "High", "OLE object: unknown", 10), ("SEC-005", "High", "OLE object: unknown", 11),
        ("SEC-007", "High", "ActiveX control detected: ctl", 3), ("SEC-010", "Low", "External reference: http://x/a", 9), ("SEC-011", "Low", "External hyperlink: https://x.example", 4),
        ("STR-001", "Medium", "Hidden worksheet: S", 7), ("STR-002", "Low", "Hidden slide: 7", 6),
    ]
    assert [(r["doc_id"], r["rule_id"], r["message"]) for r in objects.bursts(nodes, 1, 1, 0).orderBy("rule_id").collect()] == [(1, "SEC-006", "OLE objects: 2 (threshold 1)"), (1, "SEC-012", "External links: 1 (threshold 0)")]


def test_indicators_of_formats(nodes):
    got = sorted((r["doc_id"], r["indicator"], r["description"], r["location"] or "", r["node_id"] or 0) for r in objects.format_indicators(nodes).collect())
    assert got == [
        (1, "ActiveXControl", "ActiveX control binary found at x.OCX", "x.OCX", 2), (1, "ActiveXControl", "ActiveX control found", "", 3), (1, "OleObject", "OLE object found at word/embeddings/a.bin", "word/embeddings/a.bin", 1),
        (2, "OleObject", "Embedded OLE object", "", 0), (2, "RemoteResource", "Remote resource: http://x/a", "content.xml", 0), (3, "OleObject", "Embedded OLE object", "rtf", 11),
    ]
    assert [(r["node_id"], r["severity"]) for r in objects.analyzer_findings(nodes).orderBy("node_id").collect()] == [(1, "Medium"), (2, "High"), (3, "High"), (9, "Medium"), (10, "Medium"), (11, "Medium")]
    assert {r["doc_id"]: r["threat_level"] for r in objects.threat_levels(nodes).collect()} == {1: "High", 2: "High", 3: "High"}


def test_auto_open_of_sheets(spark):
    sheets = spark.createDataFrame([(1, 1, "Macro1"), (1, 2, "Other"), (2, 3, "A"), (2, 4, "B"), (3, 5, "C")], "doc_id long, node_id long, sheet string")
    names = spark.createDataFrame([(1, "auto_open", "MACRO1"), (1, "Auto_Open", None), (2, "_xlnm.Auto_Open", None), (3, "Print_Area", "C")], "doc_id long, name string, target string")
    marked = lambda every: {r["node_id"] for r in objects.auto_open(sheets, names, every).filter("auto_open").collect()}
    assert marked(False) == {1, 3} and marked(True) == {1, 3, 4}


def test_directory_tags(spark):
    schema = "slot long, left long, right long, child long, state string, entry_type string, name_length int, size long, start long"
    slots = spark.createDataFrame([
        (0, None, None, 1, "normal", "root-storage", 4, 0, 0), (1, 2, None, None, "normal", "stream", 4, 9, 99), (2, 1, 9, None, "normal", "stream", 0, 9, 1), (3, None, 3, None, "free", "unknown", 0, 0, 0),
        (4, None, None, 2, "orphaned", "stream", 3, 5, 0xFFFFFFFF), (5, None, None, 5, "normal", "storage", 3, 0, 0),
    ], schema)
    reach = directory.reached(slots.filter("slot = 0").select("slot"), directory.pointer_rows(slots).select("source", "target"), stored)
    tags = {}
    for r in directory.tags(slots, reach, 50).collect():
        tags.setdefault(r["slot"], set()).add(r["tag"])
    assert tags == {
        1: {"invalid-start-sector", "multi-referenced-entry", "sibling-2-cycle"}, 2: {"zero-name-length", "dangling-right-sibling", "multi-referenced-entry", "incoming-from-anomalous-entry", "sibling-2-cycle"},
        3: {"free-slot", "unknown-entry-type", "self-right-sibling", "incoming-from-anomalous-entry", "sibling-2-cycle", "sibling-3-cycle"}, 4: {"orphaned-entry"},
        5: {"self-child", "unreachable-live-entry", "child-2-cycle", "child-3-cycle"},
    }
    assert mapped(spark, directory.tag_severity, ["self-child", "free-slot", "orphaned-entry", "new"]) == ["high", "low", "medium", "medium"]


def test_diamonds_are_walked_once(spark):
    edges = [(3 * i + a, 3 * i + b, o) for i in range(8) for a, b, o in ((0, 1, 0), (0, 2, 1), (1, 3, 0), (2, 3, 0))] + [(24, 0, 0)]
    frame = spark.createDataFrame(edges, "parent long, child long, ord long")
    found = ir.closure(frame, spark.createDataFrame([(0,)], "root long"), stored)
    rows = [(r["node"], tuple(r["place"])) for r in found.collect()]
    assert len(rows) == 25 and [n for n, _ in sorted(rows, key=lambda x: x[1])][:5] == [0, 1, 3, 4, 6]
    pruned = ir.closure(frame, spark.createDataFrame([(0,)], "root long"), stored, skip=F.col("node") == 3)
    assert {r["node"] for r in pruned.collect()} == {0, 1, 2, 3}


def test_structural_score(spark):
    """The worst kind of evidence counts; none at all is a score too."""
    levels = {("sector:shared-sector", "directory:invalid-start"): "high", ("directory:cycle:child-2-cycle",): "high", ("sector:truncated-chain:fat:VBA",): "medium", ("directory:invalid-start",): "low", (): "none"}
    for found, level in levels.items():
        rows = spark.createDataFrame([(e, 2) for e in found], "evidence string, n long")
        assert [tuple(r) for r in sectors.structural_score(rows).collect()] == [(level, len(found), 2 * len(found))]


def test_record_anomalies(spark):
    """Streams of two records of 6 and 10 bytes that end early, or in time."""
    rows = [(cut, seq, size, 0x809) for cut in range(12) for seq, size in ((0, 2), (1, 6))]
    rows = records.offsets(spark.createDataFrame(rows, "cut int, seq int, size int, type int"), "cut", "size").withColumn("total", 16 - F.col("cut"))
    got = {r.cut: (r.offset, r.anomaly, r.message) for r in records.anomalies(rows, "size", "type", "total").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    assert got[1] == (6, "truncated-record", "record 0x0809 declares 6 byte(s) but stream ends after 5")
    assert got[7] == (6, "trailing-bytes", "3 trailing byte(s) after last complete record header")
    assert got[11] == (0, "truncated-record", "record 0x0809 declares 2 byte(s) but stream ends after 1")
