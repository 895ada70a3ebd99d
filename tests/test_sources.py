"""Readers, sinks, formulas and streams on small files made here."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from docloom.operators import formula
from docloom.sources import cfb, files, office, package, sinks
from docloom.streaming import ingest

RTF = rb"""{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\pard First\~line \'e9\par Second {\i slanted}\par
{\field{\*\fldinst{HYPERLINK "ftp://files.test/list.txt"}}{\fldrslt{the list}}}\par {\object\objemb{\*\objclass Paint.Picture}{\*\objdata 4142}}}"""


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'
DOCX = zipped(**{
    "[Content_Types].xml": '<Types><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:hyperlink r:id="rId1"><w:r><w:t>world</w:t></w:r></w:hyperlink></w:p></w:body></w:document>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId1" Type="http://x/hyperlink" Target="http://evil.ru/a" TargetMode="External"/></Relationships>',
})
XLSX = zipped(**{
    "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>SUM(1)</f><v>1</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>',
})
ODT = zipped(**{"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o xmlns:t="t"><t:p>One <t:a href="http://x">link</t:a></t:p></o>'})


def compound() -> bytes:
    head = bytearray(512)
    head[:8] = cfb.MAGIC
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<II", head, 68, cfb.END, 0)
    struct.pack_into("<109I", head, 76, 0, *[cfb.FREE] * 108)
    body = struct.pack("<HH", 0x809, 4) + b"abcd" + struct.pack("<HH", 10, 0)
    data = body.ljust(4608, b"\0")
    fat = [0xFFFFFFFD, cfb.END, *range(3, 11), cfb.END]
    entry = lambda name, kind, child, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", cfb.NONE, cfb.NONE, child)).ljust(100, b"\0") + struct.pack("<QQIQ", 0, 0, start, size)
    directory = (entry("Root Entry", 5, 1, cfb.END, 0) + entry("Workbook", 2, cfb.NONE, 2, 4608)).ljust(512, b"\0")
    return bytes(head) + struct.pack("<128I", *fat, *[cfb.FREE] * (128 - len(fat))) + directory + data


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, data in {"a.rtf": RTF, "b.docx": DOCX, "c.xlsx": XLSX, "d.odt": ODT, "e.doc": compound(), "f.rtf": b"{\\rtf1 {open", "g.bin": b"", "h.zip": b"PK\x03\x04broken"}.items():
        (d / name).write_bytes(data)
    return files.scan(spark, str(d))


def test_sniff_and_size_guard(spark, found, tmp_path):
    got = {r["path"].rpartition("/")[2][0]: r["k"] for r in found.select("path", files.sniffed(found["content"]).alias("k")).collect()}
    assert got == {"a": "rtf", "b": "zip", "c": "zip", "d": "zip", "e": "cfb", "f": "rtf", "h": "zip"}  # empty files give no row
    (tmp_path / "big").write_bytes(b"x" * 100)
    assert files.scan(spark, str(tmp_path), most=10).first()["error"] == "input-too-large"


def test_rtf(found):
    rows = office.rtf_documents(found).toPandas()
    good = rows[rows["path"].str.endswith("a.rtf")]
    assert good[good["node_type"] == "Paragraph"]["text"].tolist()[:2] == ["First line é", "Second slanted"]
    assert good[good["node_type"] == "Hyperlink"]["target"].tolist() == ["ftp://files.test/list.txt"]
    assert good[good["node_type"] == "OleObject"]["text"].tolist() == ["Paint.Picture"]
    assert "Diagnostic" in rows[rows["path"].str.endswith("f.rtf")]["node_type"].tolist()


def test_packages(found):
    parts = package.parts(found)
    formats = package.formats(parts)
    assert {r["path"][-6:].split(".")[-1]: r["format"] for r in formats.collect()} == {"docx": "docx", "xlsx": "xlsx", "odt": "odt"}
    nodes = office.package_documents(parts, formats).toPandas()
    text = lambda end, kind: nodes[nodes["path"].str.endswith(end) & (nodes["node_type"] == kind)]["text"].tolist()
    assert text("docx", "Run") == ["Hello ", "world"]
    assert text("xlsx", "Cell") == ["name", "=SUM(1)", "2.5"]
    assert text("odt", "Paragraph") == ["One link"]
    rel = package.relationships(parts).collect()
    assert [(r["source"], r["rel_type"], r["target"], r["external"]) for r in rel] == [("word/document.xml", "hyperlink", "http://evil.ru/a", True)]
    assert [r["error"] for r in parts.filter("error is not null").collect()] == ["bad-archive"]


@pytest.mark.parametrize(("name", "error"), [("../x", "path-traversal"), ("a/%2e%2e/b", "path-traversal"), ("C:/x", "path-traversal"), ("ok/x.xml", None), ("a/" * 25 + "x", "too-deep")])
def test_entry_guard(name, error):
    assert package.entry_error(name, 10, 10) == error
    assert package.entry_error("x", 10**6, 10) == "compression-ratio"


def test_compound(found):
    assert [(r["name"], r["entry_type"]) for r in cfb.slots(found).orderBy("slot").limit(2).collect()] == [("Root Entry", "root"), ("Workbook", "stream")]
    assert [r["sector"] for r in cfb.chains(found).orderBy("pos").collect()] == list(range(2, 11))
    assert [(r["offset"], r["record_type"], r["size"]) for r in cfb.sheet_records(found).orderBy("seq").limit(2).collect()] == [(0, 0x809, 4), (8, 10, 0)]


def test_broken_files_leave_the_others_whole(spark, found, tmp_path):
    """A cut allocation list, a wrong checksum, an encrypted entry, deep nesting, and bad shared strings in one folder."""
    whole = found.filter("path not like '%h.zip' and path not like '%f.rtf'")
    cut = bytearray(compound())
    struct.pack_into("<II", cut, 68, 5000, 1)
    wide = bytearray(compound())
    struct.pack_into("<H", wide, 30, 60)
    crc = bytearray(zipped(**{"a.xml": "<a/>" * 50, "b.xml": "<b/>"}))
    crc[14:18] = b"\1\2\3\4"
    at = crc.index(b"PK\1\2")
    crc[at + 16 : at + 20] = b"\1\2\3\4"
    locked = bytearray(zipped(**{"a.xml": "<a/>"}))
    for at, n in ((0, 6), (locked.index(b"PK\1\2"), 8)):
        locked[at + n] |= 1
    types = '<Types><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    deep = zipped(**{"[Content_Types].xml": types, "word/document.xml": "".join(f"<p i='{i * 7919 % 10007}'>" for i in range(3000)) + "</p>" * 3000, "word/footnotes.xml": f"<w:d {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:d>"})
    shared = zipped(**{"[Content_Types].xml": types.replace("wordprocessingml.document", "spreadsheetml.sheet").replace("word/document", "xl/workbook"), "xl/sharedStrings.xml": "<sst><si>", "xl/worksheets/s.xml": '<s><c r="A1" t="s"><v>0</v></c></s>'})
    for name, data in {"1.doc": cut, "2.zip": crc, "3.zip": locked, "4.docx": deep, "5.xlsx": shared, "6.doc": wide}.items():
        (tmp_path / name).write_bytes(data)
    both = whole.unionByName(files.scan(spark, str(tmp_path)))
    rows = lambda df: sorted(map(repr, df.collect()))
    name = lambda p: p.rpartition("/")[2]
    assert rows(cfb.slots(both)) == rows(cfb.slots(whole)) and rows(cfb.chains(both)) == rows(cfb.chains(whole)) and rows(cfb.sheet_records(both)) == rows(cfb.sheet_records(whole))
    assert {name(r["path"]): r["error"] for r in cfb.faults(both).collect()} == {"1.doc": "a sector of the allocation list is cut off", "6.doc": "sectors of 2^60 bytes"}
    parts = package.parts(both)
    assert {(name(r["path"]), r["part"], r["error"]) for r in parts.filter("error is not null").collect()} == {("2.zip", "a.xml", "bad-entry"), ("3.zip", "a.xml", "encrypted")}
    assert parts.filter("path like '%2.zip' and part = 'b.xml'").first()["content"] == b"<b/>"
    nodes, good = (office.package_documents(p, package.formats(p)) for p in (parts, package.parts(whole)))
    fresh = nodes.filter("path like '%.docx' and path like '%4.docx' or path like '%5.xlsx'").collect()
    assert sorted((name(r["path"]), r["node_type"]) for r in fresh if r["node_type"] in ("Diagnostic", "Run", "Cell")) == [("4.docx", "Diagnostic"), ("4.docx", "Run"), ("5.xlsx", "Cell"), ("5.xlsx", "Diagnostic")]
    assert rows(nodes.filter("path not like '%4.docx' and path not like '%5.xlsx'")) == rows(good)


def test_package_xml_with_errors(spark, tmp_path):
    types = '<Types><Default Extension="xml" ContentType="{}"/><Default Extension="XML" ContentType="t"/></Types>'.format(next(iter(package.MAIN_TYPES)))
    rels = '<Relationships><Relationship Id="a" Type="t" Target="x"/><Relationship Id="a" Type="t" Target="y"/></Relationships>'
    good = types.replace('<Default Extension="XML" ContentType="t"/>', "")
    for name, data in {"bad.docx": zipped(**{"[Content_Types].xml": types, "word/_rels/document.xml.rels": rels}), "good.docx": zipped(**{"[Content_Types].xml": good, "_rels/.rels": rels.replace('"a" Type="t" Target="y"', '"b" Type="u/v" Target="y" TargetMode="external"')})}.items():
        (tmp_path / name).write_bytes(data)
    parts = package.parts(files.scan(spark, str(tmp_path)))
    got = {r["path"].rpartition("/")[2]: (r["format"], r["error"]) for r in package.formats(parts).collect()}
    assert got == {"bad.docx": ("zip", "[Content_Types].xml contains duplicate Default extension: xml"), "good.docx": ("docx", None)}
    assert [(r["part"], r["error"]) for r in package.relationship_faults(parts).collect()] == [("word/_rels/document.xml.rels", "word/_rels/document.xml.rels contains duplicate relationship Id: a")]
    assert sorted((r["source"], r["rel_id"], r["rel_type"], r["external"]) for r in package.relationships(parts).collect()) == [("", "a", "t", False), ("", "b", "v", True)]


def test_files_over_the_guard_are_not_read(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"x" * 10)
    (tmp_path / "large").write_bytes(b"x" * 5000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # reading a longer one fails the job
    try:
        got = {r["path"].rpartition("/")[2]: (r["content"], r["error"]) for r in files.scan(spark, str(tmp_path), most=100).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert got == {"small": (bytearray(b"x" * 10), None), "large": (None, "input-too-large")}


def test_sinks(spark, found, tmp_path):
    nodes = office.rtf_documents(found)
    sinks.write_json(nodes, f"{tmp_path}/j", without=("target",))
    assert "target" not in spark.read.json(f"{tmp_path}/j").columns
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_json(nodes, f"{tmp_path}/j")
    sinks.write_csv(nodes.select("path", "node_type"), f"{tmp_path}/c")
    assert sinks.node_json(nodes).count() == 2


@pytest.mark.parametrize(("text", "value"), [
    ("=SUM([.A1:.B1]) * 2", 10), ("of:=A1+B1*2", 8), ("=-(A1)/0", None), ("=AVERAGE(D9:D10)", None), ("=COUNT(A1;B1;D9)", 2), ("=MAX(A1;7)-MIN(B1,1)", 6),
    ("=A2", None), ("=UNKNOWN(1)", None), ("=1+", None), ("=(1", None), ("=2*A3", 40), ("=SUM(A1:A3)", 22), ("=MIN()", 0), ("=A1:B1", None), ("=SUM(XFD1:A1048576)", None), ("=MAX(-A1,-$B$1)", -2),
])
def test_formulas(text, value):
    held = {(0, 0, 0, 0): (2.0, 1, 2.0, 2.0), (0, 1, 0, 1): (3.0, 1, 3.0, 3.0), (0, 0, 0, 1): (5.0, 2, 2.0, 3.0), (0, 0, 2, 0): (2.0, 1, 2.0, 2.0)}
    sheet = formula.Sheet(held, {(1, 0): "=A2+1", (2, 0): "=SUM(A1:B1)*4"})
    assert sheet.evaluate(text) == value


def test_formulas_over_blocks_of_rows(spark):
    """Ranges across blocks, in either direction, over values, formulas and a cycle; nulls and an empty table."""
    rows = [(1, "s", i, 0, float(i), None) for i in range(3000)] + [
        (1, "s", 0, 1, None, "=SUM($A$1:A3000)"), (1, "s", 1, 1, None, "=COUNT(A2500:A1000;B1)"), (1, "s", 2, 1, None, "=MAX([.A10:.A20])+B1"), (1, "s", 3, 1, None, "=B5"), (1, "s", 4, 1, None, "=B4"),
        (1, "t", 0, 1, None, "=SUM(A1:A3000)"), (None, "s", 0, 0, None, "=1"), (1, None, 0, 0, None, "=1"), (1, "s", 9, 9, None, None),
    ]
    cells = spark.createDataFrame(rows, "doc_id long, sheet string, row int, col int, value double, formula string")
    got = {(r["sheet"], r["row"]): None if r["value"] is None or r["value"] != r["value"] else r["value"] for r in formula.evaluated(cells).collect()}
    total = 3000 * 2999 / 2
    assert got == {("s", 0): total, ("s", 1): 1502.0, ("s", 2): 19 + total, ("s", 3): None, ("s", 4): None, ("t", 0): 0.0}
    assert formula.evaluated(cells.filter("false")).count() == 0


def test_formulas_fill_empty_cells(spark):
    cells = spark.createDataFrame([(1, "s", 0, 0, 2.0, None), (1, "s", 0, 1, 3.0, "=9"), (1, "s", 0, 2, None, "=SUM(A1:B1)"), (2, "s", 0, 0, None, "=1/0")], "doc_id long, sheet string, row int, col int, value double, formula string")
    assert sorted((r["doc_id"], r["col"], r["value"]) for r in formula.evaluated(cells).collect() if r["value"] == r["value"] and r["value"] is not None) == [(1, 2, 5.0)]


def test_streams(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    documents.repartition(3).write.parquet(f"{tmp_path}/in")
    query = ingest.text_stats_stream(ingest.document_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("stats").count() == documents.count()
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = ingest.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counts").groupBy().sum("n").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
