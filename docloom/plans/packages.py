"""Registered queries over package parts, streams, records and runs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import parts as P
from docloom.functions import scalars as S
from docloom.operators import packages
from docloom.plans import views as V
from docloom.plans.catalogue import query
from docloom.plans.nodes import _chosen, _expected

#: (base, target) to the part name, by hand.
RESOLVED = {
    ("word/document.xml", "media/image1.png"): "word/media/image1.png", ("ppt/slides/slide1.xml", "../media/a.png"): "ppt/media/a.png",
    ("word/document.xml", "/xl/workbook.xml"): "xl/workbook.xml", ("word/document.xml", r"..\customXml\item1.xml"): "customXml/item1.xml",
    ("word/document.xml", "../../up.xml"): "../up.xml", ("a.xml", "../../../x"): "../x", ("a.xml", "./b//c/."): "b/c", ("a/b/c.xml", ""): "a/b",
    ("a/b.xml", "https://x.example/../y"): "https://x.example/../y", ("a/b.xml", r"\\host\share"): r"\\host\share", ("a/b.xml", "mailto:x@y"): "mailto:x@y",
    ("a/b.xml", "1x:y"): "a/1x:y", ("//a///b.xml", "c"): "a/c", (None, "c"): None, ("a/b.xml", None): None, ("a/b.xml", r"\root.xml"): "root.xml",
}


@query("targets_resolved", f"SELECT p_partkey, resolved FROM part JOIN (VALUES {_expected((v,) for v in RESOLVED.values())}) e(i, resolved) ON p_partkey % {len(RESOLVED)} = i")
def targets_resolved(spark, d):
    pick = lambda at: _chosen([k[at] for k in RESOLVED], F.col("p_partkey"))
    return V.table(spark, d, "part").select("p_partkey", P.resolved_target(pick(0), pick(1)).alias("resolved"))


#: Formula to the arguments of its first EXEC, by hand.
CALLS = {
    '=EXEC("calc")': '"calc"', "=exec (A1,SUM(B1:B2),1)+CALL(2)": "A1,SUM(B1:B2),1", '=EXEC("a)b""c(")': '"a)b""c("', "=MYEXEC(1)+EXEC(2)": "2", "=EXEC.X(1)": None,
    "=EXEC(1": None, "=EXEC + EXEC()": "", '="EXEC(" & 1': None, "=$EXEC(1)": None, "=SUM(1)": None, "=EXEC(1)+EXEC(2)": "1", "": None,
}


@query("xlm_call_arguments", f"SELECT p_partkey, args FROM part JOIN (VALUES {_expected((v,) for v in CALLS.values())}) e(i, args) ON p_partkey % {len(CALLS)} = i")
def xlm_call_arguments(spark, d):
    return V.table(spark, d, "part").select("p_partkey", P.call_arguments(_chosen(CALLS, F.col("p_partkey")), "EXEC").alias("args"))


#: Text to its non-empty quoted strings, by hand.
QUOTED = {"""a "b" 'c'""": "b|c", "'it''s'": "it|s", '"" x "y': "y", '"a\'b"': "a'b", "none": "", "'": "", '\'x"y\' "z"': 'x"y|z'}


@query("quoted_strings", f"SELECT p_partkey, found FROM part JOIN (VALUES {_expected((v,) for v in QUOTED.values())}) e(i, found) ON p_partkey % {len(QUOTED)} = i")
def quoted_strings(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.array_join(S.quoted_strings(_chosen(QUOTED, F.col("p_partkey"))), "|").alias("found"))


#: Hex text to its bytes in lower-case hex, by hand.
HEX = {"4d5A": "4d5a", "abc": None, "zz": None, "00": "00", "4 5a": None, "ff00FF": "ff00ff"}


@query("hex_blobs", f"SELECT p_partkey, blob FROM part JOIN (VALUES {_expected((v,) for v in HEX.values())}) e(i, blob) ON p_partkey % {len(HEX)} = i")
def hex_blobs(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.lower(F.hex(S.decoded_hex(_chosen(HEX, F.col("p_partkey"))))).alias("blob"))


#: A customer's streams are its orders, named by their keys.
STREAMS = ("FileHeader", "worddocument", "Workbook", "BOOK", "PowerPoint Document", "Current User", "!_StringPool", "Root/Data", "1Table", "CompObj", "Pictures", "Contents")
V.SQL["cfb"] = f"SELECT o_custkey AS doc_id, o_orderkey AS ord, list_extract({V._list(STREAMS)}, (o_orderkey * 5 + o_custkey) % {len(STREAMS)} + 1) AS path FROM orders"


def _cfb(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return V.table(spark, d, "orders").select(c.alias("doc_id"), k.alias("ord"), _chosen(STREAMS, k * 5 + c).alias("path"))


_LADDER = (
    ("lower(path) = 'fileheader'", "hwp", "hangul-word-processor", "hwp", "high", ",stream:FileHeader"), ("lower(path) = 'worddocument'", "doc", "word-processing", "doc", "high", ",stream:WordDocument"),
    ("lower(path) IN ('workbook', 'book')", "xls", "spreadsheet", "xls", "high", ",stream:Workbook"), ("lower(path) = 'powerpoint document'", "ppt", "presentation", "ppt", "high", ",stream:PowerPoint Document"),
    ("lower(path) = 'current user'", "office-legacy", "office-legacy", "ole", "medium", ",legacy-office-layout"), ("lower(path) LIKE '!\\_string%' ESCAPE '\\'", "msi", "installer-package", "msi", "medium", ",stream:!_StringData"),
    ("true", "ole", "compound-file", "ole", "medium", ""),
)
_RUNGS = ", ".join(f"({i}, '{f}', '{a}', '{e}', '{c}', 'cfb-signature{s}')" for i, (_, f, a, e, c, s) in enumerate(_LADDER))


@query("cfb_probes", V.sql(f"""SELECT doc_id, format, family, extension, confidence, signals FROM (SELECT doc_id, min(CASE {' '.join(f'WHEN {w} THEN {i}' for i, (w, *_) in enumerate(_LADDER))} END) AS i FROM cfb GROUP BY doc_id)
    JOIN (VALUES {_RUNGS}) e(i, format, family, extension, confidence, signals) USING (i)""", "cfb"))  # fmt: skip
def cfb_probes(spark, d):
    return packages.cfb_probes(_cfb(spark, d))


@query("stream_name_matches", V.sql("SELECT w.doc_id, w.name, arg_min(s.path, s.ord) AS path FROM (SELECT DISTINCT doc_id, unnest(['WORDDOCUMENT', 'book', 'Absent']) AS name FROM cfb) w LEFT JOIN cfb s ON s.doc_id = w.doc_id AND lower(s.path) = lower(w.name) GROUP BY ALL", "cfb"))
def stream_name_matches(spark, d):
    streams = _cfb(spark, d)
    wanted = streams.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("WORDDOCUMENT"), F.lit("book"), F.lit("Absent"))).alias("name"))
    return packages.case_matches(wanted, streams)


MAINS, KINDS = ("word/document.xml", "xl/workbook.xml", "ppt/slides/slide1.xml", "docProps/core.xml", "notes"), ("WordProcessing", "Spreadsheet", "Presentation", "Rtf")


@query("main_part_faults", V.sql(f"""+m AS (SELECT o_orderkey AS doc_id, list_extract({V._list(KINDS)}, o_custkey % 4 + 1) AS format, list_extract({V._list(MAINS)}, (o_custkey + o_orderkey) % 5 + 1) AS main FROM orders)
    SELECT *, CASE WHEN (doc_id, main) NOT IN (SELECT doc_id, path FROM parts) THEN 'missing-part' WHEN format = 'Rtf' THEN 'unsupported-format' WHEN split_part(main, '/', 1) <> CASE format WHEN 'WordProcessing' THEN 'word' WHEN 'Spreadsheet' THEN 'xl' ELSE 'ppt' END THEN 'invalid-format' END AS fault FROM m""", "parts"))  # fmt: skip
def main_part_faults(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mains = V.table(spark, d, "orders").select(k.alias("doc_id"), _chosen(KINDS, c).alias("format"), _chosen(MAINS, c + k).alias("main"))
    return packages.main_part_faults(mains, V.parts(spark, d))


@query("sanitized_chains", V.sql("""+f AS (SELECT stream, min(pos) AS bad FROM chains WHERE sector >= 150 GROUP BY stream), g AS (SELECT c.stream, count(*) FILTER (WHERE bad IS NULL OR pos < bad) AS kept, count(*) AS n FROM chains c LEFT JOIN f ON f.stream = c.stream GROUP BY c.stream)
    SELECT g.stream, kept, n - kept AS cut, CASE WHEN n > kept THEN CASE WHEN o_custkey % 4 = 0 THEN 'empty' ELSE 'truncated' END END AS state FROM g JOIN orders ON o_orderkey = g.stream""", "chains"))  # fmt: skip
def sanitized_chains(spark, d):
    """Chains of lineitem, cut at the first sector of 150 or more; a stream's size is by its order's customer."""
    size = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), (F.col("o_custkey") % 4).alias("size"))
    return packages.sanitized_chains(V.chains(spark, d), 150, size)


@query("paragraph_texts", """SELECT p AS paragraph, coalesce(string_agg(t, '' ORDER BY o, t) FILTER (WHERE NOT h), '') AS text, string_agg(t, '' ORDER BY o, t) AS full_text
    FROM (SELECT l_orderkey AS p, l_linenumber AS o, l_linenumber % 3 = 0 AS h, l_returnflag || l_partkey || ' ' AS t FROM lineitem) GROUP BY p""")  # fmt: skip
def paragraph_texts(spark, d):
    """A run for each lineitem of an order; every third one is inside a hyperlink."""
    n = F.col("l_linenumber")
    text = F.concat("l_returnflag", F.col("l_partkey").cast("string"), F.lit(" "))
    runs = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paragraph"), n.alias("ord"), text.alias("text"), F.when(n % 3 == 0, n).alias("hyperlink"))
    return packages.paragraph_texts(runs)


_RECORDS = {"signup": (0x03E8, "Document"), "click": (0x0FA0, "TextCharsAtom"), "view": (0x03EE, "Slide"), "purchase": (0x0F00, "Unknown"), "error": (0x1388, "ProgTags")}
V.SQL["slide_records"] = "SELECT user_id, seq % 5 AS depth, event_type IN ('signup', 'view', 'error') AS is_container, CASE event_type " + " ".join(f"WHEN '{k}' THEN '0x{t:04X}:{n}'" for k, (t, n) in _RECORDS.items()) + " END AS kind FROM stream"
V.NEEDS["slide_records"] = ("stream",)


def _slide_records(spark, d):
    kind = F.create_map(*(x for k, (t, n) in _RECORDS.items() for x in (F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")))))[F.col("event_type")]
    return V.stream(spark, d).select("user_id", (F.col("seq") % 5).alias("depth"), F.col("event_type").isin("signup", "view", "error").alias("is_container"), kind["t"].alias("record_type"), kind["n"].alias("record_name"))


@query("slide_record_totals", V.sql("SELECT user_id, count(*) AS records, count(*) FILTER (WHERE is_container) AS containers, max(depth) AS max_depth FROM slide_records GROUP BY user_id", "slide_records"))
def slide_record_totals(spark, d):
    return packages.slide_records(_slide_records(spark, d), "user_id").withColumn("max_depth", F.col("max_depth").cast("long"))


@query("slide_record_buckets", V.sql("SELECT unnest([kind, 'depth:' || depth]) AS bucket, count(*) AS n FROM slide_records GROUP BY 1 HAVING bucket IS NOT NULL", "slide_records"))
def slide_record_buckets(spark, d):
    return packages.slide_buckets(_slide_records(spark, d)).filter("bucket is not null")


@query("inventory_order", V.sql("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(path, ''), list_position(['MediaAsset', 'OleObject', 'ActiveXControl', 'ExternalReference', 'Hyperlink', 'Slide', 'Worksheet'], node_type), node_id) AS place FROM objects", "objects"))
def inventory_order(spark, d):
    kinds = F.array(*(F.lit(k) for k in ("OleObject", "ActiveXControl", "ExternalReference", "Hyperlink", "Slide", "Worksheet")))
    rows = packages.places(V.objects(spark, d), "doc_id", F.coalesce("path", F.lit("")), F.array_position(kinds, F.col("node_type")), F.col("node_id"))
    return rows.select("doc_id", "node_id", F.col("place").cast("long").alias("place"))


@query("dde_order", V.sql("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY path NULLS FIRST, number, coalesce(prog_id, ''), node_id) AS place FROM objects WHERE node_type IN ('OleObject', 'Hyperlink')", "objects"))
def dde_order(spark, d):
    """Fields by place (file and line, those without one first), then instruction."""
    rows = V.objects(spark, d).filter("node_type in ('OleObject', 'Hyperlink')")
    rows = packages.places(rows, "doc_id", F.col("path").asc_nulls_first(), F.col("number"), F.coalesce("prog_id", F.lit("")), F.col("node_id"))
    return rows.select("doc_id", "node_id", F.col("place").cast("long").alias("place"))


@query("relationship_order", V.sql("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY 'rId' || number, node_id) AS place FROM objects WHERE node_type = 'ExternalReference'", "objects"))
def relationship_order(spark, d):
    """By id as text: ``rId10`` before ``rId2``."""
    rows = packages.places(V.objects(spark, d).filter("node_type = 'ExternalReference'"), "doc_id", F.concat(F.lit("rId"), F.col("number").cast("string")), F.col("node_id"))
    return rows.select("doc_id", "node_id", F.col("place").cast("long").alias("place"))


@query("macro_project_order", V.sql("SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(path, ''), coalesce(function, ''), sheet, node_id) AS place, min(node_id) OVER (PARTITION BY doc_id) = node_id AS is_first FROM sheets", "sheets"))
def macro_project_order(spark, d):
    """Projects by container, storage root and name; the first one of a document is that of the least id."""
    blank = F.lit("")
    rows = packages.places(V.sheets(spark, d), "doc_id", F.coalesce("path", blank), F.coalesce("function", blank), F.col("sheet"), F.col("node_id"))
    first = rows.groupBy("doc_id").agg(F.min("node_id").alias("least"))
    return rows.join(first, "doc_id").select("doc_id", "node_id", F.col("place").cast("long").alias("place"), (F.col("node_id") == F.col("least")).alias("is_first"))


STATES = ("Extracted", "Partial", "DecodeFailed", "MissingStream", "NotRequested")
#: By state: without errors and with one, without source; then with source.
_REPORTED = ("recognized", "partial", "error", "recognized", "recognized")


@query("macro_module_status", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN i = 0 AND l_suppkey % 2 = 0 THEN 'extracted' WHEN i = 3 AND l_linenumber % 2 = 1 THEN 'partial' ELSE list_extract({V._list(_REPORTED)}, i + 1) END AS status FROM (SELECT *, l_partkey % 5 AS i FROM lineitem)")
def macro_module_status(spark, d):
    state = _chosen(STATES, F.col("l_partkey"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.module_status(state, F.col("l_linenumber") % 2, F.col("l_suppkey") % 2 == 0).alias("status"))


@query("pivot_sheets", V.sql("SELECT c_custkey AS pivot, max(s.node_id) AS sheet FROM customer LEFT JOIN sheets s ON s.doc_id = c_nationkey AND s.sheet = 'Macro' || c_custkey % 9 GROUP BY c_custkey", "sheets"))
def pivot_sheets(spark, d):
    """The sheet that a pivot table names; of sheets of one name the last."""
    sheets = V.sheets(spark, d).groupBy("doc_id", "sheet").agg(F.max("node_id").alias("last"))
    name = F.concat(F.lit("Macro"), (F.col("c_custkey") % 9).cast("string"))
    pivots = V.table(spark, d, "customer").select(F.col("c_custkey").alias("pivot"), F.col("c_nationkey").cast("long").alias("doc_id"), name.alias("sheet"))
    return pivots.join(sheets, ["doc_id", "sheet"], "left").select("pivot", F.col("last").alias("sheet"))


@query("rule_context", "SELECT d.doc_id, lang, source, l.quality, l.doc_id IS NOT NULL AS has_metadata FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def rule_context(spark, d):
    """Each document with its metadata, where there is any."""
    metadata = V.table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    return V.table(spark, d, "documents").select("doc_id", "lang", "source").join(metadata, "doc_id", "left").select("doc_id", "lang", "source", "quality", F.coalesce("has", F.lit(False)).alias("has_metadata"))


@query("resource_guards", "SELECT l_orderkey AS doc_id, count(*) AS cells, count(DISTINCT l_linenumber) AS rows, CASE WHEN count(*) > 5 THEN 'cells limit exceeded' WHEN count(DISTINCT l_linenumber) > 3 THEN 'rows limit exceeded' END AS fault FROM lineitem GROUP BY 1")
def resource_guards(spark, d):
    counts = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("cells"), F.count_distinct("l_linenumber").alias("rows"))
    return packages.guarded(counts, cells=5, rows=3)


@query("core_properties", "SELECT p_partkey, p_name AS title, p_brand AS creator, CASE WHEN p_size % 3 <> 0 THEN p_type END AS subject, CAST(NULL AS VARCHAR) AS keywords, CASE WHEN p_size % 2 = 0 THEN '2024-01-0' || (p_size % 9 + 1) END AS modified FROM part")
def core_properties(spark, d):
    """Read from a core-properties part written of each part's row: an absent element and an empty one are both null."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    size = F.col("p_size")
    xml = F.concat(
        F.lit('<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t">'), tag("dc:title", F.col("p_name")), tag("dc:creator", F.col("p_brand")), tag("dc:subject", F.when(size % 3 != 0, F.col("p_type")).otherwise("")),
        F.when(size % 2 == 0, tag("dcterms:modified", F.concat(F.lit("2024-01-0"), (size % 9 + 1).cast("string")))).otherwise(""), F.lit("</cp:coreProperties>"),
    )
    rows = V.spread(V.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return rows.select("p_partkey", *P.core_properties(xml))
