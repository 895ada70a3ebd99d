"""Document-IR views of the star-schema tables, in Spark and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import ir, records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow ``rows`` dealt to all cores, ahead of work that takes long for each: few bytes of a file are one task's else."""
    return rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))


def paragraphs(spark, d):
    return ir.paragraphs(table(spark, d, "documents"))


def links(spark, d):
    """A Hyperlink for each href of a page, and an Image for each src."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    found = lambda kind, name: pages.select("doc_id", "url", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all("html", F.lit(name + '="([^"]*)"'), 1)).alias("ord", "target"))
    return found("Hyperlink", "href").unionByName(found("Image", "src"))


def tree(spark, d):
    """(parent, child, kind): regions, nations, customers, orders."""
    edge = lambda t, pk, pc, ck, cc, kind: table(spark, d, t).select(F.concat(F.lit(pk), F.col(pc).cast("string")).alias("parent"), F.concat(F.lit(ck), F.col(cc).cast("string")).alias("child"), F.lit(kind).alias("kind"))
    return (
        edge("nation", "R", "n_regionkey", "N", "n_nationkey", "Nation")
        .unionByName(edge("customer", "N", "c_nationkey", "C", "c_custkey", "Customer"))
        .unionByName(edge("orders", "C", "o_custkey", "O", "o_orderkey", "Order"))
    )


def stream(spark, d):
    """Events of each user as records; signups begin substreams."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.length(F.coalesce("props", F.lit(""))).alias("size"))
    return records.sequenced(rows, "user_id", ["ts", "event_id"])


def chains(spark, d):
    """Distinct (stream, sector) of lineitem: an order's parts, with the first line of each."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("stream"), F.col("l_partkey").alias("sector")).agg(F.min("l_linenumber").alias("pos"))


def slots(spark, d):
    """Customers as directory slots whose pointers are computed from their keys."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("slot"), F.when(k % 5 != 0, F.pmod(k * 7 + 3, F.lit(997))).alias("left"), F.when(k % 3 != 0, F.pmod(k * 11 + 5, F.lit(991))).alias("right"),
        F.when(k % 2 == 0, k.cast("long") - F.pmod(k, F.lit(7)) + 1).alias("child"),
        F.when(k % 17 == 0, "free").when(k % 13 == 0, "orphaned").otherwise("normal").alias("state"),
        F.when(k == 0, "root-storage").when(k % 23 == 0, "unknown").when(k % 4 == 0, "storage").otherwise("stream").alias("entry_type"),
        (k % 19).cast("int").alias("name_length"), (k % 6 * 100).cast("long").alias("size"), F.when(k % 29 == 0, F.lit(0xFFFFFFFF)).otherwise(k * 13 % 1000).alias("start"),
    )


MACRO_LINES = {
    "signup": "Private Sub Document_Open()", "click": 'x = Shell("cmd.exe /c dir", 1)', "view": "' Shell in a comment",
    "purchase": 'Set o = CreateObject("WScript.Shell")', "error": "Public Function Helper(a)",
}


def macros(spark, d):
    """(doc_id, line_no, line): a VBA line for each event of a user."""
    line = F.element_at(F.create_map(*(F.lit(x) for kv in MACRO_LINES.items() for x in kv)), F.col("event_type"))
    return stream(spark, d).select(F.col("user_id").alias("doc_id"), (F.col("seq") + 1).alias("line_no"), line.alias("line"))


FORMULAS = (
    '=SUM(A1:A9)', '=EXEC("calc")', '=WEBSERVICE("http://x.example/a")', '=CONCAT("CALL(",A1)', '=HYPERLINK(A1)', '=FORMULA.FILL(1,B2)',
    'DDE "excel" "sheet1" "r1c1"', '=MYEXEC(1)', 'DDEAUTO "" "topic"', '=AVERAGE(B1:B3)*2', 'dde', 'DDE "a""b" "unclosed', 'DDEX "a"', '=CALL("k","l"),RUN(2)', '=FOPEN(A1)+FREAD(B1,2)', "='x'!SET.VALUE(1,2)",
)


def formulas(spark, d):
    """(doc_id, formula): a cell formula for each part, by its size."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.element_at(F.array(*(F.lit(f) for f in FORMULAS)), F.col("p_size") % len(FORMULAS) + 1).alias("formula"))


def snapshots(spark, d):
    """Two indexes of parts: the second lacks some, has some more, and differs in name or brand elsewhere."""
    k, part = F.col("p_partkey"), table(spark, d, "part")
    index = lambda rows, key, name, brand: rows.select(F.concat(F.lit("Part["), key.cast("string"), F.lit("]")).alias("key"), F.lit("Part").alias("node_type"), F.concat_ws("|", name, brand).alias("summary"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16).alias("content_sig"), brand.alias("style_sig"))
    left = index(part.filter(k % 11 != 0), k, F.col("p_name"), F.col("p_brand"))
    name = F.when(k % 7 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name"))
    brand = F.when(k % 5 == 0, F.lit("Brand#0")).otherwise(F.col("p_brand"))
    return left, index(part.filter(k % 13 != 0), k, name, brand)


_q = lambda s: s.replace("'", "''")
SQL = {
    "paragraphs": "SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ord, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents",
    "links": """SELECT page_id AS doc_id, url, 'Hyperlink' AS kind, generate_subscripts(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1), 1) - 1 AS ord,
      unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS target FROM pages
      UNION ALL SELECT page_id, url, 'Image', generate_subscripts(regexp_extract_all(coalesce(html, ''), 'src="([^"]*)"', 1), 1) - 1,
      unnest(regexp_extract_all(coalesce(html, ''), 'src="([^"]*)"', 1)) FROM pages""",
    "tree": """SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, 'Nation' AS kind FROM nation
      UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'Order' FROM orders""",
    "stream": """SELECT user_id, event_id, ts, event_type, length(coalesce(props, '')) AS size,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events""",
    "chains": "SELECT l_orderkey AS stream, l_partkey AS sector, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL",
    "slots": """SELECT c_custkey AS slot, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7 + 3) % 997 END AS "left", CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 11 + 5) % 991 END AS "right",
      CASE WHEN c_custkey % 2 = 0 THEN c_custkey - c_custkey % 7 + 1 END AS child,
      CASE WHEN c_custkey % 17 = 0 THEN 'free' WHEN c_custkey % 13 = 0 THEN 'orphaned' ELSE 'normal' END AS state,
      CASE WHEN c_custkey = 0 THEN 'root-storage' WHEN c_custkey % 23 = 0 THEN 'unknown' WHEN c_custkey % 4 = 0 THEN 'storage' ELSE 'stream' END AS entry_type,
      CAST(c_custkey % 19 AS INT) AS name_length, CAST(c_custkey % 6 * 100 AS BIGINT) AS size, CASE WHEN c_custkey % 29 = 0 THEN 4294967295 ELSE c_custkey * 13 % 1000 END AS "start" FROM customer""",
    "pointers": """SELECT slot AS source, 'left' AS kind, "left" AS target FROM slots WHERE "left" IS NOT NULL
      UNION ALL SELECT slot, 'right', "right" FROM slots WHERE "right" IS NOT NULL UNION ALL SELECT slot, 'child', child FROM slots WHERE child IS NOT NULL""",
    "incoming": """SELECT s.*, coalesce(r.refs, 0) AS refs, coalesce(r.bad_refs, 0) AS bad_refs FROM slots s LEFT JOIN (
      SELECT target, count(*) AS refs, count(*) FILTER (WHERE f.state <> 'normal') AS bad_refs FROM pointers p JOIN slots f ON f.slot = p.source GROUP BY target) r ON r.target = s.slot""",
    "macros": "SELECT user_id AS doc_id, seq + 1 AS line_no, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{_q(v)}'" for k, v in MACRO_LINES.items()) + " END AS line FROM stream",
    "formulas": "SELECT p_partkey AS doc_id, list_extract([" + ", ".join(f"'{_q(f)}'" for f in FORMULAS) + f"], p_size % {len(FORMULAS)} + 1) AS formula FROM part",
    "snap_left": """SELECT 'Part[' || p_partkey || ']' AS key, p_name || '|' || p_brand AS summary, left(sha256(p_name), 16) AS content_sig, p_brand AS style_sig
      FROM part WHERE p_partkey % 11 <> 0""",
    "snap_right": """SELECT 'Part[' || p_partkey || ']' AS key, n || '|' || b AS summary, left(sha256(n), 16) AS content_sig, b AS style_sig FROM (
      SELECT *, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' v2' ELSE p_name END AS n, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#0' ELSE p_brand END AS b FROM part WHERE p_partkey % 13 <> 0)""",
}
NEEDS = {"pointers": ("slots",), "incoming": ("slots", "pointers"), "macros": ("stream",)}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    """``query`` over the named views."""
    names = list(dict.fromkeys(n for v in views for n in (*NEEDS.get(v, ()), v)))
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if query.startswith("+") else " ") + query.removeprefix("+")


PATHS = (
    "word/document.xml", "word/styles.xml", "word/media/image1.PNG", "word/media/clip.mp4", "word/embeddings/oleObject1.bin", "word/embeddings/data.xlsx",
    "word/activeX/activeX1.bin", "word/activeX/activeX1.xml", "word/_rels/document.xml.rels", "xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/media/sound.wav",
    "xl/embeddings/oleObject2.ole", "ppt/slides/slide1.xml", "ppt/media/photo.jpeg", "ppt/activeX/activeX2.dat", "docProps/core.xml", "docProps/app.xml",
    "customXml/item1.xml", "[trash]/0000.dat", "word/", "ObjectReplacements/Object 1", "Object 1/content.xml", "Pictures/10000.tiff", "BinData/image2.bmp",
    "Scripts/macro.js", "META-INF/encrypted.xml", "ObjectPool/_1/Ole10Native", "WordDocument", "Workbook", "PowerPoint Document", "Macros/VBA/Module1", "VBA",
    "Macros/PROJECT", "ObjectPool", "ObjectPool/_2/Package", "ObjectPool/_3/CONTENTS", "1Table", "control.ocx", "media/data.BIN", "notes",
)


def parts(spark, d):
    """(doc_id, ord, path, entry_type, size, seen): a package part for each lineitem of an order."""
    path = F.element_at(F.array(*(F.lit(p) for p in PATHS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(PATHS) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), path.alias("path"), (F.col("l_quantity") * 100).cast("long").alias("size"), (F.col("l_returnflag") == "N").alias("seen"))
    return rows.withColumn("entry_type", F.when(F.col("path").isin("VBA", "ObjectPool"), "storage").otherwise("stream"))


#: Payload heads as hex: portable executable, compound file, ZIP, PDF, a script, control bytes, nothing.
HEADS = ("4D5A9000", "D0CF11E0A1B11AE1", "504B0304140006", "255044462D312E37", "76617220783D313B0D0A", "0001", "", "2550444600")
OBJECT_TYPES = ("OleObject", "ActiveXControl", "ExternalReference", "Hyperlink", "Slide", "Worksheet")
OBJECT_PATHS = ("word/embeddings/oleObject1.bin", "xl/activeX/activeX1.bin", "control.OCX", None, "ObjectPool/_1/Ole10Native")
REF_TYPES = ("Hyperlink", "Image", "OleLink", "AttachedTemplate", "Other")
TARGETS = ("https://x.example/a", "file:///c:/a.doc", "\\\\host\\share", "//cdn.example/x", "media/image1.png", "mailto:a@b.example", "smb://h/x")
FORMATS = ("docx", "odt", "hwp", "rtf")


def objects(spark, d):
    """Nodes that detectors look at, one for each order of a customer."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
    return table(spark, d, "orders").select(
        c.alias("doc_id"), k.alias("node_id"), pick(FORMATS, c).alias("format"), pick(OBJECT_TYPES, k * 7 + c).alias("node_type"), pick(OBJECT_PATHS, k + c * 2).alias("path"),
        F.when(k % 3 == 0, F.concat(F.lit("obj"), k.cast("string"))).alias("name"), F.when(k % 11 == 0, "{00020906-0000}").alias("class_id"), F.when(k % 4 == 1, "Package").alias("prog_id"),
        pick(REF_TYPES, k + c).alias("ref_type"), pick(TARGETS, k + c * 3).alias("target"), (k % 2 == 0).alias("linked"), (F.col("o_orderstatus") == "F").alias("hidden"), (k % 40).alias("number"),
    )


URLS = (
    "http://evil%2eru/x", "https://user:p@a.example@BIT.ly:443/q?x", "http://notbit.ly/x", "http://sub.pastebin.com./a", "http://300.1.1.999/", "http://10.0.0.1:80/a", "http://[::1]/x",
    "http://[fe80::1:2]:8080/", "http://0xC0A80101/", "http://0x1C0A80101/", "gopher://ml/x", "//host/share", "%5c%5chost%5cshare", "http://a.example/%", "http://a.example/x.ru", "http://a%zz.cf",
)


def urls(spark, d):
    """(page_id, url): a written URL for each page."""
    k = F.col("page_id").cast("long")
    return table(spark, d, "pages").select(k.alias("page_id"), F.element_at(F.array(*(F.lit(u) for u in URLS)), (k % len(URLS) + 1).cast("int")).alias("url"))


def sheets(spark, d):
    """Macro sheets of a document (suppliers of a nation)."""
    k = F.col("s_suppkey").cast("long")
    return table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("long").alias("doc_id"), k.alias("node_id"), F.concat(F.lit("Macro"), (k % 7).cast("string")).alias("sheet"), (k % 3 == 0).alias("hidden"),
        (k % 4).alias("cells"), F.when(k % 2 == 0, F.concat(F.lit("xl/macrosheets/sheet"), (k % 7).cast("string"), F.lit(".xml"))).alias("path"), F.when(k % 5 == 0, "EXEC").alias("function"),
    )


def defined_names(spark, d):
    k = F.col("n_nationkey").cast("long")
    name = F.element_at(F.array(*(F.lit(x) for x in ("Auto_Open", "_xlnm.Auto_Open", "AUTO.OPEN", "Print_Area"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "nation").select(k.alias("doc_id"), name.alias("name"), F.when(k % 5 != 0, F.concat(F.lit("MACRO"), (k % 9).cast("string"))).alias("target"))


def streams(spark, d, rows=None):
    """(stream, path, root, allocation, size, start, expected, got): an order as a stream over its chain of sectors (``rows``,
    if they are at hand)."""
    chain = (chains(spark, d) if rows is None else rows).groupBy("stream").agg(F.count("*").alias("got"), F.min(F.struct("pos", "sector")).getField("sector").cast("long").alias("first"))
    size = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("stream")).agg(F.sum("l_quantity").cast("long").alias("size"))
    k = F.col("stream").cast("long")
    path = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("WordDocument", "VBA", "ObjectPool", "Workbook"))), (k % 4 + 1).cast("int")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("/"), k.cast("string"))))
    rows = chain.join(size, "stream").select("stream", path.alias("path"), "size", "first", "got", F.ceil(F.col("size") / 20).cast("long").alias("expected"), F.when(k % 31 == 0, F.lit(0xFFFFFFFF)).when(k % 37 == 0, F.col("first") + 1).otherwise(F.col("first")).alias("start"))
    return rows.withColumn("root", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("allocation", F.when(F.col("size") < 60, "mini-fat").otherwise("fat"))


_list = lambda values: "[" + ", ".join("NULL" if v is None else f"'{_q(v)}'" for v in values) + "]"
SQL |= {
    "parts": f"""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, p AS path, CAST(l_quantity * 100 AS BIGINT) AS size, l_returnflag = 'N' AS seen, CASE WHEN p IN ('VBA', 'ObjectPool') THEN 'storage' ELSE 'stream' END AS entry_type
      FROM (SELECT *, list_extract({_list(PATHS)}, (l_partkey + l_linenumber) % {len(PATHS)} + 1) AS p FROM lineitem)""",
    "objects": f"""SELECT o_custkey AS doc_id, o_orderkey AS node_id, list_extract({_list(FORMATS)}, o_custkey % {len(FORMATS)} + 1) AS format, list_extract({_list(OBJECT_TYPES)}, (o_orderkey * 7 + o_custkey) % {len(OBJECT_TYPES)} + 1) AS node_type,
      list_extract({_list(OBJECT_PATHS)}, (o_orderkey + o_custkey * 2) % {len(OBJECT_PATHS)} + 1) AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'obj' || o_orderkey END AS name, CASE WHEN o_orderkey % 11 = 0 THEN '{{00020906-0000}}' END AS class_id,
      CASE WHEN o_orderkey % 4 = 1 THEN 'Package' END AS prog_id, list_extract({_list(REF_TYPES)}, (o_orderkey + o_custkey) % {len(REF_TYPES)} + 1) AS ref_type, list_extract({_list(TARGETS)}, (o_orderkey + o_custkey * 3) % {len(TARGETS)} + 1) AS target,
      o_orderkey % 2 = 0 AS linked, o_orderstatus = 'F' AS hidden, o_orderkey % 40 AS number FROM orders""",
    "urls": f"SELECT page_id, list_extract({_list(URLS)}, page_id % {len(URLS)} + 1) AS url FROM pages",
    "sheets": """SELECT CAST(s_nationkey AS BIGINT) AS doc_id, CAST(s_suppkey AS BIGINT) AS node_id, 'Macro' || s_suppkey % 7 AS sheet, s_suppkey % 3 = 0 AS hidden, CAST(s_suppkey % 4 AS BIGINT) AS cells,
      CASE WHEN s_suppkey % 2 = 0 THEN 'xl/macrosheets/sheet' || s_suppkey % 7 || '.xml' END AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'EXEC' END AS function FROM supplier""",
    "defined_names": "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, list_extract(['Auto_Open', '_xlnm.Auto_Open', 'AUTO.OPEN', 'Print_Area'], n_nationkey % 4 + 1) AS name, CASE WHEN n_nationkey % 5 <> 0 THEN 'MACRO' || n_nationkey % 9 END AS target FROM nation",
    "streams": """SELECT *, split_part(path, '/', 1) AS root, CASE WHEN size < 60 THEN 'mini-fat' ELSE 'fat' END AS allocation FROM (
      SELECT g.stream, list_extract(['WordDocument', 'VBA', 'ObjectPool', 'Workbook'], g.stream % 4 + 1) || CASE WHEN g.stream % 4 = 0 THEN '' ELSE '/' || g.stream END AS path, size, "first", got, CAST(ceil(size / 20.0) AS BIGINT) AS expected,
      CASE WHEN g.stream % 31 = 0 THEN 4294967295 WHEN g.stream % 37 = 0 THEN "first" + 1 ELSE "first" END AS start
      FROM (SELECT stream, count(*) AS got, CAST(arg_min(sector, CAST(pos AS BIGINT) * 1000000000 + sector) AS BIGINT) AS "first" FROM chains GROUP BY stream) g
      JOIN (SELECT l_orderkey AS stream, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1) z ON z.stream = g.stream)""",
}
NEEDS |= {"streams": ("chains",)}

#: The rules over objects as SQL, and the one whose twin over links is a rule of its own.
OBJECT_RULES = """SELECT doc_id, 'SEC-005' AS rule_id, 'High' AS severity, 'OLE object: ' || coalesce(prog_id, 'unknown') AS message, node_id FROM objects WHERE node_type = 'OleObject'
UNION ALL SELECT doc_id, 'SEC-007', 'High', 'ActiveX control detected: ' || coalesce(name, 'unknown'), node_id FROM objects WHERE node_type = 'ActiveXControl'
UNION ALL SELECT doc_id, 'SEC-010', 'Low', 'External reference: ' || target, node_id FROM objects WHERE node_type = 'ExternalReference'
UNION ALL SELECT doc_id, 'SEC-011', 'Low', 'External hyperlink: ' || target, node_id FROM objects WHERE node_type = 'Hyperlink' AND regexp_matches(target, '^(//|\\\\\\\\|[A-Za-z][A-Za-z0-9+.-]*:)')
UNION ALL SELECT doc_id, 'STR-001', 'Medium', 'Hidden worksheet: ' || coalesce(name, ''), node_id FROM objects WHERE node_type = 'Worksheet' AND hidden
UNION ALL SELECT doc_id, 'STR-002', 'Low', 'Hidden slide: ' || number, node_id FROM objects WHERE node_type = 'Slide' AND hidden
UNION ALL SELECT doc_id, 'SEC-006', 'Medium', 'OLE objects: ' || count(*) || ' (threshold 2)', NULL FROM objects WHERE node_type = 'OleObject' GROUP BY doc_id HAVING count(*) > 2
UNION ALL SELECT doc_id, 'SEC-008', 'Medium', 'ActiveX controls: ' || count(*) || ' (threshold 2)', NULL FROM objects WHERE node_type = 'ActiveXControl' GROUP BY doc_id HAVING count(*) > 2"""
LINK_BURST = """
UNION ALL SELECT doc_id, 'SEC-012', 'Medium', 'External links: ' || count(*) || ' (threshold 1)', NULL FROM objects WHERE node_type = 'Hyperlink' AND regexp_matches(target, '^(//|\\\\\\\\|[A-Za-z][A-Za-z0-9+.-]*:)') GROUP BY doc_id HAVING count(*) > 1"""
