"""Registered queries over node summaries, keys, signatures and indexes, fields and durations, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fields
from docloom.functions import scalars as S
from docloom.operators import diff, ir, objects, summaries
from docloom.plans import views as V
from docloom.plans.catalogue import query
from docloom.storage import stored

_EXTERNAL = r"regexp_matches(target, '^(//|\\\\|[A-Za-z][A-Za-z0-9+.-]*:)')"
_STATE = "CASE WHEN hidden THEN 'Hidden' ELSE 'Visible' END"
_SUMMARY = f"""CASE node_type WHEN 'OleObject' THEN 'name=' || coalesce(name, '-') || ' prog_id=' || coalesce(prog_id, '-') || ' linked=' || CAST(linked AS VARCHAR) || ' size=0 hash=-'
    WHEN 'ActiveXControl' THEN 'name=' || coalesce(name, '-') || ' clsid=' || coalesce(class_id, '-') || ' prog_id=' || coalesce(prog_id, '-')
    WHEN 'ExternalReference' THEN 'type=' || ref_type || ' target=' || target
    WHEN 'Hyperlink' THEN 'target=' || target || ' external=' || CAST({_EXTERNAL} AS VARCHAR) || ' runs=0 text=""'
    WHEN 'Slide' THEN 'number=' || number || ' name=' || coalesce(name, '-') || ' shapes=0 hidden=' || CAST(hidden AS VARCHAR)
    WHEN 'Worksheet' THEN 'name=' || coalesce(name, '-') || ' sheet_id=' || node_id || ' state=' || {_STATE} || ' cells=0 merged=0' END"""
_KEY = """CASE node_type WHEN 'OleObject' THEN 'OleObject[' || coalesce(name, prog_id) || ']' WHEN 'ActiveXControl' THEN 'ActiveXControl[' || prog_id || ']'
    WHEN 'ExternalReference' THEN 'ExternalReference[' || target || ']' WHEN 'Hyperlink' THEN 'Hyperlink[' || target || ']'
    WHEN 'Slide' THEN 'Slide[' || number || ']' WHEN 'Worksheet' THEN 'Worksheet[' || coalesce(name, '-') || ']' END"""
_CONTENT = "CASE WHEN node_type IN ('OleObject', 'ActiveXControl') THEN coalesce(prog_id, name) WHEN node_type IN ('ExternalReference', 'Hyperlink') THEN target END"
_STYLE = f"CASE node_type WHEN 'Worksheet' THEN 'state=' || {_STATE} || ' kind=Worksheet' WHEN 'Slide' THEN 'layout_id=- master_id=-' END"


def _attributes(**columns):
    """The columns that are not null as a map of texts."""
    pairs = F.create_map(*(x for n, c in columns.items() for x in (F.lit(n), c.cast("string"))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("attrs")


def _nodes(rows):
    """``rows`` of the objects view as nodes."""
    c = F.col
    return rows.select("doc_id", "node_id", "node_type", _attributes(
        name=c("name"), prog_id=c("prog_id"), clsid=c("class_id"), type=c("ref_type"), target=c("target"), external=S.looks_external(c("target")), linked=c("linked"),
        hidden=c("hidden"), number=c("number"), sheet_id=c("node_id"), state=F.when(c("hidden"), "Hidden").otherwise("Visible"),
    ))


@query("node_summaries", V.sql(f"SELECT doc_id, node_id, node_type, {_SUMMARY} AS summary FROM objects", "objects"))
def node_summaries(spark, d):
    return summaries.snapshots(_nodes(V.objects(spark, d))).select("doc_id", "node_id", "node_type", "summary")


@query("node_own_keys", V.sql(f"SELECT doc_id, node_id, {_KEY} AS own_key FROM objects", "objects"))
def node_own_keys(spark, d):
    return summaries.snapshots(_nodes(V.objects(spark, d))).select("doc_id", "node_id", "own_key")


@query("node_signatures", V.sql(f"SELECT doc_id, node_id, {_CONTENT} AS content_sig, {_STYLE} AS style_sig FROM objects", "objects"))
def node_signatures(spark, d):
    return summaries.snapshots(_nodes(V.objects(spark, d))).select("doc_id", "node_id", "content_sig", "style_sig")


_KINDS = (*summaries.VALUE_LABELS, "Empty")
_CELL = "(SELECT *, 'A' || l_linenumber AS ref, repeat('x', 58) || l_partkey AS txt, l_partkey % 2 = 1 AS half, (l_partkey + l_linenumber) % 8 AS k FROM lineitem)"


@query(
    "cell_summaries",
    f"""SELECT l_orderkey AS sheet, l_linenumber AS cell,
    'ref=' || ref || ' value=' || CASE k WHEN 0 THEN 'str:' || short WHEN 1 THEN 'num:' || num WHEN 2 THEN 'bool:' || txt WHEN 3 THEN 'error:' || txt WHEN 4 THEN 'date:' || num
      WHEN 5 THEN 'inline:' || short WHEN 6 THEN 'shared:' || txt ELSE 'empty' END || ' formula=' || CASE WHEN l_partkey % 3 = 0 THEN 'SUM(A1:A9) type=Normal' ELSE '-' END AS summary,
    ref || '=' || CASE k WHEN 0 THEN 's:' || txt WHEN 1 THEN 'n:' || raw WHEN 2 THEN 'b:' || txt WHEN 3 THEN 'e:' || txt WHEN 4 THEN 'dt:' || raw WHEN 5 THEN 'is:' || txt WHEN 6 THEN 'ss:' || txt
      ELSE 'empty' END || CASE WHEN l_partkey % 3 = 0 THEN ';SUM(A1:A9)' ELSE '' END AS content_sig,
    'style=' || CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE CAST(l_partkey % 5 AS VARCHAR) END AS style_sig
    FROM (SELECT *, CASE WHEN length(txt) > 60 THEN left(txt, 60) || '...' ELSE txt END AS short, l_partkey || CASE WHEN half THEN '.500000' ELSE '' END AS num, l_partkey || CASE WHEN half THEN '.5' ELSE '' END AS raw FROM {_CELL})""",
)
def cell_summaries(spark, d):
    part, k = F.col("l_partkey"), F.element_at(F.array(*(F.lit(x) for x in _KINDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 8 + 1).cast("int"))
    number = F.concat(part.cast("string"), F.when(part % 2 == 1, ".5").otherwise(""))
    value = F.when(k.isin("Number", "DateTime"), number).otherwise(F.concat(F.repeat(F.lit("x"), 58), part.cast("string")))
    attrs = _attributes(ref=F.concat(F.lit("A"), F.col("l_linenumber").cast("string")), value_kind=k, value=value, formula=F.when(part % 3 == 0, "SUM(A1:A9)"), style_id=F.when(part % 5 != 0, part % 5))
    nodes = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("cell"), F.lit("Cell").alias("node_type"), attrs)
    return summaries.snapshots(nodes).select("sheet", "cell", "summary", "content_sig", "style_sig")


_LOCAL = f"""SELECT doc_id, node_id, base || CASE WHEN again > 1 THEN '#' || again ELSE '' END AS local_key, summary, content_sig, style_sig FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY node_id) AS again
    FROM (SELECT *, coalesce({_KEY}, node_type || '[' || coalesce(left(sha256({_CONTENT}), 16), CAST(row_number() OVER (PARTITION BY doc_id, node_type ORDER BY node_id) AS VARCHAR)) || ']') AS base,
    {_SUMMARY} AS summary, {_CONTENT} AS content_sig, {_STYLE} AS style_sig FROM (%s)))"""


@query("node_local_keys", V.sql(f"SELECT doc_id, node_id, local_key FROM ({_LOCAL % 'SELECT * FROM objects'})", "objects"))
def node_local_keys(spark, d):
    """The nodes of a document as siblings in the order of their ids."""
    return summaries.local_keys(summaries.snapshots(_nodes(V.objects(spark, d))), ["doc_id"], ["node_id"], stored).select("doc_id", "node_id", "local_key")


@query(
    "node_index_diff",
    V.sql(f"""+l AS ({_LOCAL % "SELECT * FROM objects WHERE node_id % 11 <> 0"}),
        r AS ({_LOCAL % "SELECT * REPLACE (node_id % 7 = 0 AND linked AS linked, CASE WHEN node_id % 5 = 0 THEN NOT hidden ELSE hidden END AS hidden, CASE WHEN node_id % 9 = 0 THEN 'Other' ELSE prog_id END AS prog_id) FROM objects WHERE node_id % 13 <> 0"})
        SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.local_key, r.local_key) AS key, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN r.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change,
        CASE WHEN l.doc_id IS NULL OR r.doc_id IS NULL THEN NULL WHEN l.content_sig IS DISTINCT FROM r.content_sig AND l.style_sig IS DISTINCT FROM r.style_sig THEN 'Both'
          WHEN l.content_sig IS DISTINCT FROM r.content_sig THEN 'Content' WHEN l.style_sig IS DISTINCT FROM r.style_sig THEN 'Style' ELSE 'Metadata' END AS kind, l.summary AS left_summary, r.summary AS right_summary
        FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.local_key = r.local_key WHERE l.doc_id IS NULL OR r.doc_id IS NULL OR l.summary IS DISTINCT FROM r.summary""", "objects"),
)
def node_index_diff(spark, d):
    """Each document's nodes against a later state: some gone, some new, links, visibility and program ids changed."""
    rows, k = V.objects(spark, d), F.col("node_id")
    later = rows.filter(k % 13 != 0).withColumns({
        "linked": (k % 7 == 0) & F.col("linked"), "hidden": F.when(k % 5 == 0, ~F.col("hidden")).otherwise(F.col("hidden")), "prog_id": F.when(k % 9 == 0, "Other").otherwise(F.col("prog_id")),
    })
    index = lambda r: summaries.local_keys(summaries.snapshots(_nodes(r)), ["doc_id"], ["node_id"], stored).withColumn("key", F.struct("doc_id", "local_key"))
    found = diff.diff(index(rows.filter(k % 11 != 0)), index(later))
    return found.select("key.doc_id", F.col("key.local_key").alias("key"), "change", "kind", "left_summary", "right_summary")


#: Own keys of siblings, some of which look like the endings of others.
OWN_KEYS = ("K", "K", "K#2", "M", "K#3", "K#2#2", "K#02", "M#2", "K#2", "N#")


@query(
    "reserved_sibling_keys",
    f"""WITH RECURSIVE r AS (SELECT o_custkey AS doc_id, o_orderkey AS node_id, list_extract({V._list(OWN_KEYS)}, CAST((o_orderkey * 7 + o_custkey) % {len(OWN_KEYS)} + 1 AS INT)) AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    walk AS (SELECT doc_id, node_id, i, base AS key, [base] AS used FROM r WHERE i = 1
      UNION ALL SELECT doc_id, node_id, i, key, list_append(used, key) FROM (SELECT r.doc_id, r.node_id, r.i, w.used,
        list_extract(list_filter(list_concat([r.base], list_transform(generate_series(2, len(w.used) + 1), lambda n: r.base || '#' || n)), lambda c: NOT list_contains(w.used, c)), 1) AS key
        FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1))
    SELECT doc_id, node_id, key FROM walk""",
)
def reserved_sibling_keys(spark, d):
    """A customer's orders as siblings with keys of their own: each gets its key or the next free one."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    rows = V.table(spark, d, "orders").select(c.alias("doc_id"), k.alias("node_id"), _chosen(OWN_KEYS, k * 7 + c).alias("key"))
    return summaries.allotted(rows, "key", ["doc_id"], ["node_id"], stored)


@query(
    "node_path_keys",
    V.sql("""+keyed AS (SELECT parent, child, kind || '[' || row_number() OVER (PARTITION BY parent, kind ORDER BY child) || ']' AS local FROM tree),
        walk AS (SELECT 'R' || r_regionkey AS node, 'Region[' || r_name || ']' AS key FROM region UNION ALL SELECT k.child, w.key || '/' || k.local FROM walk w JOIN keyed k ON k.parent = w.node)
        SELECT * FROM walk""", "tree", recursive=True),
)
def node_path_keys(spark, d):
    roots = V.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"), F.concat(F.lit("Region["), "r_name", F.lit("]")).alias("local_key"))
    edges = ir.sibling_keys(V.tree(spark, d), "parent", "kind", ["child"], stored).select("parent", "child", F.col("key").alias("local_key"))
    return summaries.path_keys(roots, edges, stored)


# Fields, durations and exports. The twins' rows are written by hand.

#: instruction: word-processing (kind, args, switches), rich text (kind, args, switches).
FIELDS = {
    r'HYPERLINK "https://x.example/a b" \t "_blank"': (("Hyperlink", "https://x.example/a b|_blank", r"\t"), ("Hyperlink", "https://x.example/a b|_blank", "t")),
    r"MERGEFIELD customer_name \* MERGEFORMAT": (("MergeField", "customer_name|MERGEFORMAT", r"\*"), ("MergeField", "customer_name|MERGEFORMAT", "*")),
    r'ddeauto "cmd" "/c calc"': (("DdeAuto", "cmd|/c calc", ""), ("DdeAuto", "cmd|/c calc", "")),
    r"HYPERLINK l mark": (("Hyperlink", "mark", r"\l"), ("Hyperlink", "l|mark", "")),
    r"REF &quot;a b&quot; \\\\h \h": (("Ref", "a b", r"\h|\h"), ("Ref", "&quot;a|b&quot;", r"\\\h|h")),
    r'INCLUDEPICTURE "c:\pics\a.png" \d': (("IncludePicture", r"c:\pics\a.png", r"\d"), ("IncludePicture", "c:", r"pics\a.png|d")),
    "DATE\tx": (("Date", "x", r"\t"), ("Date", "x", "")),
    'TOC "open': (("Unknown", "open", ""), ("Unknown", "open", "")),
    "   ": ((None, "", ""), (None, "", "")),
    'PAGEREF ""  x"y z"w': (("PageRef", "xy zw", ""), ("PageRef", "xy zw", "")),
}
DURATIONS = {"5ms": 5, " 1.5s ": 1500, "PT0.25S": 250, "PTS": None, "4294967296ms": None, "-1s": None, "": None, "2": None, "0s": 0, "PT1e2S": 100_000, "1.0005s": 1001, "5 ms": None}


def _chosen(values, i):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def _literal(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _expected(rows):
    return ", ".join("(" + ", ".join(_literal(v) for v in (i, *row)) + ")" for i, row in enumerate(rows))


def _fields(name, parse, at):
    @query(name, f"SELECT p_partkey, kind, args, switches FROM part JOIN (VALUES {_expected(v[at] for v in FIELDS.values())}) e(i, kind, args, switches) ON p_partkey % {len(FIELDS)} = i")
    def run(spark, d):
        kind, args, switches = parse(F.col("instruction"))
        rows = V.spread(V.table(spark, d, "part").select("p_partkey")).select("p_partkey", _chosen(FIELDS, F.col("p_partkey")).alias("instruction"))
        return rows.select("p_partkey", kind.alias("kind"), F.array_join(args, "|").alias("args"), F.array_join(switches, "|").alias("switches"))

    return run


field_instructions_word = _fields("field_instructions_word", fields.word_field, 0)
field_instructions_rtf = _fields("field_instructions_rtf", fields.rtf_field, 1)


@query("durations_ms", f"SELECT p_partkey, CAST(ms AS BIGINT) AS ms FROM part JOIN (VALUES {_expected((v,) for v in DURATIONS.values())}) e(i, ms) ON p_partkey % {len(DURATIONS)} = i")
def durations_ms(spark, d):
    return V.table(spark, d, "part").select("p_partkey", fields.duration_ms(_chosen(DURATIONS, F.col("p_partkey"))).alias("ms"))


@query(
    "macro_project_details",
    """SELECT s_nationkey AS doc_id, 'name=' || CASE WHEN s_nationkey % 3 = 0 THEN 'macro project' ELSE 'VBA' || s_nationkey END || '; protected=' || CAST(bool_or(s_suppkey % 9 = 0) AS VARCHAR) || '; modules=' || count(*)
    || '; references=' || count(*) FILTER (WHERE s_suppkey % 4 = 0) || coalesce('; autoexec=' || string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_suppkey % 5 = 0), '')
    || CASE WHEN s_nationkey % 4 = 0 THEN '; signed=true' ELSE '' END AS details FROM supplier GROUP BY s_nationkey""",
)
def macro_project_details(spark, d):
    """A nation's suppliers as the modules of a project."""
    k = F.col("s_suppkey")
    rows = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(
        F.bool_or(k % 9 == 0).alias("protected"), F.count("*").alias("modules"), F.count_if(k % 4 == 0).alias("references"), F.array_sort(F.collect_list(F.when(k % 5 == 0, F.col("s_name")))).alias("auto_exec"),
    )
    rows = rows.withColumns({"name": F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("VBA"), F.col("doc_id").cast("string"))), "signed": F.col("doc_id") % 4 == 0})
    return rows.select("doc_id", objects.project_details().alias("details"))


@query(
    "artifact_manifest",
    V.sql("""SELECT doc_id, node_id AS id, CASE node_type WHEN 'OleObject' THEN 'ole-object' WHEN 'ActiveXControl' THEN 'active-content' WHEN 'ExternalReference' THEN 'relationship-target' ELSE 'other' END AS kind,
        CASE WHEN node_id % 2 = 0 THEN 'extracted' WHEN node_id % 3 = 0 THEN 'partial' ELSE 'discovered' END AS status, coalesce(path, CASE WHEN node_id % 2 = 0 THEN 'out/' || node_id END, 'unknown') AS path FROM objects""", "objects"),
)
def artifact_manifest(spark, d):
    k = F.col("node_id")
    rows = V.objects(spark, d).withColumns({"output": F.when(k % 2 == 0, F.concat(F.lit("out/"), k.cast("string"))), "errors": F.when(k % 3 == 0, 1).otherwise(0)})
    return objects.manifest(rows).select("doc_id", "id", "kind", "status", "path")
