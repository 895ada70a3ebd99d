"""Registered queries of indicator reports, dominant anomalies, conditions of all kinds and shapes, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import indicators, ir, objects
from docloom.plans import catalogue
from docloom.plans import views as V
from docloom.plans.catalogue import query

_CONTAINER = "CASE format WHEN 'docx' THEN 'zip-ooxml' WHEN 'odt' THEN 'zip-odf' WHEN 'hwp' THEN 'cfb-ole' ELSE 'rtf' END"
_SPECS = ", ".join(f"({i}, '{k}', '{r}', '{V._q(p)}', '{V._q(a)}')" for i, (k, r, p, a) in enumerate(indicators.INDICATORS))


def evidence(spark, d) -> DataFrame:
    """(doc_id, key, e): a row for each find of the views; every third project is protected."""
    macros, project = V.macros(spark, d), F.concat(F.lit("project-"), F.col("doc_id").cast("string"))
    name = S.vba_procedure(F.col("line"))
    of = lambda rows, key, e: rows.select("doc_id", F.lit(key).alias("key"), e.alias("e"))
    projects = macros.select("doc_id").distinct()
    found = [
        of(projects, "macros", project), of(projects.filter(F.col("doc_id") % 3 == 0), "protected-vba", project), of(macros.filter(S.is_auto_exec(name)), "autoexec", F.concat(project, F.lit(":"), name)),
        of(V.formulas(spark, d).filter(S.dde(F.col("formula"))[0] != ""), "dde", F.col("formula")), of(V.parts(spark, d).filter(F.contains("path", F.lit("ObjectPool/"))), "object-pool", F.col("path")),
        objects.evidence(V.objects(spark, d)),
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "indicator_report",
    V.sql(rf"""+doc AS (SELECT DISTINCT doc_id, format, {_CONTAINER} AS container FROM objects), spec(place, key, risk, present, absent) AS (VALUES {_SPECS}),
        e AS (SELECT DISTINCT doc_id, 'macros' AS key, 'project-' || doc_id AS e FROM macros UNION ALL SELECT DISTINCT doc_id, 'protected-vba', 'project-' || doc_id FROM macros WHERE doc_id % 3 = 0
          UNION ALL SELECT doc_id, 'autoexec', 'project-' || doc_id || ':' || {catalogue._PROCEDURE} FROM macros WHERE lower({catalogue._PROCEDURE}) IN {catalogue._AUTO}
          UNION ALL SELECT doc_id, 'dde', formula FROM formulas WHERE regexp_matches(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)') UNION ALL SELECT doc_id, 'object-pool', path FROM parts WHERE contains(path, 'ObjectPool/')),
        n AS (SELECT doc_id, key, CAST(count(*) AS VARCHAR) AS value, string_agg(e, '; ' ORDER BY e) AS evidence FROM e GROUP BY ALL
          UNION ALL SELECT doc_id, key, value, evidence FROM ({catalogue.ORACLE_SQL.get("object_scorecard", "")}) WHERE value <> 'absent')
        SELECT doc.doc_id, place, spec.key, CASE WHEN place = 0 THEN format || '/' || container ELSE coalesce(value, 'absent') END AS value, CASE WHEN value IS NULL THEN 'None' ELSE risk END AS risk,
          CASE WHEN value IS NULL THEN absent ELSE present END AS reason, coalesce(evidence, '') AS evidence FROM doc CROSS JOIN spec LEFT JOIN n ON n.doc_id = doc.doc_id AND n.key = spec.key""", "objects", "macros", "formulas", "parts"),
)
def indicator_report(spark, d):
    """All eleven indicators of each document."""
    container = F.create_map(*(F.lit(x) for kv in objects.CONTAINERS.items() for x in kv))[F.col("format")]
    docs = V.objects(spark, d).select("doc_id", "format", container.alias("container")).distinct()
    return indicators.report(docs, evidence(spark, d)).withColumn("evidence", F.array_join("evidence", "; "))


_ANOMALIES = {"shared_sectors": "event_type = 'error'", "high_overlaps": "event_type = 'signup' AND event_id % 2 = 0", "other_overlaps": "event_type = 'signup' AND event_id % 2 = 1", "cycles": "event_type = 'click' AND event_id % 5 = 0",
              "unreachable": "event_type = 'view' AND event_id % 5 = 0", "invalid_starts": "event_type = 'purchase'", "idle_mini_fat": "event_type = 'view' AND event_id % 5 = 1"}


@query(
    "dominant_anomaly",
    f"""WITH c AS (SELECT user_id AS doc_id, {", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in _ANOMALIES.items())} FROM events GROUP BY 1),
    s AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS i, unnest([shared_sectors * 4 + high_overlaps * 3 + other_overlaps * 2, cycles * 3, unreachable * 3, invalid_starts * 4, idle_mini_fat * 2]) AS score FROM c)
    SELECT doc_id, CASE WHEN score > 0 THEN list_extract({V._list(indicators.CLASSES)}, i + 1) ELSE 'none' END AS dominant, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1""",
)
def dominant_anomaly(spark, d):
    counts = V.table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(*(F.count_if(F.expr(w)).alias(n) for n, w in _ANOMALIES.items()))
    return indicators.dominant_anomaly(counts)


# Queries with all conditions


def all_nodes(spark, d) -> DataFrame:
    """(doc_id, node_id, node_type, attrs): documents with their paragraphs and runs, and the hyperlinks, cells and shapes of the views."""
    attrs = lambda **kv: F.map_filter(F.create_map(*(x for n, v in kv.items() for x in (F.lit(n), v.cast("string")))), lambda _, v: v.isNotNull()).alias("attrs")
    text = ir.text_nodes(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.lit("t"), F.col("node_id").cast("string")).alias("node_id"), "node_type", attrs(text=F.col("text")))
    links = V.links(spark, d).filter("kind = 'Hyperlink'").select("doc_id", F.concat(F.lit("h"), F.col("ord").cast("string")).alias("node_id"), F.lit("Hyperlink").alias("node_type"), attrs(target=F.col("target")))
    cells = V.formulas(spark, d).select("doc_id", F.lit("c").alias("node_id"), F.lit("Cell").alias("node_type"), attrs(formula=F.when(F.col("doc_id") % 2 == 0, F.col("formula")), value=F.concat(F.lit("Number("), F.col("doc_id").cast("string"), F.lit(")"))))
    shapes = V.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("doc_id"), F.lit("s").alias("node_id"), F.lit("Shape").alias("node_type"), attrs(paragraphs=F.concat(F.lit("See\n"), "url")))
    return reduce(DataFrame.unionByName, (text, links, cells, shapes))


_ALL = """SELECT doc_id, 't' || (1 + 2 * ord) AS node_id, 'Paragraph' AS node_type, text AS t FROM paragraphs UNION ALL SELECT doc_id, 't' || (2 + 2 * ord), 'Run', text FROM paragraphs UNION ALL SELECT doc_id, 't0', 'Document', NULL FROM documents
    UNION ALL SELECT doc_id, 'h' || ord, 'Hyperlink', target FROM links WHERE kind = 'Hyperlink' UNION ALL SELECT doc_id, 'c', 'Cell', CASE WHEN doc_id % 2 = 0 THEN formula ELSE 'Number(' || doc_id || ')' END FROM formulas
    UNION ALL SELECT page_id, 's', 'Shape', 'See' || chr(10) || url || chr(10) FROM pages"""


def _held(spark, d) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id").distinct()
    marked = lambda rows, name: rows.select("doc_id").distinct().withColumn(name, F.lit(True))
    rows = docs.join(marked(V.macros(spark, d), "has_macros"), "doc_id", "left").join(marked(V.links(spark, d), "has_external_refs"), "doc_id", "left").na.fill(False)
    return rows.withColumn("format", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("rtf"))


@query("query_text_of_all_types", V.sql(f"SELECT doc_id, node_id, node_type FROM ({_ALL}) WHERE contains(lower(t), 'er')", "paragraphs", "links", "formulas"))
def query_text_of_all_types(spark, d):
    return indicators.query(all_nodes(spark, d), _held(spark, d), contains="ER").select("doc_id", "node_id", "node_type")


@query(
    "query_all_conditions",
    V.sql(f"""SELECT doc_id, node_id, node_type FROM ({_ALL}) WHERE node_type IN ('Document', 'Hyperlink', 'Cell') AND (node_type <> 'Document' OR doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM macros) AND doc_id NOT IN (SELECT doc_id FROM links))""", "paragraphs", "links", "formulas", "macros"),
)
def query_all_conditions(spark, d):
    """Documents of one format with macros and without references, and all hyperlinks and cells."""
    found = indicators.query(all_nodes(spark, d), _held(spark, d), ("Document", "Hyperlink", "Cell"), form="docx", has_macros=True, has_external_refs=False)
    return found.select("doc_id", "node_id", "node_type")


# Shapes

_PART_TYPES = ("MediaAsset", "ChartData", "OleObject", "SmartArtPart", "Theme")


def _shared(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as the shapes of a customer's presentation, and as its parts; paths are from a small pool."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    path = lambda i: F.concat(F.lit("p"), (i % 6).cast("string"))
    pick = F.element_at(F.array(*(F.lit(t) for t in _PART_TYPES)), (k % len(_PART_TYPES) + 1).cast("int"))
    rows = V.table(spark, d, "orders")
    shapes = rows.select(c.alias("doc_id"), k.alias("node_id"), F.when(k % 2 == 0, "Picture").otherwise("Other").alias("shape_type"), F.when(k % 4 != 0, path(k * 5)).alias("media_target"), F.when(k % 3 != 0, F.array(path(k + 1), path(k + 3), path(k + 1))).alias("related_targets"))
    return shapes, rows.select(c.alias("doc_id"), k.alias("node_id"), pick.alias("node_type"), path(k * 7 + 1).alias("path"))


@query(
    "shapes_linked_to_parts",
    f"""WITH part_of AS (SELECT o_custkey AS doc_id, o_orderkey AS node_id, list_extract({V._list(_PART_TYPES)}, CAST(o_orderkey % {len(_PART_TYPES)} + 1 AS INT)) AS t, 'p' || (o_orderkey * 7 + 1) % 6 AS path FROM orders),
    target AS (SELECT o_custkey AS doc_id, o_orderkey AS node_id, -1 AS i, 'p' || o_orderkey * 5 % 6 AS path FROM orders WHERE o_orderkey % 4 <> 0
      UNION ALL SELECT o_custkey, o_orderkey, unnest([0, 1, 2]), 'p' || (o_orderkey + unnest([1, 3, 1])) % 6 FROM orders WHERE o_orderkey % 3 <> 0),
    hit AS (SELECT target.doc_id, target.node_id, i, t, max(part_of.node_id) AS part FROM target JOIN part_of ON part_of.doc_id = target.doc_id AND part_of.path = target.path GROUP BY ALL)
    SELECT o_custkey AS doc_id, o_orderkey AS node_id, CASE WHEN ole IS NOT NULL THEN 'OleObject' WHEN o_orderkey % 2 = 0 THEN 'Picture' ELSE 'Other' END AS shape_type, media, chart, ole, coalesce(smartart, '') AS smartart FROM orders LEFT JOIN (
      SELECT doc_id, node_id, max(part) FILTER (WHERE i < 0 AND t = 'MediaAsset') AS media, max(part) FILTER (WHERE i < 0 AND t = 'ChartData') AS chart, arg_max(part, i) FILTER (WHERE t = 'OleObject') AS ole,
        string_agg(DISTINCT part, ',' ORDER BY part) FILTER (WHERE i >= 0 AND t = 'SmartArtPart') AS smartart FROM hit GROUP BY ALL) h ON h.doc_id = o_custkey AND h.node_id = o_orderkey""",
)
def shapes_linked_to_parts(spark, d):
    return indicators.linked_shapes(*_shared(spark, d)).withColumn("smartart", F.array_join(F.col("smartart").cast("array<string>"), ","))
