"""Registered queries of one row or one text for each document, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import ir, objects, overview
from docloom.plans import catalogue, reports  # noqa: F401  their SQL is read below
from docloom.plans import views as V
from docloom.plans.catalogue import query

_INDICATORS = catalogue.ORACLE_SQL["format_indicators"]
_SECURITY = rf"""+m AS (SELECT doc_id, count(*) AS macro_modules FROM macros GROUP BY doc_id),
f AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)')) AS dde_fields FROM formulas GROUP BY doc_id), x AS {catalogue._XLM_HITS},
o AS (SELECT doc_id, count(*) FILTER (WHERE node_type = 'OleObject') AS ole, count(*) FILTER (WHERE node_type = 'ActiveXControl') AS ax, count(*) FILTER (WHERE node_type = 'ExternalReference') AS refs FROM objects GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, max(CASE severity WHEN 'High' THEN 3 ELSE 2 END) AS worst FROM ({_INDICATORS}) GROUP BY doc_id),
sec AS (SELECT *, macro_modules + xlm_macros > 0 AS has_macros, macro_modules + ole_objects + activex_controls + external_refs + dde_fields + xlm_macros + threat_indicators > 0 AS has_security_content,
    CASE WHEN macro_modules + xlm_macros > 0 THEN 'Critical' WHEN dde_fields + ole_objects + activex_controls > 0 OR worst = 3 THEN 'High' WHEN external_refs > 0 OR worst = 2 THEN 'Medium' ELSE 'None' END AS threat_level FROM (
    SELECT d.doc_id, coalesce(macro_modules, 0) AS macro_modules, coalesce(ole, 0) AS ole_objects, coalesce(ax, 0) AS activex_controls, coalesce(refs, 0) AS external_refs, coalesce(dde_fields, 0) AS dde_fields, coalesce(x.n, 0) AS xlm_macros,
      coalesce(i.n, 0) AS threat_indicators, coalesce(worst, 0) AS worst FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN m USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN i USING (doc_id)))"""
_VIEWS = ("paragraphs", "macros", "formulas", "objects")


def security_of_documents(spark, d) -> DataFrame:
    macros = V.macros(spark, d).groupBy("doc_id").agg(F.count("*").alias("macro_modules"))
    formula = F.col("formula")
    cells = V.formulas(spark, d).groupBy("doc_id").agg(F.count_if(S.dde(formula)[0] != "").alias("dde_fields"), F.count_if(F.size(S.dangerous_xlm(formula)) > 0).alias("xlm_macros"))
    kind = lambda name, label: F.count_if(F.col("node_type") == name).alias(label)
    found = V.objects(spark, d).groupBy("doc_id").agg(kind("OleObject", "ole_objects"), kind("ActiveXControl", "activex_controls"), kind("ExternalReference", "external_refs"))
    return overview.document_security(V.table(spark, d, "documents"), [macros, cells, found], objects.format_indicators(V.objects(spark, d)))


@query("document_security", V.sql(f"{_SECURITY} SELECT doc_id, {', '.join(overview.COUNTS)}, has_macros, has_security_content, threat_level FROM sec", *_VIEWS))
def document_security(spark, d):
    return security_of_documents(spark, d)


_NODES = "(SELECT doc_id, 'Paragraph' AS t, count(*) AS n FROM paragraphs GROUP BY doc_id UNION ALL SELECT doc_id, 'Run', count(*) FROM paragraphs GROUP BY doc_id UNION ALL SELECT doc_id, 'Document', count(*) FROM documents GROUP BY doc_id UNION ALL SELECT doc_id, node_type, count(*) FROM objects WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY ALL)"


def _nodes(spark, d) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    inner = V.objects(spark, d).select("doc_id", "node_type").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return ir.text_nodes(docs).select("doc_id", "node_type").unionByName(inner)


@query("node_counts_ordered", V.sql(f"SELECT doc_id, string_agg(t || '=' || n, ',' ORDER BY n DESC, t) AS counts FROM {_NODES} GROUP BY doc_id", "paragraphs", "objects"))
def node_counts_ordered(spark, d):
    found = overview.node_counts(_nodes(spark, d))
    return found.select("doc_id", F.array_join(F.transform("counts", lambda x: F.concat_ws("=", x["node_type"], x["n"].cast("string"))), ",").alias("counts"))


_COUNT = lambda label, c: f"'  {label}: ' || CASE WHEN {c} = 0 THEN 'No' ELSE {c} || ' found' END || chr(10)"


@query(
    "summary_texts",
    V.sql(rf"""{_SECURITY},
    st AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n\f]+'))) AS BIGINT) AS words FROM paragraphs GROUP BY doc_id),
    nc AS (SELECT doc_id, sum(n) AS total, string_agg('  ' || t || ': ' || n || chr(10), '' ORDER BY n DESC, t) AS listed FROM {_NODES} GROUP BY doc_id),
    ti AS (SELECT doc_id, string_agg('  [' || upper(severity) || '] ' || indicator || ': ' || description || chr(10), '' ORDER BY severity, indicator, description) AS threats FROM ({_INDICATORS}) GROUP BY doc_id),
    me AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CASE WHEN doc_id % 3 = 0 THEN '' ELSE '  Title: Doc ' || doc_id || chr(10) END || coalesce('  Author: ' || source || chr(10), '') || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '  Modified: 2024-01-' || (10 + doc_id % 19) || chr(10) END || coalesce('  Application: ' || lang || chr(10), '') END AS meta FROM documents)
    SELECT doc_id, 'Document Summary' || chr(10) || '================' || chr(10) || chr(10) || 'File: doc-' || doc_id || chr(10) || 'Format: Word Document' || chr(10) || 'Nodes: ' || total || chr(10) || chr(10) || CASE WHEN meta <> '' THEN 'Metadata:' || chr(10) || meta || chr(10) ELSE '' END
      || 'Structure:' || chr(10) || listed || chr(10) || 'Text Statistics:' || chr(10) || '  Characters: ' || chars || chr(10) || '  Words: ~' || words || chr(10) || chr(10) || 'Security:' || chr(10) || '  Threat Level: ' || upper(threat_level) || chr(10)
      || '  VBA Macros: ' || CASE WHEN macro_modules > 0 THEN 'YES - DETECTED' ELSE 'No' END || chr(10) || {_COUNT("OLE Objects", "ole_objects")} || {_COUNT("External References", "external_refs")} || {_COUNT("DDE Fields", "dde_fields")} || {_COUNT("ActiveX Controls", "activex_controls")} || {_COUNT("XLM Macros", "xlm_macros")}
      || chr(10) || coalesce('Threat Indicators:' || chr(10) || threats, '') AS text
    FROM sec JOIN st USING (doc_id) JOIN nc USING (doc_id) JOIN me USING (doc_id) LEFT JOIN ti USING (doc_id)""", *_VIEWS),
)
def summary_texts(spark, d):
    """The summary of each document as one text."""
    docs = V.table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    k, bare = F.col("doc_id"), F.col("doc_id") % 4 == 0
    named = lambda c, unless: F.when(~bare & ~unless, c)
    never = F.lit(False)
    meta = docs.select(
        "doc_id", F.concat(F.lit("doc-"), k.cast("string")).alias("file"), F.lit("Word Document").alias("format"), named(F.concat(F.lit("Doc "), k.cast("string")), k % 3 == 0).alias("title"), named(F.col("source"), never).alias("author"),
        named(F.concat(F.lit("2024-01-"), (10 + k % 19).cast("string")), k % 5 == 0).alias("modified"), named(F.col("lang"), never).alias("application"),
    )
    found = objects.format_indicators(V.objects(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("severity", F.col("indicator").alias("kind"), "description"))).alias("indicators"))
    stats = ir.text_stats(ir.paragraphs(docs)).select("doc_id", "chars", "words")
    rows = meta.join(overview.node_counts(_nodes(spark, d)), "doc_id").join(stats, "doc_id").join(security_of_documents(spark, d), "doc_id").join(found, "doc_id", "left")
    none = F.array().cast("array<struct<severity:string,kind:string,description:string>>")
    return overview.summary_text(rows.withColumn("indicators", F.coalesce("indicators", none)))
