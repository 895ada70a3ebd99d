"""One row, and one text, for each document: what security scans found of all seven kinds, and the summary shown to people.

Each input is aggregated by document before it is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import security

COUNTS = ("macro_modules", "ole_objects", "activex_controls", "external_refs", "dde_fields", "xlm_macros", "threat_indicators")


def document_security(documents: DataFrame, counts: list[DataFrame], indicators: DataFrame) -> DataFrame:
    """A row for each of ``documents`` (doc_id): the seven ``COUNTS`` (zero where nothing was found), has_macros,
    has_security_content and threat_level.

    ``counts`` are (doc_id and some of the counts), ``indicators`` (doc_id, severity). Macros or XLM make the level critical; DDE, OLE
    and ActiveX high; references medium; an indicator its own severity; the worst counts.
    """
    found = indicators.groupBy("doc_id").agg(F.count("*").alias("threat_indicators"), F.max(S.severity_rank(F.col("severity"))).alias("_worst"))
    rows = reduce(lambda a, b: a.join(b, "doc_id", "left"), [*counts, found], documents.select("doc_id").distinct()).na.fill(0)
    n = {c: F.col(c) for c in COUNTS}
    rank = security.threat_rank(*(n[c] for c in ("macro_modules", "xlm_macros", "dde_fields", "ole_objects", "activex_controls", "external_refs")), F.col("_worst"))
    any_ = reduce(lambda a, b: a | b, (n[c] > 0 for c in COUNTS))
    macros = (n["macro_modules"] > 0) | (n["xlm_macros"] > 0)
    return rows.select("doc_id", *COUNTS, macros.alias("has_macros"), any_.alias("has_security_content"), S.severity_label(rank).alias("threat_level"))


def node_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, counts): of each document the number of nodes of each type, the most frequent first, equal ones by name. A
    document has no more entries than there are types."""
    each = nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))
    key = F.struct((-F.col("n")).alias("less"), "node_type", "n")
    return each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(x["node_type"].alias("node_type"), x["n"].alias("n"))).alias("counts"))


def summary_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text) from a row for each document: file, format, title, author, modified, application, counts (of ``node_counts``),
    chars, words, the columns of ``document_security``, and indicators, an array of (severity, kind, description). Empty
    sections are left out."""
    said = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {label}: "), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    found = lambda label, c: F.concat(F.lit(f"  {label}: "), F.when(F.col(c) == 0, "No").otherwise(F.concat(F.col(c).cast("string"), F.lit(" found"))), F.lit("\n"))
    meta = F.concat(said("Title", "title"), said("Author", "author"), said("Modified", "modified"), said("Application", "application"))
    lines = lambda items, line: F.array_join(F.transform(items, line), "")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    listed: Column = lines(F.col("counts"), lambda x: F.concat(F.lit("  "), x["node_type"], F.lit(": "), x["n"].cast("string"), F.lit("\n")))
    threats = lines(F.col("indicators"), lambda x: F.concat(F.lit("  ["), F.upper(x["severity"]), F.lit("] "), x["kind"], F.lit(": "), x["description"], F.lit("\n")))
    text = F.concat(
        F.lit("Document Summary\n================\n\n"), F.when(F.col("file").isNotNull(), F.concat(F.lit("File: "), "file", F.lit("\n"))).otherwise(""),
        F.lit("Format: "), "format", F.lit("\nNodes: "), total.cast("string"), F.lit("\n\n"), F.when(meta != "", F.concat(F.lit("Metadata:\n"), meta, F.lit("\n"))).otherwise(""),
        F.lit("Structure:\n"), listed, F.lit("\nText Statistics:\n  Characters: "), F.col("chars").cast("string"), F.lit("\n  Words: ~"), F.col("words").cast("string"), F.lit("\n\nSecurity:\n  Threat Level: "),
        F.upper("threat_level"), F.lit("\n  VBA Macros: "), F.when(F.col("macro_modules") > 0, "YES - DETECTED").otherwise("No"), F.lit("\n"), found("OLE Objects", "ole_objects"), found("External References", "external_refs"),
        found("DDE Fields", "dde_fields"), found("ActiveX Controls", "activex_controls"), found("XLM Macros", "xlm_macros"), F.lit("\n"), F.when(F.size("indicators") > 0, F.concat(F.lit("Threat Indicators:\n"), threats)).otherwise(""),
    )
    return rows.select("doc_id", text.alias("text"))
