"""Security scans of a document's formulas. ``formulas`` is (doc_id, ord, formula), formulas as attributes hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import formulas as X


def scanned(formulas: DataFrame) -> DataFrame:
    """``formulas`` with what each holds: dde (kind, application, topic, item), is_array, unsupported names, references (type, target)."""
    text = X.odf_formula(F.col("formula"))
    rows = formulas.withColumn("formula", text)
    at = F.col("formula")
    return rows.select("*", X.dde_call(at).alias("dde"), X.is_array_formula(at).alias("is_array"), X.unsupported_functions(at).alias("unsupported"), X.quoted_references(at).alias("references"))


def diagnostics(scan: DataFrame) -> DataFrame:
    """(doc_id, code, message): one entry for a document's unsupported names, in the order in which they first occur, and one for
    its array formulas. Names are reduced to their first place before a document's are gathered."""
    names = scan.select("doc_id", "ord", F.posexplode("unsupported").alias("i", "name"))
    first = names.groupBy("doc_id", "name").agg(F.min(F.struct("ord", "i")).alias("at"))
    listed = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("found"))
    said = F.concat(F.lit("Unsupported ODF formula functions detected: "), F.array_join("found.name", ", "))
    arrays = scan.filter("is_array").select("doc_id").distinct()
    return listed.select("doc_id", F.lit("ODF_FORMULA_UNSUPPORTED_FUNCTION").alias("code"), said.alias("message")).unionByName(
        arrays.select("doc_id", F.lit("ODF_FORMULA_ARRAY").alias("code"), F.lit("ODF array formula detected (not fully evaluated)").alias("message"))
    )
