"""Findings, indicators, threat levels, rules and profiles, each a selection of rows joined by union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S

RULES = {
    "SEC-001": "Critical", "SEC-002": "Critical", "SEC-003": "High", "SEC-004": "High", "SEC-005": "High", "SEC-006": "Medium", "SEC-007": "High",
    "SEC-008": "Medium", "SEC-009": "High", "SEC-010": "Low", "SEC-011": "Low", "SEC-012": "Medium", "SEC-013": "High", "STR-001": "Medium",
    "STR-002": "Low",
}


def external_reference_finding(kind: Column, target: Column) -> Column:
    """Severity of a reference, null if it is no finding."""
    remote = S.is_remote(target)
    local = F.lower(target).rlike(r"^(file://|\\\\)")
    return (
        F.when(kind == "AttachedTemplate", "High").when(kind == "OleLink", "High")
        .when((kind == "Hyperlink") & local, "Medium").when((kind == "Hyperlink") & remote, "Low").when((kind == "Image") & remote, "Medium")
    )


def threat_rank(macros: Column, xlm: Column, dde: Column, ole: Column, activex: Column, refs: Column, indicators: Column) -> Column:
    """Macros or XLM are critical; DDE, OLE and ActiveX at least high; external references at least medium."""
    return F.greatest(
        F.when((macros > 0) | (xlm > 0), F.lit(4)).otherwise(F.lit(0)), F.when((dde > 0) | (ole > 0) | (activex > 0), F.lit(3)).otherwise(F.lit(0)),
        F.when(refs > 0, F.lit(2)).otherwise(F.lit(0)), indicators,
    )


def finding(rows: DataFrame, rule: str, message: Column, node: Column | None = None) -> DataFrame:
    node = F.lit(None).cast("long") if node is None else node.cast("long")
    return rows.select("doc_id", F.lit(rule).alias("rule_id"), F.lit(RULES[rule]).alias("severity"), message.alias("message"), node.alias("node_id"))


def burst(rows: DataFrame, rule: str, label: str, most: int) -> DataFrame:
    """One finding for each document with more than ``most`` rows."""
    counted = rows.groupBy("doc_id").count().filter(F.col("count") > most)
    return finding(counted, rule, F.concat(F.lit(label + ": "), F.col("count").cast("string"), F.lit(f" (threshold {most})")))


def with_profile(findings: DataFrame, enabled: tuple[str, ...] = (), disabled: tuple[str, ...] = (), severities: dict[str, str] | None = None) -> DataFrame:
    """Only enabled rules (all if none is named), less the disabled ones; then severities by rule."""
    if enabled:
        findings = findings.filter(F.col("rule_id").isin(*enabled))
    if disabled:
        findings = findings.filter(~F.col("rule_id").isin(*disabled))
    override = reduce(lambda c, x: c.when(F.col("rule_id") == x[0], F.lit(x[1])), (severities or {}).items(), F.when(F.lit(False), F.lit("")))
    return findings.withColumn("severity", override.otherwise(F.col("severity")))
