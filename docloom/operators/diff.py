"""Structural difference of two node indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, change, kind, left_summary, right_summary) of indexes (key, node_type, summary, content_sig, style_sig).

    A node is modified only if its summaries differ; its signatures tell of what kind the change is.
    """
    names = ("node_type", "summary", "content_sig", "style_sig")
    a = left.select("key", *(F.col(n).alias(f"l_{n}") for n in names), F.lit(True).alias("in_left"))
    b = right.select("key", *(F.col(n).alias(f"r_{n}") for n in names), F.lit(True).alias("in_right"))
    both = a.join(b, "key", "full_outer")
    same = lambda n: F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}"))
    change = F.when(F.col("in_left").isNull(), "added").when(F.col("in_right").isNull(), "removed").when(~same("summary"), "modified")
    kind = F.when(~same("content_sig") & ~same("style_sig"), "Both").when(~same("content_sig"), "Content").when(~same("style_sig"), "Style").otherwise("Metadata")
    rows = both.withColumn("change", change).filter("change is not null")
    return rows.select("key", "change", F.when(F.col("change") == "modified", kind).alias("kind"), F.col("l_summary").alias("left_summary"), F.col("r_summary").alias("right_summary"))
