"""Sinks: node trees as JSON, reports as CSV or text; an existing folder is an error unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_json(rows: DataFrame, path: str, overwrite: bool = False, without: tuple[str, ...] = ()) -> None:
    """One JSON object a row, keys in order; ``without`` names columns to strip, such as spans."""
    kept = sorted(c for c in rows.columns if c not in without)
    rows.select(*kept).write.mode(_mode(overwrite)).json(path)


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(_mode(overwrite)).option("header", "true").csv(path)


def write_text(rows: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    rows.select(F.col(column).cast("string")).write.mode(_mode(overwrite)).text(path)


def node_json(nodes: DataFrame) -> DataFrame:
    """(path, json): each document's nodes in order, as one JSON array; a document is the unit."""
    node = F.struct("node_id", "node_type", "parent_id", "target", "text")
    return nodes.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(node))).alias("json"))
