"""Normal order: the child lists of documents and worksheets in an order that does not depend on how they were read.

``nodes`` is (doc_id, node_id, node_type, attrs), ``attrs`` a map of texts; ``edges`` is (doc_id, parent_id, child_id, slot, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranks import ranked

# The rank of each type in a list; all others share one.
RANKS = {
    "Section": 10, "Worksheet": 20, "Slide": 30, "Theme": 40, "VmlDrawing": 45, "DrawingPart": 47, "ConnectionPart": 48, "RelationshipGraph": 50, "CustomXmlPart": 60,
    "MediaAsset": 70, "DigitalSignature": 80, "ExtensionPart": 90, "PivotCacheRecords": 95,
}
OTHER = 500
MISSING = 0xFFFFFFFF
#: The attribute by which nodes of a type are sorted inside their rank; others go by the name of their type.
KEYS = {
    "Worksheet": "name", "Section": "name", "Theme": "name", "PresentationTag": "name", "VmlDrawing": "path", "DrawingPart": "path", "CustomXmlPart": "path", "MediaAsset": "path",
    "ExtensionPart": "path", "ConnectionPart": "span_path", "RelationshipGraph": "source", "DigitalSignature": "signature_id",
}
#: The sorted lists of a document, and of a worksheet, by how they are sorted; other lists stay as they are.
DOCUMENT = {"shared_parts": "node", "diagnostics": "node", "defined_names": "name", "pivot_caches": "cache"}
WORKSHEET = {"cells": "cell", "drawings": "node", "tables": "node", "conditional_formats": "node", "data_validations": "node", "pivot_tables": "node", "comments": "node"}


def _chosen(values: dict[str, Column], by: Column, otherwise: Column) -> Column:
    out = otherwise
    for value, result in values.items():
        out = F.when(by == value, result).otherwise(out)
    return out


def sort_keys(edges: DataFrame) -> dict[str, Column]:
    """``edges`` with its ``parent_type``, ``node_type`` (null: no such node) and ``attrs``: the keys (n1, n2, s1) by which
    its list is sorted, equal where the list keeps its order."""
    kind, attr = F.col("node_type"), lambda name: F.col("attrs")[name]
    number = lambda c, least=0: F.coalesce(c.cast("long"), F.lit(least))
    missing, zero, none = kind.isNull(), F.lit(0).cast("long"), F.lit("")
    rule = F.when(F.col("parent_type") == "Document", _chosen({k: F.lit(v) for k, v in DOCUMENT.items()}, F.col("slot"), F.lit(None).cast("string")))
    rule = F.when(F.col("parent_type") == "Worksheet", _chosen({k: F.lit(v) for k, v in WORKSHEET.items()}, F.col("slot"), F.lit(None).cast("string"))).otherwise(rule)
    rank = F.when(missing, F.lit(MISSING).cast("long")).otherwise(_chosen({k: F.lit(v) for k, v in RANKS.items()}, kind, F.lit(OTHER)).cast("long"))
    named = F.coalesce(F.coalesce(*(F.when(kind == t, F.coalesce(attr(a), none)) for t, a in KEYS.items())), F.when(kind == "Slide", F.lpad(attr("number"), F.greatest(F.length(attr("number")), F.lit(8)), F.lit("0"))), kind)
    text = F.when(missing, F.col("child_id").cast("string")).otherwise(named)
    defined, cache, cell = kind == "DefinedName", kind == "PivotCache", kind == "Cell"
    place = lambda name: F.when(cell, number(attr(name))).otherwise(F.lit(MISSING).cast("long"))
    return {
        "n1": F.when(rule == "node", rank).when(rule == "cache", F.when(cache, number(attr("cache_id"))).otherwise(zero)).when(rule == "cell", place("row")).otherwise(zero),
        "n2": F.when(rule == "cell", place("column")).otherwise(zero),
        "s1": F.when(rule == "node", text).when(rule == "name", F.when(defined, F.coalesce(attr("name"), none)).otherwise(F.coalesce(kind, none))).otherwise(none),
        "n3": F.when((rule == "name") & defined, number(attr("local_sheet_id"))).otherwise(zero),
    }


def normalized(nodes: DataFrame, edges: DataFrame, store) -> DataFrame:
    """``edges`` with ``place``, the 1-based place of the child in its list once all lists are in normal order.

    Lists that have an order of their own keep it: the content of a document, and all lists of other nodes. Children without
    a node come last where types are ranked. Rows that are equal in all keys keep their order.
    """
    node = nodes.select("doc_id", F.col("node_id").alias("child_id"), "node_type", "attrs")
    parent = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    rows = edges.join(node, ["doc_id", "child_id"], "left").join(parent, ["doc_id", "parent_id"], "left")
    keys = sort_keys(rows)
    rows = rows.select("doc_id", "parent_id", "child_id", "slot", "ord", *(c.alias(n) for n, c in keys.items()))
    placed = ranked(rows, ["doc_id", "parent_id", "slot"], ["n1", "n2", "s1", "n3", "ord"], store)
    return placed.select("doc_id", "parent_id", "child_id", "slot", F.col("place").cast("long").alias("place"))
