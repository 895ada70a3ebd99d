"""Documents as node and edge tables, and queries over them.

Nodes: (doc_id, node_id, node_type, text); edges: (doc_id, parent_id, child_id, slot, ord). A node id is the
node's place in document order, so ids are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranks import ranked


def paragraphs(documents: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, ord, text): a paragraph for each line, with the columns of its document to ``keep``."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"), *keep)


def text_nodes(documents: DataFrame, *keep: str) -> DataFrame:
    """Document (id 0), and for each line a Paragraph and in it a Run, with the columns of their document to ``keep``."""
    lines = paragraphs(documents, *keep)
    two = F.array(F.struct((1 + 2 * F.col("ord")).alias("node_id"), F.lit("Paragraph").alias("node_type")), F.struct((2 + 2 * F.col("ord")).alias("node_id"), F.lit("Run").alias("node_type")))
    inner = lines.select("doc_id", F.explode(two).alias("n"), "text", *keep).select("doc_id", "n.node_id", "n.node_type", "text", *keep)
    return documents.select("doc_id", F.lit(0).alias("node_id"), F.lit("Document").alias("node_type"), F.lit(None).cast("string").alias("text"), *keep).unionByName(inner)


def text_edges(documents: DataFrame) -> DataFrame:
    lines = paragraphs(documents)
    two = F.array(
        F.struct(F.lit(0).alias("parent_id"), (1 + 2 * F.col("ord")).alias("child_id"), F.lit("content").alias("slot"), F.col("ord").alias("ord")),
        F.struct((1 + 2 * F.col("ord")).alias("parent_id"), (2 + 2 * F.col("ord")).alias("child_id"), F.lit("runs").alias("slot"), F.lit(0).alias("ord")),
    )
    return lines.select("doc_id", F.explode(two).alias("e")).select("doc_id", "e.*")


def select_nodes(nodes: DataFrame, types: tuple[str, ...] = (), contains: str | None = None, document: Column | None = None) -> DataFrame:
    """Nodes that meet all conditions; ``document`` is asked of Document nodes alone, all others pass it."""
    if types:
        nodes = nodes.filter(F.col("node_type").isin(*types))
    if contains is not None:
        nodes = nodes.filter(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(contains.lower())))
    if document is not None:
        nodes = nodes.filter((F.col("node_type") != "Document") | document)
    return nodes


def closure(edges: DataFrame, roots: DataFrame, store, most: int = 100, skip: Column | None = None) -> DataFrame:
    """(root, node, depth) of all nodes reached from ``roots`` (root), each once, at its least depth: one join per level.

    ``edges`` is (parent, child), with ``ord`` for the ``place`` too: the ords that lead to a node, the least ones of its level
    (``trees.first_places`` gives those of a depth-first walk). Where no child has two parents a level needs no more than
    the join, as only a cycle through the root could meet a node again; else each level leaves out the nodes seen before.
    Below nodes that meet ``skip`` (of ``node``) the walk does not go on. ``store`` writes a level before the next.
    """
    placed = "ord" in edges.columns
    edges = edges.select("parent", "child", *(["ord"] if placed else []))
    tree = edges.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    place = [F.array(F.lit(0).cast("long")).alias("place")] if placed else []
    level = store(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), *place).distinct())
    out = level
    for depth in range(1, most + 1):
        open_ = level if skip is None else level.filter(~skip)
        way = [F.concat("place", F.array(F.col("ord").cast("long"))).alias("place")] if placed else []
        step = open_.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), *way)
        if tree:
            step = step.filter(F.col("root") != F.col("node"))
        else:
            step = step.groupBy("root", "node").agg(F.min("place").alias("place")) if placed else step.distinct()
            step = step.join(out.select("root", "node"), ["root", "node"], "left_anti")
        level = store(step.select("root", "node", F.lit(depth).alias("depth"), *(["place"] if placed else [])))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most} levels")


def sibling_keys(nodes: DataFrame, parent: str, kind: str, order: list[str], store) -> DataFrame:
    """``key``: the node's type and 1-based place among its parent's children of that type."""
    placed = ranked(nodes, [parent, kind], order, store, "_place")
    return placed.withColumn("key", F.concat(F.col(kind), F.lit("["), F.col("_place").cast("string"), F.lit("]"))).drop("_place")


def collected_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each document in order, each on a line of its own."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return rows.select("doc_id", F.array_join(F.col("x.text"), "\n").alias("text"))


def text_stats(lines: DataFrame) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\f]+"), F.lit(0)))
    return lines.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(words).cast("long").alias("words"))
