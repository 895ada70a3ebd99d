"""The indicator report of a document, its dominant anomaly, queries with all conditions, and shapes joined to shared parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The indicators of a report in its order, with their risk where present and what is said of them.
INDICATORS = (
    ("format-container", "None", "Detected document format and source container", "Detected document format and source container"),
    ("macros", "Critical", "VBA project or macro-capable content detected", "No macro-capable content detected"),
    ("autoexec", "Critical", "Auto-execute VBA entrypoints detected", "No auto-execute VBA entrypoints detected"),
    ("protected-vba", "Medium", "Password-protected VBA projects detected", "No password-protected VBA projects detected"),
    ("ole-objects", "High", "Embedded or linked OLE objects detected", "No OLE objects detected"),
    ("activex", "High", "ActiveX controls detected", "No ActiveX controls detected"),
    ("external-references", "Medium", "External references or remote relationships detected", "No external references detected"),
    ("dde", "High", "Dynamic Data Exchange instructions detected", "No Dynamic Data Exchange instructions detected"),
    ("object-pool", "High", "Legacy ObjectPool storage entries detected", "No ObjectPool entries detected"),
    ("native-payloads", "High", "Ole10Native or Package-style payloads detected", "No Ole10Native or Package-style payloads detected"),
    ("suspicious-relationships", "Medium", "Relationship-level external or suspicious targets detected", "No suspicious relationship targets detected"),
)
#: Anomaly classes in the order in which the first of equal scores is taken.
CLASSES = ("shared-sector", "cycle", "unreachable-live", "invalid-start", "mini-fat")


def report(documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, place, key, value, risk, reason, evidence): all ``INDICATORS`` of each of ``documents`` (doc_id, format, container) in
    order. ``evidence`` is (doc_id, key, e), a row for each find; it is listed in the order of its texts."""
    found = evidence.filter("e is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("e")).alias("evidence"))
    spec = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("key", "risk", "present", "absent"), s, strict=True))) for s in INDICATORS))
    rows = documents.select("doc_id", "format", "container", F.posexplode(spec).alias("place", "s")).withColumn("key", F.col("s.key"))
    rows = rows.join(found, ["doc_id", "key"], "left")
    there, first = F.col("n") > 0, F.col("place") == 0
    value = F.when(first, F.concat_ws("/", "format", "container")).when(there, F.col("n").cast("string")).otherwise("absent")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "place", "key", value.alias("value"), F.when(there, F.col("s.risk")).otherwise("None").alias("risk"),
        F.when(there, F.col("s.present")).otherwise(F.col("s.absent")).alias("reason"), F.coalesce("evidence", none).alias("evidence"),
    )


def dominant_anomaly(counts: DataFrame) -> DataFrame:
    """(doc_id, dominant, score) from counts of each document: shared_sectors, high_overlaps, other_overlaps, cycles, unreachable,
    invalid_starts, idle_mini_fat. The class of the greatest weighted score, of equal ones the first; ``none`` at zero."""
    n = F.col
    scores = (n("shared_sectors") * 4 + n("high_overlaps") * 3 + n("other_overlaps") * 2, n("cycles") * 3, n("unreachable") * 3, n("invalid_starts") * 4, n("idle_mini_fat") * 2)
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("i"), F.lit(c).alias("class")) for i, (c, s) in enumerate(zip(CLASSES, scores, strict=True))))
    best = F.array_max(ranked)
    return counts.select("doc_id", F.when(best["score"] > 0, best["class"]).otherwise("none").alias("dominant"), best["score"].alias("score"))


def node_text(kind: Column, attrs: Column) -> Column:
    """What a text query reads of a node: the text of runs and paragraphs, a shape's paragraphs with a line feed after each, a cell's
    formula or else its value, a hyperlink's target; null of other types."""
    shape = F.array_join(F.transform(F.split(attrs["paragraphs"], "\n"), lambda p: F.concat(p, F.lit("\n"))), "")
    return F.when(kind.isin("Run", "Paragraph"), attrs["text"]).when(kind == "Shape", shape).when(kind == "Cell", F.coalesce(attrs["formula"], attrs["value"])).when(kind == "Hyperlink", attrs["target"])


def query(nodes: DataFrame, documents: DataFrame, types: tuple[str, ...] = (), contains: str | None = None, form: str | None = None, has_macros: bool | None = None, has_external_refs: bool | None = None) -> DataFrame:
    """The nodes (doc_id, node_id, node_type, attrs) that meet all conditions given. Format, macros and references are asked
    of Document nodes alone, by ``documents`` (doc_id, format, has_macros, has_external_refs); a blank text is an error."""
    if contains is not None and not contains.strip():
        raise ValueError("a text to look for is blank")
    kept = nodes.filter(F.col("node_type").isin(*types)) if types else nodes
    if contains is not None:
        kept = kept.filter(F.contains(F.lower(F.coalesce(node_text(F.col("node_type"), F.col("attrs")), F.lit(""))), F.lit(contains.lower())))
    asked = [F.col(c).eqNullSafe(F.lit(v)) for c, v in (("format", form), ("has_macros", has_macros), ("has_external_refs", has_external_refs)) if v is not None]
    if not asked:
        return kept
    held = documents
    for condition in asked:
        held = held.filter(condition)
    tops = kept.filter("node_type = 'Document'").join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.filter("node_type <> 'Document'").unionByName(tops.select(kept.columns))


def linked_shapes(shapes: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, node_id, shape_type, media, chart, ole, smartart): the shared parts that each shape's targets name.

    ``shapes`` is (doc_id, node_id, shape_type, media_target, related_targets), ``parts`` (doc_id, node_id, node_type, path), of equal
    paths the largest id. An OLE object makes the shape one; of several the last related one counts. Parts are joined by
    path, a shape's related targets as rows.
    """
    by_path = parts.filter(F.col("node_type").isin("MediaAsset", "ChartData", "OleObject", "SmartArtPart")).groupBy("doc_id", "path").agg(
        *(F.max(F.when(F.col("node_type") == t, F.col("node_id"))).alias(n) for t, n in (("MediaAsset", "media"), ("ChartData", "chart"), ("OleObject", "ole"), ("SmartArtPart", "smartart")))
    )
    target = F.coalesce("related_targets", F.array().cast("array<string>"))
    rows = shapes.select("doc_id", "node_id", "shape_type", F.inline(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.col("media_target").alias("path"))), F.transform(target, lambda p, i: F.struct(i.cast("int").alias("i"), p.alias("path"))))))
    found = rows.join(by_path, ["doc_id", "path"], "left")
    direct = F.col("i") < 0
    ole = F.max_by("ole", F.when(F.col("ole").isNotNull(), F.col("i")))
    each = found.groupBy("doc_id", "node_id", "shape_type").agg(
        F.max(F.when(direct, F.col("media"))).alias("media"), F.max(F.when(direct, F.col("chart"))).alias("chart"), ole.alias("ole"), F.array_sort(F.collect_set(F.when(~direct, F.col("smartart")))).alias("smartart"),
    )
    return each.withColumn("shape_type", F.when(F.col("ole").isNotNull(), "OleObject").otherwise(F.col("shape_type")))
