"""Guards and reports of containers as relational steps: archive entries, package XML entries, sheets of macros, shared chains.

Errors are rows: nothing is read of a container that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import parts as P
from docloom.functions import scalars as S
from docloom.operators.ranks import carried, ranked

# The limits of an archive.
MAX_FILES, MAX_TOTAL, MAX_FILE, MAX_RATIO, MAX_DEPTH = 10_000, 100 << 20, 50 << 20, 100.0, 20

_text = lambda *cs: F.concat(*(c.cast("string") if isinstance(c, Column) else F.lit(c) for c in cs))


def is_traversal(name: Column) -> Column:
    """Whether an entry's name could leave the folder it is unpacked into."""
    return F.contains(name, F.lit("..")) | F.lower(name).rlike("%2e|%2f|%5c") | F.contains(name, F.lit("\0")) | name.rlike(r"^[/\\]|^[A-Za-z]:|\\")


def entry_error(name: Column, size: Column, packed: Column) -> Column:
    """(code, message) of the first limit that an entry breaks, or null."""
    ratio = size.cast("double") / packed
    error = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    return (
        F.when(is_traversal(name), error("path-traversal", _text("Path traversal: ", name)))
        .when(F.size(F.split(name, "/")) - 1 > MAX_DEPTH, error("path-too-deep", _text("Path too deep: ", name, f" (max depth: {MAX_DEPTH})")))
        .when(size > MAX_FILE, error("file-too-large", _text("File too large: ", name, " (", size, f" bytes, max: {MAX_FILE} bytes)")))
        .when((packed > 0) & (ratio > MAX_RATIO), error("compression-ratio", _text("Suspicious compression ratio for ", name, ": ", F.format_string("%.1f", F.bround(ratio, 1)), f":1 (max: {MAX_RATIO:.1f}:1)")))
    )


def archive_errors(entries: DataFrame) -> DataFrame:
    """``entries`` (doc_id, ord, name, size, packed) of archives with few enough files, with ``running``, the bytes unpacked up to
    an entry, and code and message of its first error: a limit of its own, a name seen before, or the entry with which the
    archive is too large. Archives with more than ``MAX_FILES`` entries are left out first, so a window holds no more than these."""
    crowded = entries.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_FILES)
    kept = entries.join(crowded, "doc_id", "left_anti")
    whole, same = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("doc_id", F.lower("name")).orderBy("ord")
    rows = kept.withColumn("running", F.sum("size").over(whole)).withColumn("_first", F.row_number().over(same))
    rows = rows.withColumn("_exact", F.row_number().over(W.partitionBy("doc_id", F.lower("name"), "name").orderBy("ord")))
    error = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    found = F.coalesce(
        entry_error(F.col("name"), F.col("size"), F.col("packed")),
        F.when(F.col("_exact") > 1, error("duplicate-name", _text("Duplicate file name in archive: ", F.col("name")))),
        F.when(F.col("_first") > 1, error("duplicate-name", _text("Duplicate file name in archive (case-insensitive): ", F.col("name")))),
        F.when((F.col("running") > MAX_TOTAL) & (F.col("running") - F.col("size") <= MAX_TOTAL), error("total-size", F.lit(None).cast("string"))),
    )
    return rows.withColumn("_error", found).select(*entries.columns, "running", "_error.code", "_error.message")


def refused_archives(entries: DataFrame) -> DataFrame:
    """(doc_id, code, message) of the archives that are not opened: too many entries, else the first entry with an error, else
    the total size."""
    counted = entries.groupBy("doc_id").agg(F.count("*").alias("n"))
    many = counted.filter(F.col("n") > MAX_FILES).select("doc_id", F.lit("too-many-files").alias("code"), _text("Too many files in archive: ", F.col("n"), f" (max: {MAX_FILES})").alias("message"))
    rows = archive_errors(entries)
    own = F.when((F.col("code").isNotNull()) & (F.col("code") != "total-size"), F.struct("ord", "code", "message"))
    first = rows.groupBy("doc_id").agg(F.min(own).alias("e"), F.sum("size").alias("total"))
    total = F.when(F.col("total") > MAX_TOTAL, F.struct(F.lit(0).alias("ord"), F.lit("total-size").alias("code"), _text("Total uncompressed size too large: ", F.col("total"), f" bytes (max: {MAX_TOTAL} bytes)").alias("message")))
    named = lambda e: F.struct(e["code"].alias("code"), e["message"].alias("message"))
    chosen = first.withColumn("_e", F.when(F.col("e").isNotNull(), named(F.col("e"))).otherwise(named(total)))
    return chosen.select("doc_id", "_e.code", "_e.message").filter("code is not null").unionByName(many)


# Entries of package XML


def tags_of(xml: Column, *names: str) -> Column:
    """The opening tags of elements of a local name in order, as their name and the text of their attributes."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)(<(?:[A-Za-z_][\w.-]*:)?(?:{'|'.join(names)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"), 1)
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, rf"^<(?:[^\s:]*:)?({'|'.join(names)})", 1).alias("name"), t.alias("text")))


def attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?s)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(tag.rlike(pattern), value)


def relationship_entries(files: DataFrame) -> DataFrame:
    """(doc_id, path, ord, id, type, target, mode, error) of the relationships in ``files`` (doc_id, path, xml). An entry without
    Id, Type or Target, of a bad mode, or with an Id seen before in its part has an error; a part's first error refuses it."""
    rows = files.select("doc_id", "path", F.posexplode(tags_of(F.col("xml"), "Relationship")).alias("ord", "tag"))
    tag = F.col("tag.text")
    mode = F.coalesce(attribute(tag, "TargetMode"), F.lit("Internal"))
    rows = rows.select("doc_id", "path", "ord", attribute(tag, "Id").alias("id"), attribute(tag, "Type").alias("type"), attribute(tag, "Target").alias("target"), mode.alias("given"))
    again = F.row_number().over(W.partitionBy("doc_id", "path", "id").orderBy("ord"))
    known = F.lower("given").isin("internal", "external")
    error = (
        F.when(~known, _text(F.col("path"), " relationship has invalid TargetMode: ", F.col("given"))).when(F.col("id").isNull(), _text(F.col("path"), " relationship is missing Id"))
        .when(F.col("type").isNull(), _text(F.col("path"), " relationship is missing Type")).when(F.col("target").isNull(), _text(F.col("path"), " relationship is missing Target"))
        .when(F.col("again") > 1, _text(F.col("path"), " contains duplicate relationship Id: ", F.col("id")))
    )
    return rows.withColumn("again", again).select("doc_id", "path", "ord", "id", "type", "target", F.when(known, F.initcap("given")).alias("mode"), error.alias("error"))


def content_type_entries(files: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, key, content_type, error) of the defaults and overrides in ``files`` (doc_id, xml): keys in lower case,
    parts without a leading slash; an entry without key or type, or with a key seen before in its kind, has an error."""
    rows = files.select("doc_id", F.posexplode(tags_of(F.col("xml"), "Default", "Override")).alias("ord", "tag"))
    kind, tag = F.col("tag.name"), F.col("tag.text")
    key = F.when(kind == "Default", F.lower(attribute(tag, "Extension"))).otherwise(F.lower(F.regexp_replace(attribute(tag, "PartName"), "^/", "")))
    rows = rows.select("doc_id", "ord", kind.alias("kind"), key.alias("key"), attribute(tag, "ContentType").alias("content_type"))
    again = F.row_number().over(W.partitionBy("doc_id", "kind", "key").orderBy("ord"))
    name, default = "[Content_Types].xml", F.col("kind") == "Default"
    error = (
        F.when(F.col("key").isNull(), F.when(default, f"{name} entry is missing Extension").otherwise(f"{name} entry is missing PartName"))
        .when(F.col("content_type").isNull(), f"{name} entry is missing ContentType")
        .when(F.col("again") > 1, _text(F.when(default, f"{name} contains duplicate Default extension: ").otherwise(f"{name} contains duplicate Override part: "), F.col("key")))
    )
    return rows.withColumn("again", again).select("doc_id", "ord", "kind", "key", "content_type", error.alias("error"))


# Macro sheets


def tracked_cells(events: DataFrame, paths: DataFrame, store) -> DataFrame:
    """(doc_id, sheet, sheet_seq, path, state, cell, formula): the formula cells of macro sheets, each with the sheet that was last
    begun before it, and that sheet's path.

    ``events`` is (doc_id, seq, kind, name, sheet_kind, state, cell, formula) of a parse; ``paths`` (doc_id, sheet, path). The
    current sheet is carried along the events, however many one document has.
    """
    begun = F.when(F.col("kind") == "sheet", F.struct("name", "sheet_kind", "state", F.col("seq").alias("at")))
    rows = carried(events.withColumn("_begun", begun), ["doc_id"], ["seq"], "_begun", store, "_sheet")
    cells = rows.filter("kind = 'cell' and formula is not null and _sheet.sheet_kind = 'MacroSheet'")
    found = cells.select("doc_id", F.col("_sheet.name").alias("sheet"), F.col("_sheet.at").alias("sheet_seq"), F.col("_sheet.state").alias("state"), "cell", "formula")
    return found.join(paths, ["doc_id", "sheet"], "left").select("doc_id", "sheet", "sheet_seq", "path", "state", "cell", "formula")


def tracked_functions(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, sheet_seq, path, cell, function, arguments): each dangerous function of each cell."""
    rows = cells.select("doc_id", "sheet", "sheet_seq", "path", "cell", "formula", F.explode(S.dangerous_xlm(F.col("formula"))).alias("function"))
    given = F.coalesce(*(F.when(F.col("function") == name, P.call_arguments(F.col("formula"), name)) for name in S.DANGEROUS_XLM))
    return rows.select("doc_id", "sheet", "sheet_seq", "path", "cell", "function", given.alias("arguments"))


def tracked_sheets(events: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, sheet_seq, state, cells, has_auto_open): a row for each macro sheet, one without cells too."""
    begun = events.filter("kind = 'sheet' and sheet_kind = 'MacroSheet'").select("doc_id", F.col("name").alias("sheet"), F.col("seq").alias("sheet_seq"), "state")
    counted = cells.groupBy("doc_id", "sheet_seq").agg(F.count("*").alias("cells"), F.bool_or(F.upper("formula").rlike("AUTO[_.]OPEN")).alias("has_auto_open"))
    return begun.join(counted, ["doc_id", "sheet_seq"], "left").na.fill({"cells": 0, "has_auto_open": False}).select("doc_id", "sheet", "sheet_seq", "state", "cells", "has_auto_open")


# Shared chains

# Streams whose sectors no other stream should claim.
SENSITIVE = "^(WORDDOCUMENT|WORKBOOK|POWERPOINT DOCUMENT|VBA/.*)$"


def shared_runs(chains: DataFrame, store) -> DataFrame:
    """(doc_id, owners, first, last, length, severity): runs of two sectors or more that the same streams claim one after the other.

    ``chains`` is (doc_id, path, sector, position). A run goes on while every owner's position is one more than before, so
    the distances between the owners' positions stay: with these a run is an island of the first owner's positions.
    """
    claims = chains.groupBy("doc_id", "sector").agg(F.array_sort(F.collect_list(F.struct("path", "position"))).alias("c")).filter(F.size("c") > 1)
    first = F.element_at("c.position", 1)
    rows = claims.select("doc_id", "sector", F.col("c.path").alias("owners"), first.alias("at"), F.transform("c.position", lambda p: p - first).alias("apart"))
    placed = ranked(rows, ["doc_id", "owners", "apart"], ["at", "sector"], store, "_place")
    island = placed.withColumn("_island", F.col("at") - F.col("_place")).groupBy("doc_id", "owners", "apart", "_island")
    runs = island.agg(F.min_by("sector", "at").alias("first"), F.max_by("sector", "at").alias("last"), F.count("*").alias("length")).filter("length > 1")
    severe = (F.col("length") >= 3) | F.exists("owners", lambda p: F.upper(p).rlike(SENSITIVE))
    return runs.select("doc_id", "owners", "first", "last", "length", F.when(severe, "high").otherwise("medium").alias("severity"))
