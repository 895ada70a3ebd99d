"""Reports over the parts, records, runs and streams of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import parts as P


def cfb_probes(streams: DataFrame) -> DataFrame:
    """(doc_id, format, family, extension, confidence, signals) of each compound file by its stream names (doc_id, path).
    Only the names of the ladder are gathered, so a file's list is as long as the ladder, however many streams it has."""
    wanted = [s.lower() for streams_, *_ in P.PROBES for s in streams_]
    names = streams.groupBy("doc_id").agg(F.collect_set(F.when(F.lower("path").isin(wanted), F.lower("path"))).alias("names"))
    return names.select("doc_id", P.cfb_probe(F.col("names")).alias("probe")).select("doc_id", "probe.*")


def main_part_faults(mains: DataFrame, parts: DataFrame) -> DataFrame:
    """``mains`` (doc_id, format, main) with ``fault``; parts are (doc_id, path)."""
    have = parts.select("doc_id", F.col("path").alias("main")).distinct().withColumn("exists", F.lit(True))
    return mains.join(have, ["doc_id", "main"], "left").select("doc_id", "format", "main", P.main_part_fault(F.col("format"), F.col("main"), F.col("exists")).alias("fault"))


def sanitized_chains(chains: DataFrame, limit: int, size: DataFrame) -> DataFrame:
    """(stream, kept, cut, state) of chains (stream, pos, sector) that end before their first sector of ``limit`` or more:
    ``empty`` or ``truncated`` by the stream's ``size`` if anything was cut, else null. Aggregates alone, so a chain of
    any length is never one list."""
    bad = F.min(F.when(F.col("sector") >= limit, F.col("pos")))
    first = chains.groupBy("stream").agg(bad.alias("bad"))
    counted = chains.join(first, "stream").groupBy("stream").agg(F.count_if(F.col("bad").isNull() | (F.col("pos") < F.col("bad"))).alias("kept"), F.count("*").alias("all"))
    state = F.when(F.col("all") > F.col("kept"), F.when(F.col("size") == 0, "empty").otherwise("truncated"))
    return counted.join(size, "stream").select("stream", "kept", (F.col("all") - F.col("kept")).alias("cut"), state.alias("state"))


def paragraph_texts(runs: DataFrame) -> DataFrame:
    """(paragraph, text, full_text) of runs (paragraph, ord, text, hyperlink): direct runs alone, and all in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text", "hyperlink")))
    joined = lambda keep: F.array_join(F.transform(F.filter("rows", keep), lambda r: r["text"]), "")
    grouped = runs.groupBy("paragraph").agg(rows.alias("rows"))
    return grouped.select("paragraph", joined(lambda r: r["hyperlink"].isNull()).alias("text"), joined(lambda r: F.lit(True)).alias("full_text"))


def slide_records(records: DataFrame, stream: str) -> DataFrame:
    """Number of records and containers and the greatest depth of each stream of (depth, is_container)."""
    return records.groupBy(stream).agg(F.count("*").alias("records"), F.count_if("is_container").alias("containers"), F.max("depth").alias("max_depth"))


def slide_buckets(records: DataFrame) -> DataFrame:
    """(bucket, n): records by type (four hex digits and name) and by depth, in one pass."""
    kind = F.concat(F.lit("0x"), F.lpad(F.hex("record_type"), 4, "0"), F.lit(":"), "record_name")
    bucket = F.explode(F.array(kind, F.concat(F.lit("depth:"), F.col("depth").cast("string"))))
    return records.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def places(rows: DataFrame, within: str, *order: Column) -> DataFrame:
    """``place``: 1-based, in the order of ``order``, inside each document."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(within).orderBy(*order)))


def case_matches(wanted: DataFrame, streams: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, name) with ``path``: the first stream of the document of that name whatever the case, or null."""
    have = streams.groupBy("doc_id", F.lower("path").alias("lowered")).agg(F.min(F.struct("ord", "path")).alias("first"))
    return wanted.withColumn("lowered", F.lower("name")).join(have, ["doc_id", "lowered"], "left").select("doc_id", "name", F.col("first.path").alias("path"))


def guarded(counts: DataFrame, **caps: int) -> DataFrame:
    """``fault``: the first counter above its cap as ``name limit exceeded``, null if none is. No row is dropped."""
    return counts.withColumn("fault", F.coalesce(*(F.when(F.col(n) > most, f"{n} limit exceeded") for n, most in caps.items())))
