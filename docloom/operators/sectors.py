"""Streams over sector chains: states, health, truncation, incoherence and scores.

``streams`` is (stream, path, root, allocation, size, start, first, expected, got), ``first`` the first sector of the chain;
``chains`` is (stream, sector, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import records

NO_SECTOR = 0xFFFFFFFF


def tagged(streams: DataFrame, chains: DataFrame) -> DataFrame:
    """``state`` (complete or truncated), ``shared``, ``reused`` and ``invalid`` of each stream."""
    claims = records.shared_sectors(chains, "stream", "sector").select("sector")
    shared = chains.join(claims, "sector", "left_semi").select("stream", F.lit(True).alias("shared")).distinct()
    starts = streams.filter(F.col("start") != NO_SECTOR).groupBy("start").count().filter("count > 1").select("start", F.lit(True).alias("reused"))
    rows = streams.join(shared, "stream", "left").join(starts, "start", "left").na.fill(False, ["shared", "reused"])
    state = F.when(F.col("got") < F.col("expected"), "truncated").otherwise("complete")
    return rows.withColumn("state", state).withColumn("invalid", (F.col("size") > 0) & (F.col("start") != NO_SECTOR) & (F.col("start") != F.col("first")))


def health(tags: DataFrame) -> DataFrame:
    """``health`` and ``risk``: the one state that tells most, and the worst severity of all."""
    first = F.when(F.col("invalid"), "invalid-start").when(F.col("shared"), "shared").when((F.col("state") == "complete") & F.col("reused"), "start-reused").otherwise(F.col("state"))
    risk = F.when(F.col("shared") | F.col("invalid"), "high").when(F.col("reused") | (F.col("state") == "truncated"), "medium").otherwise("none")
    return tags.withColumn("health", first).withColumn("risk", risk)


def health_counts(tags: DataFrame) -> DataFrame:
    """(bucket, n): each tag by root and by allocation, in one pass."""
    found = F.array_compact(F.array("state", F.when(F.col("shared"), "shared"), F.when(F.col("reused"), "start-reused"), F.when(F.col("invalid"), "invalid-start")))
    rows = tags.select(F.explode(found).alias("tag"), "root", "allocation")
    keys = F.array(F.concat(F.lit("health:"), "tag", F.lit(":root:"), "root"), F.concat(F.lit("health:"), "tag", F.lit(":allocation:"), "allocation"))
    return rows.select(F.explode(keys).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def truncated_counts(tags: DataFrame) -> DataFrame:
    return tags.filter("state = 'truncated'").groupBy(F.concat_ws(":", "allocation", "root").alias("bucket")).agg(F.count("*").alias("n"))


def start_mismatches(streams: DataFrame) -> DataFrame:
    """(bucket, severity, n): streams whose start is not the first sector of their chain."""
    wrong = streams.filter((F.col("size") > 0) & (F.col("start") != F.col("first")))
    return wrong.groupBy(F.concat(F.lit("start-sector-mismatch:"), "path").alias("bucket")).agg(F.lit("high").alias("severity"), F.count("*").alias("n"))


def roles(sectors: DataFrame, chains: DataFrame) -> DataFrame:
    """(role, n) over ``sectors`` (sector, fat, special): claimed by a stream, else by the allocation entry; each special
    role counts too."""
    claimed = sectors.join(chains.select("sector", F.lit(True).alias("claimed")).distinct(), "sector", "left")
    role = (
        F.when(F.col("claimed"), "stream-data").when(F.col("fat") == 0xFFFFFFFF, "free").when(F.col("fat") == 0xFFFFFFFE, "end-of-chain")
        .when(F.col("fat") == 0xFFFFFFFC, "fat").otherwise("next-sector")
    )
    special = F.concat(F.lit("special:"), F.when(F.col("fat") == 0xFFFFFFFC, "fat-table").otherwise(F.col("special")))
    return claimed.select(F.explode(F.array_compact(F.array(role, special))).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def special_incoherence(sectors: DataFrame, chains: DataFrame) -> DataFrame:
    """(bucket, severity, n): special sectors that are marked free or claimed by a stream."""
    rows = sectors.filter("special is not null").join(chains.select("sector", F.lit(True).alias("claimed")).distinct(), "sector", "left")
    free = F.when(F.col("claimed").isNull() & (F.col("fat") == 0xFFFFFFFF), F.struct(F.concat("special", F.lit(":marked-free")).alias("bucket"), F.lit("high").alias("severity")))
    taken = F.when(F.col("claimed"), F.struct(F.concat("special", F.lit(":claimed-by-stream")).alias("bucket"), F.lit("medium").alias("severity")))
    return rows.select(F.inline(F.array_compact(F.array(free, taken)))).groupBy("bucket", "severity").agg(F.count("*").alias("n"))


def score(streams: DataFrame) -> DataFrame:
    """The worst risk of all streams, one row."""
    has = lambda level: F.bool_or(F.col("risk") == level)
    return streams.agg(F.when(has("high"), "high").when(has("medium"), "medium").otherwise("none").alias("score"), F.count("*").alias("streams"))


def structural_score(evidence: DataFrame) -> DataFrame:
    """One row: high for shared sectors, short cycles or starts off their chain, medium for cut chains or live entries that
    the root does not reach, low for any other ``evidence`` (evidence, n), else none."""
    any_of = lambda *heads: F.coalesce(F.bool_or(F.col("evidence").rlike("^(" + "|".join(heads) + ")")), F.lit(False))
    high = any_of("sector:shared-sector", "sector:structural-incoherence", "directory:cycle")
    medium = any_of("sector:truncated-chain", "directory:reachability")
    level = F.when(high, "high").when(medium, "medium").when(F.count("*") > 0, "low").otherwise("none")
    return evidence.agg(level.alias("score"), F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
