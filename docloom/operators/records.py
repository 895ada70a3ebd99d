"""Record streams and sector chains: running counters, carried values, chains and islands.

Each window is over one stream; streams are the unit that is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER = 4
END_OF_CHAIN = -2


def sequenced(records: DataFrame, stream: str, order: list) -> DataFrame:
    return records.withColumn("seq", F.row_number().over(W.partitionBy(stream).orderBy(*order)) - 1)


def substreams(records: DataFrame, stream: str, begins: Column, kind: str) -> DataFrame:
    """``substream``: begin records so far, the stream's first record not counted; ``substream_kind``: the kind
    of the last begin record, "unknown" before the first."""
    w = W.partitionBy(stream).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    counted = F.sum((begins & (F.col("seq") > 0)).cast("int")).over(w).cast("long")
    carried = F.last(F.when(begins, F.col(kind)), ignorenulls=True).over(w)
    return records.withColumn("substream", counted).withColumn("substream_kind", F.coalesce(carried, F.lit("unknown")))


def offsets(records: DataFrame, stream: str, size: str) -> DataFrame:
    """``offset``: bytes of all earlier records with their headers."""
    w = W.partitionBy(stream).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.col(size) + HEADER).over(w), F.lit(0)).cast("long"))


def anomalies(rows: DataFrame, size: str, kind: str, length: str) -> DataFrame:
    """(kind, message) of the record at which a scan of ``length`` bytes stops, if it does not end with one: fewer bytes
    than a header are left, or fewer than the record declares. ``rows`` has the offsets; a stream has one such at most."""
    left = F.col(length) - F.col("offset")
    trailing = F.concat(left.cast("string"), F.lit(" trailing byte(s) after last complete record header"))
    cut = F.concat(F.lit("record 0x"), F.lpad(F.hex(kind), 4, "0"), F.lit(" declares "), F.col(size).cast("string"), F.lit(" byte(s) but stream ends after "), (left - HEADER).cast("string"))
    found = F.when(left < HEADER, F.struct(F.lit("trailing-bytes").alias("anomaly"), trailing.alias("message"))).otherwise(F.struct(F.lit("truncated-record").alias("anomaly"), cut.alias("message")))
    return rows.filter((left > 0) & (left < F.col(size) + HEADER)).select("*", found.alias("found")).select("*", "found.*").drop("found")


def chain_steps(sectors: DataFrame, stream: str, sector: str, order: list) -> DataFrame:
    """``step``, ``next`` (``END_OF_CHAIN`` after the last) and ``is_terminal`` of each sector of a chain."""
    w = W.partitionBy(stream).orderBy(*order)
    rows = sectors.withColumn("step", F.row_number().over(w) - 1).withColumn("next", F.lead(sector, 1).over(w))
    return rows.withColumn("is_terminal", F.col("next").isNull()).withColumn("next", F.coalesce("next", F.lit(END_OF_CHAIN)))


def shared_sectors(chains: DataFrame, stream: str, sector: str) -> DataFrame:
    """Sectors that more than one stream claims."""
    claims = chains.groupBy(sector).agg(F.count_distinct(stream).alias("owners"), F.min(stream).alias("first_owner"))
    return claims.filter("owners > 1")


def islands(rows: DataFrame, stream: str, position: str, least: int = 2) -> DataFrame:
    """Runs of positions that follow one another: (stream, first, last, length), of ``least`` or more."""
    w = W.partitionBy(stream).orderBy(position)
    marked = rows.withColumn("breaks", (F.col(position) != F.lag(position, 1, -2).over(w) + 1).cast("int"))
    grouped = marked.withColumn("island", F.sum("breaks").over(w))
    runs = grouped.groupBy(stream, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= least).drop("island")
