"""Files as rows: a guarded binary scan, and each file's format by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 512 << 20


def scan(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, error): content is null, and error says why, for files over ``most`` bytes, which are never read:
    their rows come from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none = F.lit(None)
    small = files.filter(F.col("length") <= most).select("path", "length", "content", none.cast("string").alias("error"))
    large = files.filter(F.col("length") > most).select("path", "length", none.cast("binary").alias("content"), F.lit("input-too-large").alias("error"))
    return small.unionByName(large)


def sniffed(content: Column) -> Column:
    """The container that the first bytes name; null content is unknown."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    magic = {"7b5c727466": "rtf", "d0cf11e0a1b11ae1": "cfb", "504b0304": "zip", "25504446": "pdf", "4d5a": "pe", "89504e47": "png", "ffd8ff": "jpeg", "47494638": "gif"}
    out = F.when(head.rlike("^(465753|435753|5a5753)"), "swf")
    for prefix, name in magic.items():
        out = out.when(F.startswith(head, F.lit(prefix)), name)
    return out.otherwise("unknown")
