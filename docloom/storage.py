"""Tables written between the steps of an iterative query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, kind: str = "step") -> str:
    """A new path under spark.checkpoint.dir (in local mode, if unset, a temporary folder), deleted when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/docloom-checkpoints"
    path = f"{base.rstrip('/')}/docloom-{kind}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new path in the shared folder and read it again."""
    spark, path = df.sparkSession, fresh(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
