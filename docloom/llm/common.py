"""What the operators share: input columns, stored tables, and batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one; all further columns are left in the scan."""
    return df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/docloom-checkpoints"


#: The paths in the shared folder that the run at hand has made and not dropped yet, in order; a run is a thread's own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _on(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop objects."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends if ``drop_all_but_last`` has not done so."""
    path = f"{shared_dir(spark)}/docloom-{kind}-{uuid.uuid4().hex}"
    hadoop, files = _on(spark, path)
    files.deleteOnExit(hadoop)
    if (run := _made.get()) is not None:
        run.append(path)
    return path


def made() -> list[str]:
    """Begin a run in this thread: the list that its paths will be put on, for ``drop_all_but_last``."""
    run: list[str] = []
    _made.set(run)
    return run


def drop_all_but_last(spark: SparkSession, run: list[str]) -> None:
    """Delete the tables that ``run`` has written, but for the last one, which the others went into."""
    for path in run[:-1]:
        hadoop, files = _on(spark, path)
        files.delete(hadoop, True)
    run[:-1] = []


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _on(spark, path)
    return files.exists(hadoop)


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut, and what
    is read later is the same rows even if executors are lost."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and text: repeated rows share it."""
    return F.xxhash64(df[doc_id].cast("long"), F.coalesce(df[text], F.lit("")))


def unrepeated(keyed: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """``keyed`` with one row of each ``key`` in ``repeated`` (key): of rows that differ elsewhere, the one with the
    smallest hash of all columns. Other rows pass without a shuffle as long as ``repeated`` is small enough for Spark
    to broadcast, and with none at all if it is empty."""
    if repeated.isEmpty():
        return keyed
    row = F.struct(*(F.col(f"`{c}`") for c in keyed.columns))
    flat = [F.col(f"`{f.name}`") for f in keyed.schema.fields if "map" not in f.dataType.simpleString()]
    picked = unused(keyed, "picked")
    one = keyed.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(row, F.xxhash64(*flat)).alias(picked)).select(f"{picked}.*")
    return keyed.join(repeated, key, "left_anti").unionByName(one)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes (one text at least)."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
