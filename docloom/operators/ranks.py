"""Places of rows in the order of their group, without a window over a whole group.

Rows are sorted by range over (group, order), numbered as they stream by and written, with the range each lies in. Only the first
group of a range can have begun in an earlier one, so a row's place is its number inside its range plus, for that group, the
rows in earlier ranges: one number for each range, which is broadcast. Rows are moved once, whatever share of them one group holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of a row in its range: it is of the first group, it is the last row.
_FIRST, _LAST = 1, 2
#: Types that Arrow compares as Spark does; others are compared by their JSON.
_PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.BinaryType, T.DecimalType)


def _begins(column: pa.Array, before: object, first: bool) -> np.ndarray:
    """Whether each value differs from the one ahead of it, ``before`` ahead of all; nulls are alike."""
    new = np.empty(len(column), bool)
    new[0] = first or column[0].as_py() != before
    if len(column) > 1:
        here, ahead = column.slice(1), column.slice(0, len(column) - 1)
        unlike = pc.fill_null(pc.not_equal(here, ahead), False)
        new[1:] = pc.or_(unlike, pc.xor(pc.is_null(here), pc.is_null(ahead))).to_numpy(zero_copy_only=False)
    return new


def _numbered(keys: list[str], kept: list[str], names: list[str]):
    """Sorted rows, a range at a time, with their number in their group and their mark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, n, heading, held = None, 0, True, None  # the keys of the row before, its number, still in the first group
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            if held:
                yield pa.RecordBatch.from_arrays([*held[0], pa.array(held[1]), pa.array(held[2])], names)
            columns = [batch.column(k) for k in keys]
            new = np.logical_or.reduce([_begins(c, ahead and ahead[i], ahead is None) for i, c in enumerate(columns)])
            at = np.arange(rows, dtype=np.int64)
            inside = at - np.maximum.accumulate(np.where(new, at, -n)) + 1
            later = new.copy()
            later[0] = new[0] and ahead is not None
            first = heading & (np.cumsum(later) == 0)
            ahead, n, heading = [c[rows - 1].as_py() for c in columns], int(inside[-1]), bool(first[-1])
            held = [batch.column(c) for c in kept], inside, np.where(first, _FIRST, 0).astype(np.int8)
        if held:
            held[2][-1] += _LAST
            yield pa.RecordBatch.from_arrays([*held[0], pa.array(held[1]), pa.array(held[2])], names)

    return each


def ranked(rows: DataFrame, group: list[str], order: list[str], store, name: str = "place") -> DataFrame:
    """``rows`` with ``name``: the 1-based place in the order of ``order`` (nulls first) in its group; a null is a group like any other.

    Rows that are equal in ``order`` stand in any order, so ``order`` should tell rows apart. ``store`` writes the sorted ranges.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    kept, odd = [*rows.columns, "_range"], [c for c in group if not isinstance(rows.schema[c].dataType, _PLAIN)]
    keys = [f"_key_{c}" if c in odd else c for c in group]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_inside", T.LongType()), T.StructField("_mark", T.ByteType())])
    texts = {f"_key_{c}": F.to_json(F.struct(c)) for c in odd}
    ranged = store((sorted_.withColumns(texts) if odd else sorted_).mapInArrow(_numbered(keys, kept, schema.names), schema))
    first, last = F.col("_mark").bitwiseAND(_FIRST) > 0, F.col("_mark").bitwiseAND(_LAST) > 0
    end = F.struct(F.col("_inside").alias("n"), F.struct(*group).alias("group"))
    ends = ranged.filter("_mark > 0").groupBy("_range").agg(F.max_by(end, F.when(first, F.col("_inside"))).alias("a"), F.max_by(end, F.when(last, F.col("_inside"))).alias("b"))
    both = F.array(F.struct(F.lit(True).alias("first"), F.col("a.n").alias("n"), F.col("a.group").alias("group")), F.struct(F.lit(False).alias("first"), F.col("b.n").alias("n"), F.col("b.group").alias("group")))
    counts = ends.select("_range", F.explode(F.when(F.col("a.group").eqNullSafe(F.col("b.group")), F.slice(both, 1, 1)).otherwise(both)).alias("e")).select("_range", "e.*")
    before = F.sum("n").over(W.partitionBy("group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    earlier = counts.withColumn("_before", before).filter("first and _before > 0").select("_range", "_before")
    place = F.col("_inside") + F.when(first, F.coalesce("_before", F.lit(0))).otherwise(0)
    return ranged.join(F.broadcast(earlier), "_range", "left").withColumn(name, place).drop("_range", "_inside", "_mark", "_before")


def carried(rows: DataFrame, group: list[str], order: list[str], value: str, store, name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null at or before a row in the order of its group, null before
    the first. As with ``ranked`` a window is never wider than one sorted range; what goes from range to range is the last value of each."""
    ranged = store(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*group, *order])).withColumn("_range", F.spark_partition_id()))
    key, by = F.struct(*(F.col(c) for c in group)), [F.col(c).asc_nulls_first() for c in order]
    placed = ranged.withColumn("_group", key)
    there = F.struct(*(F.col(c) for c in order))
    ends = placed.groupBy("_range", "_group").agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), there)).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy("_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("_range", "_group", before.alias("_before"))
    own = F.last(F.col(value), ignorenulls=True).over(W.partitionBy("_range", "_group").orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    found = placed.withColumn("_own", own).join(ends, ["_range", "_group"])
    return found.withColumn(name, F.coalesce("_own", "_before")).drop("_range", "_group", "_own", "_before")
