"""Passes over plays in one global order, without a global window.

A window over the whole history has no partition key, and a window per day puts a busy day in one task.
Numbers follow from the input instead: file and position. The pass over neighbours range-partitions on a unique order,
(ts, id), so no task can be hot whatever the data, and goes over each range by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.session import scratch_path

def in_range_parts(df: DataFrame, order, name="_part") -> DataFrame:
    """``df`` dealt out by ranges of ``order``, and written with the number of each row's range, which rises with the order.

    What is written stays as it is, whatever is computed from it and however often; the rows of a part are in no order.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(*keys).withColumn(name, F.spark_partition_id())
    path = scratch_path(df.sparkSession, "range-parts")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def with_previous(df: DataFrame, value: str, ts="ts", tie="id", name="_previous") -> DataFrame:
    """``ts``, ``tie`` and ``value`` of ``df`` with the value of the row before in the whole (ts, tie) order, NULL for the first.

    The lag goes over each range part; the first row of a part takes the last value of the part before. That second lag has one
    row per part.
    """
    rows = in_range_parts(df.select(F.col(ts), F.col(tie).cast("bigint").alias(tie), F.col(value)), (ts, tie))
    place = F.struct(F.col(ts).isNull(), F.col(ts), F.col(tie).isNull(), F.col(tie))
    ends = rows.groupBy("_part").agg(F.max_by(value, place).alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col(ts).asc_nulls_last(), F.col(tie).asc_nulls_last())
    lagged = rows.withColumns({name: F.lag(value).over(inside), "_number": F.row_number().over(inside)})
    previous = F.when(F.col("_number") == 1, F.col("_before")).otherwise(F.col(name))
    return lagged.join(ends, "_part").select(ts, tie, value, previous.alias(name))


def neighbour_repeats_by_day(df: DataFrame, value: str, ts="ts", tie="id") -> DataFrame:
    """Per day: pairs (row, previous row of the whole history) with both known, and equal ones."""
    same = F.col("_previous") == F.col(value)
    return with_previous(df, value, ts, tie).groupBy(F.date_trunc("day", ts).cast("timestamp_ntz").alias("day")).agg(
        F.count(same).alias("pairs"), F.count_if(same).alias("repeats"))


def number_by_position(df: DataFrame, start=0, file="source_file", position="position", name="id") -> DataFrame:
    """Consecutive numbers ``start + 1, start + 2, ...`` in the order of files and of positions within a file.

    Positions of a file count from 0 without gaps, so a number is the rows of earlier files plus the position: there is no
    sort of rows, and the result does not depend on the partitioning. Sizes are summed up inside ranges of files, and the
    ranges in one more sum of a row each. A file with a third of all rows is joined by its name; adaptive execution splits it
    where the sums are not broadcast.
    """
    sizes = df.groupBy(F.col(file).alias("_file")).agg((F.max(position) + 1).alias("_size"))
    sizes = in_range_parts(sizes, ("_file",))
    ends = sizes.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    offsets = sizes.join(starts, "_part").select("_file", before.alias("_offset"))
    number = (F.lit(start) + F.col("_offset") + F.col(position) + 1).cast("bigint").alias(name)
    kept = [F.col(c) for c in df.columns]
    return df.join(offsets, df[file].eqNullSafe(offsets["_file"])).select(number, *kept)
