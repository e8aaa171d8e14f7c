"""Places, running sums and carried values over a whole key order, whatever the keys' type.

Rows are dealt into ranges of the order and sorted in each; only one row a range is ever
put in order in one place, and sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.sources.shared import written

IN_PART = (1 << 33) - 1  # of monotonically_increasing_id: the row's place in its partition


def ordered(df: DataFrame, by: list) -> DataFrame:
    """df written in the order of by, with _part (its range) and _at (its place in the range).

    It is written because the bounds of the ranges are sampled: read twice, they must be
    the same.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PART))), "ordered")


def _before(table: DataFrame, amount: Column) -> DataFrame:
    """(_part, _before): the sum of amount over all parts before it."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy("_part").agg(amount.alias("amount"))
    return sums.select("_part", F.coalesce(F.sum("amount").over(earlier), F.lit(0)).cast("long").alias("_before"))


def placed(df: DataFrame, by: list) -> DataFrame:
    """df with place: each row's number from 0 in the order of by."""
    table = ordered(df, by)
    starts = F.broadcast(_before(table, F.count(F.lit(1))))  # a row a part
    return table.join(starts, "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(df: DataFrame, by: list, amount: str) -> DataFrame:
    """df with upto: the sum of amount over all rows up to and with each, in the order of by."""
    table = ordered(df, by)
    starts = F.broadcast(_before(table, F.sum(amount)))
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("_inside", inside).join(starts, "_part").withColumn("upto", F.col("_before") + F.col("_inside")).drop("_part", "_at", "_before", "_inside")


def carried(df: DataFrame, by: list, value: str) -> DataFrame:
    """df with value filled by the last one that is not null at or before each row, in the order of by."""
    table = ordered(df, by)
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tails = table.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_tail"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("_part", F.last("_tail", ignorenulls=True).over(earlier).alias("_tail"))
    filled = table.withColumn(value, F.last(value, ignorenulls=True).over(so_far)).join(F.broadcast(tails), "_part")
    return filled.withColumn(value, F.coalesce(value, "_tail")).drop("_part", "_at", "_tail")
