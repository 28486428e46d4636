"""Places in an order of all rows of a group, without one task per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import durable


def numbered(rows: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds out: each row's place, from 1, among the rows of its group in order; groups aren't null.

    Rows are dealt to tasks by ranges of (by, order), each task numbers its own, and what lies before in the group is added.
    Rows that agree in all of these share a range, so order should tell rows apart.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order)
    dealt = durable(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(counts.select(*by, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "range-starts")
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return dealt.withColumn("_in", within).join(starts, [*by, "_range"]).withColumn(out, (F.col("_start") + F.col("_in")).cast("int")).drop("_range", "_in", "_start")


def running_sum(rows: DataFrame, by: list[str], order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds out: the sum of weight over each row and those before it in its group, dealt to tasks by ranges as numbered() does."""
    return running(rows, by, order, weight.cast("long"), out, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b)


def running(rows: DataFrame, by: list[str], order: list[Column], value: Column, out: str, total: Callable[[Column], Column], joined: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds out: the total of value over each row and those before it in its group, joined from what lies before its range, null
    for the first, and what does within it."""
    spark = rows.sparkSession
    dealt = rows.withColumn("_value", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order)
    dealt = durable(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_range").agg(total(F.col("_value")).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = durable(sums.select(*by, "_range", total(F.col("_total")).over(before).alias("_start")), "range-starts")
    within = total(F.col("_value")).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", within).join(starts, [*by, "_range"]).withColumn(out, joined(F.col("_start"), F.col("_in"))).drop("_range", "_in", "_start", "_value")
