"""Group tables of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import close
from .ranking import average_rank


def method_means(log: DataFrame, method: str, dataset: Column) -> DataFrame:
    """Per method: datasets, mean R, auc and time, places one and up to three by auc within the datasets, and mean rank.
    Invalid rows and null methods don't count."""
    rows = log.where(F.col("valid") & F.col(method).isNotNull()).withColumn("_d", dataset)
    ranked = rows.withColumn("_rank", average_rank(F.col("auc_cNBI"), ["_d"], False))
    return ranked.groupBy(method).agg(
        F.countDistinct("_d").alias("datasets"), F.avg("R").alias("mean_R"), F.avg("auc_cNBI").alias("mean_auc_cNBI"), F.avg("time_s").alias("mean_time_s"),
        F.count_if(F.col("_rank") <= 1).alias("top1_auc"), F.count_if(F.col("_rank") <= 3).alias("top3_auc"), F.avg("_rank").alias("mean_rank_auc"),
    )


def dataset_summary(log: DataFrame, dataset: str) -> DataFrame:
    """Per dataset, of valid rows: counts and the spread of auc and time."""
    rows = log.where(F.col("valid") & F.col(dataset).isNotNull())
    return rows.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("family").alias("methods"), F.min("auc_cNBI").alias("min_auc"), F.median("auc_cNBI").alias("median_auc"), F.max("auc_cNBI").alias("max_auc"),
        F.stddev_samp("auc_cNBI").alias("std_auc"), F.stddev_pop("time_s").alias("pstd_time"),
    )


def family_summary(log: DataFrame) -> DataFrame:
    """Per family: candidates, valid share, gains, time and best score of valid rows, and the share with a slow pattern."""
    ok = F.col("valid")
    slow = F.coalesce(F.col("component_refresh") | F.col("global_rescan") | F.col("unbounded_two_hop"), F.lit(False))
    of = lambda c: F.when(ok, F.col(c))
    return log.groupBy("family").agg(
        F.count(F.lit(1)).alias("candidates"), F.avg(ok.cast("double")).alias("valid_rate"), F.avg(of("delta_auc_cNBI")).alias("mean_delta"), F.max(of("delta_auc_cNBI")).alias("top_delta"),
        F.avg(of("time_s")).alias("mean_time_s"), F.max(of("rank_score")).alias("top_rank_score"), F.avg(slow.cast("double")).alias("slow_pattern_rate"),
    )


def failure_patterns(flags: DataFrame, names: tuple[str, ...] = ("component_refresh", "global_rescan", "unbounded_two_hop", "heap_update")) -> DataFrame:
    """(name, count, rate) of each pattern."""
    one = flags.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"), *[F.count_if(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in names])).alias("x")
    return one.select("total", rows).select("x.name", "x.count", (F.col("x.count") / F.col("total")).alias("rate"))


def weighted_mean(rows: DataFrame, by: str, columns: list[str], weight: str) -> DataFrame:
    return rows.groupBy(by).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in columns])


def commonest(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n commonest values; of ties the one seen first."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o")).orderBy(F.desc("n"), "_o").limit(n).drop("_o")


def absolute_share(rows: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Adds share: x over the sum of absolute values in its group."""
    total = F.sum(F.abs(F.col(x))).over(Window.partitionBy(*by))
    return rows.withColumn("share", F.col(x) / F.nullif(total, F.lit(0.0)))


def variant_ratio(rows: DataFrame, by: str, variant: str, base: str, x: str) -> DataFrame:
    """Per group and variant: the mean of x, and its ratio to the base variant's."""
    means = rows.groupBy(by, variant).agg(F.avg(x).alias("value"))
    of = F.max(F.when(F.col(variant) == base, F.col("value"))).over(Window.partitionBy(by))
    return means.withColumn("ratio", F.col("value") / of)


def pivoted(rows: DataFrame, by: str, across: str, values: list[str], x: str) -> DataFrame:
    return rows.groupBy(by).pivot(across, values).agg(F.avg(x))


def grouped_with_nulls(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Counts and means with null keys as a group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))


def policy_statistics(log: DataFrame, families: int = 5) -> DataFrame:
    """What a policy is induced from: the commonest families of the best max(5, min(30, n)) valid rows (of ties the one
    placed higher), and four times their median time as a bound, .05 s at least."""
    valid = log.where("valid")
    n = max(5, min(30, valid.count()))
    top = valid.orderBy(F.desc("rank_score"), "candidate_id").limit(n).select("family", "time_s", "rank_score", "candidate_id")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rank_score"), "candidate_id"))  # of n rows, 30 at most
    bound = top.agg(F.greatest(F.lit(0.05), 4 * F.median("time_s")).alias("max_runtime_s"))
    return commonest(top.withColumn("_place", place), "family", "_place", families).crossJoin(F.broadcast(bound))


def table_checks(expected: DataFrame, found: DataFrame, keys: list[str], x: str, tolerance: float = 5e-3) -> DataFrame:
    """Each key's value in both tables and whether they agree within the tolerance."""
    met = expected.select(*keys, F.col(x).alias("expected")).join(found.select(*keys, F.col(x).alias("found")), keys, "full")
    return met.withColumn("agrees", close(F.col("expected"), F.col("found"), tolerance))
