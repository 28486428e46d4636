"""Ranks, scores and selections over candidate logs.

A log has candidate_id, valid, auc_cNBI, R, time_s and more; ties of floats are broken by candidate_id where a rule
leaves them open.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite
from ..sources.storage import durable, fresh
from .ordering import running, running_sum

#: Weights of relative credit, fragmentation, time and absolute quality (fixed values).
STAGE1_WEIGHTS, STAGE3_WEIGHTS = (0.45, 0.25, 0.20, 0.10), (0.40, 0.25, 0.25, 0.10)


def average_rank(x: Column, by: list, ascending: bool, only: Column | None = None) -> Column:
    """The mean place of equal values among the rows of `by` for which `only` holds; null elsewhere and for null x.

    Places count the smaller values, so one sort per partition serves.
    """
    use = x.isNotNull() if only is None else only & x.isNotNull()
    y = F.when(use, x if ascending else -x)
    w = Window.partitionBy(*by)
    place = F.rank().over(w.orderBy(y.asc_nulls_last()))
    return F.when(use, place + (F.count(y).over(Window.partitionBy(*by, y)) - 1) / 2)


class Rank(NamedTuple):
    """A rank from 1, the best, to 0: of x, larger or smaller ones first, among the rows that `only` holds for.

    The policies differ in the number that divides and in missing values. a: over all rows, missing stays null. b: over finite
    values, missing and infinite 0. c: over all rows with missing 0, everything 1 when at most one isn't missing. d: over values
    that aren't missing, missing 0. e: over all rows with at least 1 as divisor, missing null. f: as a, over rows that are
    valid. A single row ranks 1.
    """

    x: Column
    higher: bool
    only: Column | None = None
    policy: str = "a"


def _grouped(df: DataFrame, by: list[str]) -> DataFrame:
    """df with _g, its group as a text that is never null."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in by]
    return df.withColumn("_g", F.concat_ws("|", *parts) if parts else F.lit(""))


def _with_totals(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates over each group _g."""
    found = df.groupBy("_g").agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(fresh(found), "_g")


def _with_places(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds place_<name>: the mean place of equal values, from 1, in ascending order within each group _g; null for null.

    Values are counted, the counts are added up over ranges of all columns' values at once, and rows meet their value's sum; so no
    task holds a group, and a value that many rows share is a row of the sums.
    """
    df = df.withColumns({f"_y_{n}": c.cast("double") for n, c in values.items()})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_y_{n}").alias("value")) for n in values]))
    counts = df.select("_g", pairs.alias("p")).select("_g", "p.*").where("value IS NOT NULL").groupBy("_g", "metric", "value").agg(F.count(F.lit(1)).alias("same"))
    sums = running_sum(counts, ["_g", "metric"], [F.col("value")], F.col("same"), "upto")
    places = durable(sums.select("_g", "metric", "value", (F.col("upto") - (F.col("same") - 1) / 2).alias("place")), "places")
    for n in values:
        df = df.join(places.where(F.col("metric") == n).select("_g", F.col("value").alias(f"_y_{n}"), F.col("place").alias(f"place_{n}")), ["_g", f"_y_{n}"], "left").drop(f"_y_{n}")
    return df


def with_ranks(df: DataFrame, wanted: dict[str, Rank], by: list[str] | None = None) -> DataFrame:
    """df with a column for each rank, within groups of `by`; null where its `only` doesn't hold."""
    columns, values, totals = df.columns, {}, {}
    df = _grouped(df, by or [])
    for n, r in wanted.items():
        use = F.lit(True) if r.only is None else F.coalesce(r.only, F.lit(False))
        y = F.when(finite(r.x), r.x) if r.policy == "b" else F.when(~F.isnan(r.x.cast("double")), r.x)
        df = df.withColumn(f"_u_{n}", use)
        values[n] = F.when(use, -y if r.higher else y)
        totals |= {f"_known_{n}": F.count_if(use & y.isNotNull()), f"_every_{n}": F.count_if(use)}
    df = _with_places(_with_totals(df, totals), values)
    out = {}
    for n, r in wanted.items():
        rank, known, every = F.col(f"place_{n}"), F.col(f"_known_{n}"), F.col(f"_every_{n}")
        many = known if r.policy in "bd" else every
        alone = F.when(rank.isNotNull() | F.lit(r.policy in "acf"), 1.0)
        value = F.when((known if r.policy in "bcd" else every) <= 1, alone).otherwise(1 - (rank - 1) / F.greatest(many - 1, F.lit(1)))
        out[n] = F.when(F.col(f"_u_{n}"), F.coalesce(value, F.lit(0.0)) if r.policy in "bcd" else value)
    return df.withColumns(out).select(*[c for c in columns if c not in out], *out)


def with_time_rank(df: DataFrame, out: str, t: Column, by: list[str] | None = None, only: Column | None = None, quantile: float = 0.6) -> DataFrame:
    """Adds out: 1 up to the quantile of times; above it a rank among the slow times .85, of a single one .5; 0 for no number."""
    columns, use = df.columns, F.coalesce(finite(t) if only is None else only & finite(t), F.lit(False))
    df = _with_totals(_grouped(df, by or []), {"_limit": F.percentile(F.when(use, t), F.lit(quantile))})
    slow = use & (t > F.col("_limit"))
    df = _with_places(_with_totals(df, {"_slow": F.count_if(slow)}), {"slow": F.when(slow, t)})
    value = F.when(~use, 0.0).when(~slow, 1.0).when(F.col("_slow") == 1, 0.5).otherwise(0.85 * (1 - (F.col("place_slow") - 1) / F.greatest(F.col("_slow") - 1, F.lit(1))))
    return df.withColumn(out, F.coalesce(value, F.lit(0.0))).select(*[c for c in columns if c != out], out)


def add_rank_scores(log: DataFrame, weights: tuple[float, float, float, float] = STAGE1_WEIGHTS, root: float | None = None, by: list[str] | None = None, credit: str = "parent") -> DataFrame:
    """Adds deltas, the ranks of valid rows and rank_score (-1 for others).

    credit parent: relative credit is the gain over the parent, over the root where there is none; root: over the root.
    The root's auc is the smallest of the log if it isn't given.
    """
    columns = log.columns
    based = log.withColumn("_base", F.lit(root).cast("double")) if root is not None else _with_totals(_grouped(log, by or []), {"_base": F.min("auc_cNBI")})
    out = based.select(*columns, (F.col("auc_cNBI") - F.col("_base")).alias("delta_root_auc_cNBI"))
    gain = F.col("auc_cNBI") - F.col("parent_auc_cNBI") if "parent_auc_cNBI" in columns else F.lit(None).cast("double")
    out = out.withColumn("delta_auc_cNBI", F.coalesce(gain, F.col("delta_root_auc_cNBI")) if credit == "parent" else F.col("delta_root_auc_cNBI"))
    valid = F.col("valid")
    early = {"early_cNBI", "early_NCC", "early_GCC"} <= set(columns)
    asked = {"rank_relative_credit": ("delta_auc_cNBI", True), "rank_fragmentation": ("R", False), "rank_absolute_quality": ("auc_cNBI", True)}
    asked |= {"_e1": ("early_cNBI", True), "_e2": ("early_NCC", True), "_e3": ("early_GCC", False)} if early else {}
    out = with_ranks(with_time_rank(out, "rank_time", F.col("time_s"), by, valid), {n: Rank(F.col(c), higher, valid) for n, (c, higher) in asked.items()}, by)
    out = out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in asked} | {"rank_time": F.when(valid, F.col("rank_time")).otherwise(0.0)})
    score = sum((w * F.col(c) for w, c in zip(weights, ("rank_relative_credit", "rank_fragmentation", "rank_time", "rank_absolute_quality"), strict=True)), F.lit(0.0))
    part = 0.45 * F.col("_e1") + 0.35 * F.col("_e2") + 0.20 * F.col("_e3") if early else F.lit(0.0)
    out = out.withColumn("rank_early_fragmentation", part).drop("_e1", "_e2", "_e3")
    score = 0.75 * score + 0.25 * F.col("rank_early_fragmentation") if early else score
    return out.withColumn("rank_score", F.when(valid, score).otherwise(-1.0))


def spread_scores(log: DataFrame, by: list[str] | None = None, spread_only: bool = False) -> DataFrame:
    """Ranks and rank_score of influence candidates: .7 spread, .1 each relative spread, coverage and time; or spread alone."""
    valid = F.col("valid")
    asked = {f"rank_{c}": Rank(F.col(c), c != "time_s", valid, "b") for c in ("spread_ic", "relative_spread_ic", "rr_coverage", "time_s")}
    out = with_ranks(log, asked, by).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in asked})
    score = F.col("rank_spread_ic") if spread_only else 0.7 * F.col("rank_spread_ic") + 0.1 * F.col("rank_relative_spread_ic") + 0.1 * F.col("rank_rr_coverage") + 0.1 * F.col("rank_time_s")
    return out.withColumn("rank_score", F.when(valid, score).otherwise(-1.0))


def section_scores(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """100 (.4 auc + .3 R + .3 time) of ranks among valid rows; 0 for others."""
    valid = F.col("valid")
    asked = {n: Rank(F.col(c), higher, valid, "d") for n, c, higher in (("rank53_auc", "auc_cNBI", True), ("rank53_R", "R", False), ("rank53_time", "time_s", False))}
    out = with_ranks(log, asked, by).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in asked})
    return out.withColumn("rank_score_53", F.when(valid, 100 * (0.4 * F.col("rank53_auc") + 0.3 * F.col("rank53_R") + 0.3 * F.col("rank53_time"))).otherwise(0.0))


def adapter_scores(log: DataFrame, by: list[str] | None = None, influence: bool = False) -> DataFrame:
    """The search adapters' scores among valid rows: .42 R + .38 cNBI + .20 time, or .55 / .30 / .15 for influence."""
    valid = F.col("valid")
    columns = (("spread", True, 0.55), ("coverage", True, 0.30), ("time_s", False, 0.15)) if influence else (("R", False, 0.42), ("auc_cNBI", True, 0.38), ("time_s", False, 0.20))
    ranked = with_ranks(log, {f"_r_{c}": Rank(F.col(c), higher, valid, "e") for c, higher, _ in columns}, by)
    score = sum((w * F.col(f"_r_{c}") for c, _, w in columns), F.lit(0.0))
    return ranked.withColumn("adapter_score", F.when(valid, score).otherwise(-1.0)).select(*log.columns, "adapter_score")


def group_scores(log: DataFrame, group: str, weights: dict[str, tuple[float, float, float]], other: tuple[float, float, float]) -> DataFrame:
    """A score of auc, R and time ranks whose weights depend on the row's group."""
    ranked = with_ranks(log, {f"_r_{c}": Rank(F.col(c), higher, F.col("valid"), "d") for c, higher in (("auc_cNBI", True), ("R", False), ("time_s", False))})
    value = lambda w: sum((x * F.col(f"_r_{c}") for x, c in zip(w, ("auc_cNBI", "R", "time_s"), strict=True)), F.lit(0.0))
    score = value(other)
    for name, w in weights.items():
        score = F.when(F.col(group) == name, value(w)).otherwise(score)
    return ranked.withColumn("group_score", F.when(F.col("valid"), score)).select(*log.columns, "group_score")


def tie_groups(results: DataFrame, by: str = "dataset") -> DataFrame:
    """Adds rank_spread and rank_tie_group to valid rows: walking down the means, a new group begins where the gap to the
    row before is more than both confidence radii.

    Rows that agree in mean and method are in one group, whichever of them a sort puts first; of these the last radius counts.
    """
    ci = F.coalesce("spread_ci95", F.lit(0.0))
    w = Window.partitionBy(by).orderBy(F.desc("spread"), "method", ci)
    new = F.coalesce((F.lag("spread").over(w) - F.col("spread") > F.coalesce(F.lag(ci).over(w), F.lit(0.0)) + ci).cast("int"), F.lit(0))
    ranked = results.where("valid").withColumn("_new", new).withColumn("rank_spread", average_rank(F.col("spread"), [by], False))
    alike = Window.partitionBy(by).orderBy(F.desc("spread"), "method")
    group = 1 + F.sum("_new").over(alike.rangeBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("rank_tie_group", F.concat(F.col(by), F.lit("-G"), group.cast("string"))).drop("_new")


def best_so_far(log: DataFrame, x: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds best_<x>: the largest x of valid rows up to each."""
    if not by:
        return running(log, [], [F.col(order)], F.when(F.col("valid"), F.col(x)), f"best_{x}", F.max, F.greatest)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(f"best_{x}", F.max(F.when(F.col("valid"), F.col(x))).over(w))
