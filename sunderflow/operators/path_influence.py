"""Seeds by maximum influence paths (MIA), by relaxation over tables: seeds(graph, method, step, node).

A path's chance is the product of its arcs'; paths below theta don't count. Each source's best paths are found by rounds of
relaxation for all sources of all graphs at once. A path carries the nodes that it crosses, so where a node becomes a seed, or
would, only the ends of paths that cross it are found again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable, drop, fresh
from .diffusion import arcs
from .seeds import _collected


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(keys, q, crossed) the one of largest q; of ties the path that sorts last."""
    return rows.groupBy(*keys).agg(F.max(F.struct("q", "crossed")).alias("_b")).select(*keys, "_b.*")


def _longer(paths: DataFrame, arc: DataFrame, theta: float) -> DataFrame:
    """Paths with an arc more: (keys, d, q, crossed), d in place of v. The first node isn't crossed, nor is the last."""
    keys = [c for c in paths.columns if c not in ("v", "q", "crossed")]
    met = paths.withColumnRenamed("v", "s").join(arc, ["graph", "s"])
    crossed = F.when(F.col("s") == F.col("u"), F.col("crossed")).otherwise(F.array_append("crossed", F.col("s")))
    return met.select(*keys, F.col("d").alias("v"), (F.col("q") * F.col("p")).alias("q"), crossed.alias("crossed")).where(F.col("q") >= theta)


def relaxed(paths: DataFrame, arc: DataFrame, theta: float, within: DataFrame | None = None) -> DataFrame:
    """paths(graph, u, ..., v, q, crossed) with all that arcs make of them, the best of each end.

    within: the (keys, v) that paths may come to, where they may not go anywhere. Rounds end when no end gets a better path.
    """
    keys = [c for c in paths.columns if c not in ("q", "crossed")]
    state = durable(_best(paths, keys), "paths")
    front = state
    while True:
        new = _longer(front, arc, theta)
        new = _best(new if within is None else new.join(fresh(within), keys, "left_semi"), keys)
        had = fresh(state.select(*keys, F.col("q").alias("_had")))
        better = durable(new.join(had, keys, "left").where(F.col("_had").isNull() | (F.col("q") > F.col("_had"))).drop("_had"), "better-paths", replaces=None if front is state else front)
        front = better
        if better.isEmpty():
            break
        kept = state.join(fresh(better.select(*keys)), keys, "left_anti")
        state = durable(kept.unionByName(better), "paths", replaces=state)
    if front is not state:
        drop(front)
    return state


def crossings(paths: DataFrame) -> DataFrame:
    """(graph, u, x, v): the index of paths (u to v) by each node x that they cross."""
    return paths.select("graph", "u", F.explode("crossed").alias("x"), "v")


def renewed(paths: DataFrame, lost: DataFrame, arc: DataFrame, theta: float) -> DataFrame:
    """(graph, u, x, v, q, crossed): the best paths that avoid x, of the (graph, u, x, v) in `lost` that still have one.

    lost holds all ends v whose path from u crosses x. Other ends keep their paths, so those start what is found again.
    """
    keys = ["graph", "u", "x"]
    if lost.isEmpty():
        return lost.select(*keys, "v", F.lit(1.0).alias("q"), F.array().cast("array<bigint>").alias("crossed"))
    into = lost.join(arc.withColumnRenamed("d", "v"), ["graph", "v"]).where(F.col("s") != F.col("x")).select(*keys, "v", "s", "p")
    whole = into.join(fresh(lost.withColumnRenamed("v", "s")), [*keys, "s"], "left_anti")
    met = whole.join(fresh(paths.withColumnRenamed("v", "s")), ["graph", "u", "s"])
    crossed = F.when(F.col("s") == F.col("u"), F.col("crossed")).otherwise(F.array_append("crossed", F.col("s")))
    first = met.select(*keys, "v", (F.col("q") * F.col("p")).alias("q"), crossed.alias("crossed")).where(F.col("q") >= theta)
    return relaxed(first, arc, theta, lost)


def _without(paths: DataFrame, chosen: DataFrame, arc: DataFrame, theta: float) -> DataFrame:
    """paths that avoid the newly chosen (graph, x): those that end there go, those that cross it are found again."""
    lost = durable(crossings(paths).join(chosen, ["graph", "x"], "left_semi").select("graph", "u", "x", "v"), "lost-paths")
    ended = chosen.select("graph", F.col("x").alias("v"))
    kept = paths.join(ended, ["graph", "v"], "left_anti").join(fresh(lost.select("graph", "u", "v")), ["graph", "u", "v"], "left_anti")
    columns = ["graph", "u", "v", "q", "crossed"]
    return durable(kept.select(*columns).unionByName(renewed(paths, lost, arc, theta).select(*columns)), "paths")


def _gains(own: DataFrame, seeded: DataFrame, again: DataFrame, lost: DataFrame) -> DataFrame:
    """(graph, node, gain): how much the expected number of reached nodes other than seeds grows by each candidate.

    own: candidates' paths; seeded: seeds'; lost and again: seeds' paths that cross a candidate, and what they are without.
    """
    chance = lambda df, *c: df.select("graph", *c, "v", F.col("q"))
    miss = seeded.where("u <> v").groupBy("graph", "v").agg(F.product(1 - F.col("q")).alias("miss"))
    mine = chance(own.where("u <> v"), F.col("u").alias("node"))
    pairs = mine.select("graph", "node", "v").unionByName(lost.select("graph", F.col("x").alias("node"), "v")).distinct()
    through = lost.select("graph", F.col("x").alias("node"), "u", "v").join(fresh(again.select("graph", F.col("x").alias("node"), "u", "v", F.col("q").alias("again"))), ["graph", "node", "u", "v"], "left").select("graph", "node", "u", "v", F.coalesce("again", F.lit(0.0)).alias("instead"))
    others = pairs.join(fresh(chance(seeded.where("u <> v"), "u")), ["graph", "v"]).join(through, ["graph", "node", "u", "v"], "left")
    seeds_miss = others.groupBy("graph", "node", "v").agg(F.product(1 - F.coalesce("instead", "q")).alias("theirs"))
    each = pairs.join(fresh(mine), ["graph", "node", "v"], "left").join(seeds_miss, ["graph", "node", "v"], "left").join(fresh(miss), ["graph", "v"], "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    more = each.groupBy("graph", "node").agg(F.sum(one("miss") - (1 - F.coalesce("q", F.lit(0.0))) * one("theirs")).alias("more"))
    candidates = own.select("graph", F.col("u").alias("node")).distinct()
    had = miss.select("graph", F.col("v").alias("node"), (1 - F.col("miss")).alias("had"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return candidates.join(fresh(more), ["graph", "node"], "left").join(fresh(had), ["graph", "node"], "left").select("graph", "node", (zero("more") - zero("had")).alias("gain"))


def mia(edges: DataFrame, nodes: DataFrame, k: int, p: float | None = 0.1, theta: float = 1e-3) -> DataFrame:
    """Greedy on the MIA spread: seeds, plus each other node's chance to be reached by some seed's best path, where paths of
    a seed avoid the others. Gains are rounded to nine places; those that tie go to the id whose text sorts first.

    Graphs with fewer nodes than k give all of them; nodes without edges reach nobody. p None: weighted cascade.
    """
    arc = durable(arcs(edges, p).where("s <> d").distinct(), "arcs")
    start = lambda df, c: df.select("graph", F.col(c).alias("u"), F.col(c).alias("v"), F.lit(1.0).alias("q"), F.array().cast("array<bigint>").alias("crossed"))
    own, picks = relaxed(start(nodes, "id"), arc, theta), []
    seeded = own.limit(0)
    for _ in range(k):
        lost = durable(crossings(seeded), "crossings")
        gains = _gains(own, seeded, renewed(seeded, lost, arc, theta), lost)
        top = gains.groupBy("graph").agg(F.min(F.struct(-F.round("gain", 9), F.col("node").cast("string"), "node")).alias("_top"))
        picks.append(durable(top.select("graph", "_top.node"), "chosen"))
        chosen = picks[-1].select("graph", F.col("node").alias("x"))
        source = chosen.withColumnRenamed("x", "u")
        theirs = own.join(fresh(source), ["graph", "u"], "left_semi")
        seeded = durable(_without(seeded, chosen, arc, theta).unionByName(theirs.select("graph", "u", "v", "q", "crossed")), "seed-paths")
        own = _without(own.join(fresh(source), ["graph", "u"], "left_anti"), chosen, arc, theta)
    return _collected(picks, "MIA") if picks else nodes.select("graph", F.lit("MIA").alias("method"), F.lit(0).alias("step"), F.col("id").alias("node")).limit(0)
