"""Removal orders from one score per node: orders(graph, method, step, node)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.projections import both_ways
from ..sources.storage import Growing, durable, fresh
from .by_component import binned_edges, dealt
from .ordering import numbered
from .statistics import core_numbers, degrees, label_propagation, shared_neighbours, triangles


def _ranked(scored: DataFrame, method: str, *order: Column) -> DataFrame:
    placed = numbered(scored, ["graph"], list(order), "step")
    return placed.select("graph", F.lit(method).alias("method"), "step", F.col("id").alias("node"))


def score_order(scores: DataFrame, method: str) -> DataFrame:
    """scores(graph, id, score): largest score first, then smallest id."""
    return _ranked(scores, method, F.desc("score"), F.asc("id"))


def complete_order(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keeps each valid node's first place and appends the missing nodes by pos."""
    first = orders.groupBy("graph", "method", "node").agg(F.min("step").alias("at"))
    valid = first.join(nodes.select("graph", F.col("id").alias("node")), ["graph", "node"])
    cells = orders.select("graph", "method").distinct()
    missing = cells.join(nodes.select("graph", F.col("id").alias("node"), "pos"), "graph").join(first, ["graph", "method", "node"], "left_anti")
    both = valid.select("graph", "method", "node", F.lit(0).alias("late"), F.col("at").cast("long").alias("at")).unionByName(missing.select("graph", "method", "node", F.lit(1).alias("late"), F.col("pos").cast("long").alias("at")))
    return numbered(both, ["graph", "method"], [F.col("late"), F.col("at")], "step").select("graph", "method", "step", "node")


def degree_order(edges: DataFrame) -> DataFrame:
    """Largest degree first, then the id whose text sorts last."""
    return _ranked(degrees(edges), "DC", F.desc("degree"), F.desc(F.col("id").cast("string")))


def core_order(edges: DataFrame) -> DataFrame:
    """Largest core number, then degree, then id."""
    found = core_numbers(edges).join(degrees(edges), ["graph", "id"])
    return _ranked(found, "KCore", F.desc("core"), F.desc("degree"), F.desc("id"))


def clustering_scores(edges: DataFrame) -> DataFrame:
    """10^-clustering times the sum of the neighbours' degrees plus one."""
    d = degrees(edges)
    near = both_ways(edges).join(d.select("graph", F.col("id").alias("d"), "degree"), ["graph", "d"]).groupBy("graph", F.col("s").alias("id")).agg(F.sum(F.col("degree") + 1).alias("near"))
    return triangles(edges).join(near, ["graph", "id"]).select("graph", "id", (F.pow(F.lit(10.0), -F.col("clustering")) * F.col("near")).alias("score"))


def distances(edges: DataFrame, radius: int) -> DataFrame:
    """(graph, id, other): nodes at exactly `radius` steps from each node; one join a step, with what is nearer left out."""
    sym = both_ways(edges)
    here = sym.select("graph", F.col("s").alias("id"), F.col("s").alias("other")).distinct()
    seen, ring = here, here
    for _ in range(radius):
        step = ring.withColumnRenamed("other", "s").join(sym, ["graph", "s"]).select("graph", "id", F.col("d").alias("other")).distinct()
        ring = step.join(seen, ["graph", "id", "other"], "left_anti")
        seen = seen.unionByName(ring)
    return ring


def influence_scores(edges: DataFrame, radius: int = 2) -> DataFrame:
    """Collective influence: (degree - 1) times the sum of degree - 1 at distance `radius`; 0 for degree 1."""
    d = degrees(edges)
    far = distances(edges, radius).join(d.select("graph", F.col("id").alias("other"), "degree"), ["graph", "other"]).groupBy("graph", "id").agg(F.sum(F.col("degree") - 1).alias("far"))
    return d.join(far, ["graph", "id"], "left").select("graph", "id", ((F.col("degree") - 1) * F.coalesce("far", F.lit(0))).cast("double").alias("score"))


def redundancy_scores(edges: DataFrame, method: str, beta: float = 0.5, communities: DataFrame | None = None) -> DataFrame:
    """NDC: mean over neighbours v of the neighbours of u that aren't v's. NCDC: times beta inside a community. NDJC: also
    over the size of both neighbourhoods together."""
    if method not in ("NDC", "NCDC", "NDJC"):
        raise ValueError("method must be NDC, NCDC or NDJC")
    d = degrees(edges)
    shared = shared_neighbours(edges)
    both = shared.select("graph", F.col("src").alias("id"), F.col("dst").alias("v"), "common").unionByName(shared.select("graph", F.col("dst").alias("id"), F.col("src").alias("v"), "common"))
    met = both.join(d, ["graph", "id"]).join(d.select("graph", F.col("id").alias("v"), F.col("degree").alias("dv")), ["graph", "v"])
    value = (F.col("degree") - F.col("common")).cast("double")
    if method != "NDC":
        of = label_propagation(edges) if communities is None else communities
        met = met.join(of.select("graph", "id", F.col("community").alias("cu")), ["graph", "id"]).join(of.select("graph", F.col("id").alias("v"), F.col("community").alias("cv")), ["graph", "v"])
        value = value * F.when(F.col("cu") == F.col("cv"), beta).otherwise(1.0)
    if method == "NDJC":
        value = value / (F.col("degree") + F.col("dv") - F.col("common"))
    return met.groupBy("graph", "id").agg(F.avg(value).alias("score"))


#: Edges of a component that a task holds, (source, node) pairs of a batch of sources over tables, and about how many steps from
#: a source along an edge are a task's work.
BETWEEN_LOCAL, BETWEEN_PAIRS, BETWEEN_STEPS = 1_000_000, 500_000_000, 20_000_000


def betweenness(edges: DataFrame, blocks: int | None = None, local: int = BETWEEN_LOCAL, pairs: int = BETWEEN_PAIRS) -> DataFrame:
    """(graph, id, score): normalised betweenness. Paths stay in components: those of up to `local` edges are dealt to tasks by
    blocks of sources, small ones together, larger ones searched over tables, in batches of sources of up to `pairs` pairs of a
    source and a node. blocks: of sources, if their number isn't to follow from the work."""
    size = durable(degrees(edges).groupBy("graph").agg(F.count(F.lit(1)).alias("n")), "graph-sizes")
    own = durable(binned_edges(edges), "binned-edges")
    many = durable(own.groupBy("graph", "bin").agg(F.count(F.lit(1)).alias("_m")), "bin-sizes")
    of = lambda large: own.join(fresh(many.where((F.col("_m") > local) == large)), ["graph", "bin"])
    parts = _between_in_tasks(of(False), blocks)
    if not many.where(F.col("_m") > local).isEmpty():
        # Bins stand for graphs here.
        named = of(True).select(F.struct("graph", "bin").alias("graph"), "src", "dst")
        parts = parts.unionByName(_between_by_levels(durable(both_ways(named), "both-ways"), pairs).select("graph.graph", "id", "part"))
    return parts.groupBy("graph", "id").agg(F.sum("part").alias("part")).join(size, "graph").select("graph", "id", F.when(F.col("n") > 2, F.col("part") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("score"))


def _between_by_levels(sym: DataFrame, pairs: int) -> DataFrame:
    """(graph, id, part) over tables: all sources of a batch take a step at a time and count shortest paths; then what depends on
    each node is added up a level at a time, from the farthest on back."""
    ids = sym.select("graph", F.col("s").alias("id")).distinct()
    most = ids.groupBy("graph").count().agg(F.max("count")).first()[0]
    batches = -(-most * most // pairs)
    parts = [ids.select("graph", "id", F.lit(0.0).alias("part"))]
    for batch in range(batches):
        own = ids.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch)
        levels = [durable(own.select("graph", F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")), "between")]
        seen = Growing(levels[0].select("graph", "source", "id"), "between-seen")
        while True:
            step = levels[-1].withColumnRenamed("id", "s").join(sym, ["graph", "s"]).groupBy("graph", "source", F.col("d").alias("id")).agg(F.sum("paths").alias("paths"))
            new = durable(step.join(fresh(seen.rows), ["graph", "source", "id"], "left_anti"), "between")
            if new.isEmpty():
                break
            levels.append(new)
            seen.add(new.select("graph", "source", "id"))
        behind = levels[-1].withColumn("share", F.lit(0.0))
        for at in range(len(levels) - 1, 0, -1):
            parts.append(behind.groupBy("graph", "id").agg(F.sum("share").alias("part")))
            back = behind.select("graph", "source", F.col("id").alias("s"), ((1 + F.col("share")) / F.col("paths")).alias("each")).join(sym, ["graph", "s"]).groupBy("graph", "source", F.col("d").alias("id")).agg(F.sum("each").alias("each"))
            share = F.col("paths") * F.coalesce("each", F.lit(0.0))
            behind = durable(fresh(levels[at - 1]).join(back, ["graph", "source", "id"], "left").select("graph", "source", "id", "paths", share.alias("share")), "between-shares")
        parts = [durable(reduce(DataFrame.unionByName, parts).groupBy("graph", "id").agg(F.sum("part").alias("part")), "between-parts")]
    return parts[0]


def _trees_off(near: list[list[int]]) -> tuple[list[list[int]], list[int], list[float]]:
    """(neighbours without the trees that hang on the graph, nodes that each node stands for, paths through it that are settled).

    Leaves are taken off until there are none; a node stands for itself and what was taken off it. One node of a tree stays. The
    pairs that a node lies between are settled as far as one of the pair, at least, hangs on it.
    """
    degree, above, weight = [len(x) for x in near], [-1] * len(near), [1] * len(near)
    squares = [0] * len(near)  # of the numbers of nodes that hang on each node
    taken = [u for u, d in enumerate(degree) if d == 1]
    for u in taken:
        if degree[u] == 1:
            degree[u] = 0
            p = above[u] = next(v for v in near[u] if above[v] < 0)
            weight[p] += weight[u]
            squares[p] += weight[u] ** 2
            degree[p] -= 1
            if degree[p] == 1:
                taken.append(p)
    kept = [[v for v in x if above[v] < 0] if above[u] < 0 else [] for u, x in enumerate(near)]
    whole = [0] * len(near)
    for first in range(len(near)):
        if above[first] < 0 and not whole[first]:
            part, total = [first], 0
            whole[first] = -1
            for u in part:
                total += weight[u]
                for v in kept[u]:
                    if not whole[v]:
                        whole[v] = -1
                        part.append(v)
            for u in part:
                whole[u] = total
    for u in reversed(taken):
        if above[u] >= 0:
            whole[u] = whole[above[u]]
    settled = []
    for u, (n, w, s) in enumerate(zip(whole, weight, squares, strict=True)):
        hang, rest = w - 1, n - w
        settled.append(float(hang * hang - s + 2 * hang * rest))
    return kept, weight, settled


#: Pairs of a source and a node that a task searches at once.
BETWEEN_CELLS = 200_000


def _between(near: list[list[int]], weight: list[int], sources: list[int], total: list[float]) -> None:
    """Adds to total what lies between these sources and all others, which stand for `weight` nodes each. Some sources are searched
    at once, in arrays: a cell is a source and a node."""
    if not sources:
        return
    core = np.array([u for u, x in enumerate(near) if x])
    at = np.full(len(near), -1)
    at[core] = np.arange(n := len(core))
    degree = np.array([len(near[u]) for u in core])
    starts, ends = np.cumsum(degree) - degree, at[np.fromiter((v for u in core for v in near[u]), "int64", degree.sum())]
    stands, sums = np.array(weight, "float64")[core], np.zeros(n)
    many = max(1, BETWEEN_CELLS // n)
    for first in range(0, len(sources), many):
        own = at[np.array(sources[first : first + many])]
        rows = len(own)
        cell, node = np.arange(rows) * n + own, own
        origin, seen, paths, place = cell, np.zeros(rows * n, "bool"), np.zeros(rows * n), np.zeros(rows * n, "int64")
        seen[cell], paths[cell] = True, 1.0
        steps = []
        while len(cell):
            arcs = degree[node]
            nth = np.arange(arcs.sum()) - np.repeat(np.cumsum(arcs) - arcs - starts[node], arcs)
            end = ends[nth]
            to, source = np.repeat(cell - node, arcs) + end, np.repeat(cell, arcs)
            new = np.flatnonzero(~seen[to])
            to, source, end = to[new], source[new], end[new]
            seen[to] = True
            np.add.at(paths, to, paths[source])
            steps.append((source, to, end))
            nth = np.arange(len(to))
            place[to] = nth
            once = place[to] == nth
            cell, node = to[once], end[once]
        share = np.zeros(rows * n)
        for source, to, end in reversed(steps):
            np.add.at(share, source, paths[source] * ((stands[end] + share[to]) / paths[to]))
        share[origin] = 0.0
        sums += stands[own] @ share.reshape(rows, n)
    for u, x in zip(core.tolist(), sums.tolist(), strict=True):
        total[u] += x


def _between_in_tasks(edges: DataFrame, blocks: int | None) -> DataFrame:
    """(graph, id, part) of edges(graph, bin, src, dst, _m): a task takes a block of a bin's sources. Trees that hang on a component
    are settled in whole numbers; only what is left of it is searched."""
    most = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_work = F.least(F.lit(most), F.ceil(F.col("_m") * F.col("_m") / BETWEEN_STEPS)) if blocks is None else F.lit(blocks)
    cells = edges.withColumn("blocks", of_work.cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def part(pairs: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pairs["src"], *pairs["dst"]})
        index = {x: i for i, x in enumerate(ids)}
        near: list[list[int]] = [[] for _ in ids]
        for u, v in zip(pairs["src"], pairs["dst"], strict=True):
            near[index[u]].append(index[v])
            near[index[v]].append(index[u])
        block, blocks = int(pairs["block"].iloc[0]), int(pairs["blocks"].iloc[0])
        kept, weight, settled = _trees_off(near)
        total = settled if block == 0 else [0.0] * len(ids)
        _between(kept, weight, [u for u, x in enumerate(kept) if x][block::blocks], total)
        return pd.DataFrame({"graph": pairs["graph"].iloc[0], "id": ids, "part": total})

    return dealt(cells, "graph", "bin", "block").groupBy("graph", "bin", "block").applyInPandas(part, "graph string, id long, part double")


def cluc_order(edges: DataFrame) -> DataFrame:
    return score_order(clustering_scores(edges), "CLUC")


def influence_order(edges: DataFrame, radius: int = 2) -> DataFrame:
    return score_order(influence_scores(edges, radius), "CI")


def redundancy_order(edges: DataFrame, method: str) -> DataFrame:
    return score_order(redundancy_scores(edges, method), method)


def betweenness_order(edges: DataFrame) -> DataFrame:
    return score_order(betweenness(edges), "Betweenness")


def first_seeds(orders: DataFrame, k: int) -> DataFrame:
    return orders.where(F.col("step") <= k)
