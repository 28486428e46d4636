"""Removal by residual degree over tables, for graphs that no task can hold.

Degrees only fall while nodes go, so the order can be cut by them. What is removed while the largest residual degree is at
least d depends on nothing but the nodes of degree d or more now and the edges among them: that is a band. If a band fits a
task, a task runs through it. Else the band is one degree; then what goes is, in the order of ties, each node of that degree
that has no earlier one as a neighbour: the first maximal independent set in that order, which is found by rounds in which all nodes
that come before their undecided neighbours are chosen at once. After a band degrees are counted down by joins.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.projections import both_ways
from ..sources.storage import drop, durable, fresh
from .ordering import numbered


def _band(own: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One band in a task: kind 0 are nodes (a: id, b: degree, t: text), kind 1 edges (a, b) among them; floor is the least degree."""
    nodes, pairs = own[own["kind"] == 0], own[own["kind"] == 1]
    degree = dict(zip(nodes["a"].tolist(), nodes["b"].tolist(), strict=True))
    by_text = sorted(degree, key=str, reverse=last)
    tie = {u: i for i, u in enumerate(by_text)}
    near: dict[int, list[int]] = {u: [] for u in degree}
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
        near[a].append(b)
        near[b].append(a)
    floor = int(own["floor"].iloc[0]) if len(own) else 0
    heap, order = [(-d, tie[u], u) for u, d in degree.items()], []
    heapq.heapify(heap)
    while heap and -heap[0][0] >= floor:
        d, _, u = heapq.heappop(heap)
        if degree.get(u) != -d:
            continue
        order.append(u)
        del degree[u]
        for v in near[u]:
            if v in degree:
                degree[v] -= 1
                heapq.heappush(heap, (-degree[v], tie[v], v))
    return pd.DataFrame({"graph": own["graph"].iloc[0] if len(own) else None, "place": range(1, len(order) + 1), "id": order})


def _bands(alive: DataFrame, live: DataFrame, local: int) -> DataFrame:
    """(graph, floor, fits): each graph's next band: as many degrees, from the largest on, as `local` nodes and edges among
    them allow, or the largest alone."""
    held = alive.groupBy("graph", "degree").agg(F.count(F.lit(1)).alias("n"))
    ends = live.join(alive.select("graph", F.col("id").alias("src"), F.col("degree").alias("da")), ["graph", "src"]).join(alive.select("graph", F.col("id").alias("dst"), F.col("degree").alias("db")), ["graph", "dst"])
    inside = ends.groupBy("graph", F.least("da", "db").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("graph").orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    # A row for each degree that occurs: at most as many as the root of twice the edges.
    sums = held.unionByName(inside).groupBy("graph", "degree").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    floor = F.min(F.when(F.col("upto") <= local, F.col("degree")))
    return sums.groupBy("graph").agg(F.coalesce(floor, F.max("degree")).alias("floor"), floor.isNotNull().alias("fits"))


def _first_independent(nodes: DataFrame, pairs: DataFrame, before: Column) -> DataFrame:
    """(graph, id) of the first maximal independent set of nodes(graph, id). before: whether `id` comes before `other`."""
    sym = durable(both_ways(pairs).select("graph", F.col("s").alias("id"), F.col("d").alias("other")).withColumn("before", before), "level-pairs")
    open_, chosen = durable(nodes.select("graph", "id"), "level-open"), []
    while not open_.isEmpty():
        later = sym.join(open_, ["graph", "id"], "left_semi").join(open_.select("graph", F.col("id").alias("other")), ["graph", "other"], "left_semi").where("NOT before").select("graph", "id")
        won = durable(open_.join(fresh(later.distinct()), ["graph", "id"], "left_anti"), "level-chosen")
        chosen.append(won)
        beaten = sym.join(won, ["graph", "id"], "left_semi").select("graph", F.col("other").alias("id"))
        gone = fresh(won.unionByName(beaten).distinct())
        open_ = durable(open_.join(gone, ["graph", "id"], "left_anti"), "level-open", open_)
    drop(sym)
    return reduce(DataFrame.unionByName, chosen) if chosen else nodes.select("graph", "id")


def removal_by_degree(edges: DataFrame, nodes: DataFrame, method: str, last: bool, rate: float, local: int) -> DataFrame:
    """orders(graph, method, step, node) of the first rate * n steps: largest residual degree first; of ties the id whose text
    sorts last or, where `last` is false, first."""
    text = lambda c: F.col(c).cast("string")
    before = text("id") > text("other") if last else text("id") < text("other")
    tie = F.desc(text("id")) if last else F.asc(text("id"))
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    wanted = durable(n.select("graph", F.greatest(F.lit(1), F.least("n", F.bround(F.col("n") * rate))).cast("long").alias("steps")), "wanted")
    degree = both_ways(edges).groupBy("graph", F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    alive = durable(nodes.select("graph", "id").join(degree, ["graph", "id"], "left").select("graph", "id", F.coalesce("degree", F.lit(0)).alias("degree")), "alive")
    live, left = durable(edges.select("graph", "src", "dst"), "live"), wanted.withColumnRenamed("steps", "left")
    removed: list[DataFrame] = []
    while not left.isEmpty():
        bands = durable(_bands(alive, live, local).join(left.select("graph"), "graph"), "bands")
        inside = durable(alive.join(bands, "graph").where("degree >= floor"), "band-nodes")
        ids = inside.select("graph", "id", "fits", "floor")
        pairs = live.join(ids.withColumnRenamed("id", "src"), ["graph", "src"]).join(fresh(ids.select("graph", F.col("id").alias("dst"))), ["graph", "dst"])
        pairs = durable(pairs.select("graph", "src", "dst", "fits", "floor"), "band-pairs")
        rows = inside.where("fits").select("graph", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("degree").alias("b"), "floor").unionByName(pairs.where("fits").select("graph", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "floor"))
        run = lambda own: _band(own, last)
        gone = rows.groupBy("graph").applyInPandas(run, "graph string, place long, id long")
        crowded = inside.where("NOT fits")
        if not crowded.isEmpty():
            chosen = _first_independent(crowded, pairs.where("NOT fits").select("graph", "src", "dst"), before)
            gone = gone.unionByName(numbered(chosen, ["graph"], [tie], "place").select("graph", F.col("place").cast("long").alias("place"), "id"))
        gone = durable(gone, "removed")
        removed.append(gone.withColumn("band", F.lit(len(removed))))
        known = gone.groupBy("graph").agg(F.count(F.lit(1)).alias("went"))
        left = durable(left.join(fresh(known), "graph", "left").select("graph", (F.col("left") - F.coalesce("went", F.lit(0))).alias("left")).where("left > 0"), "left")
        # Graphs that are through drop out; the others' degrees fall by the neighbours that went.
        out = gone.select("graph", F.col("id").alias("src"), F.lit(True).alias("_src"))
        cut = live.join(fresh(left.select("graph")), "graph", "left_semi").join(fresh(out), ["graph", "src"], "left").join(fresh(out.withColumnsRenamed({"src": "dst", "_src": "_dst"})), ["graph", "dst"], "left")
        cut = durable(cut, "cut")
        fell = cut.where("_src AND _dst IS NULL").select("graph", F.col("dst").alias("id")).unionByName(cut.where("_dst AND _src IS NULL").select("graph", F.col("src").alias("id"))).groupBy("graph", "id").agg(F.count(F.lit(1)).alias("fell"))
        stays = alive.join(fresh(left.select("graph")), "graph", "left_semi").join(fresh(gone.select("graph", "id")), ["graph", "id"], "left_anti").join(fell, ["graph", "id"], "left")
        alive = durable(stays.select("graph", "id", (F.col("degree") - F.coalesce("fell", F.lit(0))).alias("degree")), "alive", alive)
        live = durable(cut.where("_src IS NULL AND _dst IS NULL").select("graph", "src", "dst"), "live", live)
        drop(cut)
    if not removed:
        return nodes.select("graph", F.lit(method).alias("method"), F.lit(0).cast("long").alias("step"), F.col("id").alias("node")).limit(0)
    placed = numbered(reduce(DataFrame.unionByName, removed), ["graph"], [F.col("band"), F.col("place")], "step").join(wanted, "graph").where("step <= steps")
    return placed.select("graph", F.lit(method).alias("method"), F.col("step").cast("long").alias("step"), F.col("id").alias("node"))
