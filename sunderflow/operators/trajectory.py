"""How a graph falls apart along a removal order, and what the curves come to."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import durable, fresh
from .components import connected_components
from .ordering import running_sum

_POINTS = "graph string, method string, step long, largest long, parts long, top5 long, squares double, alive long, n long"


class Sizes:
    """The sizes of components while nodes of 0 .. n-1 and edges are added: their number, sum of squares and five largest."""

    def __init__(self, n: int):
        self.parent, self.size = array("q", range(n)), array("q", bytes(8 * n))
        self.count: dict[int, int] = {}
        self.heap: list[int] = []
        self.parts = self.squares = 0

    def change(self, s: int, by: int) -> None:
        """by more components of s nodes."""
        before = self.count.get(s, 0)
        self.count[s] = before + by
        if before <= 0 < before + by:
            heapq.heappush(self.heap, -s)
        self.parts += by
        self.squares += by * s * s

    def add(self, u: int, s: int = 1) -> None:
        self.size[u] = s
        self.change(s, 1)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, u: int, v: int) -> None:
        a, b = self.root(u), self.root(v)
        if a == b:
            return
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.change(self.size[a], -1)
        self.change(self.size[b], -1)
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.change(self.size[a], 1)

    def five(self) -> tuple[int, int]:
        """The largest size and the sum of the five largest."""
        seen, total, left = [], 0, 5
        while self.heap and left:
            s = -heapq.heappop(self.heap)
            if not self.count[s] or (seen and seen[-1] == s):
                continue
            seen.append(s)
            total += s * min(left, self.count[s])
            left -= min(left, self.count[s])
        for s in seen:
            heapq.heappush(self.heap, -s)
        return (seen[0] if seen else 0), total


class _Joins:
    """Pairs of nodes by the step low + 1 .. high that takes them away, in arrays."""

    def __init__(self, low: int, high: int, steps: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(steps, kind="stable")
        self.low, self.first = low, array("q", np.searchsorted(steps[order], np.arange(low + 1, high + 2)).astype(np.int64).tobytes())
        self.a, self.b = (array("q", x[order].astype(np.int64).tobytes()) for x in (a, b))

    def at(self, k: int) -> Iterator[tuple[int, int]]:
        i, j = self.first[k - self.low - 1], self.first[k - self.low]
        return zip(self.a[i:j], self.b[i:j], strict=True)


_REPLAYED = ["step", "largest", "top5", "parts", "squares"]


def _replayed(sizes: Sizes, low: int, high: int, node: np.ndarray, joins: _Joins) -> pd.DataFrame:
    """The sizes after low + 1 .. high removals, by adding nodes again from the last one back; node: those of the steps in turn."""
    out = {c: array("d" if c == "squares" else "q", bytes(8 * (high - low))) for c in _REPLAYED}
    for i in range(high - low - 1, -1, -1):
        out["step"][i], out["parts"][i], out["squares"][i] = low + 1 + i, sizes.parts, float(sizes.squares)
        out["largest"][i], out["top5"][i] = sizes.five()
        sizes.add(int(node[i]))
        for a, b in joins.at(low + 1 + i):
            sizes.join(a, b)
    return pd.DataFrame({c: np.array(x) for c, x in out.items()})


def _array(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy()


def _points(key: tuple, out: pd.DataFrame, n: int) -> pa.Table:
    """A cell's replayed steps as points; key begins with graph and method."""
    rows = len(out)
    columns = {"graph": pa.repeat(key[0], rows), "method": pa.repeat(key[1], rows), **{c: out[c].to_numpy("float64" if c == "squares" else "int64") for c in _REPLAYED}}
    columns["alive"], columns["n"] = n - columns["step"], np.full(rows, n)
    return pa.table({c.split(" ")[0]: columns[c.split(" ")[0]] for c in _POINTS.split(", ")})


#: Nodes and edges that a task replays.
LOCAL = 2_000_000


def curve(edges: DataFrame, orders: DataFrame, rate: float | None = 0.3, local: int = LOCAL) -> DataFrame:
    """One row per (graph, method, step): GCC, NCC and the other measures after `step` removals.

    orders(graph, method, step, node) is complete. rate None takes every step. A cell (graph, method) of up to `local` nodes and
    edges is a task's work; larger ones are cut into blocks of steps, which tasks replay on their own (points_in_blocks).
    """
    cells = orders.groupBy("graph", "method").agg(F.count(F.lit(1)).alias("n"))
    steps = F.greatest(F.lit(1), F.least("n", F.bround(F.col("n") * rate))) if rate is not None else F.col("n")
    cells = cells.withColumn("steps", steps.cast("long")).join(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("m")), "graph", "left")
    cells = durable(cells.withColumn("size", F.col("n") + F.coalesce("m", F.lit(0))), "cells")
    small, large = cells.where(F.col("size") <= local), cells.where(F.col("size") > local)
    points = _points_in_tasks(edges, orders, small)
    if not large.isEmpty():
        points = points.unionByName(points_in_blocks(edges, orders, large, local))
    return with_running(measures(points))


def _points_in_tasks(edges: DataFrame, orders: DataFrame, cells: DataFrame) -> DataFrame:
    def run(key: tuple, own: pa.Table, pairs: pa.Table) -> pa.Table:
        n = own.num_rows
        if not n:
            return _points(key, pd.DataFrame(columns=_REPLAYED), 0)
        steps, node, step = own["steps"][0].as_py(), _array(own, "node"), _array(own, "step")
        by_id = np.argsort(node)
        ids, places = node[by_id], step[by_id] - 1
        del node, step, by_id
        a, b = (places[np.searchsorted(ids, _array(pairs, c))] for c in ("src", "dst"))
        del ids, places
        joins, sizes = _Joins(0, n, np.minimum(a, b) + 1, a, b), Sizes(n)
        del a, b
        for k in range(n, steps, -1):
            sizes.add(k - 1)
            for a, b in joins.at(k):
                sizes.join(a, b)
        return _points(key, _replayed(sizes, 0, steps, np.arange(steps), joins), n)

    own = orders.join(cells.select("graph", "method", "steps"), ["graph", "method"])
    spread = fresh(edges.join(cells, "graph").select("graph", "method", "src", "dst"))
    return own.groupBy("graph", "method").cogroup(spread.groupBy("graph", "method")).applyInArrow(run, _POINTS)


_CELL = ["graph", "method"]


def points_in_blocks(edges: DataFrame, orders: DataFrame, cells: DataFrame, local: int = LOCAL) -> DataFrame:
    """The points of cells(graph, method, n, steps), each in blocks of steps of about `local` nodes and edges.

    An edge goes with the first of its ends, at its step. Blocks are replayed backwards from their last step, for which their
    task needs what the graph is by then: its components, as single nodes with sizes, as far as edges of the block touch them;
    of the others only how many there are of each size. These states are found by halving: a run of blocks is split into a
    later and an earlier half; the later half begins as the run does, the earlier one with the components that the later half's
    edges join. So each halving looks at every edge once, and log2 of the blocks' number of them are made.
    """
    rank = orders.join(cells.select(*_CELL), _CELL).select(*_CELL, F.col("node").alias("id"), F.col("step").cast("long").alias("r"))
    a, b = rank.withColumnsRenamed({"id": "src", "r": "ra"}), rank.withColumnsRenamed({"id": "dst", "r": "rb"})
    until = durable(edges.join(cells.select("graph").distinct(), "graph", "left_semi").join(a, ["graph", "src"]).join(b, ["graph", "method", "dst"]).select(*_CELL, F.col("src").alias("a"), F.col("dst").alias("b"), F.least("ra", "rb").alias("r")), "until")
    # Blocks of steps by what they hold.
    held = rank.select(*_CELL, "r").unionByName(until.select(*_CELL, "r")).groupBy(*_CELL, "r").agg(F.count(F.lit(1)).alias("held"))
    held = held.join(cells.select(*_CELL, "steps"), _CELL).where("r <= steps")
    blocks = running_sum(held, _CELL, [F.col("r")], F.col("held"), "upto").select(*_CELL, "r", F.expr(f"(upto - 1) div {local}").alias("block"))
    blocks = durable(blocks, "blocks")
    depth = max(0, int(blocks.agg(F.max("block")).first()[0] or 0)).bit_length()
    # The state at the last step: components of what is never removed.
    of_block = lambda df: df.join(blocks, [*_CELL, "r"], "left").withColumn("run", F.lit(0).cast("long"))
    pairs = durable(of_block(until).select(*_RUN, "block", "a", "b", "r"), "pairs")
    alone = of_block(rank).select(*_RUN, "block", "id", F.lit(1).cast("long").alias("size"), "r")
    nodes, parts = _contracted(alone, pairs.where("block IS NULL"), F.col("block").isNull())
    state = _settled(nodes, _moved(pairs.where("block IS NOT NULL"), parts), None)
    for level in reversed(range(depth)):
        state = _halved(state, level)
    return _replay(state, blocks, cells)


_RUN = [*_CELL, "run"]


class _State(NamedTuple):
    """Where runs of blocks begin, from their last step back: nodes(.., run, block, id, size, r), with block and step r if they come
    later; pairs(.., run, block, a, b, r) to be joined; sizes(.., run, size, many) of the components that no pair touches."""

    nodes: DataFrame
    pairs: DataFrame
    sizes: DataFrame


def _contracted(nodes: DataFrame, joined: DataFrame, there: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, parts(.., run, id, part)): the nodes that `there` holds for, as the components that the pairs join them to."""
    end = lambda c: F.struct(*_RUN, F.col(c).alias("id"))
    parts = connected_components(joined.select(end("a").alias("src"), end("b").alias("dst"))).select("id.*", F.col("component.id").alias("part"))
    parts = durable(parts, "contracted")
    none = F.lit(None).cast("long")
    made = nodes.where(there).join(parts, [*_RUN, "id"], "left").groupBy(*_RUN, F.coalesce("part", "id").alias("id")).agg(F.sum("size").alias("size"))
    return made.select(*_RUN, none.alias("block"), "id", "size", none.alias("r")).unionByName(nodes.where(~there)), parts


def _moved(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs between what parts has made of their ends; repeated ones are one."""
    end = lambda c: parts.select(*_RUN, F.col("id").alias(c), F.col("part").alias(f"_{c}"))
    met = pairs.join(end("a"), [*_RUN, "a"], "left").join(end("b"), [*_RUN, "b"], "left")
    return met.select(*_RUN, "block", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "r").distinct()


def _settled(nodes: DataFrame, pairs: DataFrame, sizes: DataFrame | None) -> _State:
    """The state in which components without a pair are but sizes."""
    pairs = durable(pairs, "state-pairs")
    ends = pairs.select(*_RUN, F.col("a").alias("id")).unionByName(pairs.select(*_RUN, F.col("b").alias("id"))).distinct()
    marked = durable(nodes.join(ends.withColumn("_met", F.lit(True)), [*_RUN, "id"], "left"), "state-nodes")
    met = F.col("_met").isNotNull() | F.col("r").isNotNull()
    left = marked.where(~met).groupBy(*_RUN, "size").agg(F.count(F.lit(1)).alias("many"))
    if sizes is not None:
        left = left.unionByName(sizes).groupBy(*_RUN, "size").agg(F.sum("many").alias("many"))
    return _State(marked.where(met).drop("_met"), pairs, durable(left, "state-sizes"))


def _halved(state: _State, level: int) -> _State:
    """The state of both halves of each run: 2 run + 1 is the later one, 2 run the earlier one."""
    late = F.shiftright("block", level).bitwiseAND(F.lit(1)) == 1
    half = lambda df, later: df.withColumn("run", 2 * F.col("run") + int(later))
    there = F.col("block").isNull() | late
    later, earlier = state.pairs.where(late), state.pairs.where(~late)
    nodes, parts = _contracted(state.nodes, later, there)
    both = half(state.nodes.where(there), True).unionByName(half(nodes, False))
    return _settled(both, half(later, True).unionByName(half(_moved(earlier, parts), False)), half(state.sizes, True).unionByName(half(state.sizes, False)))


def _replay(state: _State, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The points of every block, one task each; runs are blocks by now."""
    nodes, pairs, sizes = state
    none = F.lit(None).cast("long")
    rows = nodes.select(*_RUN, F.lit(0).alias("kind"), "id", "size", "r").unionByName(pairs.select(*_RUN, F.lit(1).alias("kind"), F.col("a").alias("id"), F.col("b").alias("size"), "r"))
    rows = rows.unionByName(sizes.select(*_RUN, F.lit(2).alias("kind"), F.col("many").alias("id"), "size", none.alias("r")))
    # What is the same for a whole block is in a row of its own: its first and last step and the graph's nodes.
    spans = blocks.groupBy(*_CELL, F.col("block").alias("run")).agg(F.min("r").alias("first"), F.max("r").alias("last")).join(cells.select(*_CELL, "n"), _CELL)
    rows = rows.unionByName(spans.select(*_RUN, F.lit(3).alias("kind"), F.col("first").alias("id"), F.col("last").alias("size"), F.col("n").alias("r")))

    def run(key: tuple, own: pa.Table) -> pa.Table:
        kind, x, y = (_array(own, c) for c in ("kind", "id", "size"))
        r = _array(own.set_column(own.schema.get_field_index("r"), "r", pc.fill_null(own["r"], 0)), "r")  # steps begin with 1
        span = np.flatnonzero(kind == 3)
        if not len(span):
            return _points(key, pd.DataFrame(columns=_REPLAYED), 0)
        first, last, n = int(x[span[0]]), int(y[span[0]]), int(r[span[0]])
        ids = np.sort(x[kind == 0])
        state, later = Sizes(len(ids)), (kind == 0) & (r > 0)
        for many, s in zip(x[kind == 2].tolist(), y[kind == 2].tolist(), strict=True):
            state.change(s, many)
        there = (kind == 0) & (r == 0)
        for u, s in zip(np.searchsorted(ids, x[there]), y[there], strict=True):
            state.add(int(u), int(s))
        node = np.zeros(last - first + 1, np.int64)
        node[r[later] - first] = np.searchsorted(ids, x[later])
        pair = kind == 1
        joins = _Joins(first - 1, last, r[pair], *(np.searchsorted(ids, z[pair]) for z in (x, y)))
        del kind, x, y, r, ids, later, there, pair
        return _points(key, _replayed(state, first - 1, last, node, joins), n)

    slim = rows.select(*_RUN, F.col("kind").cast("byte").alias("kind"), "id", "size", "r")
    return slim.groupBy(*_RUN).applyInArrow(run, _POINTS)


def measures(points: DataFrame) -> DataFrame:
    """The measures of (graph, method, step, largest, parts, top5, squares, alive, n)."""
    n, alive = F.col("n").cast("double"), F.greatest(F.lit(1), F.col("alive")).cast("double")
    hhi = F.col("squares") / (alive * alive)
    effective = F.when(hhi > 0, 1 / hhi).otherwise(0.0)
    pairs = 1 - (F.col("squares") - F.col("alive")) / F.greatest(F.lit(1.0), n * (n - 1))
    top5 = F.col("top5") / n
    return points.select(
        "graph", "method", "step", (F.col("step") / n).alias("removal_ratio"), (F.col("largest") / n).alias("ACC"), (F.col("largest") / n).alias("GCC"), F.col("parts").cast("double").alias("NCC"),
        top5.alias("top5_component_mass"), hhi.alias("hhi_remaining"), effective.alias("effective_components"), pairs.alias("pairwise_disconnected"), (pairs * effective / (1 + top5)).alias("cNBI"),
    )


def with_running(curves: DataFrame) -> DataFrame:
    """Adds the means of GCC and cNBI up to each step."""
    upto = Window.partitionBy("graph", "method").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return curves.withColumn("running_R", F.avg("GCC").over(upto)).withColumn("running_auc_cNBI", F.avg("cNBI").over(upto))


def at(edges: DataFrame, orders: DataFrame, steps: list[int]) -> DataFrame:
    """The curve at a few steps, by joins and aggregations only: components of all steps' residual graphs in one run."""
    spark = edges.sparkSession
    ks = spark.createDataFrame([(k,) for k in steps], "step long")
    rank = orders.select("graph", "method", F.col("node").alias("id"), F.col("step").alias("r"))
    a, b = rank.withColumnsRenamed({"id": "src", "r": "ra"}), rank.withColumnsRenamed({"id": "dst", "r": "rb"})
    until = edges.join(a, ["graph", "src"]).join(b, ["graph", "method", "dst"]).withColumn("until", F.least("ra", "rb"))
    alive = until.join(F.broadcast(ks), F.col("until") > F.col("step"))
    end = lambda c: F.struct("graph", "method", "step", F.col(c).alias("id"))
    joined = connected_components(alive.select(end("src").alias("src"), end("dst").alias("dst"))).select("id.*", F.col("component.id").alias("part"))
    nodes = rank.join(F.broadcast(ks), F.col("r") > F.col("step")).select("graph", "method", "step", "id")
    parts = nodes.join(joined, ["graph", "method", "step", "id"], "left").groupBy("graph", "method", "step", F.coalesce("part", "id").alias("part")).agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy("graph", "method", "step").orderBy(F.desc("size"), "part"))
    sums = parts.withColumn("place", place).groupBy("graph", "method", "step").agg(
        F.max("size").alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("place") <= 5, F.col("size")).otherwise(0)).alias("top5"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"), F.sum("size").alias("alive"),
    )
    total = rank.groupBy("graph", "method").agg(F.count(F.lit(1)).alias("n"))
    every = total.join(F.broadcast(ks)).where("step <= n").join(sums, ["graph", "method", "step"], "left")
    return measures(every.fillna(0, ["largest", "parts", "top5", "squares", "alive"]))


def area(curves: DataFrame, by: list[str], x: str, ys: list[str]) -> DataFrame:
    """auc_<y>: trapezoids over the span of x; the mean without a span."""
    w = Window.partitionBy(*by).orderBy(x)
    step = F.col(x) - F.lag(x).over(w)
    named = reduce(lambda d, y: d.withColumn(f"_{y}", step * (F.col(y) + F.lag(y).over(w)) / 2), ys, curves)
    span = F.max(x) - F.min(x)
    return named.groupBy(*by).agg(*[F.when(span > 0, F.sum(f"_{y}") / span).otherwise(F.avg(y)).alias(f"auc_{y}") for y in ys])


def summary(curves: DataFrame, early: float = 0.2) -> DataFrame:
    """Per (graph, method): R, the areas, the last step's values and those of the first step nearest to `early`."""
    cell = ["graph", "method"]
    near = F.struct(F.abs(F.col("removal_ratio") - early), F.col("step"))
    last = curves.groupBy(*cell).agg(
        F.avg("GCC").alias("R"), *[F.max_by(c, "step").alias(f"final_{c}") for c in ("ACC", "NCC", "cNBI")], *[F.min_by(c, near).alias(f"early_{c}") for c in ("GCC", "NCC", "cNBI")]
    )
    return area(curves, cell, "removal_ratio", ["ACC", "NCC", "cNBI"]).join(last, cell)


def classic_r(full_curves: DataFrame) -> DataFrame:
    """100 times the mean GCC over all n removals, from a curve with rate None."""
    return full_curves.groupBy("graph", "method").agg((100 * F.avg("GCC")).alias("classic_R"))


def residual_measures(curves: DataFrame, step: int) -> DataFrame:
    """One residual state: GCC, top five's mass, effective components and hidden score."""
    return curves.where(F.col("step") == step).select("graph", "method", "step", "GCC", "top5_component_mass", "effective_components", F.col("cNBI").alias("hidden_score"))


def mini_evaluation(full_curves: DataFrame) -> DataFrame:
    """The short evaluation of whole orders: mean GCC, and the mean of NCC / n (which is no cNBI)."""
    n = F.round(F.col("step") / F.col("removal_ratio"))
    return full_curves.groupBy("graph", "method").agg(F.avg("GCC").alias("mean_gcc"), F.avg(F.col("NCC") / n).alias("ncc_ratio_mean"))


def threshold_nodes(curves: DataFrame, tau: float = 0.01) -> DataFrame:
    """The first step with GCC <= tau, else the last one with reached false."""
    hit = F.min(F.when(F.col("GCC") <= tau, F.col("step")))
    return curves.groupBy("graph", "method").agg(F.coalesce(hit, F.max("step")).alias("ct_nodes"), hit.isNotNull().alias("reached"))


def threshold_ratio(curves: DataFrame, taus: list[float], interpolated: bool = True) -> DataFrame:
    """Per threshold the removal ratio at which GCC falls to it; interpolated from (0, 1) on, or the step's own."""
    cell = ["graph", "method"]
    w = Window.partitionBy(*cell).orderBy("step")
    t = F.explode(F.array(*[F.lit(x) for x in taus])).alias("tau")
    rows = curves.select(*cell, "step", "removal_ratio", "GCC", F.coalesce(F.lag("removal_ratio").over(w), F.lit(0.0)).alias("x0"), F.coalesce(F.lag("GCC").over(w), F.lit(1.0)).alias("y0")).select("*", t)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("tau") - F.col("y0")) / F.nullif(F.col("GCC") - F.col("y0"), F.lit(0.0))))
    value = F.coalesce(F.col("x0") + part * (F.col("removal_ratio") - F.col("x0")), F.col("removal_ratio")) if interpolated else F.col("removal_ratio")
    hit = F.min_by(F.when(F.col("GCC") <= F.col("tau"), value), F.when(F.col("GCC") <= F.col("tau"), F.col("step")))
    return rows.groupBy(*cell, "tau").agg(F.coalesce(hit, F.max("removal_ratio")).alias("ct_ratio"), F.count_if(F.col("GCC") <= F.col("tau")).alias("n")).select(*cell, "tau", "ct_ratio", (F.col("n") > 0).alias("reached"))


def prefix_change(orders: DataFrame, base: str, share: float = 0.2) -> DataFrame:
    """Per (graph, method): how many of the first share * n places differ from the base method's."""
    n = orders.groupBy("graph").agg(F.countDistinct("node").alias("n"))
    first = orders.join(n, "graph").where(F.col("step") <= F.greatest(F.lit(1), F.bround(F.col("n") * share)))
    other = first.where(F.col("method") == base).select("graph", "step", F.col("node").alias("b"))
    return first.join(other, ["graph", "step"]).groupBy("graph", "method").agg(F.avg((F.col("node") != F.col("b")).cast("double")).alias("change_rate"))


def stride_sample(curves: DataFrame, points: int = 180) -> DataFrame:
    """Every max(1, rows // points)-th row of each curve, from the first."""
    cell = Window.partitionBy("graph", "method")
    stride = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(cell) / points))
    return curves.withColumn("_s", stride).withColumn("_i", F.row_number().over(cell.orderBy("step")) - 1).where("_i % _s = 0").drop("_s", "_i")


def same_gcc_pairs(curves: DataFrame, tolerance: float = 0.003, gap: float = 15.0, points: int = 180) -> DataFrame:
    """Pairs of methods' sampled points with nearly equal GCC and far apart cNBI: per point the other method's nearest.

    The curves meet in bands of GCC as wide as the tolerance, a point with its own and the two next to it, so it is an
    equi-join.
    """
    band = F.floor(F.col("GCC") / tolerance)
    rows = stride_sample(curves, points).select("graph", "method", "step", "removal_ratio", "GCC", "cNBI")
    a = rows.select("graph", *[F.col(c).alias(f"{c}_a") for c in rows.columns[1:]], F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = rows.select("graph", *[F.col(c).alias(f"{c}_b") for c in rows.columns[1:]], band.alias("band"))
    off = F.abs(F.col("GCC_a") - F.col("GCC_b"))
    met = a.join(b, ["graph", "band"]).where((F.col("method_a") < F.col("method_b")) & (off <= tolerance)).withColumn("gcc_diff", off)
    near = Window.partitionBy("graph", "method_a", "method_b", "step_a").orderBy("gcc_diff", "step_b")
    best = met.withColumn("_n", F.row_number().over(near)).where("_n = 1").withColumn("hidden_gap", F.abs(F.col("cNBI_a") - F.col("cNBI_b")))
    return best.where(F.col("hidden_gap") >= gap).drop("_n", "band")
