"""Independent Cascade and Linear Threshold diffusion with coins and thresholds that are hashes of their place.

Worlds are rows, so all of them spread at once by joins; every method sees the same worlds. seeds(graph, method, node).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash_uniform
from ..sources.projections import both_ways
from ..sources.storage import Growing, durable, fresh
from .components import connected_components

#: The seed of the formal worlds (fixed value).
SEED = 20260626


def probability(candidates: list[Column], fallback: Column) -> Column:
    """The first candidate that is a number, cut to [0, 1]; else the fallback."""
    found = F.coalesce(*[c.try_cast("double") for c in candidates]) if candidates else F.lit(None).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)), fallback)


def arcs(edges: DataFrame, p: float | None = 0.1, directed: bool = False) -> DataFrame:
    """(graph, s, d, p). p None: weighted cascade, one over the target's arriving arcs."""
    out = edges.select("graph", F.col("src").alias("s"), F.col("dst").alias("d")) if directed else both_ways(edges)
    if p is not None:
        return out.withColumn("p", F.lit(float(p)))
    arriving = out.groupBy("graph", "d").agg(F.count(F.lit(1)).alias("_n"))
    return out.join(arriving, ["graph", "d"]).select("graph", "s", "d", (1.0 / F.greatest("_n", F.lit(1))).alias("p"))


def _worlds(df: DataFrame, worlds: int) -> DataFrame:
    return df.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))


def live_edges(edges: DataFrame, worlds: int = 1024, p: float = 0.1, seed: int = SEED) -> DataFrame:
    """(graph, world, src, dst): an undirected edge has one coin a world, for both directions."""
    each = _worlds(edges.select("graph", "src", "dst"), worlds)
    return each.where(hash_uniform(seed, F.col("world"), F.col("src"), F.col("dst")) <= p).select("graph", "world", "src", "dst")


#: Live edges of one world that a task joins by itself.
LOCAL = 2_000_000


def _joined(live: pa.Table) -> pa.Table:
    """One world's components."""
    src, dst = live.column("src").to_numpy(), live.column("dst").to_numpy()
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    above = list(range(len(ids)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for x, y in zip(ends[: len(src)].tolist(), ends[len(src) :].tolist(), strict=True):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(ids))], np.int64)
    sizes = np.bincount(tops, minlength=len(ids))[tops]
    of = [pa.array([live.column(c)[0].as_py()] * len(ids), live.schema.field(c).type) for c in ("graph", "world")]
    return pa.table([*of, pa.array(ids, pa.int64()), pa.array(ids[tops], pa.int64()), pa.array(sizes, pa.int64())], ["graph", "world", "id", "part", "size"])


def live_components(live: DataFrame, local: int = LOCAL) -> DataFrame:
    """(graph, world, id, part, size) of every node with a live edge; others are alone in their world.

    Worlds of up to `local` live edges are a task's work each; if there are larger ones, all are joined together by stars.
    """
    live = durable(live, "live-edges")
    largest = live.groupBy("graph", "world").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
    if (largest or 0) <= local:
        return durable(live.groupBy("graph", "world").applyInArrow(_joined, "graph string, world int, id long, part long, size long"), "live-parts")
    end = lambda c: F.struct("graph", "world", F.col(c).alias("id"))
    parts = connected_components(live.select(end("src").alias("src"), end("dst").alias("dst"))).select("id.*", F.col("component.id").alias("part"))
    parts = durable(parts, "live-parts")
    return parts.join(parts.groupBy("graph", "world", "part").agg(F.count(F.lit(1)).alias("size")), ["graph", "world", "part"])


def live_spread(seeds: DataFrame, parts: DataFrame, nodes: DataFrame, worlds: int) -> DataFrame:
    """Per (graph, method): the mean share of nodes that seeds reach over fixed worlds: sizes of the components they hit."""
    each = _worlds(seeds.select("graph", "method", F.col("node").alias("id")).distinct().join(nodes.select("graph", "id"), ["graph", "id"]), worlds)
    hit = each.join(parts, ["graph", "world", "id"], "left").select("graph", "method", "world", F.coalesce("part", "id").alias("part"), F.coalesce("size", F.lit(1)).alias("size")).distinct()
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    total = hit.groupBy("graph", "method").agg(F.sum("size").alias("total"))
    return total.join(n, "graph").select("graph", "method", (F.col("total") / worlds / F.col("n")).alias("spread"))


#: Worlds that share a number: a bit each.
BITS = 64


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _blocks(df: DataFrame, worlds: int) -> DataFrame:
    """df with block and bits: a row for each BITS worlds, all of them set."""
    last = worlds - worlds // BITS * BITS
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-worlds // BITS) - 1)))
    return df.withColumn("block", blocks).withColumn("bits", F.when(F.col("block") < worlds // BITS, F.lit(-1)).otherwise(F.lit((1 << last) - 1)).cast("long"))


def _tossed(wins: Callable[[Column], Column]) -> Column:
    """Those worlds of bits in which the coin wins; only theirs are tossed. wins takes the world."""
    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    toss = lambda found, i: F.when((F.getbit("bits", i) == 1) & wins(F.col("block") * BITS + i), found.bitwiseOR(_bit(i))).otherwise(found)
    return F.aggregate(places, F.lit(0).cast("long"), toss)


def _reached(first: DataFrame, arc: DataFrame, wins: Callable[[Column], Column], label: str) -> DataFrame:
    """(graph, method, block, node, bits): the worlds in which each node is reached, from first on, which has the same columns.

    BITS worlds are a number, so a frontier has a row for a node and block, whatever the worlds: arcs keep the worlds whose coins
    win, rows that meet are merged by or, and what was reached before is masked out.
    """
    keys, tasks = ["graph", "method", "block", "node"], int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = durable(first.groupBy(*keys).agg(F.bit_or("bits").alias("bits")), label)
    found = Growing(new, label)
    while not new.isEmpty():
        # A row is up to BITS coins' work, so rows are dealt to all tasks, however few they are.
        over = new.withColumnRenamed("node", "s").join(arc, ["graph", "s"]).repartition(tasks, "s", "d", "block")
        over = over.select("graph", "method", "block", F.col("d").alias("node"), _tossed(wins).alias("bits"))
        met = over.where("bits <> 0").groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
        before = found.rows.groupBy(*keys).agg(F.bit_or("bits").alias("had"))
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        new = durable(met.join(before, keys, "left").select(*keys, left.alias("bits")).where("bits <> 0"), f"{label}-new")
        found.add(new)
    return found.rows


def _world_rows(reached: DataFrame) -> DataFrame:
    """(graph, method, world, node): a row for each bit."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    return reached.select("graph", "method", "block", "node", F.explode(set_).alias("_i")).select("graph", "method", (F.col("block") * BITS + F.col("_i")).alias("world"), "node")


def cascade(seeds: DataFrame, arc: DataFrame, worlds: int, seed: int = SEED, strict: bool = False) -> DataFrame:
    """(graph, method, world, node): what is active in the end. Each arc has one coin a world, tossed when its source
    becomes active. strict: coin < p instead of <=."""

    def wins(world: Column) -> Column:
        coin = hash_uniform(seed, world, F.col("s"), F.col("d"))
        return coin < F.col("p") if strict else coin <= F.col("p")

    return _world_rows(_reached(_blocks(seeds.select("graph", "method", "node").distinct(), worlds), arc, wins, "active"))


def mean_active(active: DataFrame, worlds: int) -> DataFrame:
    """Per (graph, method): mean nodes active at the end."""
    return active.groupBy("graph", "method").agg((F.count(F.lit(1)) / worlds).alias("spread"))


def reverse_sets(nodes: DataFrame, arc: DataFrame, sets: int, seed: int = SEED, first: int = 0) -> DataFrame:
    """(graph, rr, node): the reverse reachable sets of hashed roots, number first to sets - 1; each arc has one coin a set."""
    return drawn_sets(nodes, arc, nodes.select("graph", F.lit(first).alias("first"), F.lit(sets).alias("sets")).distinct(), seed)


def drawn_sets(nodes: DataFrame, arc: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """reverse_sets for wanted(graph, first, sets): which numbers of each graph."""
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    numbers = wanted.where("first < sets").select("graph", F.explode(F.sequence(F.col("first"), F.col("sets") - 1)).alias("rr"))
    draws = numbers.join(n, "graph").withColumn("pos", (F.floor(hash_uniform(seed, F.col("rr"), F.lit("root")) * F.col("n")) + 1).cast("int"))
    roots = draws.join(nodes.select("graph", "pos", "id"), ["graph", "pos"])
    roots = roots.select("graph", F.lit("rr").alias("method"), F.expr(f"rr div {BITS}").cast("int").alias("block"), F.col("id").alias("node"), _bit(F.col("rr") % BITS).alias("bits"))
    back = arc.select("graph", F.col("d").alias("s"), F.col("s").alias("d"), "p")
    found = _reached(roots, back, lambda world: hash_uniform(seed, world, F.col("d"), F.col("s")) <= F.col("p"), "rr")
    return _world_rows(found).select("graph", F.col("world").alias("rr"), "node")


def reverse_coverage(seeds: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """Per (graph, method): the share of reverse reachable sets that hold a seed."""
    hit = seeds.select("graph", "method", "node").join(sets, ["graph", "node"]).groupBy("graph", "method").agg(F.countDistinct("rr").alias("hit"))
    cells = seeds.select("graph", "method").distinct()
    return cells.join(hit, ["graph", "method"], "left").select("graph", "method", (F.coalesce("hit", F.lit(0)) / number).alias("coverage"))


def arriving_weights(edges: DataFrame) -> DataFrame:
    """(graph, s, d, weight): one over the target's degree."""
    return arcs(edges, None).withColumnRenamed("p", "weight")


#: Cells (node or edge end, world) that a task of thresholds holds at a time, the edges of a graph that it may hold, and the
#: worlds of one task.
CELLS, THRESHOLD_LOCAL, THRESHOLD_WORLDS = 8_000_000, 1_000_000, 128


def _over_thresholds(seed: int, worlds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a task does: own(graph, block, method, node) and its graph's pairs(graph, block, src, dst), for a block of worlds."""

    def coins(cells: np.ndarray, width: int, first: int, ids: list[int]) -> list[float]:
        return [int(hashlib.md5(f"{seed}|{first + c % width}|{ids[c // width]}".encode()).hexdigest()[:8], 16) / 4294967296.0 for c in cells.tolist()]

    def run(own: pa.Table, pairs: pa.Table) -> pa.Table:
        kinds = pa.schema([("graph", pa.string()), ("method", pa.string()), ("world", pa.int32()), ("node", pa.int64())])
        if not len(own):
            return kinds.empty_table()
        graph, block = own.column("graph")[0].as_py(), own.column("block")[0].as_py()
        src, dst = (pairs.column(c).to_numpy() for c in ("src", "dst"))
        seeds: dict[str, list[int]] = {}
        for m, x in zip(own.column("method").to_pylist(), own.column("node").to_pylist(), strict=True):
            seeds.setdefault(m, []).append(x)
        ids, ends = np.unique(np.concatenate([src, dst, np.array([x for v in seeds.values() for x in v], np.int64)]), return_inverse=True)
        a, b = ends[: len(src)], ends[len(src) : 2 * len(src)]
        near = np.concatenate([b, a])[np.argsort(np.concatenate([a, b]), kind="stable")]
        degree = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        starts, names = np.concatenate([[0], np.cumsum(degree)]), ids.tolist()
        step, parts = max(1, CELLS // (len(ids) + len(near))), []
        for first in range(block * THRESHOLD_WORLDS, min(worlds, (block + 1) * THRESHOLD_WORLDS), step):
            width = min(step, min(worlds, (block + 1) * THRESHOLD_WORLDS) - first)
            theta = np.full(len(ids) * width, np.nan)
            for method, chosen in seeds.items():
                on, pressed = np.zeros(len(theta), bool), np.zeros(len(theta), np.int32)
                front = (np.searchsorted(ids, np.unique(chosen))[:, None] * width + np.arange(width)).ravel()
                while len(front):
                    on[front] = True
                    u = front // width
                    many = degree[u]
                    at = np.repeat(starts[u] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    met = near[at] * width + np.repeat(front % width, many)
                    np.add.at(pressed, met, 1)
                    met = np.unique(met[~on[met]])
                    unknown = met[np.isnan(theta[met])]
                    theta[unknown] = coins(unknown, width, first, names)
                    front = met[pressed[met] / degree[met // width] >= theta[met]]
                cells = np.flatnonzero(on)
                parts.append(pa.table([pa.array([graph] * len(cells), pa.string()), pa.array([method] * len(cells), pa.string()), pa.array(first + cells % width, pa.int32()), pa.array(ids[cells // width], pa.int64())], schema=kinds))
        return pa.concat_tables(parts)

    return run


def threshold_spread(seeds: DataFrame, edges: DataFrame, worlds: int = 4096, seed: int = SEED, local: int = THRESHOLD_LOCAL) -> DataFrame:
    """(graph, method, world, node): the least fixed point at which no further node's active share of neighbours reaches
    its threshold. A node needs an active neighbour, whatever its threshold.

    Worlds are independent: for graphs of up to `local` edges a block of worlds is a task's work, larger ones spread by joins.
    """
    sizes = durable(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_m")), "graph-sizes")
    chosen = seeds.select("graph", "method", "node").distinct()
    large = sizes.where(F.col("_m") > local).select("graph")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-worlds // THRESHOLD_WORLDS) - 1))).alias("block")
    own = chosen.join(large, "graph", "left_anti").select("graph", blocks, "method", "node")
    pairs = edges.join(sizes.where(F.col("_m") <= local), "graph").select("graph", blocks, "src", "dst")
    out = own.groupBy("graph", "block").cogroup(pairs.groupBy("graph", "block")).applyInArrow(_over_thresholds(seed, worlds), "graph string, method string, world int, node long")
    if large.isEmpty():
        return out
    return out.unionByName(_pressed_rounds(chosen.join(large, "graph", "left_semi"), edges.join(large, "graph", "left_semi"), worlds, seed))


def _pressed_rounds(seeds: DataFrame, edges: DataFrame, worlds: int, seed: int) -> DataFrame:
    """threshold_spread by joins: each round, what the newly active press on."""
    sym = durable(both_ways(edges), "both-ways")
    degree = sym.groupBy("graph", F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    keys = ["graph", "method", "world", "node"]
    new = durable(_worlds(seeds, worlds).select(*keys), "lt-active")
    active, pressed = Growing(new, "lt-active"), None
    while True:
        touched = new.withColumnRenamed("node", "s").join(sym, ["graph", "s"]).groupBy("graph", "method", "world", F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        touched = durable(touched.join(active.rows, keys, "left_anti").select(*keys, "n"), "lt-pressed")
        if pressed is None:
            now, pressed = touched, Growing(touched, "lt-pressed")
        else:  # what presses on a node is added up for those only that are pressed anew
            pressed.add(touched)
            now = pressed.rows.join(fresh(touched.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"))
        over = now.join(degree, ["graph", "node"]).where(F.col("n") / F.col("degree") >= hash_uniform(seed, F.col("world"), F.col("node")))
        new = durable(over.select(*keys), "lt-new")
        if new.isEmpty():
            return active.rows
        active.add(new)


def threshold_summary(active: DataFrame, nodes: DataFrame, worlds: int) -> DataFrame:
    """Per (graph, method): mean, population deviation, 95 % radius and normalised mean of the active nodes per world."""
    each = active.groupBy("graph", "method", "world").agg(F.count(F.lit(1)).alias("a"))
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    stats = each.groupBy("graph", "method").agg(F.avg("a").alias("spread_mean"), F.stddev_pop("a").alias("spread_std"))
    return stats.join(n, "graph").select("graph", "method", "spread_mean", "spread_std", (1.96 * F.col("spread_std") / F.sqrt(F.lit(float(worlds)))).alias("spread_ci95"), (F.col("spread_mean") / F.col("n")).alias("normalized_spread"), F.lit(worlds).alias("simulations"))


def two_hop_coverage(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (graph, method): the share of nodes within two steps of a seed."""
    sym = both_ways(edges)
    here = seeds.select("graph", "method", "node").distinct()
    step = lambda df: df.withColumnRenamed("node", "s").join(sym, ["graph", "s"]).select("graph", "method", F.col("d").alias("node")).distinct()
    one = step(here)
    all_ = here.unionByName(one).unionByName(step(one)).distinct()
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return all_.groupBy("graph", "method").agg(F.count(F.lit(1)).alias("c")).join(n, "graph").select("graph", "method", (F.col("c") / F.col("n")).alias("coverage"))


def normal_seeds(seeds: DataFrame, nodes: DataFrame, k: int, fill: str = "text") -> DataFrame:
    """Per (graph, method) exactly min(k, n) seeds (graph, method, step, node): the first k different valid ones, filled
    up by id as text, or by pos."""
    first = seeds.groupBy("graph", "method", "node").agg(F.min("step").alias("at")).join(nodes.select("graph", F.col("id").alias("node")), ["graph", "node"])
    rest = seeds.select("graph", "method").distinct().join(nodes.select("graph", F.col("id").alias("node"), "pos"), "graph").join(first, ["graph", "method", "node"], "left_anti")
    both = first.select("graph", "method", "node", F.lit(0).alias("late"), F.col("at").cast("long").alias("at"), F.lit("").alias("t"))
    late = rest.select("graph", "method", "node", F.lit(1).alias("late"), (F.col("pos") if fill == "pos" else F.lit(0)).cast("long").alias("at"), F.col("node").cast("string").alias("t"))
    place = F.row_number().over(Window.partitionBy("graph", "method").orderBy("late", "at", "t"))
    return both.unionByName(late).select("graph", "method", place.alias("step"), "node").where(F.col("step") <= k)
