"""Degrees, triangles and core numbers of edges(graph, src, dst)."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.projections import both_ways
from ..sources.storage import Growing, drop, durable, fresh
from .by_component import binned_edges, dealt
from .components import connected_components


def degrees(edges: DataFrame) -> DataFrame:
    """(graph, id, degree)."""
    return both_ways(edges).groupBy("graph", F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def triangle_corners(edges: DataFrame) -> DataFrame:
    """(graph, a, b, c): every triangle once.

    Edges point from the end of smaller (degree, id) to the larger, so a node starts at most sqrt(2m) of them and the
    wedges number m^1.5 at most, hubs or not.
    """
    d = durable(degrees(edges), "degrees")
    a, b = d.select("graph", F.col("id").alias("src"), F.col("degree").alias("ds")), d.select("graph", F.col("id").alias("dst"), F.col("degree").alias("dd"))
    met = edges.join(a, ["graph", "src"]).join(b, ["graph", "dst"])
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    low = met.select("graph", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    low = durable(low, "oriented")
    wedges = low.join(low.select("graph", "a", F.col("b").alias("c")), ["graph", "a"]).where("b < c")
    ends = edges.select("graph", F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(ends, ["graph", "b", "c"]).select("graph", "a", "b", "c")


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, common) of every edge: how many nodes both ends meet."""
    t = triangle_corners(edges)
    sides = t.select("graph", F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("e"))
    counts = sides.groupBy("graph", "e.src", "e.dst").agg(F.count(F.lit(1)).alias("common"))
    return edges.join(counts, ["graph", "src", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph, id, triangles, clustering) of every node with an edge."""
    corner = triangle_corners(edges).select("graph", F.explode(F.array("a", "b", "c")).alias("id"))
    counts = corner.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("triangles"))
    all_nodes = degrees(edges).join(counts, ["graph", "id"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    share = F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
    return all_nodes.select("graph", "id", "degree", "triangles", share.alias("clustering"))


#: Edges of a graph whose core numbers one task finds by itself.
LOCAL = 2_000_000


def _peeled(pairs: pa.Table) -> pa.Table:
    """Core numbers of one graph: the node of least degree goes next, and its core is the largest least degree so far."""
    src, dst = (pairs.column(c).to_numpy() for c in ("src", "dst"))
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    degree = np.bincount(ends, minlength=len(ids))
    near = np.concatenate([b, a])[np.argsort(np.concatenate([a, b]), kind="stable")].tolist()
    starts = np.concatenate([[0], np.cumsum(degree)]).tolist()
    left, core, level = degree.tolist(), [-1] * len(ids), 0
    waiting: list[list[int]] = [[] for _ in range(max(left, default=0) + 1)]
    for u, d in enumerate(left):
        waiting[d].append(u)
    at = 0
    while at < len(waiting):
        if not waiting[at]:
            at += 1
            continue
        u = waiting[at].pop()
        if core[u] >= 0 or left[u] != at:
            continue
        level = max(level, at)
        core[u] = level
        for v in near[starts[u] : starts[u + 1]]:
            if core[v] < 0:
                left[v] -= 1
                waiting[left[v]].append(v)
                at = min(at, left[v])
    return pa.table({"graph": pa.array([pairs.column("graph")[0].as_py()] * len(ids), pa.string()), "id": pa.array(ids, pa.int64()), "core": pa.array(core, pa.int64())})


def _fallen(sym: DataFrame) -> DataFrame:
    """(graph, id, core) by rounds: a node's core falls to the h-index of its neighbours', from their degrees on.

    Only neighbours of what fell in a round are looked at in the next. Neighbours are counted by core before they meet, so
    a hub's row is as long as cores are different. Rounds end when nothing falls; there is no bound on them.
    """
    now = durable(sym.groupBy("graph", F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("core")), "cores")
    fell = now.select("graph", "id")
    while True:
        asked = durable(sym.join(fell.select("graph", F.col("id").alias("d")), ["graph", "d"]).select("graph", "s").distinct(), "asked")
        near = sym.join(asked, ["graph", "s"]).join(now.select("graph", F.col("id").alias("d"), "core"), ["graph", "d"])
        held = near.groupBy("graph", "s", "core").agg(F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("graph", "s").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)
        index = held.withColumn("n", F.sum("n").over(above)).groupBy("graph", F.col("s").alias("id")).agg(F.max(F.least("core", "n")).alias("h"))
        lower = durable(index.join(now, ["graph", "id"]).where("h < core").select("graph", "id", "h"), "fallen")
        if lower.isEmpty():
            return now
        now = durable(now.join(lower, ["graph", "id"], "left").select("graph", "id", F.coalesce("h", "core").alias("core")), "cores", now)
        fell = lower.select("graph", "id")
        drop(asked)


def core_numbers(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(graph, id, core). Graphs of up to `local` edges are peeled in a task each, larger ones by rounds over all tasks."""
    sizes = durable(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_m")), "graph-sizes")
    small = edges.join(sizes.where(F.col("_m") <= local), "graph").select("graph", "src", "dst")
    out = small.groupBy("graph").applyInArrow(_peeled, "graph string, id long, core long")
    large = sizes.where(F.col("_m") > local)
    if large.isEmpty():
        return out
    return out.unionByName(_fallen(durable(both_ways(edges.join(large, "graph").select("graph", "src", "dst")), "both-ways")))


def components(edges: DataFrame) -> DataFrame:
    """(graph, id, component): component is the smallest id in it."""
    pairs = edges.select(F.struct("graph", F.col("src").alias("id")).alias("src"), F.struct("graph", F.col("dst").alias("id")).alias("dst"))
    return connected_components(pairs).select("id.graph", "id.id", F.col("component.id").alias("component"))


def manifest(edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, mean and largest degree, components, connected."""
    d = degrees(edges).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    parts = components(edges).groupBy("graph").agg(F.countDistinct("component").alias("components"))
    return d.join(parts, "graph").withColumn("connected", F.col("components") == 1)


def _precedence(c: str) -> Column:
    """Nodes are coloured in the order of a hash of their id."""
    return F.struct(F.md5(F.concat(F.lit("7|"), F.col(c).cast("string"))), F.col(c))


def colouring(sym: DataFrame) -> DataFrame:
    """(graph, id, colour) of sym(graph, s, d): each node, in the order of its hash, takes the least colour that none of its
    neighbours has taken. A round colours all nodes whose earlier neighbours are coloured."""
    earlier = durable(sym.where(_precedence("d") < _precedence("s")), "earlier")
    need = earlier.groupBy("graph", F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("need"))
    open_ = durable(need, "uncoloured")
    new = sym.select("graph", F.col("s").alias("id")).distinct().join(open_, ["graph", "id"], "left_anti").withColumn("colour", F.lit(0))
    new = durable(new, "coloured")
    done, met = Growing(new, "coloured"), None
    while not open_.isEmpty():
        told = durable(earlier.join(new.select("graph", F.col("id").alias("d"), "colour"), ["graph", "d"]).select("graph", F.col("s").alias("id"), "colour"), "told")
        if met is None:
            met = Growing(told, "told")
        else:
            met.add(told)
        heard = met.rows.join(fresh(told.select("graph", "id").distinct()), ["graph", "id"], "left_semi").groupBy("graph", "id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("colour").alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
        new = durable(heard.join(fresh(open_), ["graph", "id"]).where("n = need").select("graph", "id", free.alias("colour")), "coloured")
        done.add(new)
        open_ = durable(open_.join(fresh(new.select("graph", "id")), ["graph", "id"], "left_anti"), "uncoloured", open_)
    return done.rows


def _labelled(pairs: pa.Table) -> pa.Table:
    """Label propagation of one graph, or of some of its components."""
    src, dst = (pairs.column(c).to_numpy() for c in ("src", "dst"))
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    names, near = ids.tolist(), [[] for _ in ids]
    for a, b in zip(ends[: len(src)].tolist(), ends[len(src) :].tolist(), strict=True):
        near[a].append(b)
        near[b].append(a)
    colour = [-1] * len(names)
    for u in sorted(range(len(names)), key=lambda i: (hashlib.md5(f"7|{names[i]}".encode()).hexdigest(), names[i])):
        taken = {colour[v] for v in near[u]}
        colour[u] = next(c for c in range(len(near[u]) + 1) if c not in taken)
    classes: list[list[int]] = [[] for _ in range(max(colour, default=-1) + 1)]
    for u, c in enumerate(colour):
        classes[c].append(u)
    label, quiet, at = list(range(len(names))), 0, 0  # places of ids are in their order
    while quiet < len(classes):
        moved = False
        for u in classes[at]:
            votes = Counter(label[v] for v in near[u])
            best = min(votes, key=lambda x: (-votes[x], x))
            moved |= best != label[u]
            label[u] = best
        quiet, at = 0 if moved else quiet + 1, (at + 1) % len(classes)
    return pa.table({"graph": pa.array([pairs.column("graph")[0].as_py()] * len(names), pa.string()), "id": pa.array(names, pa.int64()), "community": pa.array([names[x] for x in label], pa.int64())})


def _labelled_over_tables(sym: DataFrame) -> DataFrame:
    colours = durable(colouring(sym), "colours")
    number = (colours.agg(F.max("colour")).first()[0] or 0) + 1
    now, quiet, at = durable(colours.withColumn("community", F.col("id")), "labels"), 0, 0
    while quiet < number:
        own = now.where(F.col("colour") == at)
        near = sym.join(fresh(own.select("graph", F.col("id").alias("s"))), ["graph", "s"]).join(fresh(now.select("graph", F.col("id").alias("d"), "community")), ["graph", "d"])
        votes = near.groupBy("graph", "s", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("graph", F.col("s").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("graph", "id", F.col("b.community").alias("best"))
        moved = durable(best.join(fresh(own), ["graph", "id"]).where("best <> community").select("graph", "id", "best"), "moved-labels")
        quiet, at = quiet + 1 if moved.isEmpty() else 0, (at + 1) % number
        if not quiet:
            now = durable(now.join(fresh(moved), ["graph", "id"], "left").select("graph", "id", "colour", F.coalesce("best", "community").alias("community")), "labels", now)
        drop(moved)
    return now.select("graph", "id", "community")


def label_propagation(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(graph, id, community): nodes take their neighbours' commonest label, of ties the smallest, until none changes.

    Labels start as ids. Nodes are coloured so that no neighbours share a colour, and colours take turns: the nodes of one change
    at once. A change adds edges within a label or makes a label smaller, so the turns end. Components don't hear of each other, so
    each of up to `local` edges is a task's work, small ones together; larger ones go by joins.
    """
    own = durable(binned_edges(edges), "binned-edges")
    many = durable(own.groupBy("graph", "bin").agg(F.count(F.lit(1)).alias("_m")), "bin-sizes")
    of = lambda large: own.join(fresh(many.where((F.col("_m") > local) == large)), ["graph", "bin"]).select("graph", "bin", "src", "dst")
    out = dealt(of(False), "graph", "bin").groupBy("graph", "bin").applyInArrow(_labelled, "graph string, id long, community long")
    if many.where(F.col("_m") > local).isEmpty():
        return out
    return out.unionByName(_labelled_over_tables(durable(both_ways(of(True).select("graph", "src", "dst")), "both-ways")))
