"""MIA by relaxation against Dijkstra's searches in plain code."""

import heapq

import pytest
from pyspark.sql import functions as F

from sunderflow.operators import diffusion, path_influence
from sunderflow.sources import projections

from .test_graphs import graph, random_pairs


def _paths(arcs, source, theta, blocked):
    best, heap = {source: 1.0}, [(-1.0, source)]
    while heap:
        q, u = heapq.heappop(heap)
        if -q < best[u]:
            continue
        for v, p in arcs.get(u, ()):
            if v not in blocked and -q * p >= theta and -q * p > best.get(v, 0.0):
                best[v] = -q * p
                heapq.heappush(heap, (q * p, v))
    return best


def _spread(arcs, seeds, theta):
    miss = {}
    for s in seeds:
        for v, q in _paths(arcs, s, theta, set(seeds) - {s}).items():
            if v not in seeds:
                miss[v] = miss.get(v, 1.0) * (1 - q)
    return len(seeds) + sum(1 - m for m in miss.values())


def _plain(arcs, ids, k, theta):
    chosen = []
    for _ in range(min(k, len(ids))):
        left = sorted((u for u in ids if u not in chosen), key=str)
        chosen.append(max(left, key=lambda u: round(_spread(arcs, [*chosen, u], theta), 9)))
    return chosen


@pytest.mark.parametrize(("p", "theta", "k"), [(0.5, 0.02, 3), (None, 0.01, 2), (1.0, 0.5, 2)])
def test_mia_equals_plain_searches(spark, p, theta, k):
    many = [("g", random_pairs(14, 22, 7)), ("h", random_pairs(12, 13, 8)), ("two", [(3, 20)])]
    edges = None
    for name, pairs in many:
        own = graph(spark, pairs, name)
        edges = own if edges is None else edges.unionByName(own)
    nodes = projections.nodes_of(edges).unionByName(spark.createDataFrame([("two", 5, 3)], "graph string, id long, pos int").select("graph", "id", F.col("pos").cast(dict(projections.nodes_of(edges).dtypes)["pos"])))
    got = {}
    for r in sorted(path_influence.mia(edges, nodes, k, p, theta).collect(), key=lambda r: r.step):
        got.setdefault(r.graph, []).append(r.node)
    arcs = {}
    for r in diffusion.arcs(edges, p).collect():
        arcs.setdefault(r.graph, {}).setdefault(r.s, []).append((r.d, r.p))
    ids = {}
    for r in nodes.collect():
        ids.setdefault(r.graph, []).append(r.id)
    assert got == {g: _plain(arcs[g], ids[g], k, theta) for g in ids}


def test_mia_of_nothing(spark):
    edges = spark.createDataFrame([], "graph string, src long, dst long")
    nodes = spark.createDataFrame([], "graph string, id long, pos long")
    assert path_influence.mia(edges, nodes, 2).count() == 0 and path_influence.mia(edges, nodes, 0).count() == 0
