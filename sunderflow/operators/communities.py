"""Communities by greedy modularity."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable
from .by_component import binned_edges, dealt


def merge_greedily(pairs: list[tuple[int, int]], twice: int | None = None) -> dict[int, int]:
    """Each node's community, named by its smallest node. twice: twice the edges of the whole graph, if pairs are some of its components.

    The two communities whose union adds most to the modularity become one, of ties those with the smallest names, until no
    union adds anything. With m edges, e of them between two communities of total degrees j and k, a union adds
    (2 m e - j k) / 2 m^2; the numerator is compared, which is whole.
    """
    twice = twice or 2 * len(pairs)
    between: dict[int, Counter] = defaultdict(Counter)
    for a, b in pairs:
        between[a][b] += 1
        between[b][a] += 1
    total = {u: near.total() for u, near in between.items()}
    members = {u: [u] for u in between}
    gain = lambda a, b: twice * between[a][b] - total[a] * total[b]
    heap = [(-gain(a, b), min(a, b), max(a, b)) for a, b in pairs]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        worth, a, b = heapq.heappop(heap)
        if a not in members or b not in members or -worth != gain(a, b):
            continue
        members[a] += members.pop(b)
        total[a] += total.pop(b)
        for c, n in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] += n
                between[c][a] += n
        for c in between[a]:
            heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))
    return {u: name for name, own in members.items() for u in own}


def greedy_modularity(edges: DataFrame) -> DataFrame:
    """(graph, id, community) of every node with an edge; community is the smallest id in it. Unions never join components, and
    of the others only the number of edges counts, so a task holds a component or several small ones."""

    def run(pairs: pa.Table) -> pa.Table:
        found = merge_greedily([*zip(pairs.column("src").to_pylist(), pairs.column("dst").to_pylist(), strict=True)], pairs.column("twice")[0].as_py())
        ids = np.array(sorted(found), np.int64)
        return pa.table({"graph": pa.array([pairs.column("graph")[0].as_py()] * len(ids), pa.string()), "id": ids, "community": pa.array([found[u] for u in ids.tolist()], pa.int64())})

    size = durable(edges.groupBy("graph").agg((2 * F.count(F.lit(1))).alias("twice")), "graph-sizes")
    return dealt(binned_edges(edges).join(size, "graph"), "graph", "bin").groupBy("graph", "bin").applyInArrow(run, "graph string, id long, community long")
