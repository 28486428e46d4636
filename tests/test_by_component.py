"""What runs by components gives what whole graphs give."""

from __future__ import annotations

import heapq
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sunderflow.operators import adaptive, by_component, communities, seeds, static_orders, statistics, variants  # noqa: F401  (registers heuristics)
from sunderflow.plans import validation
from sunderflow.sources import projections


@pytest.fixture(scope="module")
def islands():
    """Edges of random graphs side by side, of 3 to 40 nodes each."""
    rng, out = random.Random(7), set()
    for i, n in enumerate((3, 5, 9, 14, 20, 30, 40)):
        out |= {(min(p) + 100 * i, max(p) + 100 * i) for p in (rng.sample(range(n), 2) for _ in range(n + n // 3))}
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark, islands):
    return spark.createDataFrame([("g", a, b) for a, b in islands], "graph string, src long, dst long").cache()


@pytest.fixture
def small_bins(monkeypatch):
    """Components of 10 nodes are bins, others share bins of about 6."""
    for f in (by_component.bins_of, by_component.binned):
        monkeypatch.setattr(f, "__defaults__", (10, 6))


def _near(pairs):
    near = {x: [] for p in pairs for x in p}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    return near


def _reached(near, chosen, runs, seed):
    """Linear Threshold, world by world and round by round."""
    total = 0
    for w in range(runs):
        on = set(chosen)
        while new := {v for u in on for v in near[u] if v not in on and sum(x in on for x in near[v]) / len(near[v]) >= seeds._coin(seed, w, v)}:
            on |= new
        total += len(on)
    return total / runs


def test_threshold_greedy_in_all_worlds_at_once(islands):
    near = _near([p for p in islands if p[0] >= 500])
    ids, want = sorted(near), []
    for _ in range(4):
        spread, _, _, u = max((_reached(near, [*(x for x, _ in want), u], 9, 3), len(near[u]), str(u), u) for u in ids if u not in [x for x, _ in want])
        want.append((u, spread))
    assert seeds._threshold_greedy(ids, near, 4, 9, 3) == want


def test_communities_by_components(table, islands, small_bins):
    found = {r.id: r.community for r in communities.greedy_modularity(table).collect()}
    assert found == communities.merge_greedily(islands)
    assert by_component.bins_of(table, projections.nodes_of(table)).select("bin").distinct().count() > 4


@pytest.mark.parametrize("k", [2, 7])
def test_cluster_greedy_by_components(table, islands, small_bins, k):
    of, each = communities.merge_greedily(islands), {}
    for u in sorted(of):
        each.setdefault(of[u], []).append(u)
    assert len(each) > k
    inside, options = _near(islands), []
    for c, ids in sorted(each.items()):
        near = {u: [v for v in inside[u] if of[v] == c] for u in ids}
        options.append(seeds._threshold_greedy(ids, near, k, 8, 5))
    shares = seeds.best_split([np.array([0.0, *(x for _, x in o)]) for o in options], k)
    want = [u for o, n in zip(options, shares, strict=True) for u, _ in o[:n]]
    got = seeds.cluster_greedy(table, projections.nodes_of(table), communities.greedy_modularity(table), k, 8, 5)
    assert [r.node for r in got.orderBy("step").collect()] == want


def _between_plainly(near):
    """Ordered pairs, by counts of shortest paths from every node."""
    known = {}
    for s in near:
        level, count, seen = {s: 0}, {s: 1}, [s]
        for u in seen:
            for v in near[u]:
                if v not in level:
                    level[v], count[v] = level[u] + 1, 0
                    seen.append(v)
                if level[v] == level[u] + 1:
                    count[v] += count[u]
        known[s] = level, count
    return {u: sum(known[s][1][u] * known[u][1][t] / known[s][1][t] for s in near for t in known[s][0] if len({s, t, u}) == 3 and u in known[s][0] and known[s][0][u] + known[u][0][t] == known[s][0][t]) for u in near}


@pytest.mark.parametrize("options", [{}, {"blocks": 3}, {"local": 12, "pairs": 500}])
def test_betweenness_by_components(table, islands, small_bins, options):
    """In tasks, in blocks of sources, and with the larger components over tables."""
    near = _near(islands)
    pairs = (len(near) - 1) * (len(near) - 2)
    got = {r.id: round(r.score * pairs, 6) for r in static_orders.betweenness(table, **options).collect()}
    assert got == {u: round(x, 6) for u, x in _between_plainly(near).items()}


def test_trees_are_settled_in_whole_numbers():
    """A tree needs no search; a ring with a tail is searched without the tail."""
    path = [[1], [0, 2], [1, 3], [2]]
    kept, weight, settled = static_orders._trees_off(path)
    assert not any(kept) and settled == [0.0, 4.0, 4.0, 0.0]
    tail = [[1, 2], [0, 2], [0, 1, 3], [2, 4], [3]]
    kept, weight, settled = static_orders._trees_off(tail)
    assert kept == [[1, 2], [0, 2], [0, 1], [], []] and weight[:3] == [1, 1, 3] and settled == [0.0, 0.0, 8.0, 6.0, 0.0]


@pytest.mark.parametrize("method", ["MCGreedy", "CELF++"])
def test_spread_greedy_by_components(spark, table, small_bins, method):
    """As over tables, ties included: the second graph is made of pairs."""
    pairs = spark.createDataFrame([("h", i, i + 50) for i in range(50)], "graph string, src long, dst long")
    both = table.unionByName(pairs)
    lone = spark.createDataFrame([("h", 7000, 101)], "graph string, id long, pos int")
    nodes = projections.nodes_of(both).unionByName(lone)
    made = lambda **how: sorted(tuple(r) for r in seeds.spread_greedy(both, nodes, 5, 16, 0.5, method=method, **how).collect())
    assert len(made()) == 10 and made() == made(held=0)


def test_labels_by_components(table, small_bins):
    """A limit of 30 edges leaves some components to tasks and some to tables; all agree."""
    made = lambda **how: sorted(tuple(r) for r in statistics.label_propagation(table, **how).collect())
    whole = statistics._labelled(table.select("graph", "src", "dst").toArrow()).to_pylist()
    assert made() == made(local=30) == sorted((r["graph"], r["id"], r["community"]) for r in whole)


def test_validation_by_components(table, small_bins):
    """Programs of events give by components what they give on the whole graph; others still run, and errors show."""

    def broken(g):
        raise ValueError("broken")
        yield

    programs = {n: adaptive.PROGRAMS[n] for n in ("HDA", "MinSum", "S-case", "Local")} | {"broken": by_component.by_events(broken)}
    nodes = projections.nodes_of(table)
    made = lambda whole: {r.method: r for r in validation.evaluate(table, nodes, programs, whole=whole).drop("time_s").collect()}
    assert made(0) == made(10**6) and made(0)["broken"].error == "ValueError: broken" and made(0)["HDA"].valid


@pytest.mark.parametrize("name", ["Q-case", "S-case", "Q-inner", "S-inner"])
def test_outdated_scores_do_not_pile_up(monkeypatch, name):
    """A heap holds few more entries than there are nodes, however often scores are renewed."""
    rng, most, push = random.Random(3), [], heapq.heappush
    monkeypatch.setattr(variants.heapq, "heappush", lambda heap, x: (push(heap, x), most.append(len(heap))))
    pairs = {(min(p), max(p)) for p in (rng.sample(range(400), 2) for _ in range(900))}
    order = adaptive.PROGRAMS[name](adaptive.Residual(list(range(400)), pairs), 400)
    assert sorted(order) == list(range(400)) and max(most) < 1.5 * 400 + 64 + 120


def test_offers_are_held_in_arrays():
    """An event of eight numbers takes some 100 bytes, and the table says what was added."""
    tracemalloc.start()
    offers, before = by_component.Offers(), tracemalloc.get_traced_memory()[0]
    for i in range(20_000):
        offers.add(i, tuple(float(i + j) for j in range(8)), i % 7, None if i % 5 == 0 else i)
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 160 * 20_000
    offers.more = True
    rows = offers.table(*map(pa.scalar, ("g", "m", "b"))).to_pylist()
    assert rows[5] == {"graph": "g", "method": "m", "bin": "b", "seq": 5, "score": [5.0 + j for j in range(8)], "tie": 5, "node": None, "last": False, "error": "", "time_s": 0.0}
    assert rows[6]["node"] == 6 and [r["seq"] for r in rows if r["last"]] == [19_999]
    assert by_component.Offers().table(*map(pa.scalar, ("g", "m", "b"))).num_rows == 0
