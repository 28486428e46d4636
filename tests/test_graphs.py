"""Values worked out by hand or by plain code on small graphs."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sunderflow.operators import adaptive, communities, diffusion, ordering, path_influence, seeds, static_orders, statistics, trajectory, variants
from sunderflow.operators.components import connected_components
from sunderflow.sources import edgelists, generators, projections

SMOKE = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 6), (6, 7), (7, 8), (8, 9), (1, 9), (5, 10), (10, 11)]


def graph(spark, pairs, name="g"):
    return spark.createDataFrame([(name, min(p), max(p)) for p in pairs], "graph string, src long, dst long")


@pytest.fixture(scope="module")
def smoke(spark):
    return graph(spark, SMOKE).cache()


def order_of(df):
    return [r.node for r in df.orderBy("step").collect()]


def adaptive_order(edges, method, rate=1.0):
    return order_of(adaptive.adaptive_orders(edges, projections.nodes_of(edges), [method], rate))


def test_smoke_orders(smoke):
    assert adaptive_order(smoke, "HDA", 0.3)[:4] == [2, 9, 7, 5]
    assert order_of(static_orders.degree_order(smoke)) == [2, 1, 9, 8, 7, 6, 5, 4, 3, 10, 11, 0]


def test_smoke_curve(smoke, spark):
    full = [2, 9, 7, 5, 4, 11, 1, 8, 6, 3, 10, 0]
    orders = spark.createDataFrame([("g", "HDA", i, n) for i, n in enumerate(full, 1)], "graph string, method string, step int, node long")
    rows = trajectory.curve(smoke, orders, 0.3).orderBy("step").collect()
    assert [round(r.GCC, 9) for r in rows] == [0.5, 0.416666667, 0.416666667, 0.166666667]
    assert [int(r.NCC) for r in rows] == [2, 3, 4, 5]
    assert [round(r.cNBI, 9) for r in rows] == [0.642908054, 1.130926490, 1.244239631, 2.618181818]
    one = trajectory.summary(trajectory.curve(smoke, orders, 0.3)).first()
    assert round(one.R, 9) == 0.375 and round(one.auc_cNBI, 9) == 1.335237019
    assert round(trajectory.classic_r(trajectory.curve(smoke, orders, None)).first().classic_R, 9) == 18.75
    native = trajectory.at(smoke, orders, [1, 2, 3, 4, 12]).orderBy("step").collect()
    assert [round(r.cNBI, 9) for r in native] == [0.642908054, 1.130926490, 1.244239631, 2.618181818, 0.0]


def test_smoke_seeds(smoke):
    assert order_of(seeds.degree_discount(smoke, 3, 0.1)) == [2, 9, 7]
    assert order_of(path_influence.mia(smoke, projections.nodes_of(smoke), 3, 0.1)) == [2, 5, 8]


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


class Plain:
    """Residual graphs the slow way."""

    def __init__(self, pairs):
        self.near = {}
        for a, b in pairs:
            self.near.setdefault(a, set()).add(b)
            self.near.setdefault(b, set()).add(a)

    def remove(self, u):
        for v in self.near.pop(u):
            self.near[v].discard(u)

    def core(self, of=None):
        left = {u: self.near[u] & set(of or self.near) for u in (of or self.near)}
        while low := [u for u in left if len(left[u]) < 2]:
            for u in low:
                for v in left.pop(u):
                    if v in left:
                        left[v].discard(u)
        return left

    def parts(self):
        out, seen = [], set()
        for u in self.near:
            if u not in seen:
                part = [u]
                seen.add(u)
                for x in part:
                    part += self.near[x] - seen
                    seen |= self.near[x]
                out.append(part)
        return out


def slow_order(pairs, pick):
    g, order = Plain(pairs), []
    while g.near:
        u = pick(g)
        order.append(u)
        g.remove(u)
    return order


def largest(g):
    return max(g.parts(), key=lambda p: (len(p), min(p)))


def over(g, u):
    return max(0, len(g.near[u]) - 1)


def cavity(g, u):
    return sum(over(g, v) for v in g.near[u])


def entangled(g, u):
    near = g.near[u]
    two = {w for v in near for w in g.near[v]} - {u}
    pairs, d = sum(w in g.near[v] for v in near for w in near if v < w), len(near)
    return 100.0 * d + 5.0 * len(two - near) + len(two & near) - (10.0 * 2 * pairs / (d * (d - 1)) if d > 1 else 0.0)


PICKS = {
    "HDA": lambda g: max(g.near, key=lambda u: (len(g.near[u]), str(u))),
    "HDA-fast": lambda g: min(g.near, key=lambda u: (-len(g.near[u]), str(u))),
    "CoreHD": lambda g: max(c := g.core() or g.near, key=lambda u: (len(c[u]), u)),
    "CoreHD-fast": lambda g: min(g.core() or g.near, key=lambda u: (-len(g.near[u]), str(u))),
    "Decycle": lambda g: (lambda p: max(c := g.core(p) or {u: g.near[u] for u in p}, key=lambda u: (len(c[u]), u)))(max(g.parts(), key=lambda p: (len(p), min(p)))),
    "MinSum": lambda g: (lambda p: min(g.core(p) or p, key=lambda u: (-(1e4 * over(g, u) + sum(over(g, v) for v in g.near[u]) + len(g.near[u])), u)))(largest(g)),
    "BPD": lambda g: min(largest(g), key=lambda u: (-(over(g, u) * (1.0 + cavity(g, u)) + 0.05 * sum(cavity(g, v) - over(g, u) for v in g.near[u]) + len(g.near[u])), u)),
    "VE": lambda g: min(largest(g), key=lambda u: (-entangled(g, u), u)),
    "Component": lambda g: max(max(g.parts(), key=lambda p: (len(p), min(p))), key=lambda u: (len(g.near[u]), u)),
}


def cut_pick(g):
    part = max(g.parts(), key=lambda p: (len(p), min(p)))
    rest = {}
    for u in part:
        t = Plain([])
        t.near = {x: set(g.near[x]) for x in part}
        t.remove(u)
        pieces = t.parts()
        if len(pieces) > 1:
            rest[u] = max(map(len, pieces))
    return min(rest, key=lambda u: (rest[u], u)) if rest else None


@pytest.mark.parametrize("method", PICKS)
@pytest.mark.parametrize("seed", [1, 2])
def test_adaptive_orders(spark, method, seed):
    pairs = random_pairs(60, 90, seed)
    assert adaptive_order(graph(spark, pairs), method) == slow_order(pairs, PICKS[method])


def test_cut_order(spark):
    pairs = random_pairs(40, 44, 3)
    got = adaptive_order(graph(spark, pairs), "GND-cut")
    g = Plain(pairs)
    for u in got:
        want = cut_pick(g)
        assert want is None or u == want
        g.remove(u)


def test_core_numbers(spark):
    pairs = random_pairs(50, 140, 4)
    g, core, k = Plain(pairs), {}, 0
    while g.near:
        low = [u for u in g.near if len(g.near[u]) <= k]
        if not low:
            k += 1
        for u in low:
            core[u] = k
            g.remove(u)
    for local in (statistics.LOCAL, 0):
        assert {r.id: r.core for r in statistics.core_numbers(graph(spark, pairs), local).collect()} == core


def test_betweenness(spark):
    rows = {r.id: r.score for r in static_orders.betweenness(graph(spark, [(0, 1), (1, 2), (2, 3)])).collect()}
    assert {k: round(v, 6) for k, v in rows.items()} == {0: 0.0, 1: 0.666667, 2: 0.666667, 3: 0.0}


@pytest.mark.parametrize("local", [100_000, 50, 7])
def test_components_of_paths_and_stars(spark, local):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r.component for r in connected_components(df, local=local).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1200)} | {5000: 5000}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [100_000, 40])
def test_components_of_random_graphs(spark, local):
    pairs = random_pairs(300, 280, 8)
    g = Plain(pairs)
    want = {u: min(part) for part in g.parts() for u in part}
    df = spark.createDataFrame([((("g", a)), ("g", b)) for a, b in pairs], "src struct<graph: string, id: long>, dst struct<graph: string, id: long>")
    assert {r.id.id: r.component.id for r in connected_components(df, local=local).collect()} == want


def test_row_order_is_nothing(spark):
    pairs = random_pairs(40, 80, 5)
    a, b = graph(spark, pairs), graph(spark, pairs[::-1])
    for f in (static_orders.degree_order, static_orders.cluc_order, static_orders.influence_order):
        assert order_of(f(a)) == order_of(f(b))


def test_general_radius(spark):
    path = graph(spark, [(i, i + 1) for i in range(6)])
    rows = {r.id: r.score for r in static_orders.influence_scores(path, 3).collect()}
    assert rows == {0: 0.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: 0.0}


@pytest.mark.parametrize(("name", "n"), [("Powerlaw_500", 500), ("SynthComm1000_s23", 1000), ("SynthGridSW1200_s31", 1200)])
def test_named_graphs(spark, name, n):
    one = statistics.manifest(generators.named(spark, name)).first()
    assert one.nodes == n and one.connected and one.edges >= n - 1


def test_scaling_family(spark):
    for kind in ("powerlaw", "ER", "WS", "SBM", "BA"):
        assert statistics.manifest(generators.scaling_family(spark, kind, 400, 42)).first().connected


def test_preferential_attachment(spark):
    one = statistics.manifest(generators.preferential(spark, "ba", 2000, 3, 5)).first()
    assert one.nodes == 2000 and one.connected and 5000 < one.edges <= 5997 and one.max_degree > 60


def test_proxy_graphs(spark):
    rows = {r.graph: r for r in statistics.manifest(generators.proxy_graphs(spark)).collect()}
    assert set(rows) == {"BA120", "ER120", "WS120", "SBM128"} and all(r.connected for r in rows.values())


def test_covering_seeds(spark):
    stars = graph(spark, [(0, i) for i in range(1, 9)] + [(20, i) for i in range(21, 27)] + [(1, 2), (1, 3), (1, 4)])
    nodes = projections.nodes_of(stars)
    assert order_of(seeds.diverse_degree(stars, nodes, 2))[:2] == [0, 20]
    assert order_of(seeds.two_hop_cover(stars, nodes, 2))[0] in range(9) and order_of(seeds.two_hop_cover(stars, nodes, 2))[1] in range(20, 27)


def test_edge_files(spark, tmp_path):
    (tmp_path / "a.edgelist").write_text("# head\n3 1\n1,3\n2 2\nx 1\n1 2\n")
    parsed = edgelists.parse_lines(edgelists.read_lines(spark, str(tmp_path))).cache()
    assert tuple(edgelists.line_counts(parsed).first()) == ("a", 5, 1, 1, 3, 2)
    assert [(r.id, r.pos) for r in edgelists.file_nodes(parsed).orderBy("pos").collect()] == [(3, 1), (1, 2), (2, 3)]
    edgelists.write_edges(edgelists.edges_of(parsed), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/edges")).collect()) == ["1 2", "1 3"]


def test_sequences(spark, tmp_path):
    (tmp_path / "s.csv").write_text("step,node\n1,5\n2,7\n")
    (tmp_path / "s.txt").write_text("5 .1\n7 .2\n")
    assert order_of(edgelists.read_sequence(spark, str(tmp_path / "s.csv"))) == [5, 7]
    assert order_of(edgelists.read_sequence(spark, str(tmp_path / "s.txt"))) == [5, 7]


def test_source_chain(smoke, spark):
    nodes = projections.nodes_of(smoke)
    good = static_orders.degree_order(smoke)
    assert edgelists.first_valid_source([("file", None), ("short", good.where("step > 1")), ("DC", good), ("last", good)], nodes)[0] == "DC"


def test_spread_grows_with_seeds(smoke, spark):
    nodes = projections.nodes_of(smoke)
    sets = spark.createDataFrame([("g", "one", 2), ("g", "two", 2), ("g", "two", 11)], "graph string, method string, node long")
    parts = diffusion.live_components(diffusion.live_edges(smoke, 64, 0.4))
    live = {r.method: r.spread for r in diffusion.live_spread(sets, parts, nodes, 64).collect()}
    lt = {r.method: r.spread_mean for r in diffusion.threshold_summary(diffusion.threshold_spread(sets, smoke, 64), nodes, 64).collect()}
    assert live["one"] < live["two"] and lt["one"] < lt["two"]


def test_greedy_is_greedy(smoke):
    nodes = projections.nodes_of(smoke)
    first = seeds.spread_greedy(smoke, nodes, 1, 32, 0.4).first().node
    parts = diffusion.live_components(diffusion.live_edges(smoke, 32, 0.4))
    every = nodes.select("graph", F.col("id").cast("string").alias("method"), F.col("id").alias("node"))
    spread = {int(r.method): r.spread for r in diffusion.live_spread(every, parts, nodes, 32).collect()}
    assert first == min(spread, key=lambda u: (-round(spread[u], 9), str(u)))


def test_registered_program(smoke):
    adaptive.register("Backwards", lambda g, steps: sorted(g.alive, reverse=True))
    assert adaptive_order(smoke, "Backwards") == list(range(11, -1, -1))


@pytest.mark.parametrize("weights", [{}, {"boundary": 0.0}, {"redundancy": 0.3, "cap": 3, "two_hop_cap": 2}, {"neighbours": 0.2, "phase": 2.0, "two_hop_cap": 0}])
def test_local_scores(weights):
    """Every score anew at every step."""
    w = {"neighbours": 0.02, "weak": 0.1, "boundary": 0.0015, "redundancy": 0.0, "phase": 0.15, "cap": None, "two_hop_cap": None} | weights
    pairs, order = random_pairs(40, 90, 6), []
    got = adaptive.local_scores(**weights)(residual := adaptive.Residual(list(range(40)), pairs), 40)
    g = Plain(pairs)
    for u in range(40):
        g.near.setdefault(u, set())

    def score(u):
        near = sorted(g.near[u])[: w["cap"]]
        cut = None if w["two_hop_cap"] is None else max(1, w["two_hop_cap"])
        rim = sum(len(g.near[x]) for v in near for x in sorted(g.near[v] - {u})[:cut])
        links = sum(b in g.near[a] for a in near for b in near if a < b)
        weak = sum(len(g.near[v]) <= 2 for v in near)
        return (1 + w["phase"] * len(order) / 40) * len(g.near[u]) + w["neighbours"] * sum(len(g.near[v]) for v in near) + w["weak"] * weak + w["boundary"] * rim - w["redundancy"] * links

    while g.near:
        best = max(g.near, key=lambda u: (round(score(u), 9), str(u)))
        assert abs(score(got[len(order)]) - score(best)) < 1e-9
        g.remove(got[len(order)])
        order.append(got[len(order)])
    assert not residual.alive


def test_betweenness_of_random_graphs(spark):
    """Against the share of shortest paths counted pair by pair."""
    pairs = random_pairs(18, 32, 8)
    near = Plain(pairs).near

    def paths(s):
        level, count, ring = {s: 0}, {s: 1}, [s]
        while ring:
            nxt = []
            for u in ring:
                for v in near[u]:
                    if v not in level:
                        level[v], count[v] = level[u] + 1, 0
                        nxt.append(v)
                    if level[v] == level[u] + 1:
                        count[v] += count[u]
            ring = nxt
        return level, count

    known = {u: paths(u) for u in near}
    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t in near:
            for u in near.keys() - {s, t}:
                if t in known[s][0] and u in known[s][0] and t in known[u][0] and known[s][0][u] + known[u][0][t] == known[s][0][t]:
                    want[u] += known[s][1][u] * known[u][1][t] / known[s][1][t] / (len(near) - 1) / (len(near) - 2)
    rows = static_orders.betweenness(graph(spark, pairs), 3).collect()
    assert {r.id: round(r.score, 9) for r in rows} == {u: round(x, 9) for u, x in want.items()}


def modularity(pairs, community):
    m, out = len(pairs), 0.0
    degree = Counter(x for p in pairs for x in p)
    for c in set(community.values()):
        inside = sum(community[a] == c == community[b] for a, b in pairs)
        out += inside / m - (sum(d for u, d in degree.items() if community[u] == c) / (2 * m)) ** 2
    return out


def test_greedy_modularity(spark):
    """Each union is the best one, by trying all; two cliques with a bridge are two communities."""
    for seed in (1, 2, 3):
        pairs = random_pairs(24, 40, seed)
        now = {u: u for p in pairs for u in p}
        while True:
            names, base = sorted(set(now.values())), modularity(pairs, now)
            tried = [(round(modularity(pairs, {u: a if c == b else c for u, c in now.items()}) - base, 12), -a, -b) for a in names for b in names if a < b and any({now[x], now[y]} == {a, b} for x, y in pairs)]
            gain, a, b = max(tried, default=(0, 0, 0))
            if gain <= 0:
                break
            now = {u: -a if c == -b else c for u, c in now.items()}
        assert communities.merge_greedily(pairs) == now
    cliques = [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(k, k + 5) if a < b] + [(4, 10)]
    rows = communities.greedy_modularity(graph(spark, cliques)).collect()
    assert {r.id: r.community for r in rows} == {u: u // 10 * 10 for p in cliques for u in p}


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(parts)
    got = ordering.numbered(df, ["g"], [F.desc("x"), F.asc("i")], "at").collect()
    want = {}
    for g in "abc":
        want |= {(g, i): n for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1)}
    assert {(r.g, r.i): r.at for r in got} == want
    assert ordering.numbered(df.limit(0), ["g"], [F.asc("i")], "at").count() == 0


def test_scores_worked_out_by_hand():
    """S-inner on a star's middle and a path's middle, from its table of weights."""
    root2, root3 = 2**0.5, 3**0.5
    score = variants.SInner(frozenset())
    star = adaptive.Residual([0, 1, 2, 3], [(0, 1), (0, 2), (0, 3)])
    assert score.key(star, 0)[0] == pytest.approx(1.15 * 3 + 0.58 * 3 + 0.045 * root3 + (0.010 - 0.015) + 0.052 * 3 / 4)
    path = adaptive.Residual([0, 1, 2, 3, 4], [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert score.key(path, 2)[0] == pytest.approx(1.15 * 2 + 0.32 * 2 + 0.58 * 2 + 0.62 * 2 * root2 + 0.70 * 2 + 0.046 * 2 * root2 + 2 * (0.010 - 0.015) + 0.052 * 6 / 3)
    triangle = adaptive.Residual([0, 1, 2], [(0, 1), (1, 2), (0, 2)])
    assert score.key(triangle, 0)[0] == pytest.approx(1.15 * 2 + 0.58 * 2 - 0.50 * root2 + 2 * (0.010 - 0.015) + 0.052 * 2 / 3)


#: Nodes, edges and largest degree of the published graphs, by file name (fixed values).
PUBLISHED = {
    "smoke": (12, 12, 3), "CEnew": (453, 2025, 237), "Powerlaw_500": (500, 943, 63), "crime": (829, 1473, 25), "email": (1133, 5451, 71), "PH": (2000, 16098, 273), "hamster": (2000, 16098, 273), "Yeast": (2375, 11693, 118),
    "Collaboration": (4158, 13422, 81), "GrQC": (4158, 13422, 81), "Grid": (4941, 6594, 19),
}


@pytest.mark.skipif("GRAPHS_DIR" not in os.environ, reason="GRAPHS_DIR names no folder of published edge lists")
def test_published_graphs(spark):
    edges = edgelists.edges_of(edgelists.parse_lines(edgelists.read_lines(spark, os.environ["GRAPHS_DIR"]))).cache()
    got = {r.graph: (r.nodes, r.edges, r.max_degree) for r in statistics.manifest(edges).collect()}
    assert {g: n for g, n in got.items() if g in PUBLISHED} == {g: n for g, n in PUBLISHED.items() if g in got} and len(got) >= 10
    if "hamster" in got:
        assert {r.graph: r.duplicate_of for r in edgelists.content_hash(edges.where("graph IN ('PH', 'hamster')")).collect()} == {"PH": None, "hamster": "PH"}


def test_components_of_worlds(spark):
    """World by world and by stars alike."""
    live = diffusion.live_edges(graph(spark, random_pairs(40, 60, 3)), 6, 0.4)
    one, all_ = ({tuple(r) for r in diffusion.live_components(live, local).select("graph", "world", "id", "part", "size").collect()} for local in (diffusion.LOCAL, 0))
    assert one == all_ and len(one) > 20
    assert diffusion.live_components(live.limit(0)).count() == 0
