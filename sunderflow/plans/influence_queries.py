"""Queries of diffusion and seed selection over the part graph, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import communities, diffusion, path_influence, ranking, seeds, static_orders, statistics
from ..sources import projections
from ..sources.storage import durable
from . import table_functions
from .graph_queries import DC, E, edges, rounded
from .graph_queries import SQL as GRAPH_SQL

K = 12
#: Draws: live-edge and cascade worlds, thresholds' worlds, worlds of greedy choices, reverse reachable sets, and the runs and
#: swaps of what simulates as it chooses (fixed values).
WORLDS, THRESHOLDS, GREEDY, SETS, RUNS, SWAPS = 1024, 4096, 256, 2048, 128, 128


def _dc_seeds(e: DataFrame, k: int = K) -> DataFrame:
    return durable(static_orders.first_seeds(static_orders.degree_order(e), k), "seeds")


def _two_sets(e: DataFrame) -> DataFrame:
    """Seeds of two methods: the first and the next K of the degree order."""
    o = static_orders.degree_order(e).where(F.col("step") <= 2 * K)
    return durable(o.withColumn("method", F.when(F.col("step") <= K, "first").otherwise("next")), "seeds")


def _spread(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return diffusion.live_spread(_two_sets(e), diffusion.live_components(diffusion.live_edges(e, WORLDS, 0.3)), projections.nodes_of(e), WORLDS)


def _cascade(s: SparkSession, d: str, p: float | None, strict: bool = False) -> DataFrame:
    e = edges(s, d)
    return diffusion.mean_active(diffusion.cascade(_two_sets(e), durable(diffusion.arcs(e, p), "arcs"), WORLDS, strict=strict), WORLDS)


def _sets(s: SparkSession, d: str, e: DataFrame, n: int = SETS) -> DataFrame:
    return diffusion.reverse_sets(projections.nodes_of(e), durable(diffusion.arcs(e, 0.3), "arcs"), n)


def _coverage(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return diffusion.reverse_coverage(_two_sets(e), _sets(s, d, e), SETS)


def _threshold(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return diffusion.threshold_summary(diffusion.threshold_spread(_two_sets(e), e, THRESHOLDS), projections.nodes_of(e), THRESHOLDS)


def _two_hop(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return diffusion.two_hop_coverage(_two_sets(e), e, projections.nodes_of(e))


def _normal(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    raw = _dc_seeds(e, 5).unionByName(_dc_seeds(e, 2).withColumn("step", F.col("step") + 10)).unionByName(_dc_seeds(e, 1).withColumns({"step": F.lit(20), "node": F.lit(-1).cast("long")}))
    return diffusion.normal_seeds(raw, projections.nodes_of(e), 8).select("graph", F.col("step").cast("long").alias("step"), "node")


def _budget(s: SparkSession, d: str) -> DataFrame:
    n = statistics.degrees(edges(s, d)).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return n.select("graph", scalars.seed_budget(F.col("n")).alias("seeds"), scalars.budget(F.col("n"), 0.3).alias("steps"), scalars.budget(F.col("n"), 0.4).alias("steps_40"))


def influence_benchmark(e: DataFrame, nodes: DataFrame, k: int, thresholds: int, worlds: int, p: float) -> DataFrame:
    """Methods' seeds under the same worlds: LT and IC spread, ranks and tie groups of LT, one row per (graph, method)."""
    by = [static_orders.first_seeds(static_orders.degree_order(e), k), seeds.degree_discount(e, k, p), seeds.neighbour_cover(e, k), seeds.diverse_degree(e, nodes, k), seeds.two_hop_cover(e, nodes, k)]
    chosen = by[0]
    for b in by[1:]:
        chosen = chosen.unionByName(b)
    chosen = durable(diffusion.normal_seeds(chosen, nodes, k), "seeds")
    lt = diffusion.threshold_summary(diffusion.threshold_spread(chosen, e, thresholds), nodes, thresholds)
    ic = diffusion.live_spread(chosen, diffusion.live_components(diffusion.live_edges(e, worlds, p)), nodes, worlds).withColumnRenamed("spread", "ic_spread")
    rows = lt.join(ic, ["graph", "method"]).select(F.col("graph").alias("dataset"), "method", F.lit(True).alias("valid"), F.col("spread_mean").alias("spread"), "spread_ci95", "normalized_spread", "ic_spread")
    return ranking.tie_groups(durable(rows, "benchmark"))


def _pick(df: DataFrame) -> DataFrame:
    return df.select("graph", F.col("step").cast("long").alias("step"), "node")


def _with(f):  # noqa: ANN001, ANN202
    return lambda s, d: _pick(f(e := edges(s, d), projections.nodes_of(e)))


QUERIES = {
    "arcs_constant": lambda s, d: diffusion.arcs(edges(s, d), 0.1),
    "arcs_weighted_cascade": lambda s, d: rounded(diffusion.arcs(edges(s, d), None)),
    "arc_probability": lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), diffusion.probability([F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise((F.col("p_partkey") % 5 - 1).cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.lit("0.25"))], F.lit(0.1)).alias("p")),
    "world_edges": lambda s, d: diffusion.live_edges(edges(s, d), WORLDS, 0.3),
    "live_spread": lambda s, d: rounded(_spread(s, d)),
    "ic_spread": lambda s, d: rounded(_cascade(s, d, 0.3)),
    "ic_spread_weighted": lambda s, d: rounded(_cascade(s, d, None)),
    "ic_spread_strict": lambda s, d: rounded(_cascade(s, d, 0.05, True)),
    "rr_sets": lambda s, d: _sets(s, d, edges(s, d)),
    "rr_coverage": lambda s, d: rounded(_coverage(s, d)),
    "lt_weights": lambda s, d: rounded(diffusion.arriving_weights(edges(s, d))),
    "lt_spread": lambda s, d: rounded(_threshold(s, d)),
    "two_hop_coverage": lambda s, d: rounded(_two_hop(s, d)),
    "normal_seeds": _normal,
    "seed_budget": _budget,
    "degree_discount": lambda s, d: _pick(seeds.degree_discount(edges(s, d), 3)),
    "neighbour_cover": lambda s, d: _pick(seeds.neighbour_cover(edges(s, d), 3)),
    "free_degree": lambda s, d: seeds.free_degree(e := edges(s, d), _dc_seeds(e)),
    "dominating_set": lambda s, d: _pick(seeds.dominating_set(edges(s, d))),
    "rr_greedy": lambda s, d: _pick(seeds.reverse_greedy(_sets(s, d, edges(s, d)), 3)),
    "mc_greedy": _with(lambda e, n: seeds.spread_greedy(e, n, 3, GREEDY, 0.3)),
    "celf": _with(lambda e, n: seeds.spread_greedy(e, n, 3, GREEDY, 0.3, method="CELF")),
    "celf_pp": _with(lambda e, n: seeds.spread_greedy(e, n, 3, GREEDY, 0.3, method="CELF++")),
    "diverse_degree": _with(lambda e, n: seeds.diverse_degree(e, n, 5)),
    "two_hop_cover": _with(lambda e, n: seeds.two_hop_cover(e, n, 5)),
    "influence_benchmark": lambda s, d: rounded(influence_benchmark(e := edges(s, d), projections.nodes_of(e), 5, THRESHOLDS, WORLDS, 0.1)),
    "imm": _with(lambda e, n: seeds.imm(e, n, 3, 0.2)),
    "mia": _with(lambda e, n: path_influence.mia(e, n, 3)),
    "sql_removal_order": lambda s, d: _pick(table_functions.removal_order()(edges(s, d).asTable(), F.lit("HDA"), F.lit(0.3))),
    "sql_seed_order": lambda s, d: _pick(table_functions.seed_order()(edges(s, d).asTable(), F.lit("Degree"), F.lit(5.0))),
    "dom_im": _with(lambda e, n: seeds.dominating_search(e, n, 5, runs=RUNS, iterations=SWAPS)),
    "cluster_greedy": _with(lambda e, n: seeds.cluster_greedy(e, n, communities.greedy_modularity(e), 3, runs=RUNS)),
}


def _u(seed: int, *xs: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({x} AS VARCHAR)' for x in xs)})), 1, 8)) AS BIGINT) / 4294967296.0)"


S = diffusion.SEED
NEIGHBOURHOODS = "nb AS (SELECT id AS u, id AS x FROM deg UNION ALL SELECT s, d FROM sym)"
SEEDS = f"{DC}, sd AS (SELECT CASE WHEN r <= {K} THEN 'first' ELSE 'next' END AS method, id AS node FROM o WHERE r <= {2 * K})"


def _worlds_sql(n: int) -> str:
    return f"w AS (SELECT unnest(range({n})) AS world)"


W = _worlds_sql(WORLDS)


def _cascade_sql(p: str, wins: str, with_: str = "") -> str:
    return f"""WITH RECURSIVE {E}, {SEEDS}, {W}{with_}, arc AS (SELECT s, d, {p} AS p FROM sym {'JOIN deg ON deg.id = d' if 'degree' in p else ''}),
act(method, world, node) AS (SELECT method, world, node FROM sd, w UNION SELECT a.method, a.world, arc.d FROM act a JOIN arc ON arc.s = a.node WHERE {_u(S, 'a.world', 'arc.s', 'arc.d')} {wins} arc.p)
SELECT 'part' AS graph, method, round(count(*) / {WORLDS}.0, 9) AS spread FROM act GROUP BY method"""


_RR = f"""rw AS (SELECT unnest(range({SETS})) AS rr), n AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS n FROM deg),
rt AS (SELECT rr, id FROM rw JOIN n ON n.pos = CAST(floor({_u(S, 'rr', "'root'")} * n.n) AS BIGINT) + 1),
rs(rr, node) AS (SELECT rr, id FROM rt UNION SELECT rs.rr, sym.s FROM rs JOIN sym ON sym.d = rs.node WHERE {_u(S, 'rs.rr', 'sym.s', 'sym.d')} <= 0.3)"""


def _greedy_sql(cover: str, tie: str, k: int, first_tie: str = "") -> str:
    """k unrolled rounds of greedy cover over cv(u, x, wt)."""
    out, later = f"{cover}", tie
    for i in range(1, k + 1):
        tie = first_tie or later if i == 1 else later
        prev = "cv" if i == 1 else f"l{i - 1}"
        out += f", g{i} AS (SELECT u FROM {prev} JOIN deg ON deg.id = u GROUP BY u, degree ORDER BY sum(wt) DESC, {tie} LIMIT 1), l{i} AS (SELECT * FROM {prev} WHERE x NOT IN (SELECT c.x FROM {prev} c JOIN g{i} ON g{i}.u = c.u))"
    return out + " " + " UNION ALL ".join(f"SELECT 'part' AS graph, CAST({i} AS BIGINT) AS step, u AS node FROM g{i}" for i in range(1, k + 1))


_LIVE = f"""le AS (SELECT world, src, dst FROM e, w WHERE {_u(S, 'world', 'src', 'dst')} <= 0.3), ls AS (SELECT world, src AS s, dst AS d FROM le UNION ALL SELECT world, dst, src FROM le),
lc(world, id, c) USING KEY (world, id) AS (SELECT world, id, id FROM w, deg UNION SELECT ls.world, ls.s, min(f.c) FROM ls JOIN lc f ON f.world = ls.world AND f.id = ls.d JOIN recurring.lc g ON g.world = ls.world AND g.id = ls.s GROUP BY ls.world, ls.s, g.c HAVING min(f.c) < g.c),
lz AS (SELECT world, c, count(*) AS size FROM lc GROUP BY world, c)"""

_DD = """t{i} AS (SELECT id, degree, (SELECT count(*) FROM sym WHERE s = deg.id AND d IN ({chosen})) AS t FROM deg WHERE id NOT IN ({chosen})),
g{i} AS (SELECT id FROM t{i} ORDER BY CAST(degree - 2 * t - (degree - t) * t * 0.01 AS DOUBLE) DESC, degree DESC, CAST(id AS VARCHAR) DESC LIMIT 1)"""


def _discount_sql() -> str:
    parts, chosen = [], "SELECT -1"
    for i in (1, 2, 3):
        parts.append(_DD.format(i=i, chosen=chosen))
        chosen += f" UNION ALL SELECT id FROM g{i}"
    return f"WITH {E}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT 'part' AS graph, CAST({i} AS BIGINT) AS step, id AS node FROM g{i}" for i in (1, 2, 3))


def _mc_greedy_sql(first_tie: str = "") -> str:
    return f"WITH RECURSIVE {E}, {_worlds_sql(GREEDY)}, " + _greedy_sql(f"{_LIVE}, cv AS (SELECT id AS u, lc.world * 10000000 + lc.c AS x, size AS wt FROM lc JOIN lz ON lz.world = lc.world AND lz.c = lc.c)", "CAST(u AS VARCHAR)", 3, first_tie)


def _chosen_sql(rounds: list[str]) -> str:
    return ", ".join(f"g{i} AS ({r})" for i, r in enumerate(rounds, 1)) + " " + " UNION ALL ".join(f"SELECT 'part' AS graph, CAST({i} AS BIGINT) AS step, id AS node FROM g{i}" for i in range(1, len(rounds) + 1))


def _diverse_sql(k: int) -> str:
    """Unrolled: by degree; after the first half only what chosen ones don't cover."""
    rounds, chosen = [], "SELECT -1 AS id"
    for i in range(1, k + 1):
        without = chosen if i <= max(1, k // 2) else f"SELECT x FROM nb WHERE u IN ({chosen})"
        rounds.append(f"SELECT id FROM deg WHERE id NOT IN ({without}) ORDER BY degree DESC, CAST(id AS VARCHAR) DESC LIMIT 1")
        chosen += f" UNION ALL SELECT id FROM g{i}"
    return f"WITH {E}, {NEIGHBOURHOODS}, " + _chosen_sql(rounds)


def _two_hop_sql(k: int) -> str:
    """Unrolled: most uncovered nodes among those reached; what a node reaches are its neighbourhood and the neighbours of
    its first neighbours, up to the one at which there are over 120."""
    rounds, chosen = [], "SELECT -1 AS id"
    for i in range(1, k + 1):
        rounds.append(f"""SELECT deg.id FROM deg LEFT JOIN (SELECT * FROM reach WHERE x NOT IN (SELECT x FROM nb WHERE u IN ({chosen}))) r ON r.u = deg.id
 WHERE deg.id NOT IN ({chosen}) GROUP BY deg.id, degree ORDER BY count(r.x) DESC, degree DESC, CAST(deg.id AS VARCHAR) DESC LIMIT 1""")
        chosen += f" UNION ALL SELECT id FROM g{i}"
    return f"""WITH {E}, {NEIGHBOURHOODS}, fn AS (SELECT s AS u, d AS v, row_number() OVER (PARTITION BY s ORDER BY d) AS r FROM sym),
fa AS (SELECT u, sym.d AS x, min(r) AS r FROM fn JOIN sym ON sym.s = v WHERE r <= 24 GROUP BY u, sym.d), fc AS (SELECT u, r, sum(count(*)) OVER (PARTITION BY u ORDER BY r) - count(*) AS before FROM fa GROUP BY u, r),
reach AS (SELECT u, x FROM nb UNION SELECT fa.u, fa.x FROM fa JOIN fc ON fc.u = fa.u AND fc.r = fa.r WHERE before <= 120), """ + _chosen_sql(rounds)


def _mia_sql(k: int) -> str:
    """Unrolled: all pairs within three arcs, the most that p = .1 leaves at .001; seeds' pairs anew for each candidate."""
    out, chosen = f"WITH {E}", "SELECT -1 AS id"
    for i in range(1, k + 1):
        free = f"NOT IN ({chosen})"
        out += f""", y{i} AS (SELECT s, d FROM sym WHERE s {free} AND d {free}), a{i} AS (SELECT u.id AS u, sym.s AS c, sym.d AS v FROM ({chosen}) g JOIN sym ON sym.s = g.id, deg u WHERE sym.d {free} AND u.id {free} AND sym.d <> u.id),
b{i} AS (SELECT DISTINCT u, c, y.d AS v FROM a{i} JOIN y{i} y ON y.s = v WHERE y.d <> u), f{i} AS (SELECT DISTINCT u, c, y.d AS v FROM b{i} JOIN y{i} y ON y.s = v WHERE y.d <> u),
o{i} AS (SELECT DISTINCT s AS u, d AS v FROM y{i}), p{i} AS (SELECT DISTINCT u, y.d AS v FROM o{i} JOIN y{i} y ON y.s = v), q{i} AS (SELECT DISTINCT u, y.d AS v FROM p{i} JOIN y{i} y ON y.s = v),
h{i} AS (SELECT u, c, v, min(h) AS h FROM (SELECT u, c, v, 1 AS h FROM a{i} UNION ALL SELECT u, c, v, 2 FROM b{i} UNION ALL SELECT u, c, v, 3 FROM f{i} UNION ALL SELECT u, u, v, 1 FROM o{i} UNION ALL SELECT u, u, v, 2 FROM p{i} UNION ALL SELECT u, u, v, 3 FROM q{i}) WHERE u <> v GROUP BY u, c, v),
r{i} AS (SELECT u, v, 1 - product(1 - pow(0.1, h)) AS reached FROM h{i} GROUP BY u, v), z{i} AS (SELECT u, sum(reached) AS gain FROM r{i} GROUP BY u),
g{i} AS (SELECT id FROM deg LEFT JOIN z{i} ON u = id WHERE id {free} ORDER BY round(coalesce(gain, 0), 9) DESC, CAST(id AS VARCHAR) LIMIT 1)"""
        chosen += f" UNION ALL SELECT id FROM g{i}"
    return out + " " + " UNION ALL ".join(f"SELECT 'part' AS graph, CAST({i} AS BIGINT) AS step, id AS node FROM g{i}" for i in range(1, k + 1))


SQL = {
    "arcs_constant": f"WITH {E} SELECT 'part' AS graph, s, d, CAST(0.1 AS DOUBLE) AS p FROM sym",
    "arcs_weighted_cascade": f"WITH {E} SELECT 'part' AS graph, s, d, round(1.0 / degree, 9) AS p FROM sym JOIN deg ON deg.id = d",
    "arc_probability": "SELECT p_partkey AS k, CAST(coalesce(greatest(0.0, least(1.0, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 5 - 1.0 END, CASE WHEN p_partkey % 2 = 0 THEN 0.25 END))), 0.1) AS DOUBLE) AS p FROM part",
    "world_edges": f"WITH {E}, {W} SELECT 'part' AS graph, CAST(world AS INTEGER) AS world, src, dst FROM e, w WHERE {_u(S, 'world', 'src', 'dst')} <= 0.3",
    "live_spread": f"""WITH RECURSIVE {E}, {SEEDS}, {W}, {_LIVE}, h AS (SELECT DISTINCT method, lc.world, lc.c FROM sd JOIN lc ON lc.id = sd.node)
SELECT 'part' AS graph, method, round(sum(size) / {WORLDS}.0 / (SELECT count(*) FROM deg), 9) AS spread FROM h JOIN lz ON lz.world = h.world AND lz.c = h.c GROUP BY method""",
    "ic_spread": _cascade_sql("0.3", "<="),
    "ic_spread_weighted": _cascade_sql("1.0 / degree", "<="),
    "ic_spread_strict": _cascade_sql("0.05", "<"),
    "rr_sets": f"WITH RECURSIVE {E}, {_RR} SELECT 'part' AS graph, CAST(rr AS INTEGER) AS rr, node FROM rs",
    "rr_coverage": f"WITH RECURSIVE {E}, {SEEDS}, {_RR} SELECT 'part' AS graph, method, round(count(DISTINCT rr) / {SETS}.0, 9) AS coverage FROM sd LEFT JOIN rs ON rs.node = sd.node GROUP BY method",
    "lt_weights": f"WITH {E} SELECT 'part' AS graph, s, d, round(1.0 / degree, 9) AS weight FROM sym JOIN deg ON deg.id = d",
    "lt_spread": f"""WITH RECURSIVE {E}, {SEEDS}, {_worlds_sql(THRESHOLDS)}, th AS (SELECT world, id, degree, {_u(S, 'world', 'id')} AS theta FROM w, deg),
act(method, world, id, rd) USING KEY (method, world, id) AS (
  SELECT method, world, node, 0 FROM sd, w
  UNION
  SELECT a.method, th.world, th.id, max(a.rd) + 1 FROM recurring.act a JOIN sym ON sym.s = a.id JOIN th ON th.world = a.world AND th.id = sym.d
  WHERE NOT EXISTS (SELECT 1 FROM recurring.act b WHERE b.method = a.method AND b.world = th.world AND b.id = th.id)
  GROUP BY a.method, th.world, th.id, th.degree, th.theta HAVING CAST(count(*) AS DOUBLE) / th.degree >= th.theta),
p AS (SELECT method, world, count(*) AS a FROM act GROUP BY method, world)
SELECT 'part' AS graph, method, round(avg(a), 9) AS spread_mean, round(stddev_pop(a), 9) AS spread_std, round(1.96 * stddev_pop(a) / sqrt({THRESHOLDS}.0), 9) AS spread_ci95, round(avg(a) / (SELECT count(*) FROM deg), 9) AS normalized_spread, {THRESHOLDS} AS simulations FROM p GROUP BY method""",
    "two_hop_coverage": f"""WITH {E}, {SEEDS}, h1 AS (SELECT method, d AS node FROM sd JOIN sym ON s = node), h2 AS (SELECT method, d AS node FROM h1 JOIN sym ON s = node), c AS (SELECT * FROM sd UNION SELECT * FROM h1 UNION SELECT * FROM h2)
SELECT 'part' AS graph, method, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM deg), 9) AS coverage FROM c GROUP BY method""",
    "normal_seeds": f"WITH {E}, {DC}, x AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN r <= 5 THEN 0 ELSE 1 END, CASE WHEN r <= 5 THEN r ELSE 0 END, CAST(id AS VARCHAR)) AS step FROM o) SELECT 'part' AS graph, step, id AS node FROM x WHERE step <= 8",
    "free_degree": f"WITH {E}, {DC} SELECT 'part' AS graph, s AS id, count(*) FILTER (WHERE d NOT IN (SELECT id FROM o WHERE r <= {K})) AS free FROM sym GROUP BY s",
    "seed_budget": f"""WITH {E}, c AS (SELECT count(*) AS n FROM deg) SELECT 'part' AS graph, CAST(greatest(3, least(12, round_even(0.05 * n, 0))) AS BIGINT) AS seeds, CAST(greatest(1, least(n, round_even(n * 0.3, 0))) AS BIGINT) AS steps, CAST(greatest(1, least(n, round_even(n * 0.4, 0))) AS BIGINT) AS steps_40 FROM c""",
    "degree_discount": _discount_sql(),
    "neighbour_cover": f"WITH {E}, " + _greedy_sql(f"{NEIGHBOURHOODS}, cv AS (SELECT u, x, 1 AS wt FROM nb)", "degree DESC, CAST(u AS VARCHAR) DESC", 3),
    "dominating_set": f"""WITH RECURSIVE {E}, {NEIGHBOURHOODS}, ds(x, step, u) USING KEY (x) AS (
  SELECT nb.x, 1, b.u FROM (SELECT u FROM nb JOIN deg ON deg.id = u GROUP BY u, degree ORDER BY count(*) DESC, degree DESC, CAST(u AS VARCHAR) DESC LIMIT 1) b JOIN nb ON nb.u = b.u
  UNION
  SELECT nb.x, t.step + 1, b.u FROM (SELECT max(step) AS step FROM ds) t,
   (SELECT nb.u FROM nb JOIN deg ON deg.id = nb.u WHERE nb.x NOT IN (SELECT x FROM recurring.ds) GROUP BY nb.u, degree ORDER BY count(*) DESC, degree DESC, CAST(nb.u AS VARCHAR) DESC LIMIT 1) b
   JOIN nb ON nb.u = b.u WHERE nb.x NOT IN (SELECT x FROM recurring.ds))
SELECT DISTINCT 'part' AS graph, CAST(step AS BIGINT) AS step, u AS node FROM ds""",
    "rr_greedy": f"WITH RECURSIVE {E}, " + _greedy_sql(f"{_RR}, cv AS (SELECT node AS u, rr AS x, 1 AS wt FROM rs)", "CAST(u AS VARCHAR)", 3),
    "mc_greedy": _mc_greedy_sql(),
}
SQL["celf"] = SQL["mc_greedy"]
SQL["celf_pp"] = _mc_greedy_sql("CAST(u AS VARCHAR) DESC")
SQL["diverse_degree"] = _diverse_sql(5)
SQL["two_hop_cover"] = _two_hop_sql(5)
SQL["mia"] = _mia_sql(3)
SQL["sql_removal_order"] = GRAPH_SQL["order_hda"]
SQL["sql_seed_order"] = f"WITH {E}, {DC} SELECT 'part' AS graph, r AS step, id AS node FROM o WHERE r <= 5"
