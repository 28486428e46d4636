"""Queries over the graphs in the relational tables, with the SQL they equal. Floats are rounded to 9 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptive, static_orders, statistics, trajectory, variants
from ..sources import edgelists, generators, projections
from ..sources.storage import durable
from . import validation


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse graph that most queries use, as a table so that their joins don't derive it again."""
    return durable(projections.part_graph(spark, sf_dir), "part-graph")


E = """e AS (
  SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
   AND date_trunc('month', a.l_shipdate) = date_trunc('month', b.l_shipdate)),
sym AS (SELECT src AS s, dst AS d FROM e UNION ALL SELECT dst, src FROM e),
deg AS (SELECT s AS id, count(*) AS degree FROM sym GROUP BY s)"""
TRIANGLES = """tri AS (
  SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
corner AS (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri),
tc AS (SELECT deg.id, degree, count(corner.id) AS triangles FROM deg LEFT JOIN corner ON deg.id = corner.id GROUP BY deg.id, degree),
cl AS (SELECT *, CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * triangles / (degree * (degree - 1)) END AS clustering FROM tc)"""
SHARED = """sides AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri),
sh AS (SELECT e.src, e.dst, count(sides.src) AS common FROM e LEFT JOIN sides ON e.src = sides.src AND e.dst = sides.dst GROUP BY e.src, e.dst),
shs AS (SELECT src AS u, dst AS v, common FROM sh UNION ALL SELECT dst, src, common FROM sh)"""
COMPONENTS = """cc(id, c) USING KEY (id) AS (
  SELECT id, id FROM deg
  UNION
  SELECT sym.s, min(f.c) FROM sym JOIN cc f ON f.id = sym.d JOIN recurring.cc g ON g.id = sym.s GROUP BY sym.s, g.c HAVING min(f.c) < g.c)"""
#: Colours in the order of the ids' hashes, then labels: an iteration is one colour's turn. The row of id -1 is the clock: t counts
#: turns, c those without a change; there are as many of these as colours in the end.
LABELS = """pre AS MATERIALIZED (SELECT s, d FROM sym WHERE (md5('7|' || d), d) < (md5('7|' || s), s)), need AS MATERIALIZED (SELECT s, count(*) AS n FROM pre GROUP BY s),
co(id, colour) USING KEY (id) AS (
  SELECT id, CAST(0 AS BIGINT) FROM deg WHERE id NOT IN (SELECT s FROM pre)
  UNION
  SELECT a.s, list_min(list_filter(range(0, count(*) + 1), lambda x: NOT list_contains(list(g.colour), x)))
  FROM (SELECT DISTINCT pre.s FROM co f JOIN pre ON pre.d = f.id) a JOIN need ON need.s = a.s JOIN pre ON pre.s = a.s JOIN recurring.co g ON g.id = pre.d
  GROUP BY a.s, need.n HAVING count(*) = need.n),
kk AS MATERIALIZED (SELECT max(colour) + 1 AS k FROM co), cs AS MATERIALIZED (SELECT colour, s, d FROM sym JOIN co ON co.id = s),
lp(id, c, t) USING KEY (id) AS (
  SELECT id, id, CAST(0 AS BIGINT) FROM (SELECT id FROM deg UNION ALL SELECT -1)
  UNION
  SELECT id, CASE WHEN id <> -1 THEN c WHEN count(*) OVER () > 1 THEN 0 WHEN t = 0 THEN 1 ELSE c + 1 END, t + 1 FROM (
    SELECT b.s AS id, b.c, b.t FROM (
      SELECT s, g.c, w.t, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, g.c) AS rn
      FROM (SELECT t FROM lp WHERE id = -1) w, kk JOIN cs ON cs.colour = w.t % kk.k JOIN recurring.lp g ON g.id = cs.d GROUP BY s, g.c, w.t) b JOIN recurring.lp own ON own.id = b.s
    WHERE b.rn = 1 AND b.c <> own.c
    UNION ALL
    SELECT id, c, t FROM lp WHERE id = -1) x, kk
  WHERE (SELECT CASE WHEN t = 0 THEN 0 ELSE c END FROM recurring.lp WHERE id = -1) < kk.k),
com AS (SELECT id, c AS community FROM lp WHERE id <> -1)"""
DC = """o AS (SELECT id, row_number() OVER (ORDER BY degree DESC, CAST(id AS VARCHAR) DESC) AS r FROM deg)"""


CLUC = f"""ns AS (SELECT s, sum(degree + 1) AS near FROM sym JOIN deg ON deg.id = d GROUP BY s),
cluc AS (SELECT id, row_number() OVER (ORDER BY pow(10.0, -clustering) * near DESC, id) AS r FROM cl JOIN ns ON ns.s = id)"""
CI = """two AS (SELECT DISTINCT a.s, b.d FROM sym a JOIN sym b ON a.d = b.s WHERE a.s <> b.d),
rim AS (SELECT two.s, sum(degree - 1) AS far FROM two JOIN deg ON deg.id = two.d WHERE NOT EXISTS (SELECT 1 FROM sym WHERE sym.s = two.s AND sym.d = two.d) GROUP BY two.s),
ci AS (SELECT id, row_number() OVER (ORDER BY (degree - 1) * coalesce(far, 0) DESC, id) AS r FROM deg LEFT JOIN rim ON rim.s = id)"""


def curve_sql(rate: str, tail: str, orders: str = f"{DC}, om AS MATERIALIZED (SELECT 'DC' AS method, id, r FROM o)") -> str:
    """The trajectories of orders om(method, id, r): components of all residual graphs by one keyed recursion."""
    return f"""WITH RECURSIVE {E}, {orders},
k1 AS (SELECT CAST(greatest(1, least(count(*), round_even(count(*) * {rate}, 0))) AS BIGINT) AS steps, count(*) AS n FROM deg),
ks AS MATERIALIZED (SELECT method, k, (row_number() OVER (ORDER BY method, k)) * 1000000000000 AS base FROM (SELECT method, unnest(range(1, steps + 1)) AS k FROM k1, (SELECT DISTINCT method FROM om))),
ae AS MATERIALIZED (SELECT base + s AS s, base + d AS d FROM ks, sym, om a, om b WHERE a.method = ks.method AND b.method = ks.method AND a.id = s AND b.id = d AND a.r > k AND b.r > k),
lab(id, c) USING KEY (id) AS (
  SELECT base + id, base + id FROM ks JOIN om ON om.method = ks.method WHERE r > k
  UNION
  SELECT ae.s, min(f.c) FROM ae JOIN lab f ON f.id = ae.d JOIN recurring.lab g ON g.id = ae.s GROUP BY ae.s, g.c HAVING min(f.c) < g.c),
sz AS (SELECT method, k, c, count(*) AS size, row_number() OVER (PARTITION BY method, k ORDER BY count(*) DESC, c) AS place FROM lab JOIN ks ON base = id - id % 1000000000000 GROUP BY method, k, c),
raw AS (
  SELECT ks.method, ks.k AS step, n, coalesce(max(size), 0) AS largest, count(size) AS parts, coalesce(sum(CASE WHEN place <= 5 THEN size END), 0) AS top5,
         CAST(coalesce(sum(size * size), 0) AS DOUBLE) AS squares, coalesce(sum(size), 0) AS alive
  FROM ks CROSS JOIN k1 LEFT JOIN sz ON sz.method = ks.method AND sz.k = ks.k GROUP BY ks.method, ks.k, n),
hh AS (SELECT *, squares / (greatest(1, alive) * greatest(1, alive)) AS hhi, CAST(top5 AS DOUBLE) / n AS t5, 1 - (squares - alive) / greatest(1.0, CAST(n AS DOUBLE) * (n - 1)) AS pd FROM raw),
cu AS (
  SELECT 'part' AS graph, method, step, CAST(step AS DOUBLE) / n AS removal_ratio, CAST(largest AS DOUBLE) / n AS "ACC", CAST(largest AS DOUBLE) / n AS "GCC", CAST(parts AS DOUBLE) AS "NCC",
         t5 AS top5_component_mass, hhi AS hhi_remaining, CASE WHEN hhi > 0 THEN 1 / hhi ELSE 0.0 END AS effective_components, pd AS pairwise_disconnected,
         pd * (CASE WHEN hhi > 0 THEN 1 / hhi ELSE 0.0 END) / (1 + t5) AS "cNBI" FROM hh)
{tail}"""


def dc_curve(spark: SparkSession, sf_dir: str, rate: float | None = 0.3) -> DataFrame:
    own = edges(spark, sf_dir)
    return durable(trajectory.curve(own, static_orders.degree_order(own), rate), "curve")


def method_curves(spark: SparkSession, sf_dir: str, rate: float | None = 0.3) -> DataFrame:
    """Curves of the degree, clustering and influence orders."""
    own = edges(spark, sf_dir)
    orders = static_orders.degree_order(own).unionByName(static_orders.cluc_order(own)).unionByName(static_orders.influence_order(own))
    return durable(trajectory.curve(own, durable(orders, "orders"), rate), "curves")


def _variant_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of a heuristic and its knock-outs."""
    own = edges(spark, sf_dir)
    names = ["S-case", *[f"S-case -{k}" for k in variants.SCase.knockouts], "S-case -phase", "S-case -all_but_degree"]
    return durable(trajectory.curve(own, durable(adaptive.adaptive_orders(own, projections.nodes_of(own), names), "orders")), "curves")


def _scores_sql(score: str, with_: str) -> str:
    return f"WITH {with_} SELECT 'part' AS graph, row_number() OVER (ORDER BY round(({score}), 9) DESC, id) AS step, id AS node"


def _order(df: DataFrame) -> DataFrame:
    return df.select("graph", F.col("step").cast("long").alias("step"), "node")


def _by_score(scores: DataFrame) -> DataFrame:
    """Scores are rounded before they are ranked, so that engines that sum in other orders agree on ties."""
    return _order(static_orders.score_order(scores.withColumn("score", F.round("score", 9)), "x"))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy edge lines made of all line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text = F.when(n == 1, F.concat_ws(" ", p, s)).when(n == 2, F.concat(F.lit("  "), p, F.lit(","), s)).when(n == 3, F.concat(p, F.lit(".0\t"), s)).when(n == 4, F.concat(F.lit("# "), p)).when(n == 5, F.concat(F.lit("x "), s)).otherwise(F.concat_ws(" ", s, s))
    return items.select(F.concat(F.lit("g"), (F.col("l_orderkey") % 2).cast("string")).alias("graph"), (F.col("l_orderkey") * 10 + n).alias("line_no"), text.alias("line"))


LINES = """li AS (
  SELECT 'g' || CAST(l_orderkey % 2 AS VARCHAR) AS graph,
         CASE WHEN l_linenumber IN (1, 2, 3) THEN 'pair' WHEN l_linenumber = 4 THEN 'skipped' WHEN l_linenumber = 5 THEN 'bad' ELSE 'same' END AS t,
         CASE WHEN l_linenumber IN (1, 2, 3) THEN l_partkey ELSE l_suppkey END AS u, l_suppkey AS v
  FROM lineitem),
pl AS (SELECT graph, u, v, CASE WHEN t IN ('skipped', 'bad') THEN t WHEN u = v THEN 'selfloop' ELSE 'edge' END AS kind FROM li)"""


def many_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, trade = projections.part_graph(spark, sf_dir), projections.trade_graph(spark, sf_dir)
    return part.unionByName(trade).unionByName(trade.withColumn("graph", F.lit("trade_again")))


TRADE = """te AS (
  SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity >= 45)"""


def broken_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders: exact, one with every tenth node missing and the first repeated, one with a stranger."""
    own = static_orders.degree_order(edges(spark, sf_dir))
    short = own.where("step % 10 <> 0").unionByName(own.where("step = 1").withColumn("step", F.lit(10**6))).withColumn("method", F.lit("short"))
    strange = own.unionByName(own.where("step = 1").withColumn("step", F.lit(10**6)).withColumn("node", F.lit(-5).cast("long"))).withColumn("method", F.lit("strange"))
    return own.unionByName(short).unionByName(strange)


def _gen_sbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.block_model(spark, "sbm", [60, 60, 60, 60], 0.1, 0.01, 23)


def _gen_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.grid_small_world(spark, "grid", 1200, 31)


def _u(seed: int, *xs: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({x} AS VARCHAR)' for x in xs)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _q_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.part_graph(spark, sf_dir)


QUERIES = {
    "edge_canonical": _q_edges,
    "edge_trade": lambda s, d: projections.trade_graph(s, d),
    "edge_copart_degree": lambda s, d: statistics.degrees(projections.copart_graph(s, d)),
    "edge_user": lambda s, d: projections.user_graph(s, d),
    "edge_line_counts": lambda s, d: edgelists.line_counts(edgelists.parse_lines(edge_lines(s, d))),
    "edge_hash": lambda s, d: edgelists.content_hash(many_graphs(s, d)),
    "edge_relabelled": lambda s, d: edgelists.relabelled(e := edges(s, d), projections.nodes_of(e)),
    "order_validate": lambda s, d: edgelists.validate_orders(durable(broken_orders(s, d), "broken"), projections.nodes_of(edges(s, d))),
    "order_complete": lambda s, d: static_orders.complete_order(durable(broken_orders(s, d), "broken"), projections.nodes_of(edges(s, d))).select("graph", "method", F.col("step").cast("long").alias("step"), "node"),
    "gen_block_model": _gen_sbm,
    "gen_grid_small_world": _gen_grid,
    "gen_power_law_degrees": lambda s, d: statistics.degrees(generators.named(s, "SynthPL500_g25_s11")),
    "graph_degree": lambda s, d: statistics.degrees(edges(s, d)),
    "graph_manifest": lambda s, d: rounded(statistics.manifest(edges(s, d))),
    "components": lambda s, d: statistics.components(edges(s, d)),
    "component_sizes": lambda s, d: statistics.components(edges(s, d)).groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size")),
    "triangles": lambda s, d: rounded(statistics.triangles(edges(s, d))),
    "shared_neighbours": lambda s, d: statistics.shared_neighbours(edges(s, d)),
    "core_numbers": lambda s, d: statistics.core_numbers(edges(s, d)),
    "communities": lambda s, d: statistics.label_propagation(edges(s, d)),
    "order_dc": lambda s, d: _order(static_orders.degree_order(edges(s, d))),
    "order_kcore": lambda s, d: _order(static_orders.core_order(edges(s, d))),
    "order_cluc": lambda s, d: _by_score(static_orders.clustering_scores(edges(s, d))),
    "order_ci2": lambda s, d: _by_score(static_orders.influence_scores(edges(s, d))),
    "order_ndc": lambda s, d: _by_score(static_orders.redundancy_scores(edges(s, d), "NDC")),
    "order_ncdc": lambda s, d: _by_score(static_orders.redundancy_scores(edges(s, d), "NCDC")),
    "order_ndjc": lambda s, d: _by_score(static_orders.redundancy_scores(edges(s, d), "NDJC")),
    "order_betweenness": lambda s, d: _by_score(static_orders.betweenness(edges(s, d))),
    "high_degree_seeds": lambda s, d: _order(static_orders.first_seeds(static_orders.degree_order(edges(s, d)), 12)),
    "curve_dc": lambda s, d: rounded(dc_curve(s, d)),
    "curve_at_steps": lambda s, d: rounded(trajectory.at(e := edges(s, d), static_orders.degree_order(e), [1, 5, 50])),
    "curve_summary": lambda s, d: rounded(trajectory.summary(dc_curve(s, d))),
    "classic_r": lambda s, d: rounded(trajectory.classic_r(dc_curve(s, d, None)), 6),
    "mini_evaluation": lambda s, d: rounded(trajectory.mini_evaluation(dc_curve(s, d, None)), 6),
    "residual_measures": lambda s, d: rounded(trajectory.residual_measures(dc_curve(s, d), 10)),
    "ct_nodes": lambda s, d: trajectory.threshold_nodes(dc_curve(s, d), 0.01),
    "ct_interpolated": lambda s, d: rounded(trajectory.threshold_ratio(dc_curve(s, d), [0.1, 0.05])),
    "ct_plain": lambda s, d: rounded(trajectory.threshold_ratio(dc_curve(s, d), [0.1, 0.05, 0.01], False)),
    "prefix_change": lambda s, d: rounded(trajectory.prefix_change(durable(static_orders.degree_order(e := edges(s, d)).unionByName(static_orders.influence_order(e)), "orders"), "DC")),
    "stride_sample": lambda s, d: rounded(trajectory.stride_sample(dc_curve(s, d), 20).select("graph", "method", "step", "GCC")),
    "same_gcc_pairs": lambda s, d: rounded(trajectory.same_gcc_pairs(method_curves(s, d), gap=0.5)),
}

for _m in ("HDA", "HDA-fast", "CoreHD", "CoreHD-fast", "Decycle", "MinSum", "BPD", "VE", "GND-cut", "GND", "Local", "Component", *variants.SCORERS):
    QUERIES[f"order_{_m.lower().replace('-', '_')}"] = lambda s, d, m=_m: _order(adaptive.adaptive_orders(e := edges(s, d), projections.nodes_of(e), [m]))

def _validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The flagship: eight programs on two graphs, their ranks and means (without times, which no rerun repeats)."""
    graphs = durable(projections.part_graph(spark, sf_dir).unionByName(projections.trade_graph(spark, sf_dir)), "graphs")
    names = ("HDA", "HDA-fast", "CoreHD", "CoreHD-fast", "MinSum", "BPD", "Q-case", "S-case")
    return validation.full_validation(graphs, projections.nodes_of(graphs), {n: adaptive.PROGRAMS[n] for n in names})


QUERIES["full_validation"] = lambda s, d: rounded(_validated(s, d)[0].drop("time_s"))
QUERIES["full_validation_means"] = lambda s, d: rounded(_validated(s, d)[1].drop("mean_time_s"))
QUERIES["variant_curves"] = lambda s, d: rounded(trajectory.summary(_variant_curves(s, d)))
QUERIES["feature_shares"] = lambda s, d: _variant_curves(s, d).groupBy("method").agg(F.max("step").alias("steps"), F.round(F.avg("cNBI"), 9).alias("mean_cNBI"))

#: Core numbers by falling to the neighbours' h-index, as long as any falls.
CORES = """co(id, core) USING KEY (id) AS (
  SELECT id, degree FROM deg
  UNION
  SELECT id, max(least(core, n)) AS h FROM (
    SELECT g.id, g.core AS own, nb.core, row_number() OVER (PARTITION BY g.id ORDER BY nb.core DESC) AS n
    FROM (SELECT DISTINCT sym.s FROM co f JOIN sym ON sym.d = f.id) asked JOIN recurring.co g ON g.id = asked.s JOIN sym ON sym.s = g.id JOIN recurring.co nb ON nb.id = sym.d)
  GROUP BY id, own HAVING max(least(core, n)) < own)"""
_TAU = lambda taus: f"(SELECT unnest([{', '.join(map(str, taus))}]) AS tau)"

SQL = {
    "edge_canonical": f"WITH {E} SELECT 'part' AS graph, src, dst FROM e",
    "edge_trade": f"WITH {TRADE} SELECT 'trade' AS graph, src, dst FROM te",
    "edge_copart_degree": """WITH c AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT 'copart' AS graph, id, count(*) AS degree FROM (SELECT src AS id FROM c UNION ALL SELECT dst FROM c) GROUP BY id""",
    "edge_user": """WITH p AS (SELECT user_id AS u, lead(user_id) OVER w AS v, ts AS s, lead(ts) OVER w AS t FROM events WHERE event_type = 'purchase' WINDOW w AS (ORDER BY ts, event_id))
SELECT DISTINCT 'user' AS graph, least(u, v) AS src, greatest(u, v) AS dst FROM p WHERE u <> v AND epoch_us(t) - epoch_us(s) <= 60000000""",
    "edge_line_counts": f"""WITH {LINES} SELECT graph, count(*) FILTER (WHERE kind <> 'skipped') AS raw, count(*) FILTER (WHERE kind = 'bad') AS bad, count(*) FILTER (WHERE kind = 'selfloop') AS selfloop,
 count(*) FILTER (WHERE kind = 'edge') AS usable, count(DISTINCT CASE WHEN kind = 'edge' THEN [least(u, v), greatest(u, v)] END) AS edges FROM pl GROUP BY graph""",
    "edge_hash": f"""WITH {E}, {TRADE}, a AS (SELECT 'part' AS graph, src, dst FROM e UNION ALL SELECT 'trade', src, dst FROM te UNION ALL SELECT 'trade_again', src, dst FROM te),
h AS (SELECT graph, sha256(string_agg(src || ' ' || dst, chr(10) ORDER BY src, dst) || chr(10)) AS sha256 FROM a GROUP BY graph)
SELECT graph, sha256, nullif(min(graph) OVER (PARTITION BY sha256), graph) AS duplicate_of FROM h""",
    "edge_relabelled": f"WITH {E}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM deg) SELECT 'part' AS graph, a.new AS src, b.new AS dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst",
    "order_validate": f"""WITH {E}, {DC}, m AS (SELECT count(*) AS n, count(*) // 10 AS gone FROM o), f AS (SELECT min(id) AS first_missing FROM o WHERE r % 10 = 0)
SELECT 'part' AS graph, method, CASE WHEN method = 'short' THEN gone ELSE 0 END AS missing, CASE WHEN method = 'strange' THEN 1 ELSE 0 END AS extra, CASE WHEN method = 'short' THEN 1 ELSE 0 END AS duplicates,
 CASE WHEN method = 'short' THEN first_missing END AS first_missing, CASE WHEN method = 'strange' THEN -5 END AS first_extra, method = 'DC' AS ok FROM m, f, (SELECT unnest(['DC', 'short', 'strange']) AS method)""",
    "order_complete": f"""WITH {E}, {DC} SELECT 'part' AS graph, method, row_number() OVER (PARTITION BY method ORDER BY CASE WHEN method = 'short' AND r % 10 = 0 THEN 1 ELSE 0 END, CASE WHEN method = 'short' AND r % 10 = 0 THEN id ELSE r END) AS step, id AS node
FROM o, (SELECT unnest(['DC', 'short', 'strange']) AS method)""",
    "gen_block_model": f"SELECT 'sbm' AS graph, u AS src, v AS dst FROM range(240) a(u), range(240) b(v) WHERE u < v AND {_u(23, '0', 'u', 'v')} < CASE WHEN u // 60 = v // 60 THEN 0.1 ELSE 0.01 END",
    "gen_grid_small_world": f"""WITH p AS (SELECT id AS u, id + 1 AS v FROM range(1200) t(id) WHERE id % 40 < 39 UNION ALL SELECT id, id + 40 FROM range(1160) t(id)
 UNION ALL SELECT CAST(floor({_u(31, '0', 'id')} * 1200) AS BIGINT), CAST(floor({_u(31, '1', 'id')} * 1200) AS BIGINT) FROM range(48) t(id))
SELECT DISTINCT 'grid' AS graph, least(u, v) AS src, greatest(u, v) AS dst FROM p WHERE u <> v""",
    "graph_degree": f"WITH {E} SELECT 'part' AS graph, id, degree FROM deg",
    "graph_manifest": f"""WITH RECURSIVE {E}, {COMPONENTS} SELECT 'part' AS graph, count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, round(avg(degree), 9) AS mean_degree, max(degree) AS max_degree,
 (SELECT count(DISTINCT c) FROM cc) AS components, (SELECT count(DISTINCT c) FROM cc) = 1 AS connected FROM deg""",
    "components": f"WITH RECURSIVE {E}, {COMPONENTS} SELECT 'part' AS graph, id, c AS component FROM cc",
    "component_sizes": f"WITH RECURSIVE {E}, {COMPONENTS} SELECT 'part' AS graph, c AS component, count(*) AS size FROM cc GROUP BY c",
    "triangles": f"WITH {E}, {TRIANGLES} SELECT 'part' AS graph, id, degree, triangles, round(clustering, 9) AS clustering FROM cl",
    "shared_neighbours": f"WITH {E}, {TRIANGLES}, {SHARED} SELECT 'part' AS graph, src, dst, common FROM sh",
    "core_numbers": f"WITH RECURSIVE {E}, {CORES} SELECT 'part' AS graph, id, core FROM co",
    "communities": f"WITH RECURSIVE {E}, {LABELS} SELECT 'part' AS graph, id, community FROM com",
    "order_dc": f"WITH {E}, {DC} SELECT 'part' AS graph, r AS step, id AS node FROM o",
    "high_degree_seeds": f"WITH {E}, {DC} SELECT 'part' AS graph, r AS step, id AS node FROM o WHERE r <= 12",
    "order_kcore": f"WITH RECURSIVE {E}, {CORES} SELECT 'part' AS graph, row_number() OVER (ORDER BY core DESC, degree DESC, co.id DESC) AS step, co.id AS node FROM co JOIN deg ON co.id = deg.id",
    "order_cluc": _scores_sql("pow(10.0, -clustering) * near", f"{E}, {TRIANGLES}, ns AS (SELECT s, sum(degree + 1) AS near FROM sym JOIN deg ON deg.id = d GROUP BY s)") + " FROM cl JOIN ns ON ns.s = id",
    "order_ci2": _scores_sql("(degree - 1) * coalesce(far, 0)", f"""{E}, two AS (SELECT DISTINCT a.s, b.d FROM sym a JOIN sym b ON a.d = b.s WHERE a.s <> b.d),
rim AS (SELECT two.s, sum(degree - 1) AS far FROM two JOIN deg ON deg.id = two.d WHERE NOT EXISTS (SELECT 1 FROM sym WHERE sym.s = two.s AND sym.d = two.d) GROUP BY two.s)""") + " FROM deg LEFT JOIN rim ON rim.s = id",
    "order_ndc": _scores_sql("score", f"{E}, {TRIANGLES}, {SHARED}, sc AS (SELECT u AS id, avg(CAST(degree - common AS DOUBLE)) AS score FROM shs JOIN deg ON deg.id = u GROUP BY u)") + " FROM sc",
    "order_ncdc": _scores_sql("score", f"""RECURSIVE {E}, {LABELS}, {TRIANGLES}, {SHARED}, sc AS (SELECT u AS id, avg((degree - common) * CASE WHEN a.community = b.community THEN 0.5 ELSE 1.0 END) AS score
 FROM shs JOIN deg ON deg.id = u JOIN com a ON a.id = u JOIN com b ON b.id = v GROUP BY u)""") + " FROM sc",
    "order_ndjc": _scores_sql("score", f"""RECURSIVE {E}, {LABELS}, {TRIANGLES}, {SHARED}, sc AS (SELECT u AS id, avg((d1.degree - common) * CASE WHEN a.community = b.community THEN 0.5 ELSE 1.0 END / (d1.degree + d2.degree - common)) AS score
 FROM shs JOIN deg d1 ON d1.id = u JOIN deg d2 ON d2.id = v JOIN com a ON a.id = u JOIN com b ON b.id = v GROUP BY u)""") + " FROM sc",
    "order_betweenness": _scores_sql("part / greatest(1, (n - 1) * (n - 2))", f"""RECURSIVE {E},
bf(src, id, lvl, paths) USING KEY (src, id) AS (
  SELECT id, id, 0, CAST(1 AS DOUBLE) FROM deg
  UNION
  SELECT f.src, sym.d, f.lvl + 1, sum(f.paths) FROM bf f JOIN sym ON sym.s = f.id WHERE NOT EXISTS (SELECT 1 FROM recurring.bf g WHERE g.src = f.src AND g.id = sym.d) GROUP BY f.src, sym.d, f.lvl),
fw AS MATERIALIZED (SELECT * FROM bf),
bk(t, src, id, paths, share) AS (
  SELECT lvl, src, id, paths, CAST(0 AS DOUBLE) FROM fw WHERE lvl = (SELECT max(lvl) FROM fw)
  UNION ALL
  SELECT p.lvl, p.src, p.id, p.paths, coalesce(sum(p.paths * w.each), 0) FROM (SELECT DISTINCT t FROM bk) c JOIN fw p ON p.lvl = c.t - 1
  LEFT JOIN (SELECT bk.src, sym.d, (1 + bk.share) / bk.paths AS each FROM bk JOIN sym ON sym.s = bk.id) w ON w.src = p.src AND w.d = p.id
  WHERE p.lvl >= 1 GROUP BY p.lvl, p.src, p.id, p.paths),
sc AS (SELECT deg.id, coalesce(sum(share), 0) AS part, (SELECT count(*) FROM deg) AS n FROM deg LEFT JOIN bk ON bk.id = deg.id AND bk.t >= 1 GROUP BY deg.id)""") + " FROM sc",
    "curve_dc": curve_sql("0.3", """SELECT graph, method, step, round(removal_ratio, 9) AS removal_ratio, round("ACC", 9) AS "ACC", round("GCC", 9) AS "GCC", round("NCC", 9) AS "NCC", round(top5_component_mass, 9) AS top5_component_mass,
 round(hhi_remaining, 9) AS hhi_remaining, round(effective_components, 9) AS effective_components, round(pairwise_disconnected, 9) AS pairwise_disconnected, round("cNBI", 9) AS "cNBI",
 round(avg("GCC") OVER (ORDER BY step), 9) AS "running_R", round(avg("cNBI") OVER (ORDER BY step), 9) AS "running_auc_cNBI" FROM cu"""),
    "curve_at_steps": curve_sql("1.0", """SELECT graph, method, step, round(removal_ratio, 9) AS removal_ratio, round("ACC", 9) AS "ACC", round("GCC", 9) AS "GCC", round("NCC", 9) AS "NCC", round(top5_component_mass, 9) AS top5_component_mass,
 round(hhi_remaining, 9) AS hhi_remaining, round(effective_components, 9) AS effective_components, round(pairwise_disconnected, 9) AS pairwise_disconnected, round("cNBI", 9) AS "cNBI" FROM cu WHERE step IN (1, 5, 50)"""),
    "curve_summary": curve_sql("0.3", """, g AS (SELECT *, removal_ratio - lag(removal_ratio) OVER w AS dx, lag("GCC") OVER w AS g0, lag("NCC") OVER w AS n0, lag("cNBI") OVER w AS b0 FROM cu WINDOW w AS (ORDER BY step))
SELECT graph, method, round(sum(dx * ("ACC" + g0) / 2) / (max(removal_ratio) - min(removal_ratio)), 9) AS "auc_ACC", round(sum(dx * ("NCC" + n0) / 2) / (max(removal_ratio) - min(removal_ratio)), 9) AS "auc_NCC",
 round(sum(dx * ("cNBI" + b0) / 2) / (max(removal_ratio) - min(removal_ratio)), 9) AS "auc_cNBI", round(avg("GCC"), 9) AS "R", round(arg_max("ACC", step), 9) AS "final_ACC", round(arg_max("NCC", step), 9) AS "final_NCC", round(arg_max("cNBI", step), 9) AS "final_cNBI",
 round(arg_min("GCC", {'a': abs(removal_ratio - 0.2), 'b': step}), 9) AS "early_GCC", round(arg_min("NCC", {'a': abs(removal_ratio - 0.2), 'b': step}), 9) AS "early_NCC", round(arg_min("cNBI", {'a': abs(removal_ratio - 0.2), 'b': step}), 9) AS "early_cNBI"
FROM g GROUP BY graph, method"""),
    "classic_r": curve_sql("1.0", """SELECT graph, method, round(100 * avg("GCC"), 6) AS "classic_R" FROM cu GROUP BY graph, method"""),
    "mini_evaluation": curve_sql("1.0", """SELECT graph, method, round(avg("GCC"), 6) AS mean_gcc, round(avg("NCC") / max(step), 6) AS ncc_ratio_mean FROM cu GROUP BY graph, method"""),
    "residual_measures": curve_sql("0.3", """SELECT graph, method, step, round("GCC", 9) AS "GCC", round(top5_component_mass, 9) AS top5_component_mass, round(effective_components, 9) AS effective_components, round("cNBI", 9) AS hidden_score FROM cu WHERE step = 10"""),
    "stride_sample": curve_sql("0.3", """SELECT graph, method, step, round("GCC", 9) AS "GCC" FROM (SELECT *, row_number() OVER (ORDER BY step) - 1 AS i, greatest(1, count(*) OVER () // 20) AS stride FROM cu) WHERE i % stride = 0"""),
    "ct_nodes": curve_sql("0.3", """SELECT graph, method, coalesce(min(step) FILTER (WHERE "GCC" <= 0.01), max(step)) AS ct_nodes, count(*) FILTER (WHERE "GCC" <= 0.01) > 0 AS reached FROM cu GROUP BY graph, method"""),
    "ct_interpolated": curve_sql("0.3", f""", p AS (SELECT *, coalesce(lag(removal_ratio) OVER (ORDER BY step), 0.0) AS x0, coalesce(lag("GCC") OVER (ORDER BY step), 1.0) AS y0 FROM cu),
v AS (SELECT p.*, tau, coalesce(x0 + greatest(0.0, least(1.0, (tau - y0) / nullif("GCC" - y0, 0))) * (removal_ratio - x0), removal_ratio) AS x FROM p, {_TAU([0.1, 0.05])})
SELECT graph, method, CAST(tau AS DOUBLE) AS tau, round(coalesce(arg_min(x, step) FILTER (WHERE "GCC" <= tau), max(removal_ratio)), 9) AS ct_ratio, count(*) FILTER (WHERE "GCC" <= tau) > 0 AS reached FROM v GROUP BY graph, method, tau"""),
    "prefix_change": f"""WITH {E}, {DC}, two AS (SELECT DISTINCT a.s, b.d FROM sym a JOIN sym b ON a.d = b.s WHERE a.s <> b.d),
rim AS (SELECT two.s, sum(degree - 1) AS far FROM two JOIN deg ON deg.id = two.d WHERE NOT EXISTS (SELECT 1 FROM sym WHERE sym.s = two.s AND sym.d = two.d) GROUP BY two.s),
ci AS (SELECT id, row_number() OVER (ORDER BY (degree - 1) * coalesce(far, 0) DESC, id) AS r FROM deg LEFT JOIN rim ON rim.s = id),
b AS (SELECT 'DC' AS method, * FROM o UNION ALL SELECT 'CI', * FROM ci), lim AS (SELECT greatest(1, round_even(count(*) * 0.2, 0)) AS k FROM deg)
SELECT 'part' AS graph, b.method, round(avg(CASE WHEN b.id <> o.id THEN 1.0 ELSE 0.0 END), 9) AS change_rate FROM b JOIN o ON o.r = b.r, lim WHERE b.r <= k GROUP BY b.method""",
    "ct_plain": curve_sql("0.3", f"""SELECT graph, method, CAST(tau AS DOUBLE) AS tau, round(coalesce(arg_min(removal_ratio, step) FILTER (WHERE "GCC" <= tau), max(removal_ratio)), 9) AS ct_ratio, count(*) FILTER (WHERE "GCC" <= tau) > 0 AS reached FROM cu, {_TAU([0.1, 0.05, 0.01])} GROUP BY graph, method, tau"""),
}


def _greedy_degree_sql(tie: str) -> str:
    """Removal by residual degree, one recursion a step, then the other nodes by id."""
    return f"""WITH RECURSIVE {E}, lim AS (SELECT CAST(greatest(1, least(count(*), round_even(count(*) * 0.3, 0))) AS BIGINT) AS steps FROM deg),
g(k, gone) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT k + 1, list_append(gone, coalesce((SELECT s FROM sym WHERE NOT list_contains(gone, s) AND NOT list_contains(gone, d) GROUP BY s ORDER BY count(*) DESC, CAST(s AS VARCHAR) {tie} LIMIT 1),
    (SELECT id FROM deg WHERE NOT list_contains(gone, id) ORDER BY CAST(id AS VARCHAR) {tie} LIMIT 1)))
  FROM g, lim WHERE k < steps),
p AS (SELECT unnest(gone) AS id, unnest(range(1, len(gone) + 1)) AS place FROM g, lim WHERE k = steps)
SELECT 'part' AS graph, row_number() OVER (ORDER BY coalesce(place, 1000000000), deg.id) AS step, deg.id AS node FROM deg LEFT JOIN p ON p.id = deg.id"""


SQL["order_hda"] = _greedy_degree_sql("DESC")
SQL["order_hda_fast"] = _greedy_degree_sql("ASC")


def _core_degree_sql(order: str, fallback: str) -> str:
    """Removal inside the 2-core, then the other nodes by id. An iteration peels one layer (kind 0) or, where none is left to
    peel, removes a node (kind 1); what was peeled once never comes back into the core."""
    inside = "(SELECT s, count(*) AS inside FROM sym WHERE s NOT IN (SELECT id FROM recurring.st) AND d NOT IN (SELECT id FROM recurring.st) GROUP BY s)"
    gone = "(SELECT id FROM recurring.st WHERE kind = 1)"
    residual = f"(SELECT s, count(*) AS residual FROM sym WHERE s NOT IN {gone} AND d NOT IN {gone} GROUP BY s)"
    low = f"(SELECT deg.id FROM deg LEFT JOIN {inside} c ON c.s = deg.id WHERE deg.id NOT IN (SELECT id FROM recurring.st) AND coalesce(inside, 0) < 2)"
    return f"""WITH RECURSIVE {E}, lim AS (SELECT CAST(greatest(1, least(count(*), round_even(count(*) * 0.3, 0))) AS BIGINT) AS steps FROM deg),
st(id, kind, t) USING KEY (id) AS (
  SELECT CAST(-1 AS BIGINT), 0, 0
  UNION
  SELECT x.id, x.kind, w.t + 1 FROM (SELECT max(t) AS t FROM st) w, (SELECT *, min(kind) OVER () AS least FROM (
    SELECT id, 0 AS kind FROM {low}
    UNION ALL
    SELECT coalesce((SELECT c.s FROM {inside} c JOIN {residual} q ON q.s = c.s ORDER BY {order} LIMIT 1), (SELECT deg.id FROM deg LEFT JOIN {residual} q ON q.s = deg.id WHERE deg.id NOT IN {gone} ORDER BY {fallback} LIMIT 1)), 1)) x
  WHERE kind = least AND (SELECT count(*) FROM recurring.st WHERE kind = 1) < (SELECT steps FROM lim))
SELECT 'part' AS graph, row_number() OVER (ORDER BY CASE WHEN kind = 1 THEN t ELSE 1000000000 END, deg.id) AS step, deg.id AS node FROM deg LEFT JOIN st ON st.id = deg.id"""


SQL["order_corehd"] = _core_degree_sql("inside DESC, c.s DESC", "coalesce(residual, 0) DESC, deg.id DESC")
SQL["order_corehd_fast"] = _core_degree_sql("residual DESC, CAST(c.s AS VARCHAR)", "coalesce(residual, 0) DESC, CAST(deg.id AS VARCHAR)")
SQL["same_gcc_pairs"] = curve_sql(
    "0.3",
    """, sa AS (SELECT method, step, removal_ratio, "GCC", "cNBI" FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY step) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY method) // 180) AS stride FROM cu) WHERE i % stride = 0),
mt AS (SELECT a.method AS method_a, a.step AS step_a, a.removal_ratio AS removal_ratio_a, a."GCC" AS "GCC_a", a."cNBI" AS "cNBI_a", b.method AS method_b, b.step AS step_b, b.removal_ratio AS removal_ratio_b, b."GCC" AS "GCC_b", b."cNBI" AS "cNBI_b", abs(a."GCC" - b."GCC") AS gcc_diff
 FROM sa a JOIN sa b ON a.method < b.method AND abs(a."GCC" - b."GCC") <= 0.003)
SELECT 'part' AS graph, method_a, step_a, round(removal_ratio_a, 9) AS removal_ratio_a, round("GCC_a", 9) AS "GCC_a", round("cNBI_a", 9) AS "cNBI_a", method_b, step_b, round(removal_ratio_b, 9) AS removal_ratio_b, round("GCC_b", 9) AS "GCC_b", round("cNBI_b", 9) AS "cNBI_b",
 round(gcc_diff, 9) AS gcc_diff, round(abs("cNBI_a" - "cNBI_b"), 9) AS hidden_gap
FROM (SELECT *, row_number() OVER (PARTITION BY method_a, method_b, step_a ORDER BY gcc_diff, step_b) AS nth FROM mt) WHERE nth = 1 AND abs("cNBI_a" - "cNBI_b") >= 0.5""",
    f"{TRIANGLES}, {DC}, {CLUC}, {CI}, om AS MATERIALIZED (SELECT 'DC' AS method, id, r FROM o UNION ALL SELECT 'CLUC', id, r FROM cluc UNION ALL SELECT 'CI', id, r FROM ci)",
)
