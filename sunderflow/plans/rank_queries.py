"""Queries of the ranking layer over a candidate log that is made of the part table, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code_checks, scalars
from ..operators import ranking, report, selection
from ..sources import tables
from . import search
from .graph_queries import rounded

K = "p_partkey"
_LOG = f"""
  SELECT {K} AS k, substr(sha1(concat('p', CAST({K} AS STRING))), 1, 12) AS candidate_id, {K} % 7 <> 0 AS valid, p_retailprice AS auc_cNBI, CAST(p_size AS DOUBLE) / 50 + CAST({K} % 13 AS DOUBLE) / 100 AS R,
         CAST({K} * 37 % 1000 AS DOUBLE) / 250 AS time_s, p_brand AS family, concat('pool', CAST(p_size % 3 AS STRING)) AS pool,
         CASE WHEN {K} % 5 = 0 THEN NULL ELSE p_retailprice * 0.95 - {K} % 11 END AS parent_auc_cNBI, p_retailprice / 2 + {K} % 17 AS early_cNBI, CAST(50 + {K} % 29 AS DOUBLE) AS early_NCC,
         CAST({K} % 31 AS DOUBLE) / 31 AS early_GCC, concat('n', lpad(CAST({K} AS STRING), 7, '0')) AS node_id,
         CASE WHEN {K} > 0 THEN concat('n', lpad(CAST(CAST(floor({K} / 3) AS BIGINT) AS STRING), 7, '0')) END AS parent_node_id,
         {' + '.join(f'CASE WHEN {K} >= {3**i} THEN 1 ELSE 0 END' for i in range(12))} AS depth,
         substr('QSBR', CAST({K} % 4 + 1 AS INT), 1) AS tree_branch, CASE WHEN {K} % 10 = 0 THEN 'elite' ELSE 'search' END AS tree_role, concat('sig', CAST({K} % 6 AS STRING)) AS feature_signature,
         CAST({K} * 53 % 997 AS DOUBLE) / 997 AS spread_ic, CAST({K} * 31 % 499 AS DOUBLE) / 499 - 0.5 AS relative_spread_ic, CAST({K} * 17 % 101 AS DOUBLE) / 101 AS rr_coverage,
         CASE WHEN {K} % 9 = 0 THEN NULL ELSE CAST({K} * 7 % 23 AS DOUBLE) END AS patchy
  FROM part"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


L = "l AS (" + _LOG.replace("AS STRING", "AS VARCHAR") + "), v AS (SELECT * FROM l WHERE valid)"


def _avg(x: str, higher: bool, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}{x}"
    return f"(rank() OVER ({part} ORDER BY {x} {'DESC' if higher else 'ASC'}) + (count(*) OVER ({same}) - 1) / 2.0)"


def _r01(x: str, higher: bool, n: str = "count(*) OVER ()") -> str:
    return f"(1 - ({_avg(x, higher)} - 1) / greatest({n} - 1, 1))"


_TIME = """tq AS (SELECT quantile_cont(time_s, 0.6) AS q FROM v),
ts AS (SELECT v.*, q, CASE WHEN time_s <= q THEN 1.0 ELSE NULL END AS fast FROM v, tq),
tr AS (SELECT *, CASE WHEN fast = 1 THEN 1.0 WHEN count(*) FILTER (WHERE fast IS NULL) OVER () = 1 THEN 0.5
  ELSE 0.85 * (1 - (rank() OVER (PARTITION BY fast ORDER BY time_s) + (count(*) OVER (PARTITION BY fast, time_s) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY fast) - 1, 1)) END AS rank_time FROM ts)"""


def _score_sql(credit: str, root: str) -> str:
    gain = f"coalesce(auc_cNBI - parent_auc_cNBI, auc_cNBI - {root})" if credit == "parent" else f"auc_cNBI - {root}"
    return f"""WITH {L}, {_TIME}, b AS (SELECT min(auc_cNBI) AS root FROM l), d AS (SELECT tr.*, {gain} AS delta FROM tr, b),
s AS (SELECT candidate_id, 0.75 * (0.45 * {_r01('delta', True)} + 0.25 * {_r01('R', False)} + 0.20 * rank_time + 0.10 * {_r01('auc_cNBI', True)})
  + 0.25 * (0.45 * {_r01('early_cNBI', True)} + 0.35 * {_r01('early_NCC', True)} + 0.20 * {_r01('early_GCC', False)}) AS rank_score FROM d)
SELECT l.candidate_id, round(coalesce(rank_score, -1.0), 9) AS rank_score FROM l LEFT JOIN s ON s.candidate_id = l.candidate_id"""


_FRONT = """fr AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.auc_cNBI >= a.auc_cNBI AND b.R <= a.R AND b.time_s <= a.time_s AND (b.auc_cNBI > a.auc_cNBI OR b.R < a.R OR b.time_s < a.time_s)))"""

_SECTION = f"""se AS (SELECT candidate_id, 100 * (0.4 * {_r01('auc_cNBI', True)} + 0.3 * {_r01('R', False)} + 0.3 * {_r01('time_s', False)}) AS s FROM v)"""

_TARGETS = [("legacy_q", 1000.0, 0.5, 2.0), ("legacy_s", 900.0, None, 1.0), ("none", None, None, None)]


#: Budgets of steps whose branches branch_schedule lists.
BUDGETS = (1, 2, 3, 4, 5, 10, 37, 50, 200)


def _with_columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows with those of the columns that they lack, as nulls."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in names if c not in rows.columns})


def _results(s: SparkSession, d: str) -> DataFrame:
    """Benchmark results made of suppliers: datasets are nations."""
    s.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("supplier")
    return s.sql(_RESULTS)


_RESULTS = """SELECT concat('d', CAST(s_nationkey % 5 AS STRING)) AS dataset, concat('m', CAST(s_suppkey % 40 AS STRING)) AS method, s_suppkey AS k, s_suppkey % 8 <> 3 AS valid, round(s_acctbal) / 50 AS spread,
 CAST(s_suppkey % 4 AS DOUBLE) AS spread_ci95, CASE WHEN s_suppkey % 3 = 0 THEN 'LT' ELSE 'LT_RandomThreshold' END AS model_type, CASE WHEN s_suppkey % 5 = 0 THEN 1024 ELSE 4096 END AS simulations FROM supplier"""
RES = "r AS (" + _RESULTS.replace("AS STRING", "AS VARCHAR") + ")"


def _means(s: SparkSession, d: str) -> DataFrame:
    return report.method_means(log(s, d), "family", F.col("pool"))


def _gate(s: SparkSession, d: str) -> DataFrame:
    means = log(s, d).where("valid").groupBy("family").agg(F.avg("auc_cNBI").alias("mean_auc_cNBI"), F.avg("R").alias("mean_R"), F.avg("time_s").alias("mean_time_s"))
    targets = s.createDataFrame(_TARGETS, "target string, target_auc double, target_R double, target_time_s double")
    return selection.gate(means, targets).select("family", "target", "auc_ok", "r_ok", "time_ok", "passes")


def _two(df: DataFrame, *more: str) -> DataFrame:
    return df.select("label", "candidate_id", *more)


def _codes(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("part")
    return s.sql(_CODES)


_WORDS = ["degree", "heapq.heappush", "list(G.neighbors(u))", "G.neighbors(v)", "weak tie", "cap = 8", "nx.clustering", "connected_components(G)", "betweenness", "progress"]
_CODES = "SELECT p_partkey AS k, concat(" + ", ".join(f"CASE WHEN floor(p_partkey / {2**i}) % 2 = 1 THEN '{w} ' ELSE '' END" for i, w in enumerate(_WORDS)) + ") AS code FROM part"


def _flags(s: SparkSession, d: str) -> DataFrame:
    c = F.col("code")
    flags = scalars.code_flags(c)
    return _codes(s, d).select("k", scalars.short_id(c).alias("id"), *[v.alias(n) for n, v in flags.items()], scalars.signature(flags).alias("signature"), scalars.code_family(c, F.lit("other")).alias("family"), scalars.contract_violation(c).alias("violation"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    t = s.sql(_TEXTS)
    return t.select("k", *[scalars.bool_text(F.col("b"), c).alias(f"bool_{c}") for c in scalars.TRUE_WORDS], scalars.number_text(F.col("n")).alias("number"), scalars.run_token(F.col("w")).alias("token"), scalars.run_timestamp(F.col("ts")).alias("stamp"), F.get_json_object(scalars.json_object(F.col("j")), "$.a").alias("a"))


_TEXTS = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN ' Yes' WHEN 2 THEN 'y' WHEN 3 THEN 'OK' WHEN 4 THEN '1' WHEN 5 THEN 'no' END AS b,
 CASE o_orderkey % 6 WHEN 0 THEN '*12.5*' WHEN 1 THEN '3.4%' WHEN 2 THEN '-' WHEN 3 THEN '7s' WHEN 4 THEN 'timeout guard' ELSE 'x1' END AS n,
 concat(' ', o_orderpriority, ' a  b!! ', o_orderstatus) AS w, CASE o_orderkey % 4 WHEN 0 THEN '20260101-010203' WHEN 1 THEN '20260101010203' WHEN 2 THEN '20260101' ELSE 'soon' END AS ts,
 concat('Here: ```json {"a": "', o_orderstatus, '"} ``` done') AS j FROM orders"""
TX = "x AS (" + _TEXTS + ")"

def _answers(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("part")
    return s.sql(_ANSWERS)


_ANSWERS = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Error 503' WHEN 1 THEN 'the Model is FULL' WHEN 2 THEN '请换一个模型' WHEN 3 THEN 'import os.path' WHEN 4 THEN 'x = EVAL(y); open(z)' WHEN 5 THEN 'full of models' WHEN 6 THEN 'rate limit'
 WHEN 7 THEN p_name END AS t FROM part"""
_GROUPS = {"pool0": (0.6, 0.2, 0.2), "pool1": (0.2, 0.6, 0.2)}

QUERIES = {
    "custom_order": lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn("place", scalars.custom_order(F.col("l_returnflag"), ["R", "N"])).where("place IS NOT NULL"),
    "avg_rank": lambda s, d: log(s, d).select("candidate_id", ranking.average_rank(F.col("R"), ["pool"], True, F.col("valid")).alias("rank_R"), ranking.average_rank(F.col("auc_cNBI"), ["pool"], False, F.col("valid")).alias("rank_auc")),
    "rank01_variants": lambda s, d: rounded(ranking.with_ranks(log(s, d).where("valid"), {f"rank_{p}": ranking.Rank(F.col("patchy"), True, None, p) for p in "abcdef"}).select("candidate_id", *[f"rank_{p}" for p in "abcdef"])),
    "time_saturated_rank": lambda s, d: rounded(ranking.with_time_rank(log(s, d).where("valid"), "rank_time", F.col("time_s")).select("candidate_id", "rank_time")),
    "rank_score": lambda s, d: rounded(ranking.add_rank_scores(log(s, d)).select("candidate_id", "rank_score")),
    "rank_score_root_credit": lambda s, d: rounded(ranking.add_rank_scores(log(s, d), root=500.0, credit="root").select("candidate_id", "rank_score")),
    "spread_score": lambda s, d: rounded(ranking.spread_scores(log(s, d)).select("candidate_id", "rank_score")),
    "section_score": lambda s, d: rounded(ranking.section_scores(log(s, d)).select("candidate_id", "rank_score_53")),
    "adapter_score": lambda s, d: rounded(ranking.adapter_scores(log(s, d)).select("candidate_id", "adapter_score")),
    "group_score": lambda s, d: rounded(ranking.group_scores(log(s, d), "pool", _GROUPS, (0.3, 0.3, 0.4)).select("candidate_id", "group_score")),
    "tie_groups": lambda s, d: ranking.tie_groups(_results(s, d)).select("dataset", "k", "rank_spread", "rank_tie_group"),
    "best_so_far": lambda s, d: ranking.best_so_far(log(s, d), "auc_cNBI", "k", ["pool"]).select("candidate_id", "best_auc_cNBI"),
    "pareto": lambda s, d: selection.pareto(log(s, d)).select("candidate_id", "auc_cNBI", "R", "time_s"),
    "pareto_count": lambda s, d: selection.pareto_count(log(s, d), "pool"),
    "final_two": lambda s, d: _two(selection.final_two(selection.pareto(log(s, d)))),
    "target_guard": lambda s, d: _two(selection.final_two_guarded(selection.pareto(log(s, d))), "guard_status"),
    "influence_two": lambda s, d: _two(selection.influence_two(ranking.spread_scores(log(s, d)).withColumn("rank_score", F.round("rank_score", 9)))),
    "top_k_membership": lambda s, d: selection.top_k(log(s, d), {"auc": [F.desc("auc_cNBI")], "auc_R": [F.desc("auc_cNBI"), F.asc("R")], "time": [F.asc("time_s")]}, 10).select("criterion", F.col("selection_rank").cast("long").alias("selection_rank"), "candidate_id"),
    "membership_manifest": lambda s, d: selection.manifest_of(selection.top_k(log(s, d), {"auc": [F.desc("auc_cNBI")], "time": [F.asc("time_s")]}, 10), ["criterion", "selection_rank"]),
    "pool_summary": lambda s, d: rounded(selection.pool_summary(log(s, d), ["pool"], {"alpha": 1200.0, "era": 1500.0})),
    "reference_gate": _gate,
    "round_robin": lambda s, d: selection.round_robin(log(s, d).where("valid"), "auc_cNBI", 20).select("candidate_id"),
    "branch_seeds": lambda s, d: selection.branch_seeds(log(s, d).withColumn("delta_root_auc_cNBI", F.col("auc_cNBI") - 900).withColumn("rank_score", F.col("auc_cNBI")), 24),
    "expandable_parent": lambda s, d: rounded(selection.expandable_parent(log(s, d).withColumn("rank_score", F.col("auc_cNBI") / 2000)).select("node_id", "priority")),
    "expandable_parent_legacy": lambda s, d: rounded(selection.expandable_parent(log(s, d).withColumn("rank_score", F.col("auc_cNBI") / 2000), True, branch="S").select("node_id", "priority")),
    "tree_priorities": lambda s, d: rounded(selection.tree_priorities(log(s, d).withColumn("rank_score", F.col("auc_cNBI") / 2000))),
    "child_counts": lambda s, d: log(s, d).where("parent_node_id IS NOT NULL").groupBy("parent_node_id").agg(F.count(F.lit(1)).alias("children")),
    "lineage": lambda s, d: selection.lineage(log(s, d), "n0000187"),
    "tree_depths": lambda s, d: selection.depths(log(s, d)),
    "tree_layout": lambda s, d: selection.layout(log(s, d)),
    "branch_schedule": lambda s, d: selection.branch_schedule(s.createDataFrame([(b,) for b in BUDGETS], "budget int")),
    "parameter_study": lambda s, d: rounded(search.parameter_study(s, 100)),
    "code_flags": _flags,
    "text_values": _texts,
    "method_mean": lambda s, d: rounded(_means(s, d)),
    "dataset_summary": lambda s, d: rounded(report.dataset_summary(log(s, d), "pool")),
    "family_summary": lambda s, d: rounded(report.family_summary(ranking.add_rank_scores(log(s, d)).join(_codes(s, d).select("k", *[v.alias(n) for n, v in scalars.code_flags(F.col("code")).items()]), "k", "left"))),
    "failure_patterns": lambda s, d: rounded(report.failure_patterns(_flags(s, d))),
    "weighted_mean": lambda s, d: rounded(report.weighted_mean(log(s, d).where("valid"), "pool", ["auc_cNBI", "R"], "early_NCC")),
    "commonest_families": lambda s, d: report.commonest(log(s, d).where("valid"), "family", "k", 5),
    "absolute_share": lambda s, d: rounded(report.absolute_share(log(s, d).where("valid"), "relative_spread_ic", ["pool"]).select("candidate_id", "share")),
    "variant_ratio": lambda s, d: rounded(report.variant_ratio(log(s, d).where("valid"), "pool", "tree_branch", "Q", "auc_cNBI")),
    "pivot_means": lambda s, d: rounded(report.pivoted(log(s, d).where("valid"), "pool", "tree_branch", ["B", "Q", "R", "S"], "auc_cNBI")),
    "null_groups": lambda s, d: rounded(report.grouped_with_nulls(log(s, d), "patchy", "R")),
    "policy_statistics": lambda s, d: rounded(report.policy_statistics(ranking.add_rank_scores(log(s, d)).withColumn("rank_score", F.round("rank_score", 9)))),
    "table_checks": lambda s, d: report.table_checks(log(s, d).select("candidate_id", F.col("auc_cNBI").alias("value")), log(s, d).select("candidate_id", F.when(F.col("k") % 50 == 0, F.col("auc_cNBI") + 1).when(F.col("k") % 77 > 0, F.col("auc_cNBI")).alias("value")), ["candidate_id"], "value").where("NOT agrees"),
    "resume_rows": lambda s, d: tables.still_to_do(_results(s, d).select("dataset", "method").distinct(), _results(s, d).withColumn("error", F.when(F.col("k") % 2 == 0, "skipped_timeout_60").otherwise("")), ["dataset", "method"]),
    "keep_last": lambda s, d: tables.keep_last(_results(s, d), ["dataset", "method"], [F.col("k")]).select("dataset", "method", "k"),
    "replace_rows": lambda s, d: tables.replace_rows(_results(s, d).select("dataset", "method", "spread"), _results(s, d).where("k % 10 = 0").select("dataset", "method", F.lit(-1.0).alias("spread")), ["dataset", "method"]),
    "formal_rows": lambda s, d: tables.formal_results(_with_columns(_results(s, d), tables.FORMAL_COLUMNS)).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.max("spread").alias("best")),
    "answer_checks": lambda s, d: _answers(s, d).select("k", code_checks.forbidden_token(F.col("t")).alias("forbidden"), code_checks.capacity_issue(F.col("t")).alias("capacity")),
    "family_sets": lambda s, d: log(s, d).groupBy("pool").agg(F.collect_set("family").alias("f"), F.collect_set(F.when(F.col("valid"), F.col("family"))).alias("v")).select("pool", F.size(F.array_intersect("f", "v")).alias("both"), F.size(F.array_except("f", "v")).alias("only"), F.size(F.array_union("f", "v")).alias("any")),
    "compressed_axis": lambda s, d: rounded(log(s, d).where("time_s > 0").select("candidate_id", scalars.compressed_log(F.col("time_s"), -1.0, 0.25).alias("x"))),
}

_SEED_SCORES = f"""z AS (SELECT *, auc_cNBI - 900 AS delta FROM v),
sc AS (SELECT *, 0.45 * {_r01('delta', True)} + 0.25 * {_r01('auc_cNBI', True)} + 0.20 * {_r01('R', False)} + 0.10 * {_r01('time_s', False)} AS q,
 0.30 * {_r01('delta', True)} + 0.25 * {_r01('auc_cNBI', True)} + 0.25 * {_r01('R', False)} + 0.20 * {_r01('time_s', False)} AS b FROM z),
lim AS (SELECT quantile_cont(auc_cNBI, 0.55) AS a, quantile_cont(time_s, 0.75) AS t FROM z),
f AS (SELECT sc.*, 0.40 * {_r01('time_s', False)} + 0.25 * {_r01('delta', True)} + 0.20 * {_r01('R', False)} + 0.15 * {_r01('auc_cNBI', True)} AS s FROM sc, lim WHERE auc_cNBI >= a),
qp AS (SELECT candidate_id FROM sc ORDER BY q DESC, candidate_id LIMIT 8), sp AS (SELECT candidate_id FROM f ORDER BY s DESC, candidate_id LIMIT 6),
rr AS (SELECT *, row_number() OVER (PARTITION BY feature_signature ORDER BY b DESC, candidate_id) AS turn FROM sc), r1 AS (SELECT feature_signature, b AS b1, candidate_id AS c1 FROM rr WHERE turn = 1),
bp AS (SELECT rr.candidate_id FROM rr JOIN r1 USING (feature_signature) ORDER BY turn, b1 DESC, c1 LIMIT 6),
rp AS (SELECT candidate_id FROM sc, lim WHERE time_s >= t OR candidate_id IN (SELECT candidate_id FROM qp) ORDER BY q DESC, candidate_id LIMIT 4)"""


def _flag_sql() -> dict[str, str]:
    low = "lower(code)"
    has = lambda *w: "(" + " OR ".join(f"contains({low}, '{x}')" for x in w) + ")"
    calls = f"len(regexp_extract_all({low}, 'neighbors\\('))"
    return {
        "degree_backbone": has("degree"), "frontier": f"({has('frontier', 'boundary')} OR {calls} >= 1)", "weak_tie": has("weak", "<= 2", "< 3"), "two_hop": f"({has('two_hop', '2-hop')} OR {calls} >= 2)",
        "boundary": f"({has('boundary')} OR {calls} >= 2)", "redundancy": has("redund", "clustering", "has_edge"), "phase": has("progress", "phase"), "heap_update": has("heapq", "heappush"),
        "component_refresh": has("connected_components"), "global_rescan": has("betweenness", "pagerank", "all_pairs"), "unbounded_two_hop": f"({calls} >= 2 AND NOT {has('cap', 'limit', 'break')})", "neighbor_calls": calls,
    }


def _needle_sql(needles: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(t), '{n.lower()}') THEN '{n}'" for n in needles) + " END"


FLAGS = "fl AS (SELECT *, " + ", ".join(f"{v} AS {n}" for n, v in _flag_sql().items()) + f" FROM ({_CODES}))"

_STUDY_SQL = """WITH n AS (SELECT unnest(range(100)) AS number), r AS (SELECT number, number % 25 AS r FROM n), a AS (
 SELECT 'R/GCC-only' AS "group", 'degree-backbone' AS family, number, 0.005 * (r % 5) AS neighbours, 0.0 AS weak, 0.0 AS boundary, 0.0 AS redundancy, 0.05 * (r % 3) AS phase, 8 + 4 * (r % 5) AS cap, 0 AS two_hop_cap FROM r
 UNION ALL SELECT g, 'free-boundary-scan', number, 0.02 + 0.01 * (r % 5), 0.10 + 0.05 * (r % 4), 0.0015 + 0.0005 * (r % 6), CASE WHEN r % 3 = 0 THEN 0.0 ELSE 0.02 END, 0.15 * (r % 4), CASE WHEN r % 2 = 1 THEN 64 END, CASE WHEN r % 4 > 0 THEN 32 END FROM r, (SELECT unnest(['Absolute-cNBI', 'Relative-Free']) AS g)
 UNION ALL SELECT g, 'relative-local-mix', number, 0.015 + 0.006 * (r % 5), 0.08 + 0.04 * (r % 4), 0.0008 + 0.0004 * (r % 5), 0.03 + 0.01 * (r % 4), 0.10 * (r % 4), 16 + 8 * (r % 4), 12 + 8 * (r % 4) FROM r, (SELECT unnest(['Relative-Delta-cNBI', 'CostAware-Free']) AS g)
 UNION ALL SELECT 'Bounded-Guided', 'bounded-local-policy', number, 0.010 + 0.004 * (r % 5), 0.06 + 0.03 * (r % 4), 0.0005 + 0.0002 * (r % 5), 0.04 + 0.01 * (r % 5), 0.06 * (r % 4), 8 + 4 * (r % 4), 6 + 4 * (r % 4) FROM r)
SELECT "group", family, CAST(number AS INTEGER) AS number, CAST(round(neighbours, 9) AS DOUBLE) AS neighbours, CAST(round(weak, 9) AS DOUBLE) AS weak, CAST(round(boundary, 9) AS DOUBLE) AS boundary, CAST(round(redundancy, 9) AS DOUBLE) AS redundancy, CAST(round(phase, 9) AS DOUBLE) AS phase,
 CAST(cap AS INTEGER) AS cap, CAST(two_hop_cap AS INTEGER) AS two_hop_cap, ("group" = 'Relative-Free' AND number IN (7, 29, 53, 71, 89)) OR ("group" = 'CostAware-Free' AND number IN (31, 77)) AS invalid FROM a"""

SQL = {
    "custom_order": "SELECT l_returnflag, count(*) AS n, CAST(list_position(['R', 'N'], l_returnflag) AS BIGINT) AS place FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY l_returnflag",
    "avg_rank": f"WITH {L} SELECT l.candidate_id, rank_R, rank_auc FROM l LEFT JOIN (SELECT candidate_id, {_avg('R', False, 'pool')} AS rank_R, {_avg('auc_cNBI', True, 'pool')} AS rank_auc FROM v) x ON x.candidate_id = l.candidate_id",
    "rank01_variants": f"""WITH {L}, n AS (SELECT candidate_id, {_avg('patchy', True)} AS place, count(*) OVER () AS known, (SELECT count(*) FROM v) AS every FROM v WHERE patchy IS NOT NULL)
SELECT v.candidate_id, round(1 - (place - 1) / (every - 1), 9) AS rank_a, round(coalesce(1 - (place - 1) / (known - 1), 0.0), 9) AS rank_b, round(coalesce(1 - (place - 1) / (every - 1), 0.0), 9) AS rank_c,
 round(coalesce(1 - (place - 1) / (known - 1), 0.0), 9) AS rank_d, round(1 - (place - 1) / (every - 1), 9) AS rank_e, round(1 - (place - 1) / (every - 1), 9) AS rank_f FROM v LEFT JOIN n ON n.candidate_id = v.candidate_id""",
    "time_saturated_rank": f"WITH {L}, {_TIME} SELECT candidate_id, round(rank_time, 9) AS rank_time FROM tr",
    "rank_score": _score_sql("parent", "root"),
    "rank_score_root_credit": _score_sql("root", "500.0"),
    "spread_score": f"""WITH {L}, s AS (SELECT candidate_id, 0.7 * {_r01('spread_ic', True)} + 0.1 * {_r01('relative_spread_ic', True)} + 0.1 * {_r01('rr_coverage', True)} + 0.1 * {_r01('time_s', False)} AS s FROM v)
SELECT l.candidate_id, round(coalesce(s, -1.0), 9) AS rank_score FROM l LEFT JOIN s ON s.candidate_id = l.candidate_id""",
    "section_score": f"WITH {L}, {_SECTION} SELECT l.candidate_id, round(coalesce(s, 0.0), 9) AS rank_score_53 FROM l LEFT JOIN se ON se.candidate_id = l.candidate_id",
    "adapter_score": f"""WITH {L}, s AS (SELECT candidate_id, 0.42 * {_r01('R', False)} + 0.38 * {_r01('auc_cNBI', True)} + 0.20 * {_r01('time_s', False)} AS s FROM v)
SELECT l.candidate_id, round(coalesce(s, -1.0), 9) AS adapter_score FROM l LEFT JOIN s ON s.candidate_id = l.candidate_id""",
    "group_score": f"""WITH {L}, s AS (SELECT candidate_id, pool, {_r01('auc_cNBI', True)} AS a, {_r01('R', False)} AS b, {_r01('time_s', False)} AS c FROM v)
SELECT l.candidate_id, round(CASE l.pool WHEN 'pool0' THEN 0.6 * a + 0.2 * b + 0.2 * c WHEN 'pool1' THEN 0.2 * a + 0.6 * b + 0.2 * c ELSE 0.3 * a + 0.3 * b + 0.4 * c END, 9) AS group_score FROM l LEFT JOIN s ON s.candidate_id = l.candidate_id""",
    "tie_groups": f"""WITH {RES}, o AS (SELECT *, lag(spread) OVER w AS s0, lag(spread_ci95) OVER w AS c0, {_avg('spread', True, 'dataset')} AS rank_spread FROM r WHERE valid WINDOW w AS (PARTITION BY dataset ORDER BY spread DESC, method))
SELECT dataset, k, rank_spread, dataset || '-G' || CAST(1 + sum(CASE WHEN s0 - spread > coalesce(c0, 0) + spread_ci95 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY spread DESC, method ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS rank_tie_group FROM o""",
    "best_so_far": f"WITH {L} SELECT candidate_id, max(CASE WHEN valid THEN auc_cNBI END) OVER (PARTITION BY pool ORDER BY k ROWS UNBOUNDED PRECEDING) AS best_auc_cNBI FROM l",
    "pareto": f"WITH {L}, {_FRONT} SELECT candidate_id, auc_cNBI, R, time_s FROM fr",
    "pareto_count": f"""WITH {L} SELECT pool, count(*) AS pareto FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.pool = a.pool AND b.auc_cNBI >= a.auc_cNBI AND b.R <= a.R AND b.time_s <= a.time_s
 AND (b.auc_cNBI > a.auc_cNBI OR b.R < a.R OR b.time_s < a.time_s)) GROUP BY pool""",
    "final_two": f"""WITH {L}, {_FRONT}, q AS (SELECT * FROM fr ORDER BY auc_cNBI DESC, R, candidate_id LIMIT 1), s AS (SELECT fr.* FROM fr, q WHERE fr.auc_cNBI >= 0.9 * q.auc_cNBI AND fr.R <= q.R + 0.08 ORDER BY fr.time_s, fr.auc_cNBI DESC, fr.R, fr.candidate_id LIMIT 1)
SELECT 'Final-Q' AS label, candidate_id FROM q UNION ALL SELECT 'Final-S', candidate_id FROM s""",
    "target_guard": f"""WITH {L}, {_FRONT}, t AS (SELECT count(*) AS n, quantile_cont(auc_cNBI, 0.75) AS a75, quantile_cont(auc_cNBI, 0.5) AS a50, quantile_cont(time_s, 0.5) AS t50, quantile_cont(time_s, 0.75) AS t75 FROM fr),
p AS (SELECT fr.*, auc_cNBI >= a75 AND time_s <= t50 AS strict, auc_cNBI >= a50 AND time_s <= t75 AS relaxed, least(5, greatest(1, ceil(n * 0.4))) AS need FROM fr, t),
m AS (SELECT CASE WHEN count(*) FILTER (WHERE strict) >= max(need) THEN 1 WHEN count(*) FILTER (WHERE relaxed) >= max(need) THEN 2 ELSE 3 END AS mode FROM p),
u AS (SELECT p.* FROM p, m WHERE (mode = 1 AND strict) OR (mode = 2 AND relaxed) OR mode = 3), e AS (SELECT count(*) FILTER (WHERE tree_role = 'elite') > 0 AS any_elite FROM u),
q AS (SELECT u.* FROM u, e WHERE NOT any_elite OR tree_role = 'elite' ORDER BY R, time_s, auc_cNBI DESC, candidate_id LIMIT 1),
s AS (SELECT fr.* FROM fr, q WHERE fr.auc_cNBI >= 0.9 * q.auc_cNBI AND fr.R <= q.R + 0.08 ORDER BY fr.tree_role = 'elite' DESC, fr.time_s, fr.R, fr.auc_cNBI DESC, fr.candidate_id LIMIT 1),
st AS (SELECT CASE mode WHEN 1 THEN 'strict_auc_top25_time_median' WHEN 2 THEN 'relaxed_auc_median_time_q75' ELSE 'fallback_full_frontier_min_pool' END || CASE WHEN any_elite THEN '_elite_preferred' ELSE '' END AS guard_status FROM m, e)
SELECT 'Final-Q' AS label, candidate_id, guard_status FROM q, st UNION ALL SELECT 'Final-S', candidate_id, guard_status FROM s, st""",
    "influence_two": f"""WITH {L}, s AS (SELECT v.*, round(0.7 * {_r01('spread_ic', True)} + 0.1 * {_r01('relative_spread_ic', True)} + 0.1 * {_r01('rr_coverage', True)} + 0.1 * {_r01('time_s', False)}, 9) AS score, row_number() OVER (ORDER BY spread_ic) AS p, count(*) OVER () AS n FROM v),
f AS (SELECT spread_ic AS floor_ FROM s WHERE p = greatest(1, ceil(0.75 * n)))
SELECT * FROM (SELECT 'Final-Best' AS label, candidate_id FROM s ORDER BY score DESC, candidate_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'Final-Fast', candidate_id FROM s, f WHERE spread_ic >= floor_ ORDER BY time_s, spread_ic DESC, candidate_id LIMIT 1)""",
    "top_k_membership": f"""WITH {L}, o AS (SELECT 'auc' AS criterion, candidate_id, row_number() OVER (ORDER BY auc_cNBI DESC, candidate_id) AS selection_rank FROM v UNION ALL SELECT 'auc_R', candidate_id, row_number() OVER (ORDER BY auc_cNBI DESC, R, candidate_id) FROM v
 UNION ALL SELECT 'time', candidate_id, row_number() OVER (ORDER BY time_s, candidate_id) FROM v) SELECT criterion, selection_rank, candidate_id FROM o WHERE selection_rank <= 10""",
    "membership_manifest": f"""WITH {L}, o AS (SELECT 'auc' AS criterion, candidate_id, row_number() OVER (ORDER BY auc_cNBI DESC, candidate_id) AS r FROM v UNION ALL SELECT 'time', candidate_id, row_number() OVER (ORDER BY time_s, candidate_id) FROM v),
g AS (SELECT candidate_id, count(*) AS memberships, min({{'a': criterion, 'b': r}}) AS f FROM o WHERE r <= 10 GROUP BY candidate_id)
SELECT candidate_id, memberships, 'C' || lpad(CAST(row_number() OVER (ORDER BY f, candidate_id) AS VARCHAR), 3, '0') AS label FROM g""",
    "pool_summary": f"""WITH {L}, p AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY valid DESC, auc_cNBI DESC, candidate_id) AS p, CASE WHEN valid THEN auc_cNBI END AS a FROM l)
SELECT pool, round(avg(CAST(valid AS INT)), 9) AS valid_rate, count(*) FILTER (WHERE valid) AS valid_candidates, max(a) AS best_auc, round(avg(a) FILTER (WHERE p <= 10), 9) AS top10_auc, round(avg(time_s) FILTER (WHERE valid), 9) AS mean_time_s,
 count(*) FILTER (WHERE a > 1200) AS above_alpha, round(count(*) FILTER (WHERE a > 1200) / count(a), 9) AS hit_rate_alpha, count(*) FILTER (WHERE a > 1500) AS above_era, round(count(*) FILTER (WHERE a > 1500) / count(a), 9) AS hit_rate_era FROM p GROUP BY pool""",
    "reference_gate": f"""WITH {L}, m AS (SELECT family, avg(auc_cNBI) AS a, avg(R) AS r, avg(time_s) AS t FROM v GROUP BY family), g(target, ta, tr, tt) AS (VALUES ('legacy_q', 1000.0, 0.5, 2.0), ('legacy_s', 900.0, NULL, 1.0), ('none', NULL, NULL, NULL))
SELECT family, target, a >= ta AS auc_ok, r <= tr AS r_ok, t <= tt AS time_ok, (ta IS NOT NULL OR tr IS NOT NULL OR tt IS NOT NULL) AND coalesce(a >= ta, true) AND coalesce(r <= tr, true) AND coalesce(t <= tt, true) AS passes FROM m, g""",
    "round_robin": f"""WITH {L}, rr AS (SELECT *, row_number() OVER (PARTITION BY feature_signature ORDER BY auc_cNBI DESC, candidate_id) AS turn FROM v), r1 AS (SELECT feature_signature, auc_cNBI AS b1, candidate_id AS c1 FROM rr WHERE turn = 1)
SELECT rr.candidate_id FROM rr JOIN r1 USING (feature_signature) ORDER BY turn, b1 DESC, c1 LIMIT 20""",
    "branch_seeds": f"""WITH {L}, {_SEED_SCORES} SELECT candidate_id, 'Q' AS tree_branch FROM qp UNION ALL SELECT candidate_id, 'S' FROM sp UNION ALL SELECT candidate_id, 'B' FROM bp UNION ALL SELECT candidate_id, 'R' FROM rp""",
    "expandable_parent": f"""WITH {L}, c AS (SELECT parent_node_id AS node_id, count(*) AS n FROM l WHERE parent_node_id IS NOT NULL GROUP BY parent_node_id)
SELECT v.node_id, round(auc_cNBI / 2000 + 0.1 / (1 + coalesce(n, 0)), 9) AS priority FROM v LEFT JOIN c ON c.node_id = v.node_id ORDER BY auc_cNBI / 2000 + 0.1 / (1.0 + coalesce(n, 0)) DESC, auc_cNBI DESC, coalesce(n, 0), v.node_id DESC LIMIT 1""",
    "expandable_parent_legacy": f"""WITH {L}, b AS (SELECT * FROM l WHERE tree_branch = 'S'), c AS (SELECT parent_node_id AS node_id, count(*) AS n FROM b WHERE parent_node_id IS NOT NULL GROUP BY parent_node_id),
p AS (SELECT b.node_id, depth, coalesce(n, 0) AS n, auc_cNBI / 2000 + 0.1 / sqrt(1.0 + coalesce(n, 0)) - 0.005 * depth AS priority FROM b LEFT JOIN c ON c.node_id = b.node_id WHERE valid)
SELECT node_id, round(priority, 9) AS priority FROM p ORDER BY p.priority DESC, n, depth, node_id DESC LIMIT 1""",
    "tree_priorities": f"""WITH {L}, c AS (SELECT parent_node_id AS node_id, count(*) AS n FROM l WHERE parent_node_id IS NOT NULL GROUP BY parent_node_id), m AS (SELECT count(*) AS all_ FROM l)
SELECT v.node_id, coalesce(n, 0) AS visits, round(auc_cNBI / 2000 + 1.35 * sqrt(ln(greatest(all_, 2)) / (1 + coalesce(n, 0))), 9) AS uct, round(auc_cNBI / 2000 / (1 + 0.12 * depth) + 1.1 * sqrt(ln(greatest(all_, 2)) / (1 + coalesce(n, 0))), 9) AS mcts FROM v LEFT JOIN c ON c.node_id = v.node_id, m""",
    "child_counts": f"WITH {L} SELECT parent_node_id, count(*) AS children FROM l WHERE parent_node_id IS NOT NULL GROUP BY parent_node_id",
    "lineage": f"""WITH RECURSIVE {L}, w(hop, node_id, parent) AS (SELECT 0, node_id, parent_node_id FROM l WHERE node_id = 'n0000187' UNION ALL SELECT hop + 1, l.node_id, l.parent_node_id FROM w JOIN l ON l.node_id = w.parent) SELECT hop, node_id FROM w""",
    "tree_depths": f"WITH {L} SELECT node_id, depth FROM l",
    "tree_layout": f"WITH {L} SELECT node_id, row_number() OVER (PARTITION BY depth ORDER BY node_id) - (count(*) OVER (PARTITION BY depth) + 1) / 2.0 AS x, CAST(depth AS DOUBLE) AS y FROM l",
    "code_flags": f"""WITH {FLAGS} SELECT k, substr(sha1(code), 1, 12) AS id, {', '.join(_flag_sql())}, coalesce(nullif(concat_ws('|', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in scalars.SIGNATURE)}), ''), 'plain') AS signature,
 CASE WHEN component_refresh THEN 'component-refresh' WHEN contains(lower(code), 'two') OR neighbor_calls >= 2 THEN 'two-hop-boundary' WHEN contains(lower(code), 'clustering') OR contains(lower(code), 'redund') THEN 'redundancy-aware'
  WHEN contains(lower(code), 'heapq') THEN 'heap-local-update' WHEN contains(lower(code), 'degree') THEN 'degree-local' ELSE 'other' END AS family,
 CASE WHEN global_rescan THEN 'static contract violation: global centrality/rescan token' WHEN component_refresh THEN 'static contract violation: connected components refresh' WHEN unbounded_two_hop THEN 'static contract violation: unbounded two-hop scan'
  WHEN contains(lower(code), 'shortest_path') OR contains(lower(code), 'all_pairs') THEN 'static contract violation: path search' ELSE '' END AS violation FROM fl""",
    "text_values": f"""WITH {TX} SELECT k, coalesce(lower(trim(b)) IN ('1', 'true', 'yes', 'y'), false) AS bool_report, coalesce(lower(trim(b)) IN ('1', 'true', 'yes'), false) AS bool_benchmark, coalesce(lower(trim(b)) IN ('1', 'true'), false) AS bool_worlds,
 coalesce(lower(trim(b)) IN ('1', 'true', 'yes', 'y', 'ok'), false) AS bool_figures, try_cast(nullif(regexp_replace(regexp_replace(n, '\\*', '', 'g'), '[%sh]', '', 'g'), '-') AS DOUBLE) AS number,
 trim(regexp_replace(regexp_replace(trim(w), '[^0-9A-Za-z_-]+', '_', 'g'), '_+', '_', 'g'), '_') AS token,
 CASE WHEN regexp_full_match(ts, '\\d{{8}}-\\d{{6}}') THEN ts WHEN regexp_full_match(ts, '\\d{{14}}') THEN substr(ts, 1, 8) || '-' || substr(ts, 9, 6) WHEN regexp_full_match(ts, '\\d{{8}}') THEN ts || '-000000' END AS stamp, substr(j, 22, 1) AS a FROM x""",
    "method_mean": f"""WITH {L}, r AS (SELECT *, {_avg('auc_cNBI', True, 'pool')} AS rk FROM v)
SELECT family, count(DISTINCT pool) AS datasets, round(avg(R), 9) AS "mean_R", round(avg(auc_cNBI), 9) AS "mean_auc_cNBI", round(avg(time_s), 9) AS mean_time_s, count(*) FILTER (WHERE rk <= 1) AS top1_auc, count(*) FILTER (WHERE rk <= 3) AS top3_auc, round(avg(rk), 9) AS mean_rank_auc FROM r GROUP BY family""",
    "dataset_summary": f"""WITH {L} SELECT pool, count(*) AS rows, count(DISTINCT family) AS methods, round(min(auc_cNBI), 9) AS min_auc, round(median(auc_cNBI), 9) AS median_auc, round(max(auc_cNBI), 9) AS max_auc, round(stddev_samp(auc_cNBI), 9) AS std_auc, round(stddev_pop(time_s), 9) AS pstd_time FROM v GROUP BY pool""",
    "family_summary": f"""WITH {L}, {FLAGS}, b AS (SELECT min(auc_cNBI) AS root FROM l), {_TIME}, d AS (SELECT tr.*, coalesce(auc_cNBI - parent_auc_cNBI, auc_cNBI - root) AS delta FROM tr, b),
s AS (SELECT k, delta, 0.75 * (0.45 * {_r01('delta', True)} + 0.25 * {_r01('R', False)} + 0.20 * rank_time + 0.10 * {_r01('auc_cNBI', True)}) + 0.25 * (0.45 * {_r01('early_cNBI', True)} + 0.35 * {_r01('early_NCC', True)} + 0.20 * {_r01('early_GCC', False)}) AS score FROM d)
SELECT l.family, count(*) AS candidates, round(avg(CAST(l.valid AS INT)), 9) AS valid_rate, round(avg(delta), 9) AS mean_delta, round(max(delta), 9) AS top_delta, round(avg(CASE WHEN l.valid THEN l.time_s END), 9) AS mean_time_s, round(max(score), 9) AS top_rank_score,
 round(avg(CAST(coalesce(component_refresh OR global_rescan OR unbounded_two_hop, false) AS INT)), 9) AS slow_pattern_rate FROM l LEFT JOIN s ON s.k = l.k LEFT JOIN fl ON fl.k = l.k GROUP BY l.family""",
    "failure_patterns": f"""WITH {FLAGS} SELECT name, n AS count, round(n / total, 9) AS rate FROM (SELECT count(*) AS total, count(*) FILTER (WHERE component_refresh) AS a, count(*) FILTER (WHERE global_rescan) AS b, count(*) FILTER (WHERE unbounded_two_hop) AS c, count(*) FILTER (WHERE heap_update) AS d FROM fl) t,
 LATERAL (VALUES ('component_refresh', a), ('global_rescan', b), ('unbounded_two_hop', c), ('heap_update', d)) x(name, n)""",
    "weighted_mean": f"WITH {L} SELECT pool, round(sum(auc_cNBI * early_NCC) / sum(early_NCC), 9) AS \"auc_cNBI\", round(sum(R * early_NCC) / sum(early_NCC), 9) AS \"R\" FROM v GROUP BY pool",
    "commonest_families": f"WITH {L} SELECT family, count(*) AS n FROM v GROUP BY family ORDER BY n DESC, min(k) LIMIT 5",
    "absolute_share": f"WITH {L} SELECT candidate_id, round(relative_spread_ic / sum(abs(relative_spread_ic)) OVER (PARTITION BY pool), 9) AS share FROM v",
    "variant_ratio": f"WITH {L}, m AS (SELECT pool, tree_branch, avg(auc_cNBI) AS x FROM v GROUP BY pool, tree_branch) SELECT m.pool, m.tree_branch, round(m.x, 9) AS value, round(m.x / q.x, 9) AS ratio FROM m JOIN m q ON q.pool = m.pool AND q.tree_branch = 'Q'",
    "pivot_means": f"WITH {L} SELECT pool, " + ", ".join(f"round(avg(auc_cNBI) FILTER (WHERE tree_branch = '{b}'), 9) AS \"{b}\"" for b in "BQRS") + " FROM v GROUP BY pool",
    "null_groups": f"WITH {L} SELECT patchy, count(*) AS n, round(avg(R), 9) AS mean FROM l GROUP BY patchy",
    "policy_statistics": f"""WITH {L}, b AS (SELECT min(auc_cNBI) AS root FROM l), {_TIME}, d AS (SELECT tr.*, coalesce(auc_cNBI - parent_auc_cNBI, auc_cNBI - root) AS delta FROM tr, b),
s AS (SELECT *, round(0.75 * (0.45 * {_r01('delta', True)} + 0.25 * {_r01('R', False)} + 0.20 * rank_time + 0.10 * {_r01('auc_cNBI', True)}) + 0.25 * (0.45 * {_r01('early_cNBI', True)} + 0.35 * {_r01('early_NCC', True)} + 0.20 * {_r01('early_GCC', False)}), 9) AS score FROM d),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS place FROM s ORDER BY score DESC, candidate_id LIMIT 30)
SELECT family, count(*) AS n, round((SELECT greatest(0.05, 4 * median(time_s)) FROM t), 9) AS max_runtime_s FROM t GROUP BY family ORDER BY n DESC, min(place) LIMIT 5""",
    "table_checks": f"""WITH {L} SELECT candidate_id, auc_cNBI AS expected, CASE WHEN k % 50 = 0 THEN auc_cNBI + 1 WHEN k % 77 > 0 THEN auc_cNBI END AS found, false AS agrees FROM l WHERE k % 50 = 0 OR k % 77 = 0""",
    "resume_rows": f"WITH {RES} SELECT DISTINCT dataset, method FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.dataset = a.dataset AND b.method = a.method AND b.k % 2 = 1)",
    "keep_last": f"WITH {RES} SELECT dataset, method, max(k) AS k FROM r GROUP BY dataset, method",
    "replace_rows": f"WITH {RES}, n AS (SELECT dataset, method, -1.0 AS spread FROM r WHERE k % 10 = 0) SELECT dataset, method, spread FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.dataset = r.dataset AND n.method = r.method) UNION ALL SELECT dataset, method, CAST(spread AS DOUBLE) FROM n",
    "formal_rows": f"WITH {RES} SELECT dataset, count(*) AS rows, max(spread) AS best FROM r WHERE model_type = 'LT_RandomThreshold' AND simulations = 4096 GROUP BY dataset",
    "answer_checks": f"""WITH t AS ({_ANSWERS}) SELECT k, {_needle_sql(code_checks.FORBIDDEN)} AS forbidden, coalesce({_needle_sql(code_checks.CAPACITY)}, CASE WHEN (contains(t, '模型') AND contains(t, '满')) OR (contains(t, '请') AND contains(t, '换') AND contains(t, '模型')) THEN '模型/换模型相关中文提示' END,
 CASE WHEN regexp_matches(lower(t), 'model.*full|full.*model') THEN 'model/full/capacity related prompt' END, '') AS capacity FROM t""",
    "family_sets": f"WITH {L}, g AS (SELECT pool, family, bool_or(valid) AS v FROM l GROUP BY pool, family) SELECT pool, CAST(count(*) FILTER (WHERE v) AS INTEGER) AS both, CAST(count(*) FILTER (WHERE NOT v) AS INTEGER) AS only, CAST(count(*) AS INTEGER) AS any FROM g GROUP BY pool",
    "branch_schedule": f"""WITH b AS (SELECT unnest([{', '.join(map(str, BUDGETS))}]) AS budget), l AS (SELECT budget, {', '.join(f"greatest(1, round_even(budget * {x}, 0)) AS {b}" for b, x in selection.BRANCH_SHARES.items())} FROM b),
 m AS (SELECT *, Q + S + B + R - budget AS over FROM l), c AS (SELECT budget, Q - CASE WHEN over < 0 THEN over ELSE ceil(over / 2) END AS q, S - CASE WHEN over < 0 THEN 0 ELSE floor(over / 2) END AS s, B AS b, R AS r FROM m)
 SELECT budget, step, CASE WHEN budget < 4 THEN substr('QSB', CAST((step - 1) % 3 + 1 AS BIGINT), 1) WHEN step <= q THEN 'Q' WHEN step <= q + s THEN 'S' WHEN step <= q + s + b THEN 'B' WHEN step <= q + s + b + r THEN 'R' ELSE 'B' END AS branch
 FROM (SELECT *, CAST(unnest(range(1, budget + 1)) AS INTEGER) AS step FROM c)""",
    "parameter_study": _STUDY_SQL,
    "compressed_axis": f"WITH {L} SELECT candidate_id, round(CASE WHEN log10(greatest(time_s, 1e-12)) < -1 THEN -1 + (log10(greatest(time_s, 1e-12)) + 1) * 0.25 ELSE log10(greatest(time_s, 1e-12)) END, 9) AS x FROM l WHERE time_s > 0",
}
