import pytest
from pyspark.sql import functions as F

from sunderflow.functions import code_checks, scalars
from sunderflow.operators import ranking, selection
from sunderflow.plans import policy
from sunderflow.sources import edgelists, tables


def test_guarded_selection(spark):
    rows = [("low-r-trap", 320.0, 0.34, 2.0), ("balanced-target", 370.0, 0.368, 0.7), ("fast-support", 360.0, 0.38, 0.3), ("quality-slow", 380.0, 0.39, 1.8)]
    frontier = spark.createDataFrame(rows, "candidate_id string, auc_cNBI double, R double, time_s double").withColumn("valid", F.lit(True))
    got = {r.label: (r.candidate_id, r.guard_status) for r in selection.final_two_guarded(frontier).collect()}
    assert got == {"Final-Q": ("balanced-target", "relaxed_auc_median_time_q75"), "Final-S": ("fast-support", "relaxed_auc_median_time_q75")}


def test_spread_score(spark):
    rows = [("a", True, 0.4, 0.1, 0.2, 2.0), ("b", True, 0.5, 0.0, 0.1, 1.0)]
    log = spark.createDataFrame(rows, "candidate_id string, valid boolean, spread_ic double, relative_spread_ic double, rr_coverage double, time_s double")
    assert {r.candidate_id: round(r.rank_score, 12) for r in ranking.spread_scores(log).collect()}["b"] == 0.8
    assert {r.candidate_id: r.rank_score for r in ranking.spread_scores(log, spread_only=True).collect()}["b"] == 1.0


def test_gate(spark):
    means = spark.createDataFrame([("Q", 10.0, 0.2, 1.0), ("S", 8.0, 0.3, 0.5)], "method string, mean_auc_cNBI double, mean_R double, mean_time_s double")
    targets = spark.createDataFrame([("legacy_q", 9.0, 0.25, 1.2), ("legacy_s", 7.0, None, 0.6)], "target string, target_auc double, target_R double, target_time_s double")
    got = {(r.method, r.target): r.passes for r in selection.gate(means, targets).collect()}
    assert got[("Q", "legacy_q")] and got[("S", "legacy_s")] and not got[("S", "legacy_q")]


def test_formal_results(spark):
    row = dict.fromkeys(tables.FORMAL_COLUMNS, "x") | {"model_type": "LT_RandomThreshold", "simulations": "1024"}
    df = spark.createDataFrame([row])
    with pytest.raises(ValueError, match="4096"):
        tables.formal_results(df)
    assert tables.formal_results(df.withColumn("simulations", F.lit("4096"))).count() == 1
    with pytest.raises(ValueError, match="lack"):
        tables.formal_results(df.drop("k"))


def test_markdown_tables():
    text = "intro\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| broken |\n\nend"
    assert tables.markdown_tables(text) == [(["a", "b"], [["1", "2"]])]


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿a,b\n1,2\n".encode())
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), ["a", "zz"]).columns == ["a"]


def test_schedule():
    assert [selection.branch_of(i, 200) for i in (1, 60, 61, 120, 121, 170, 171, 200)] == ["Q", "Q", "S", "S", "B", "B", "R", "R"]
    for budget in (4, 7, 50, 333):
        assert {selection.branch_of(i, budget) for i in range(1, budget + 1)} == set("QSBR")


def test_budgets(spark):
    rows = spark.createDataFrame([(20,), (500,), (10,)], "n long").select(scalars.seed_budget(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows] == [3, 12, 3]


def test_lineage_stops_at_a_cycle(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node_id string, parent_node_id string")
    assert [r.node_id for r in selection.lineage(tree, "a").orderBy("hop").collect()] == ["a", "b", "c"]


def test_fenced_code(spark):
    texts = ["say ```python\ndef other(): pass\n``` and ```\ndef degree_order(G):\n  return []\n``` end", "x def degree_order(G): y", " none "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.fenced_code(F.col("t"), "degree_order").alias("c")).collect()
    assert [r.c for r in rows] == ["def degree_order(G):\n  return []", "def degree_order(G): y", "none"]


def test_in_order(spark):
    row = spark.sql("SELECT 'a then b' AS t").select(scalars.in_order(F.col("t"), "a", "b").alias("x"), scalars.in_order(F.col("t"), "b", "a").alias("y")).first()
    assert row.x and not row.y


def test_checked_code():
    assert code_checks.checked_code("  def f(G):\n      import math\n      return []\n", "f").startswith("def f")
    for bad in ("def g(): pass", "def f(): eval('1')", "import csv\ndef f(): pass", "def f():\n    from collections.abc import X, Y\n    import networkx.algorithms, html"):
        with pytest.raises(ValueError, match="missing|forbidden|not allowed"):
            code_checks.checked_code(bad, "f")


def test_policy(spark):
    rows = [(f"c{i}", True, ["a", "b", "a"][i % 3], i / 10, 0.2) for i in range(9)]
    log = spark.createDataFrame(rows, "candidate_id string, valid boolean, family string, rank_score double, time_s double")
    got = policy.induce(log, [{"allowed_signals": ["core-number", "global rescan", {"signal": "degree"}], "preferred_families": ["new one", "b", "required"], "cap_bounds": {"my cap!": [1, {}, 2], "no": None}, "update_bounds": {"mode": "x", "other": 1}}])
    assert got.preferred_families == ["a", "b", "new-one"]
    assert "core_number" in got.allowed_signals and "phase" in got.allowed_signals
    assert got.cap_bounds["my_cap_"] == [1, 2] and round(got.cap_bounds["max_candidate_runtime_s_on_proxy"], 9) == 0.8
    assert got.update_bounds["mode"] == "x" and "other" not in got.update_bounds
    assert policy.induce(log.where("NOT valid")).preferred_families == ["degree-local"]


def test_sinks(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith("\ufeffa,b".encode())
    assert tables.read_csv(spark, str(tmp_path / "c")).columns == ["a", "b"]
    tables.write_manifest(spark, {"b": 1, "a": "é"}, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == '{"a": "é", "b": 1}'


def test_graph_folder(spark, tmp_path):
    (tmp_path / "a.edgelist").write_text("7 9\n9 4\n")
    (tmp_path / "b.edgelist").write_text("1 2\n")
    assert sorted(tuple(r) for r in edgelists.load_graphs(spark, str(tmp_path), 2).collect()) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1)]
    with pytest.raises(ValueError, match="12"):
        edgelists.load_graphs(spark, str(tmp_path))


def test_schedule_as_columns(spark):
    got = {(r.budget, r.step): r.branch for r in selection.branch_schedule(spark.createDataFrame([(b,) for b in range(1, 61)], "budget int")).collect()}
    assert got == {(b, i): selection.branch_of(i, b) for b in range(1, 61) for i in range(1, b + 1)}
    for b in range(4, 61):
        assert abs(sum(got[b, i] == "Q" for i in range(1, b + 1)) - 0.3 * b) <= 2


def test_policy_hears_forbidden_patterns(spark):
    log = spark.createDataFrame([("c", True, "a", 1.0, 0.1)], "candidate_id string, valid boolean, family string, rank_score double, time_s double")
    plain = policy.induce(log).forbidden_patterns
    assert plain == sorted(policy.PATTERNS)
    said = ["recount Components", {"pattern": "Random walks"}, "nothing", ["shortest paths", 7]]
    assert set(policy.known([{"forbidden_patterns": said}], "forbidden_patterns", policy.patterns_of)) == {"connected_components_each_step", "nondeterministic_random_ordering", "all_pairs_shortest_path"}
    assert policy.induce(log, [{"forbidden_patterns": said}]).forbidden_patterns == plain
    assert policy.induce(log, [{"allowed_signals": ["core number"]}] * 11).allowed_signals.count("core_number") == 1
    assert "core_number" not in policy.induce(log, [{}] * 10 + [{"allowed_signals": ["core number"]}]).allowed_signals


@pytest.mark.parametrize("by", [None, "pool"])
def test_skylines_merge(spark, by):
    import random

    rng = random.Random(4)
    rows = [(f"c{i}", rng.random() > 0.1, rng.choice("xy"), rng.choice([rng.random(), float("nan"), 0.5]), rng.random(), round(rng.random(), 1)) for i in range(300)]
    log = spark.createDataFrame(rows, "candidate_id string, valid boolean, pool string, auc_cNBI double, R double, time_s double").repartition(30)
    good = [r for r in rows if r[1] and r[3] == r[3]]
    beats = lambda b, a: b[3] >= a[3] and b[4] <= a[4] and b[5] <= a[5] and (b[3] > a[3] or b[4] < a[4] or b[5] < a[5]) and (by is None or a[2] == b[2])
    want = {a[0] for a in good if not any(beats(b, a) for b in good)}
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = [r.candidate_id for r in selection.pareto(log, by=by).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == sorted(want)
