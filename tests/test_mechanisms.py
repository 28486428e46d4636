"""Programs in killed processes, table functions, runs as streams, policy hooks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sunderflow.operators import adaptive
from sunderflow.plans import search, seed_search, table_functions, validation
from sunderflow.sources import projections
from sunderflow.streaming import candidates, runs

from .test_graphs import graph, random_pairs


def _native(g, steps):
    return pow(7, 10**9, 10**600000 + 1)  # one call that the interpreter can't interrupt


def test_native_loop_is_killed(spark):
    edges = graph(spark, random_pairs(20, 40, 1))
    programs = {"native": _native, "gone": lambda g, s: __import__("os")._exit(3), "deaf": lambda g, s: (_ for _ in ()).throw(KeyboardInterrupt()), "fine": adaptive.PROGRAMS["HDA"]}
    rows = {r.method: r for r in validation.run_programs(edges, projections.nodes_of(edges), programs, 0.3, 2.0).collect()}
    assert rows["native"].error.startswith("TimeoutError") and rows["native"].time_s == 2.0 and not rows["native"].order
    assert rows["gone"].error.startswith("ProcessError") and rows["deaf"].error.startswith("KeyboardInterrupt")
    assert rows["fine"].valid and len(rows["fine"].order) == 6


def test_what_a_program_changes_stays_its_own():
    kept = [1, 2]
    assert validation.limited(lambda: kept.append(3) or kept, 5.0)[0] == [1, 2, 3] and kept == [1, 2]
    assert validation.limited(lambda: lambda: 1, 5.0)[0] is None  # can't be sent


@pytest.fixture(scope="module")
def functions(spark):
    table_functions.register_functions(spark, 2.0, adaptive.PROGRAMS | {"native": _native, "none": lambda g, s: None}, seed_search.SEED_PROGRAMS)


def test_table_functions_equal_operators(spark, functions):
    edges = graph(spark, random_pairs(40, 80, 3)).unionByName(graph(spark, random_pairs(30, 35, 4), "h"))
    odd = spark.createDataFrame([("g", None, 3), ("g", 5, 5), (None, 1, 2), ("empty", None, None)], "graph string, src long, dst long")
    table = edges.unionByName(edges).unionByName(odd).withColumn("step", F.lit("clash"))
    got = spark.sql("SELECT * FROM removal_order(TABLE({t}), 'HDA', 0.3D)", t=table)
    want = {(r.graph, r.step, r.node) for r in adaptive.adaptive_orders(edges, projections.nodes_of(edges), ["HDA"]).collect()}
    assert {(r.graph, r.step, r.node) for r in got.collect()} == want | {(None, 1, 2), (None, 2, 1)}
    got = spark.sql("SELECT * FROM seed_order(TABLE({t}), 'Root', CAST(NULL AS DOUBLE))", t=edges).collect()
    want = seed_search.run_seed_programs(edges, projections.nodes_of(edges), {"Root": seed_search.SEED_PROGRAMS["Root"]}).collect()
    for r in want:
        assert [x.node for x in sorted(got, key=lambda x: x.step) if x.graph == r.graph] == r.seeds
    assert spark.sql("SELECT * FROM seed_order(TABLE({t}), 'Degree', 2)", t=edges).count() == 4


def test_table_functions_tell_errors(spark, functions):
    edges = graph(spark, random_pairs(10, 15, 3))
    for name, error in (("native", "TimeoutError"), ("none", "no node")):
        row = spark.sql(f"SELECT * FROM removal_order(TABLE({{t}}), '{name}', 0.3D)", t=edges).first()
        assert row.step is None and row.error.startswith(error)
    assert spark.sql("SELECT * FROM removal_order(TABLE({t}), 'HDA', 0.3D)", t=edges.limit(0)).count() == 0
    for call, error in (("TABLE({t}), 'unknown', 0.3D", "unknown"), ("TABLE(SELECT 1 AS x), 'HDA', 0.3D", "src, dst")):
        with pytest.raises(Exception, match=error):
            spark.sql(f"SELECT * FROM removal_order({call})", t=edges).collect()


def _drained(query):
    assert query.awaitTermination(120) and query.exception() is None


def _rows(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        yield {"candidate_id": f"c{rng.randrange(30)}", "family": rng.choice(["a", "b", None]), "valid": rng.choice([True, False, None]), "auc_cNBI": rng.choice([1.0, 2.0, 2.5, None]), "R": 0.1, "time_s": rng.random(), "logged_at": "2026-01-01T00:00:00"}


def test_best_so_far_goes_on_after_a_restart(spark, tmp_path):
    before = spark.conf.get(runs.STORE)
    spark.conf.set(runs.STORE, runs.ROCKS)
    try:
        folder, seen, last = tmp_path / "log", [], {}
        folder.mkdir()

        def keep(batch, number):
            last.update({r.family: r for r in batch.collect()})

        for i in range(2):  # each query is a start from the checkpoint
            new = list(_rows(i, 60))
            seen += new
            (folder / f"{i}.json").write_text("\n".join(map(json.dumps, new)))
            best = runs.best_so_far(candidates.candidate_stream(spark, str(folder)))
            _drained(best.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
            for family in ("a", "b", None):
                own = [r for r in seen if r["family"] == family]
                good = [r for r in own if r["valid"] and r["auc_cNBI"] is not None]
                top = max(r["auc_cNBI"] for r in good)
                assert tuple(last[family]) == (family, len(own), sum(r["valid"] is True for r in own), top, min(r["candidate_id"] for r in good if r["auc_cNBI"] == top))
    finally:
        spark.conf.set(runs.STORE, before)


def test_upserts_repeat(spark, tmp_path):
    folder, order, schema = tmp_path / "in", [F.col("at")], "dataset string, method string, at int, x int, error string"
    folder.mkdir()
    stream = lambda: spark.readStream.schema(schema).json(str(folder))
    row = lambda m, at, x, error=None: json.dumps({"dataset": "d", "method": m, "at": at, "x": x, "error": error})
    (folder / "1.json").write_text("\n".join([row("a", 1, 1), row("a", 2, 2), row("b", 1, 3, "skipped_timeout_60"), row("c", 9, 4)]))
    write = lambda checkpoint: _drained(runs.upsert(stream(), str(tmp_path / "out"), ["dataset", "method"], order, str(tmp_path / checkpoint)))
    read = lambda: sorted((r.method, r.x) for r in runs.current(spark, str(tmp_path / "out"), ["dataset", "method"], order).collect())
    write("c")
    assert read() == [("a", 2), ("b", 3), ("c", 4)]
    (folder / "2.json").write_text("\n".join([row("b", 0, 5), row("c", 1, 6), row("a", 3, 7, "skipped_timeout_9")]))
    write("c")
    want = [("a", 2), ("b", 5), ("c", 6)]
    assert read() == want
    (tmp_path / "c" / "commits" / "1").unlink()  # the batch was written, its commit was lost
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    write("c")
    assert read() == want
    write("c")
    assert read() == want


def test_policies_guide_and_fall_back(spark):
    edges = graph(spark, random_pairs(20, 30, 5))

    class Silent:
        heard = []

        def hear(self, text):
            self.heard.append(text)

        def propose(self, parent, index, branch):
            return None

    records = search.run_policy("AlphaEvolve", edges, projections.nodes_of(edges), adaptive.PROGRAMS["HDA"], Silent(), 2)
    assert [r["family"] for r in records] == ["root", "fast_archive", "harmony"] and all(r["valid"] for r in records) and len(Silent.heard) == 2
    assert set(search.FALLBACKS) == set(search.GUIDANCE) == set(search.POLICIES) and {f for fs in search.FALLBACKS.values() for f in fs} == set(search.FALLBACK_PROGRAMS)
    some = [{"family": "x", "valid": True, "rank_score": 0.5}, {"family": "y", "valid": True, "rank_score": 0.1}, {"family": "z", "valid": False, "rank_score": 0.9}]
    assert "x does better than y" in search.guidance("ReEvo", some) and "the root" in search.guidance("HiFo", [])
