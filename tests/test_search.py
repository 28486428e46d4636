import json
import random
import time

import pytest

from sunderflow.operators import adaptive, variants
from sunderflow.plans import search, validation
from sunderflow.sources import projections
from sunderflow.streaming import candidates

from .test_graphs import graph, random_pairs


@pytest.fixture(scope="module")
def small(spark):
    edges = graph(spark, random_pairs(40, 70, 9)).cache()
    return edges, projections.nodes_of(edges).cache()


def test_programs_that_fail_are_rows(small):
    def slow(g, steps):
        time.sleep(5)

    def broken(g, steps):
        raise KeyError("x")

    rows = {r.method: r for r in validation.evaluate(*small, {"slow": slow, "broken": broken, "HDA": adaptive.PROGRAMS["HDA"]}, seconds=0.5).collect()}
    assert rows["HDA"].valid and rows["HDA"].R > 0
    assert not rows["slow"].valid and rows["slow"].time_s == 0.5 and rows["slow"].R is None
    assert rows["broken"].error.startswith("KeyError")


def test_search_stages(small):
    log1, log3, final = search.run_search(*small, adaptive.PROGRAMS["HDA"], search.GridProposals(), 4, 4)
    assert log1.count() == 5 and log3.count() == 8
    assert {r.label for r in final.collect()} == {"Final-Q", "Final-S"}
    assert {r.node_id for r in log1.where("parent_node_id IS NULL").collect()} == {"root-0000"}


@pytest.mark.parametrize("name", search.POLICIES)
def test_policies_pick_valid_records(name):
    rng, state = random.Random(1), {}
    records = [{"node_id": str(i), "parent_id": str(i // 2) if i else None, "valid": i % 3 != 1, "rank_score": (i * 37 % 20) / 20, "island": i % 4, "niche": str(i % 3), "clade": str(i % 2)} for i in range(20)]
    assert all(search.POLICIES[name](records, rng, state)["valid"] for _ in range(10))


def test_policy_run(small):
    assert len(search.run_policy("MCTS", *small, adaptive.PROGRAMS["HDA"], search.GridProposals(), 2)) == 3


@pytest.mark.parametrize("name", variants.SCORERS)
def test_knockouts_change_scores(name):
    g = adaptive.Residual(list(range(60)), random_pairs(60, 160, 9))
    kind = variants.SCORERS[name]
    full = {u: kind(frozenset()).key(g, u) for u in g.alive if g.degree(u)}
    for term in kind.knockouts:
        cut = kind(frozenset({term}))
        assert any(cut.key(g, u)[0] != k[0] for u, k in full.items()), term
    with pytest.raises(ValueError, match="knock-out"):
        variants.heuristic(name, ("nonsense",))


@pytest.mark.parametrize("name", variants.SCORERS)
def test_without_all_terms_it_is_the_degree(small, name):
    edges, nodes = small
    orders = adaptive.adaptive_orders(edges, nodes, [f"{name} -all_but_degree", "HDA-fast"], 1.0).collect()
    by = {}
    for r in sorted(orders, key=lambda r: r.step):
        by.setdefault(r.method, []).append(r.node)
    assert by[f"{name} -all_but_degree"] == by["HDA-fast"]


def test_candidate_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    row = {"candidate_id": "a", "family": "f", "valid": True, "auc_cNBI": 2.0, "R": 0.1, "time_s": 1.0, "logged_at": "2026-01-01T00:00:00"}
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"candidate_id": "b", "valid": False, "auc_cNBI": 9.0})))
    stream = candidates.new_candidates(candidates.candidate_stream(spark, str(folder)))
    query = stream.writeStream.format("memory").queryName("fresh_candidates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(60)
    assert sorted(r.candidate_id for r in spark.table("fresh_candidates").collect()) == ["a", "b"]
    query = candidates.progress(candidates.candidate_stream(spark, str(folder))).writeStream.format("memory").outputMode("complete").queryName("search_progress").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(60)
    one = spark.table("search_progress").first()
    assert one.candidates == 3 and one.best_auc == 2.0
