"""Programs that choose seeds."""

import time

import pytest

from sunderflow.operators import diffusion, seeds
from sunderflow.plans import seed_search
from sunderflow.sources import projections

from .test_graphs import graph, random_pairs


@pytest.fixture(scope="module")
def worlds(spark):
    edges = graph(spark, random_pairs(60, 110, 12)).unionByName(graph(spark, random_pairs(30, 40, 13), "h")).cache()
    return seed_search.Worlds(edges, projections.nodes_of(edges).cache(), worlds=32, sets=64)


def test_root_is_the_discount_operator(worlds):
    found = {r.graph: r.seeds for r in seed_search.run_seed_programs(worlds.edges, worlds.nodes, {"root": seed_search.discounted_degree(0.1)}).collect()}
    want = {}
    for r in seeds.degree_discount(worlds.edges, 3, 0.1).orderBy("graph", "step").collect():
        want.setdefault(r.graph, []).append(r.node)
    assert {g: s[:3] for g, s in found.items()} == want


def test_answers_are_checked(worlds):
    def slow(g, k):
        time.sleep(5)

    programs = {"few": lambda g, k: [0, 0, -7, "x", 1], "none": lambda g, k: None, "wrong": lambda g, k: 7, "strange": lambda g, k: [10**9], "slow": slow} | seed_search.SEED_PROGRAMS
    rows = {(r.graph, r.method): r for r in seed_search.evaluate_seeds(worlds, programs, seconds=1.0).collect()}
    assert len(rows) == 2 * len(programs)
    for g in "gh":
        few = rows[g, "few"]
        assert few.valid and few.raw_seed_size == 5 and len(few.seed_nodes) == 3 and 0 < few.spread_ic <= 1
        assert not any(rows[g, m].valid for m in ("none", "wrong", "strange", "slow"))
        assert rows[g, "slow"].time_s == 1.0 and rows[g, "slow"].spread_ic is None and rows[g, "wrong"].error.startswith("TypeError")
        spread = diffusion.live_spread(few_seeds(worlds, few), worlds.parts, worlds.nodes, 32).first().spread
        assert spread == few.spread_ic


def few_seeds(worlds, row):
    return worlds.edges.sparkSession.createDataFrame([(row.graph, "few", i, u) for i, u in enumerate(row.seed_nodes, 1)], "graph string, method string, step int, node long")


def test_seed_search(worlds):
    def propose(parent, i):
        return ("apart", seed_search.spread_apart) if i % 2 else ("broken", lambda g, k: [])

    log, final = seed_search.run_seed_search(worlds, seed_search.largest_degree, propose, 3)
    rows = {r.node_id: r for r in log.collect()}
    assert len(rows) == 4 and rows["seeds-0000"].relative_spread_ic == 0.0
    assert rows["seeds-0002"].rank_score == -1.0 and not rows["seeds-0002"].valid
    assert {r.label for r in final.collect()} == {"Final-Best", "Final-Fast"}


def test_registered_seed_program(worlds):
    seed_search.register_seeds("last", lambda g, k: list(range(g.n))[-k:])
    try:
        assert seed_search.run_seed_programs(worlds.edges, worlds.nodes, {"last": seed_search.SEED_PROGRAMS["last"]}).where("valid").count() == 2
    finally:
        del seed_search.SEED_PROGRAMS["last"]
