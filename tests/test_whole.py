"""Queries that must do the whole job, not a part of it."""

from collections import Counter, defaultdict

import pytest

from sunderflow.operators import diffusion, seeds, statistics
from sunderflow.plans import graph_queries, influence_queries


def test_edge_lines_of_all_line_items(spark, data):
    want, pairs = defaultdict(Counter), defaultdict(set)
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        g, n, p, s = f"g{r.l_orderkey % 2}", r.l_linenumber, r.l_partkey, r.l_suppkey
        kind = "skipped" if n == 4 else "bad" if n == 5 else "selfloop" if n > 5 or p == s else "edge"
        want[g][kind] += 1
        if kind == "edge":
            pairs[g].add((min(p, s), max(p, s)))
    got = {r.graph: (r.raw, r.bad, r.selfloop, r.usable, r.edges) for r in graph_queries.QUERIES["edge_line_counts"](spark, data).collect()}
    assert got == {g: (c.total() - c["skipped"], c["bad"], c["selfloop"], c["edge"], len(pairs[g])) for g, c in want.items()}


def test_imm_is_not_cut_to_500_sets(spark, data, monkeypatch):
    """Which numbers imm asks for; 20 sets stand in for each sample, as the cap alone is looked at."""
    asked = []

    def drawn(n, a, wanted, seed):
        asked.extend(r.sets for r in wanted.collect())
        return diffusion.reverse_sets(n, a, 20, seed)

    monkeypatch.setattr(seeds, "drawn_sets", drawn)
    influence_queries.QUERIES["imm"](spark, data)
    assert 500 < max(asked) <= 20_000


@pytest.mark.parametrize(("n", "local"), [(3000, statistics.LOCAL), (24, 0)])
def test_core_numbers_run_to_their_end(spark, n, local):
    """A path's ends fall inwards a node a round; nothing bounds the rounds."""
    path = spark.createDataFrame([("g", i, i + 1) for i in range(n - 1)], "graph string, src long, dst long")
    rows = statistics.core_numbers(path, local).collect()
    assert len(rows) == n and {r.core for r in rows} == {1}


def test_dominating_set_is_whole(spark, data):
    """Every node is chosen or next to a chosen one, and each choice is the greedy one."""
    near = defaultdict(set)
    for r in graph_queries.QUERIES["edge_canonical"](spark, data).collect():
        near[r.src].add(r.dst)
        near[r.dst].add(r.src)
    left, order = set(near), [r.node for r in influence_queries.QUERIES["dominating_set"](spark, data).orderBy("step").collect()]
    for u in order:
        assert u == max(near, key=lambda x: (len(left & {x, *near[x]}), len(near[x]), str(x)))
        left -= {u, *near[u]}
    assert not left
