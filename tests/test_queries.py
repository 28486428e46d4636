"""Every query of the graph, influence and ranking layers against its SQL; those without SQL must run."""

import pytest

from sunderflow.operators import ranking
from sunderflow.plans import graph_queries, influence_queries, rank_queries

QUERIES = graph_queries.QUERIES | influence_queries.QUERIES | rank_queries.QUERIES
SQL = graph_queries.SQL | influence_queries.SQL | rank_queries.SQL
#: On the smallest tables the node that the lineage starts from is there, too.
ORDERS = [q for q in QUERIES if q not in SQL and q.startswith("order_")]


@pytest.mark.parametrize("name", [q for q in QUERIES if q in SQL])
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ORDERS)
def test_orders_are_exact(name, spark, data):
    steps = QUERIES[name](spark, data).collect()
    nodes = {r.id for r in QUERIES["graph_degree"](spark, data).collect()}
    assert sorted(r.step for r in steps) == list(range(1, len(nodes) + 1))
    assert {r.node for r in steps} == nodes


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SQL and q not in ORDERS])
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).columns
    QUERIES[name](spark, data).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tie_groups_of_equal_means_and_methods(spark):
    """Rows of one mean and method, of which sorts may put any first, are in one group."""
    made = [("d", f"m{i % 7}", i, float(i % 21 * 3), float(i % 7 % 4), True) for i in range(2000)]
    results = spark.createDataFrame(made, "dataset string, method string, k long, spread double, spread_ci95 double, valid boolean").repartition(5)
    got = {r.k: r.rank_tie_group for r in ranking.tie_groups(results).collect()}
    want, group, before = {}, 1, None
    for _, method, k, spread, ci, _ in sorted(made, key=lambda r: (-r[3], r[1])):
        group += before is not None and before[0] - spread > before[1] + ci
        want[k], before = f"d-G{group}", (spread, ci)
    assert got == want and group > 3
