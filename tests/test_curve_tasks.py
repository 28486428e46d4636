"""Tasks that replay curves take Arrow tables, without a copy in pandas, and blocks of steps agree with whole curves."""

import pytest

from sunderflow.operators import static_orders, trajectory


def _pairs(spark):
    made = [("g", i, (i * 7 + 3) % 120) for i in range(120)] + [("g", i, (i * i + 11) % 120) for i in range(60)]
    return spark.createDataFrame([x for x in made if x[1] < x[2]], "graph string, src long, dst long").distinct()


@pytest.mark.parametrize("rate", [0.3, None])
def test_blocks_and_whole_curves(spark, rate):
    edges = _pairs(spark)
    orders = static_orders.degree_order(edges).select("graph", "method", "step", "node")
    whole, blocks = (trajectory.curve(edges, orders, rate, local) for local in (10**6, 60))
    assert "Pandas" not in whole._jdf.queryExecution().toString() + blocks._jdf.queryExecution().toString()
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = rounded(whole)
    assert got == rounded(blocks) and len(got) > 20
