"""Betweenness searches many sources at once and gives what one by one gives."""

import numpy as np
import pytest

from sunderflow.operators import adaptive, static_orders


@pytest.mark.parametrize("cells", [1, 500, 10**6])
@pytest.mark.parametrize("n,m", [(2, 1), (30, 20), (60, 70), (90, 300)])
def test_batches_of_sources(cells, n, m, monkeypatch):
    monkeypatch.setattr(static_orders, "BETWEEN_CELLS", cells)
    draw = np.random.default_rng(n)
    g = adaptive.Residual(list(range(n)), {(int(a), int(b)) for a, b in draw.integers(0, n, (m, 2)) if a < b})
    near, weight, total = static_orders._trees_off([sorted(x) for x in g.near])
    static_orders._between(near, weight, [u for u, x in enumerate(near) if x], total)
    want = {u: x for part in g.components(g.alive) for u, x in adaptive._betweenness(g, set(part)).items()}
    assert total == pytest.approx([want[u] for u in range(n)])
