"""Components that are kept up as nodes go give what a look at all of them gives, without that look."""

import numpy as np
import pytest

from sunderflow.operators import adaptive


def _drawn(n: int, m: int, seed: int) -> adaptive.Residual:
    draw = np.random.default_rng(seed)
    ids = (draw.permutation(n) * 3 + 5).tolist()
    return adaptive.Residual(ids, {(ids[a], ids[b]) for a, b in draw.integers(0, n, (m, 2)) if a < b})


def _plain(g: adaptive.Residual, method: str) -> list[int]:
    order = []
    while g.alive:
        part = max(g.components(g.alive), key=lambda p: (len(p), min(g.ids[u] for u in p)))
        pool = method == "Decycle" and g.two_core(set(part)) or {u: g.degree(u) for u in part}
        order.append(max(pool, key=lambda u: (pool[u], g.ids[u])))
        g.remove(order[-1])
    return order


@pytest.mark.parametrize("method", ["Component", "Decycle"])
@pytest.mark.parametrize("n,m", [(40, 25), (60, 80), (80, 300), (200, 220), (300, 700)])
@pytest.mark.parametrize("seed", range(4))
def test_same_order(method, n, m, seed):
    want = _plain(_drawn(n, m, seed), method)
    assert adaptive.PROGRAMS[method](_drawn(n, m, seed), n) == want


@pytest.mark.parametrize("method", ["Component", "Decycle"])
def test_a_removal_does_not_look_at_the_whole_component(method, monkeypatch):
    g, looked = _drawn(5000, 7000, 1), []
    for name in ("components", "two_core"):
        monkeypatch.setattr(g, name, lambda of, was=getattr(g, name): looked.append(len(of)) or was(of))
    assert len(adaptive.PROGRAMS[method](g, 1500)) == 1500
    assert sum(looked) <= 2 * g.n


def _plain_cutting(g: adaptive.Residual) -> list[int]:
    order = []
    while g.alive:
        part = set(max(g.components(g.alive), key=lambda p: (len(p), min(g.ids[u] for u in p))))
        if cut := adaptive._cuts(g, part):
            order.append(min(cut, key=lambda u: (cut[u], g.ids[u])))
        else:
            score = adaptive._betweenness(g, part)
            order.append(min(score, key=lambda u: (-round(score[u], 9), g.ids[u])))
        g.remove(order[-1])
    return order


@pytest.mark.parametrize("n,m", [(40, 25), (60, 60), (80, 95), (150, 180), (120, 300)])
@pytest.mark.parametrize("seed", range(5))
def test_same_cuts(n, m, seed):
    assert adaptive.PROGRAMS["GND-cut"](_drawn(n, m, seed), n) == _plain_cutting(_drawn(n, m, seed))


def test_cuts_are_looked_for_in_the_core(monkeypatch):
    """A ring with trees: trees that hang on it aren't walked again for each removal."""
    looked, was = [], adaptive._cuts
    monkeypatch.setattr(adaptive, "_cuts", lambda g, part: looked.append(len(part)) or was(g, part))
    g = adaptive.Residual(list(range(2000)), [(i, (i + 1) % 100) for i in range(100)] + [(i, (i + 37) % 100) for i in range(100)] + [(i, i - 100) for i in range(100, 2000)])
    assert len(adaptive.PROGRAMS["GND-cut"](g, 60)) == 60
    assert sum(looked) < 4000
