"""Spectral scores are the Fiedler vector's, whatever a component's size."""

import numpy as np
import pytest

from sunderflow.operators import adaptive, spectral


def _halves(n: int) -> adaptive.Residual:
    """Two rings of n nodes with chords and tails, joined by one edge, between nodes 0 and n."""
    pairs, ring = {(0, n)}, n - n // 10
    for at in (0, n):
        pairs |= {(at + i, at + (i + step) % ring) for i in range(ring) for step in (1, 7, 19)} | {(at + i - ring, at + i) for i in range(ring, n)}
    return adaptive.Residual(list(range(2 * n)), pairs)


@pytest.mark.parametrize("n", [60, 300, 1600])
def test_the_bridge_scores_best(n):
    g = _halves(n)
    score = adaptive.spectral_scores(g, set(g.alive))
    assert score == {u: 1000.0 * (u in (0, n)) + g.degree(u) for u in g.alive}


@pytest.mark.parametrize("seed", range(5))
def test_approached_is_the_vector(seed, monkeypatch):
    draw = np.random.default_rng(seed)
    g = adaptive.Residual(list(range(700)), {(int(a), int(b)) for a, b in draw.integers(0, 700, (750, 2)) if a < b})
    part = set(max(g.components(g.alive), key=len))
    got = []
    for dense in (10, 10_000):
        monkeypatch.setattr(spectral, "DENSE", dense)
        got.append(adaptive.spectral_scores(g, part))
    assert got[0] == got[1]


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(3000)], [(0, i) for i in range(1, 3000)], [(i, (i + 1) % 3000) for i in range(3000)]])
def test_paths_stars_and_rings(pairs):
    g = adaptive.Residual(list(range(max(b for _, b in pairs) + 1)), pairs)
    starts = np.cumsum([0, *map(len, g.near)])
    ends = np.array([v for x in g.near for v in sorted(x)])
    x = spectral.fiedler(starts, ends)
    own = (np.diff(starts) * x - np.add.reduceat(x[ends], starts[:-1])) @ x / (x @ x)
    assert abs(x.mean()) < 1e-4 and np.abs(x).max() == 1
    least = {(0, 1): 4 * np.sin(np.pi / 2 / g.n) ** 2} if len(pairs) == g.n - 1 and g.degree(0) == 1 else {(0, 1): 1.0 if g.degree(0) > 2 else 4 * np.sin(np.pi / g.n) ** 2}
    assert own == pytest.approx(least[0, 1], rel=1e-3, abs=1e-9)
