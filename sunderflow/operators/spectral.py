"""The Fiedler vector of a component of any size, in arrays: what grows is linear in its nodes and edges."""

from __future__ import annotations

import numpy as np

#: Nodes up to which all eigenvectors are taken at once; beyond, the second one alone is approached. Both give the same vector.
DENSE = 400
#: Vectors that are kept while the second one is approached, and after a restart.
MOST, KEPT = 24, 8


class _Laplacian:
    """L of a connected graph without loops: neighbours of node i are ends[starts[i]:starts[i + 1]]."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends, self.degree = starts[:-1], ends, np.diff(starts)

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.degree * x - np.add.reduceat(x[self.ends], self.starts)


def _leaves(starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of (leaves, what they hang on), until there are none; one node of a tree stays."""
    degree, only = np.diff(starts), np.bitwise_xor.reduceat(ends, starts[:-1])
    rounds, leaves = [], np.flatnonzero(degree == 1)
    while len(leaves):
        above = only[leaves]
        if len(leaves) == 2 and above[0] == leaves[1]:
            leaves, above = leaves[:1], above[:1]
        rounds.append((leaves, above))
        degree[leaves] = 0
        np.subtract.at(degree, above, 1)
        np.bitwise_xor.at(only, above, leaves)
        above = np.unique(above)
        leaves = above[degree[above] == 1]
    return rounds


class _Solver:
    """Nearly solves Lx = b where b adds up to 0: trees exactly, from their leaves on, what is left by conjugate gradients."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.rounds = _leaves(starts, ends)
        inside = np.ones(len(starts) - 1, dtype=bool)
        for leaves, _ in self.rounds:
            inside[leaves] = False
        self.core = np.flatnonzero(inside)
        if len(self.core) > 1:
            at = np.cumsum(inside) - 1
            own = np.repeat(inside, np.diff(starts)) & inside[ends]
            counts = np.bincount(np.repeat(np.arange(len(inside)), np.diff(starts))[own], minlength=len(inside))[inside]
            self.inner = _Laplacian(np.concatenate(([0], np.cumsum(counts))), at[ends[own]])

    def __call__(self, b: np.ndarray, exact: float = 1e-3) -> np.ndarray:
        b = b.copy()
        for leaves, above in self.rounds:
            np.add.at(b, above, b[leaves])
        x = np.zeros(len(b))
        if len(self.core) > 1:
            x[self.core] = self._gradients(b[self.core], exact)
        for leaves, above in reversed(self.rounds):
            x[leaves] = x[above] + b[leaves]
        return x - x.mean()

    def _gradients(self, b: np.ndarray, exact: float) -> np.ndarray:
        inner = self.inner
        b = b - b.mean()
        x, r, enough = np.zeros(len(b)), b, exact * np.linalg.norm(b)
        z = r / inner.degree
        p, rz = z, r @ z
        for _ in range(len(b)):
            if np.linalg.norm(r) <= enough or rz <= 0:
                break
            q = inner.times(p)
            step = rz / (p @ q)
            x, r = x + step * p, r - step * q
            z = r / inner.degree
            rz, before = r @ z, rz
            p = z + rz / before * p
        return x


def _approached(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rayleigh and Ritz: the space grows by the solution for what the best vector so far lacks, until doubles tell no more."""
    n = len(starts) - 1
    laplacian, solve = _Laplacian(starts, ends), _Solver(starts, ends)
    first = np.random.default_rng(7).standard_normal(n)  # the same whenever it is run
    space, images, new = np.empty((0, n)), np.empty((0, n)), solve(first - first.mean())
    x, least, waited = new, np.inf, 0
    while True:
        new = new - new.mean()
        for _ in range(2):
            new = new / np.linalg.norm(new)
            new = new - space.T @ (space @ new)
        if (length := np.linalg.norm(new)) < 1e-6 or len(space) >= n - 1:
            return x
        space = np.vstack((space, new / length))
        images = np.vstack((images, laplacian.times(space[-1])))
        small = space @ images.T
        values, turned = np.linalg.eigh((small + small.T) / 2)
        x = turned[:, 0] @ space
        lacks = turned[:, 0] @ images - values[0] * x
        rest = np.linalg.norm(lacks)
        waited = 0 if rest < least / 2 else waited + 1
        least = min(least, rest)
        if rest <= 1e-10 * values[0] + 1e-15 * laplacian.degree.max() or waited > 4 * MOST and rest <= 1e-6 * values[0]:
            return x
        if len(space) >= MOST:
            space, images = turned[:, :KEPT].T @ space, turned[:, :KEPT].T @ images
        new = solve(lacks - lacks.mean())


def fiedler(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eigenvector of the Laplacian's second eigenvalue for a connected graph of two nodes or more, largest entry 1, rounded to
    6 places, the first entry that isn't 0 positive; neighbours of node i are ends[starts[i]:starts[i + 1]]."""
    n = len(starts) - 1
    if n <= DENSE:
        laplacian = np.diag(np.diff(starts).astype(float))
        laplacian[np.repeat(np.arange(n), np.diff(starts)), ends] = -1.0
        x = np.linalg.eigh(laplacian)[1][:, 1]
    else:
        x = _approached(starts, ends)
    x = np.round(x / np.abs(x).max(), 6)
    return x * np.sign(x[np.flatnonzero(x)[0]]) + 0.0
