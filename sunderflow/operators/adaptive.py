"""Removal orders that look at the residual graph after each removal.

Each is sequential within a component, so those that say what they do event by event run by components (by_component); others
take a task for each cell (graph, method, rate): one Arrow group each.
A program takes (Residual, steps) and returns nodes; whatever it leaves out follows by pos. register() adds programs.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable, fresh
from .by_component import WHOLE, Event, Events, bins_of, by_events, merged_orders
from .levels import removal_by_degree
from .spectral import fiedler
from .static_orders import complete_order


class Residual:
    """What is left of a graph. Nodes are 0 .. n-1 by pos; ids[i] is the id, text[i] its place among ids as texts, those of a
    larger graph if it is given. schedule, for parts of a larger graph, gives the shares of that graph that are gone at an
    event and after its removal."""

    def __init__(self, ids: list[int], pairs: Iterable[tuple[int, int]], text: list[int] | None = None):
        self.ids, self.n = ids, len(ids)
        self.schedule: Callable[[int], tuple[float, float]] | None = None
        self.share = self.then = 0.0
        at = {x: i for i, x in enumerate(ids)}
        self.near: list[set[int]] = [set() for _ in ids]
        for a, b in pairs:
            self.near[at[a]].add(at[b])
            self.near[at[b]].add(at[a])
        self.alive = set(range(self.n))
        self.text = text or [0] * self.n
        if text is None:
            for place, i in enumerate(sorted(range(self.n), key=lambda i: str(ids[i]))):
                self.text[i] = place

    def degree(self, u: int) -> int:
        return len(self.near[u])

    def remove(self, u: int) -> set[int]:
        """Takes u out; returns the neighbours it had."""
        met, self.near[u] = self.near[u], set()
        for v in met:
            self.near[v].discard(u)
        self.alive.discard(u)
        self.share = self.then
        return met

    def turn(self, event: int) -> None:
        """Where events are scheduled, this one begins."""
        if self.schedule:
            self.share, self.then = self.schedule(event)

    def gone(self) -> float:
        return self.share if self.schedule else 1.0 - len(self.alive) / self.n

    def components(self, of: set[int]) -> list[list[int]]:
        left, out = set(of), []
        while left:
            part = [left.pop()]
            for u in part:
                new = self.near[u] & left
                left -= new
                part.extend(new)
            out.append(part)
        return out

    def two_core(self, of: set[int]) -> dict[int, int]:
        """Degrees inside the 2-core of the subgraph that `of` induces."""
        inside = {u: len(self.near[u] & of) for u in of}
        low = [u for u, d in inside.items() if d < 2]
        for u in low:
            if inside.pop(u, None) is None:
                continue
            for v in self.near[u]:
                if v in inside:
                    inside[v] -= 1
                    if inside[v] == 1:
                        low.append(v)
        return inside


Program = Callable[[Residual, int], list[int]]


class Parts:
    """The residual graph's components, largest first; of ties the one whose smallest id is largest.

    A removal only touches the component it is made in, so the others stay as they were found.
    """

    def __init__(self, g: Residual):
        self.g, self.heap = g, []
        self.give_back(g.alive)

    def take(self) -> tuple[int, int, set[int]]:
        """Less its size, less its smallest id, its nodes."""
        return heapq.heappop(self.heap)

    def give_back(self, nodes: set[int]) -> None:
        """Puts back what is left of a component that was taken."""
        for part in self.g.components(nodes & self.g.alive):
            heapq.heappush(self.heap, (-len(part), -min(self.g.ids[u] for u in part), set(part)))


def _by_degree(g: Residual, tie: Callable[[int], int], late: int = 0) -> Iterator[Event]:
    """Largest residual degree first, then least tie; a heap in which outdated entries are skipped. late: what the keys begin with."""
    heap = [(-g.degree(u), tie(u), u) for u in g.alive]
    heapq.heapify(heap)
    while heap:
        d, place, u = heapq.heappop(heap)
        if u not in g.alive or -d != g.degree(u):
            continue
        yield (late, d), place, u
        for v in g.remove(u):
            heapq.heappush(heap, (-g.degree(v), tie(v), v))


hda_original = by_events(lambda g: _by_degree(g, lambda u: -g.text[u]))
hda_fast = by_events(lambda g: _by_degree(g, lambda u: g.text[u]))


class _Core:
    """The 2-core, kept up as nodes go. weight: of its nodes, how many nodes each stands for, itself and those of the trees that
    hang on it; right as long as only nodes of the core, or of components without one, are taken."""

    def __init__(self, g: Residual):
        self.g, self.inside, self.weight = g, g.two_core(g.alive), [1] * g.n
        self.weigh(g.alive)

    def weigh(self, of: set[int]) -> None:
        """Weighs the core's nodes among these, of which components are whole."""
        for u in of:
            self.weight[u] = 1
        left = {u: self.g.degree(u) for u in of if u not in self.inside}
        low = [u for u, d in left.items() if d == 1]
        for u in low:
            del left[u]
            for v in self.g.near[u]:
                if v in left:
                    left[v] -= 1
                    if left[v] == 1:
                        low.append(v)
                if v in left or v in self.inside:
                    self.weight[v] += self.weight[u]

    def take(self, u: int) -> set[int]:
        """Removes u from the graph; returns the nodes whose degree in graph or core changed."""
        was = self.inside.pop(u, None) is not None
        met = self.g.remove(u)
        changed, low = set(met), []
        if was:
            for v in met:
                if v in self.inside:
                    self.inside[v] -= 1
                    if self.inside[v] == 1:
                        low.append(v)
        for x in low:
            if self.inside.pop(x, None) is None:
                continue
            changed.add(x)
            for y in self.g.near[x]:
                if y in self.inside:
                    self.inside[y] -= 1
                    self.weight[y] += self.weight[x]
                    changed.add(y)
                    if self.inside[y] == 1:
                        low.append(y)
        return changed


def _core_first(g: Residual, in_core: bool, tie: Callable[[int], int]) -> Iterator[Event]:
    """The core's node of largest degree (inside the core or the graph), without a core the graph's."""
    core = _Core(g)
    weight = lambda u: core.inside[u] if in_core else g.degree(u)
    heap = [(-weight(u), tie(u), u) for u in core.inside]
    heapq.heapify(heap)
    while core.inside:
        d, place, u = heapq.heappop(heap)
        if u not in core.inside or -d != weight(u):
            continue
        yield (0, d), place, u
        for v in core.take(u):
            if v in core.inside:
                heapq.heappush(heap, (-weight(v), tie(v), v))
    yield from _by_degree(g, tie, 1)


corehd_original = by_events(lambda g: _core_first(g, True, lambda u: -g.ids[u]))
corehd_fast = by_events(lambda g: _core_first(g, False, lambda u: g.text[u]))


class Pieces:
    """The residual graph's components, kept up as nodes go, and in each its node of least key.

    Where a node goes, searches from its neighbours take turns; those that meet go on as one, and when a single one is left the rest
    needs no search. So a removal costs what breaks off and a little around it, not the component.
    """

    def __init__(self, g: Residual, key: Callable[[int], tuple[int, ...]]):
        self.g, self.key = g, key
        self.of = [-1] * g.n  # each node's component
        self.size: list[int] = []
        self.nodes: list[set[int]] = []
        self.names: list[list[tuple[int, int]]] = []  # heaps of (id, node); those that are elsewhere by now are skipped
        self.best: list[list[tuple[tuple[int, ...], int]]] = []  # heaps of (key, node); those that aren't so any more are skipped
        self.heap: list[tuple[int, int, int]] = []
        for part in g.components(g.alive):
            self._found(part)

    def _found(self, part: list[int]) -> None:
        c = len(self.size)
        for u in part:
            self.of[u] = c
        self.size.append(len(part))
        self.nodes.append(set(part))
        self.names.append([(self.g.ids[u], u) for u in part])
        self.best.append([(self.key(u), u) for u in part])
        heapq.heapify(self.names[c])
        heapq.heapify(self.best[c])
        self._offer(c)

    def _offer(self, c: int) -> None:
        names = self.names[c]
        while self.of[names[0][1]] != c:
            heapq.heappop(names)
        heapq.heappush(self.heap, (-self.size[c], -names[0][0], c))

    def first(self) -> tuple[int, int, int]:
        """Of the largest component, of ties the one whose smallest id is largest: less its size, less its smallest id, its best node."""
        while -self.heap[0][0] != self.size[self.heap[0][2]]:
            heapq.heappop(self.heap)
        size, name, c = self.heap[0]
        best = self.best[c]
        while self.of[best[0][1]] != c or best[0][0] != self.key(best[0][1]):
            heapq.heappop(best)
        return size, name, best[0][1]

    def take(self, u: int, remove: Callable[[int], set[int]]) -> None:
        """Removes u; remove does it in the graph and returns the nodes whose keys changed."""
        c, met = self.of[u], list(self.g.near[u])
        changed = remove(u)
        self.of[u] = -1
        self.size[c] -= 1
        self.nodes[c].discard(u)
        for part in self._apart(met):
            self.size[c] -= len(part)
            self.nodes[c].difference_update(part)
            self._found(part)
        for v in changed:
            heapq.heappush(self.best[self.of[v]], (self.key(v), v))
        if self.size[c]:
            self._offer(c)

    def _apart(self, met: list[int]) -> list[list[int]]:
        """The parts that hold these nodes, but one."""
        near, owner = self.g.near, {v: i for i, v in enumerate(met)}
        into, seen, ahead = list(range(len(met))), [[v] for v in met], [deque([v]) for v in met]
        found: list[list[int]] = []

        def search(i: int) -> int:
            while into[i] != i:
                into[i] = into[into[i]]
                i = into[i]
            return i

        going = into[:]
        while len(going) > 1:
            left = len(going)
            for i in going:
                if into[i] != i:
                    continue
                if left == 1:
                    break
                if not ahead[i]:
                    found.append(seen[i])
                    into[i] = -1
                    left -= 1
                    continue
                for u in [ahead[i].popleft() for _ in range(min(8, len(ahead[i])))]:
                    for v in near[u]:
                        if v not in owner:
                            owner[v] = i
                            seen[i].append(v)
                            ahead[i].append(v)
                        elif (j := search(owner[v])) != i:
                            left -= 1
                            if len(seen[j]) > len(seen[i]):
                                i, j = j, i
                            into[j] = i
                            seen[i] += seen[j]
                            ahead[i] += ahead[j]
                            seen[j], ahead[j] = [], deque()
            going = [i for i in going if into[i] == i]
        return found


def _hubs(g: Residual) -> Iterator[Event]:
    """Largest degree in the largest component, component by component."""
    yield from _best_of_largest(g, lambda u: (-g.degree(u), -g.ids[u]), g.remove)


def _decycling(g: Residual) -> Iterator[Event]:
    """BPD / MinSum fallback: the 2-core's node of largest degree (inside the core) in the largest component, without a core its
    node of largest degree."""
    core = _Core(g)
    yield from _best_of_largest(g, lambda u: (0, -core.inside[u], -g.ids[u]) if u in core.inside else (1, -g.degree(u), -g.ids[u]), core.take)


def _best_of_largest(g: Residual, key: Callable[[int], tuple[int, ...]], remove: Callable[[int], set[int]]) -> Iterator[Event]:
    pieces = Pieces(g, key)
    while g.alive:
        size, name, u = pieces.first()
        yield (size,), name, u
        pieces.take(u, remove)


def _largest_first(choose: Callable[[Residual, set[int]], list[int]]) -> Program:
    """Removes what is chosen in the largest component, again and again."""

    def events(g: Residual) -> Iterator[Event]:
        parts = Parts(g)
        while g.alive:
            size, name, part = parts.take()
            for u in choose(g, part):
                yield (size,), name, u
                g.remove(u)
            parts.give_back(part)

    return by_events(events)


def _cuts(g: Residual, part: set[int]) -> dict[int, int]:
    """For each cut node of a component: the size of the largest piece that its removal leaves."""
    root = min(part)
    seen, low, size, cut = {root: 0}, {root: 0}, {root: 1}, {}
    pieces: dict[int, list[int]] = {}
    stack = [(root, -1, iter(sorted(g.near[root])))]
    children = 0
    while stack:
        u, parent, rest = stack[-1]
        for v in rest:
            if v not in seen:
                seen[v] = low[v] = len(seen)
                size[v] = 1
                stack.append((v, u, iter(sorted(g.near[v]))))
                break
            if v != parent:
                low[u] = min(low[u], seen[v])
        else:
            stack.pop()
            if parent >= 0:
                size[parent] += size[u]
                low[parent] = min(low[parent], low[u])
                children += parent == root
                if low[u] >= seen[parent]:
                    pieces.setdefault(parent, []).append(size[u])
    for u, found in pieces.items():
        if u != root or children > 1:
            cut[u] = max(*found, len(part) - 1 - sum(found)) if u != root else max(found)
    return cut


def _betweenness(g: Residual, part: set[int]) -> dict[int, float]:
    total = dict.fromkeys(part, 0.0)
    for s in part:
        level, paths, seen = {s: 0}, {s: 1.0}, [s]
        for u in seen:
            for v in g.near[u]:
                if v not in level:
                    level[v], paths[v] = level[u] + 1, 0.0
                    seen.append(v)
                if level[v] == level[u] + 1:
                    paths[v] += paths[u]
        share = dict.fromkeys(seen, 0.0)
        for v in reversed(seen[1:]):
            total[v] += share[v]
            for u in g.near[v]:
                if level[u] == level[v] - 1:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
    return total


def _core_cuts(core: _Core, first: int, n: int) -> dict[int, int] | None:
    """For each cut node in the 2-core of a component of n nodes, the size of the largest piece that its removal leaves; the core's
    node `first` is in it. None where trees that hang on a node might hold the largest piece. Without that, every cut node outside
    the core leaves more than the one that its tree hangs on."""
    inside, weight = core.inside, core.weight
    near = lambda u: [v for v in core.g.near[u] if v in inside]
    seen, size, cut = {first: 0}, {first: weight[first]}, {}
    low = {first: 0}
    pieces: dict[int, list[int]] = {}
    stack = [(first, -1, iter(near(first)))]
    while stack:
        u, parent, rest = stack[-1]
        least = low[u]
        for v in rest:
            at = seen.get(v)
            if at is None:
                low[u] = least
                seen[v] = low[v] = len(seen)
                size[v] = weight[v]
                stack.append((v, u, iter(near(v))))
                break
            if at < least and v != parent:
                least = at
        else:
            low[u] = least
            stack.pop()
            if parent >= 0:
                size[parent] += size[u]
                if least < low[parent]:
                    low[parent] = least
                if least >= seen[parent]:
                    pieces.setdefault(parent, []).append(size[u])
    for u in seen:
        found = pieces.get(u, [])
        above = n - weight[u] - sum(found)
        others = len(found) + (above > 0)
        most = max(*found, above) if found else above
        if weight[u] - 1 > most:
            return None
        if weight[u] > 1 or others > 1:
            cut[u] = most
    return cut


def _cutting(g: Residual) -> Iterator[Event]:
    """The cut node of the largest component that leaves the smallest rest; without one its most between node."""
    core = _Core(g)
    pieces = Pieces(g, lambda u: ())
    while g.alive:
        size, name, u = pieces.first()
        part = pieces.nodes[pieces.of[u]]
        first = next((v for v in part if v in core.inside), None)
        cut = _core_cuts(core, first, len(part)) if first is not None else None
        trees = cut is None
        if trees:
            cut = _cuts(g, part)
        if cut:
            u = min(cut, key=lambda u: (cut[u], g.ids[u]))
        else:
            score = _betweenness(g, part)
            u = min(score, key=lambda u: (-round(score[u], 9), g.ids[u]))
        yield (size,), name, u
        rest = set(part) - {u} if trees and first is not None else ()
        pieces.take(u, core.take)
        if rest:
            core.weigh(rest)


def batch_size(n: int) -> int:
    """Nodes that go at once from a component of n."""
    return 1 if n <= 100 else max(1, n // 100) if n <= 2000 else max(8, n // 80)


def _batches(score: Callable[[Residual, set[int]], dict[int, float]]) -> Program:
    """Removes the best-scored nodes of the largest component in batches."""

    def choose(g: Residual, part: set[int]) -> list[int]:
        scores = score(g, part) or {u: float(g.degree(u)) for u in part}
        return sorted(scores, key=lambda u: (-scores[u], g.ids[u]))[: batch_size(len(part))]

    return _largest_first(choose)


def _excess(g: Residual, u: int) -> int:
    return max(0, g.degree(u) - 1)


def minsum_scores(g: Residual, part: set[int]) -> dict[int, float]:
    pool = g.two_core(part) or part
    return {u: 1e4 * _excess(g, u) + sum(_excess(g, v) for v in g.near[u]) + g.degree(u) for u in pool}


def bpd_scores(g: Residual, part: set[int]) -> dict[int, float]:
    cavity = {u: sum(_excess(g, v) for v in g.near[u]) for u in part}
    second = {u: sum(cavity[v] - _excess(g, u) for v in g.near[u]) for u in part}
    return {u: _excess(g, u) * (1.0 + cavity[u]) + 0.05 * second[u] + g.degree(u) for u in part}


def spectral_scores(g: Residual, part: set[int]) -> dict[int, float]:
    """1000 times the neighbours across the Fiedler vector's median, plus degree, whatever the part's size; degrees of up to three nodes."""
    if len(part) < 4:
        return {u: float(g.degree(u)) for u in part}
    nodes = sorted(part)
    at = {u: i for i, u in enumerate(nodes)}
    starts = np.concatenate(([0], np.cumsum([g.degree(u) for u in nodes])))
    ends = np.fromiter((at[v] for u in nodes for v in sorted(g.near[u])), "int64", starts[-1])
    x = fiedler(starts, ends)
    side = x >= np.median(x)
    across = np.add.reduceat(side[ends] != np.repeat(side, np.diff(starts)), starts[:-1], dtype="int64")
    return dict(zip(nodes, (1000.0 * across + np.diff(starts)).tolist(), strict=True))


def entanglement_scores(g: Residual, part: set[int]) -> dict[int, float]:
    out = {}
    for u in part:
        near, d = g.near[u], g.degree(u)
        two = set().union(*(g.near[v] for v in near)) - {u}
        links = sum(len(g.near[v] & near) for v in near) / 2
        clustering = 2 * links / (d * (d - 1)) if d > 1 else 0.0
        out[u] = 100.0 * d + 5.0 * len(two - near) + len(two & near) - 10.0 * clustering
    return out


class _Level:
    """Nodes of one degree: heaps of the texts' places by the rest of the score. What isn't so any more is skipped."""

    def __init__(self) -> None:
        self.rests: list[float] = []
        self.nodes: dict[float, list[tuple[int, int]]] = {}

    @property
    def best(self) -> float:
        return -self.rests[0]

    def put(self, rest: float, text: int, u: int) -> None:
        if rest not in self.nodes:
            self.nodes[rest] = []
            heapq.heappush(self.rests, -rest)
        heapq.heappush(self.nodes[rest], (-text, u))

    def clean(self, now: dict[int, tuple[int, float]], d: int) -> bool:
        """Whether any node is left, whose rest is best and which is first of its heap."""
        while self.rests:
            heap = self.nodes[self.best]
            while heap and now.get(heap[0][1]) != (d, self.best):
                heapq.heappop(heap)
            if heap:
                return True
            del self.nodes[-heapq.heappop(self.rests)]
        return False

    def last_of_best(self, now: dict[int, tuple[int, float]], d: int, best: Callable[[float], bool]) -> int:
        """The node whose text sorts last among those whose rest makes a best score; several rests may round to it."""
        met, aside = [], []
        while self.clean(now, d) and best(self.best):
            met.append(self.nodes[self.best][0])
            aside.append((self.best, self.nodes.pop(-heapq.heappop(self.rests))))
        for rest, heap in aside:
            self.nodes[rest] = heap
            heapq.heappush(self.rests, -rest)
        return min(met)[1]


def local_scores(neighbours: float = 0.02, weak: float = 0.1, boundary: float = 0.0015, redundancy: float = 0.0, phase: float = 0.15, cap: int | None = None, two_hop_cap: int | None = None) -> Program:
    """A parametric local scorer: at each step the node of largest score goes; of ties the id whose text sorts last.

    Degree, times 1 + phase x share removed; plus weights times the neighbours' degrees, how many of them have at most two,
    and the degrees of their neighbours; less a weight times the links among neighbours. At most `cap` neighbours by pos and
    `two_hop_cap` neighbours of each (one at least) are read; None reads all. (A term that is the same for all nodes, as a
    count of components would be, changes no order and is left out.) Only scores that a removal can change are renewed.
    """
    reach = None if two_hop_cap is None else max(1, two_hop_cap)

    def rest(g: Residual, u: int) -> float:
        near = sorted(g.near[u])[:cap]
        degrees = [g.degree(v) for v in near]
        rim = sum(sum(map(g.degree, [w for w in sorted(g.near[v]) if w != u][:reach])) for v in near) if boundary else 0
        links = sum(len(g.near[v] & set(near)) for v in near) // 2 if redundancy else 0
        return neighbours * sum(degrees) + weak * sum(d <= 2 for d in degrees) + boundary * rim - redundancy * links

    def program(g: Residual, steps: int) -> list[int]:
        level: dict[int, _Level] = {}  # alive nodes by degree, and there by the rest of their score
        now: dict[int, tuple[int, float]] = {}

        def put(v: int) -> None:
            now[v] = g.degree(v), float(rest(g, v))
            level.setdefault(now[v][0], _Level()).put(now[v][1], g.text[v], v)

        for u in g.alive:
            put(u)
        order: list[int] = []
        while g.alive and len(order) < steps:
            times, tops = 1 + phase * len(order) / g.n, []
            for d in list(level):
                if level[d].clean(now, d):
                    tops.append((times * d + level[d].best, d))
                else:
                    del level[d]
            most = max(tops)[0]
            u = max((level[d].last_of_best(now, d, lambda x, d=d: times * d + x == most) for score, d in tops if score == most), key=lambda u: g.text[u])
            del now[u]
            changed = ring = g.remove(u)
            order.append(u)
            for _ in range(2 if boundary else 1):  # as far as degrees are looked at
                ring = set().union(*(g.near[v] for v in ring)) - changed if ring else set()
                changed = changed | ring
            for v in changed:
                put(v)
        return order

    return program


PROGRAMS: dict[str, Program] = {
    "HDA": hda_original, "HDA-fast": hda_fast, "Degree-heap": hda_fast, "CoreHD": corehd_original, "CoreHD-fast": corehd_fast, "Decycle": by_events(_decycling),
    "GND-cut": by_events(_cutting), "MinSum": _batches(minsum_scores), "BPD": _batches(bpd_scores), "GND": _batches(spectral_scores), "VE": _batches(entanglement_scores),
    "Local": local_scores(), "Local-bounded": local_scores(0.010, 0.06, 0.0005, 0.04, 0.06, 8, 6), "Component": by_events(_hubs),
}


def register(name: str, program: Program) -> None:
    """Makes a program callable by name. It runs as it is: only register code that you trust."""
    PROGRAMS[name] = program


#: Methods that graphs beyond a task have a way for: whether ties go to the text that sorts last.
BY_LEVELS = {"HDA": True, "HDA-fast": False, "Degree-heap": False}
#: Nodes and edges of a graph that a task holds.
LOCAL = 3_000_000


def adaptive_orders(edges: DataFrame, nodes: DataFrame, methods: list[str], rate: float = 0.3, local: int = LOCAL, whole: int = WHOLE) -> DataFrame:
    """orders(graph, method, step, node) of every graph by every method, complete; steps beyond rate go by pos.

    Graphs of up to `whole` nodes and edges, and others by programs that aren't made of events, are a task's work each. Larger ones
    run by components, in bins: a task holds a component. For the methods BY_LEVELS graphs with a component of over `local` nodes
    and edges are removed over tables.
    """
    split = {m: p for m in methods if hasattr(p := PROGRAMS[m], "events")}
    size = nodes.select("graph").unionByName(edges.select("graph")).groupBy("graph").agg(F.count(F.lit(1)).alias("_n"))
    cut = durable(size.where(F.col("_n") > min(local, whole)).select("graph"), "cut") if split else None
    if cut is None or cut.isEmpty():
        return _in_tasks(edges, nodes, methods, rate)
    of = lambda df, how, graphs=cut: df.join(graphs, "graph", how)
    small, found = _in_tasks(of(edges, "left_anti"), of(nodes, "left_anti"), methods, rate), []
    if others := [m for m in methods if m not in split]:
        small = small.unionByName(_in_tasks(of(edges, "left_semi"), of(nodes, "left_semi"), others, rate))
    edges, nodes = of(edges, "left_semi"), of(nodes, "left_semi")
    bins = bins_of(edges, nodes)
    levels = [m for m in split if m in BY_LEVELS]
    large = _beyond(edges, bins, local) if levels else None
    if large is not None:
        found += [removal_by_degree(of(edges, "left_semi", large), of(nodes, "left_semi", large), m, BY_LEVELS[m], rate, local) for m in levels]
        found.append(merged_orders(of(edges, "left_anti", large), of(nodes, "left_anti", large), of(bins, "left_anti", large), {m: split.pop(m) for m in levels}, rate)[0])
    if split:
        found.append(merged_orders(edges, nodes, bins, split, rate)[0])
    columns = ["graph", "method", F.col("step").cast("long").alias("step"), "node"]
    return small.unionByName(complete_order(durable(reduce(DataFrame.unionByName, [x.select(*columns) for x in found]), "orders"), nodes))


def _beyond(edges: DataFrame, bins: DataFrame, local: int) -> DataFrame | None:
    """The graphs with a bin of over `local` nodes and edges, if there are any."""
    own = edges.join(bins.withColumnRenamed("id", "src"), ["graph", "src"]).select("graph", "bin").unionByName(bins.select("graph", "bin"))
    large = durable(own.groupBy("graph", "bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local).select("graph").distinct(), "large")
    return None if large.isEmpty() else large


def _in_tasks(edges: DataFrame, nodes: DataFrame, methods: list[str], rate: float) -> DataFrame:
    chosen = {m: PROGRAMS[m] for m in methods}

    def run(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = own.sort_values("pos")["id"].tolist()
        steps = max(1, min(len(ids), round(len(ids) * rate)))
        g = Residual(ids, zip(pairs["src"].tolist(), pairs["dst"].tolist(), strict=True))
        order = chosen[key[1]](g, steps)[:steps] if ids else []
        return pd.DataFrame({"graph": key[0], "method": key[1], "step": np.arange(1, len(order) + 1), "node": [ids[u] for u in order]})

    spark = edges.sparkSession
    cells = spark.createDataFrame([(m,) for m in methods], "method string")
    left = nodes.select("graph", "id", "pos").join(F.broadcast(cells)).groupBy("graph", "method")
    right = fresh(edges.select("graph", "src", "dst").join(F.broadcast(cells))).groupBy("graph", "method")
    found = left.cogroup(right).applyInPandas(run, "graph string, method string, step long, node long")
    return complete_order(found, nodes)
