"""The three-stage program search with proposals from a source that is given.

Stage 1 grows a tree from a root program; stage 2 induces bounds from its log; stage 3 grows from quota'd seeds within the
bounds; the skyline of its log gives the final two. The loop is sequential; each step's evaluation fans out over graphs.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import median
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, report, selection
from ..operators.adaptive import PROGRAMS, Program, local_scores
from ..sources.storage import durable
from .validation import evaluate

Record = dict


class ProposalSource(Protocol):
    def propose(self, parent: Record, index: int, branch: str | None) -> tuple[str, Program] | None:
        """A family's name and a program for a child of the parent; None has the policy's fallback take its place.

        A source with a method hear(text) is told the policy's guidance before each step of run_policy.
        """


@dataclass
class GridProposals:
    """Deterministic proposals: local scorers whose weights walk a hashed grid around the step's number."""

    seed: int = 20260603

    def propose(self, parent: Record, index: int, branch: str | None) -> tuple[str, Program]:
        rng = random.Random(f"{self.seed}|{parent['node_id']}|{index}|{branch}")
        weights = {k: round(rng.uniform(0, top), 3) for k, top in (("phase", 1.5), ("neighbours", 0.5), ("weak", 0.4), ("boundary", 0.3), ("redundancy", 0.2))}
        cap = {"S": 8, "Q": 32}.get(branch or "", 16)
        family = max(("neighbours", "weak", "boundary", "redundancy"), key=weights.__getitem__)
        return f"local-{family}", local_scores(**weights, cap=cap, two_hop_cap=4 * cap)


#: The parameter study: first value, step and number of values of each parameter by group, where None reads all (fixed
#: values). A candidate's number, modulo 25, gives its values.
STUDY_FAMILIES = {
    "R/GCC-only": "degree-backbone", "Absolute-cNBI": "free-boundary-scan", "Relative-Free": "free-boundary-scan", "Relative-Delta-cNBI": "relative-local-mix", "CostAware-Free": "relative-local-mix", "Bounded-Guided": "bounded-local-policy",
}
STUDY = {
    "degree-backbone": {"neighbours": (0.0, 0.005, 5), "weak": (0.0, 0.0, 1), "boundary": (0.0, 0.0, 1), "redundancy": (0.0, 0.0, 1), "phase": (0.0, 0.05, 3), "cap": (8, 4, 5), "two_hop_cap": (0, 0, 1)},
    "free-boundary-scan": {"neighbours": (0.02, 0.01, 5), "weak": (0.10, 0.05, 4), "boundary": (0.0015, 0.0005, 6), "redundancy": (0.02, 0.0, 1), "phase": (0.0, 0.15, 4), "cap": (64, 0, 1), "two_hop_cap": (32, 0, 1)},
    "relative-local-mix": {"neighbours": (0.015, 0.006, 5), "weak": (0.08, 0.04, 4), "boundary": (0.0008, 0.0004, 5), "redundancy": (0.03, 0.01, 4), "phase": (0.0, 0.10, 4), "cap": (16, 8, 4), "two_hop_cap": (12, 8, 4)},
    "bounded-local-policy": {"neighbours": (0.010, 0.004, 5), "weak": (0.06, 0.03, 4), "boundary": (0.0005, 0.0002, 5), "redundancy": (0.04, 0.01, 5), "phase": (0.0, 0.06, 4), "cap": (8, 4, 4), "two_hop_cap": (6, 4, 4)},
}
#: Where every so many numbers, from the first, the value is another one: none (0) or all (None).
STUDY_EVERY = {"free-boundary-scan": {"redundancy": (3, 0.0), "cap": (2, None), "two_hop_cap": (4, None)}}
#: Candidates that fail on purpose.
STUDY_INVALID = {"Relative-Free": (7, 29, 53, 71, 89), "CostAware-Free": (31, 77)}


def parameter_study(spark: SparkSession, candidates: int) -> DataFrame:
    """(group, number, family, parameters of local_scores, invalid) of `candidates` candidates of every group."""
    rows = spark.createDataFrame([*STUDY_FAMILIES.items()], "group string, family string").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    r = F.col("number") % 25
    for name in STUDY["degree-backbone"]:
        value, kind = F.lit(None), "int" if "cap" in name else "double"
        for family, params in STUDY.items():
            first, step, values = params[name]
            every, other = STUDY_EVERY.get(family, {}).get(name, (None, None))
            own = (F.lit(first) + F.lit(step) * (r % values)).cast(kind)
            own = own if every is None else F.when(r % every == 0, F.lit(other).cast(kind)).otherwise(own)
            value = F.when(F.col("family") == family, own).otherwise(value)
        rows = rows.withColumn(name, value.cast(kind))
    bad = F.lit(False)
    for group, numbers in STUDY_INVALID.items():
        bad = bad | ((F.col("group") == group) & F.col("number").isin(*numbers))
    return rows.withColumn("invalid", bad)


def study_programs(rows: list) -> dict[str, Program]:
    """The programs of parameter_study's rows, by group and number; invalid ones raise."""

    def invalid(*_: object) -> list[int]:
        raise ValueError("invalid on purpose")

    return {f"{r.group} {r.number}": invalid if r.invalid else local_scores(**{name: r[name] for name in STUDY["degree-backbone"]}) for r in rows}


_LOG = "node_id string, parent_node_id string, candidate_id string, family string, depth int, tree_branch string, tree_role string, valid boolean, error string, auc_cNBI double, R double, time_s double, early_cNBI double, early_NCC double, early_GCC double, parent_auc_cNBI double"


@dataclass
class Search:
    """One search over graphs. records holds the log; programs the callables by node."""

    edges: DataFrame
    nodes: DataFrame
    source: ProposalSource
    rate: float = 0.3
    seconds: float = 30.0
    records: list[Record] = field(default_factory=list)
    programs: dict[str, Program] = field(default_factory=dict)

    def measure(self, program: Program) -> Record:
        """Means over the graphs; invalid if any graph's cell is."""
        rows = evaluate(self.edges, self.nodes, {"candidate": program}, self.rate, self.seconds)
        names = ("auc_cNBI", "R", "early_cNBI", "early_NCC", "early_GCC")
        one = rows.agg(F.every("valid").alias("valid"), F.max("error").alias("error"), F.avg("time_s").alias("time_s"), *[F.avg(n).alias(n) for n in names]).first()
        return one.asDict()

    def add(self, program: Program, family: str, parent: Record | None, role: str, branch: str = "") -> Record:
        node = f"{role}-{len(self.records):04d}"
        row = {"node_id": node, "parent_node_id": parent and parent["node_id"], "candidate_id": node, "family": family, "depth": parent["depth"] + 1 if parent else 0, "tree_branch": branch, "tree_role": role, "parent_auc_cNBI": parent and parent["auc_cNBI"]}
        row |= self.measure(program)
        self.records.append(row)
        self.programs[node] = program
        return row

    def log(self, weights: tuple[float, float, float, float]) -> DataFrame:
        columns = [c.split()[0] for c in _LOG.split(", ")]
        df = self.edges.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in self.records], _LOG)
        return ranking.add_rank_scores(df, weights, self.records[0]["auc_cNBI"])

    def grow(self, budget: int, weights: tuple[float, float, float, float], role: str, branches: bool = False) -> None:
        by_node = {}
        for i in range(1, budget + 1):
            branch = selection.branch_of(i, budget) if branches else None
            by_node = {r["node_id"]: r for r in self.records}
            chosen = selection.expandable_parent(self.log(weights), branch=branch).first()
            if chosen is None:
                raise ValueError("the tree has no valid node to expand")
            parent = by_node[chosen.node_id]
            family, program = self.source.propose(parent, i, branch)
            self.add(program, family, parent, role, branch or parent["tree_branch"])


def run_search(edges: DataFrame, nodes: DataFrame, root: Program, source: ProposalSource, stage1: int, stage3: int, seeds: int = 4, rate: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stage 1 log, stage 3 log, final two)."""
    first = Search(edges, nodes, source, rate)
    first.add(root, "root", None, "root")
    first.grow(stage1, ranking.STAGE1_WEIGHTS, "free")
    log1 = durable(first.log(ranking.STAGE1_WEIGHTS), "stage1-log")
    bounds = report.policy_statistics(log1).collect()
    chosen = selection.branch_seeds(log1.withColumn("feature_signature", F.col("family")), seeds).collect()
    limit = max((b.max_runtime_s for b in bounds), default=1.0)
    second = Search(edges, nodes, source, rate, seconds=max(1.0, 20 * limit))
    for row in chosen:
        second.add(first.programs[row.candidate_id], "seed", None, "seed", row.tree_branch)
    second.grow(stage3, ranking.STAGE3_WEIGHTS, "bounded", True)
    log3 = durable(second.log(ranking.STAGE3_WEIGHTS), "stage3-log")
    return log1, log3, selection.final_two_guarded(selection.pareto(log3))


# Policies of the compared searches: each picks a parent among records with node_id, parent_id, valid and rank_score.


def _valid(records: list[Record]) -> list[Record]:
    return [r for r in records if r.get("valid")]


def _score(r: Record) -> float:
    return float(r.get("rank_score") if r.get("rank_score") is not None else -1.0)


def _depth(r: Record, by_id: dict[str, Record]) -> int:
    seen: set[str] = set()
    at = r.get("parent_id")
    while at in by_id and at not in seen:
        seen.add(at)
        at = by_id[at].get("parent_id")
    return len(seen)


def best_parent(records: list[Record], rng: random.Random, state: dict) -> Record:
    """The best score: the default, also for reflective and harmony searches."""
    return max(_valid(records), key=_score)


def _visits(records: list[Record]) -> Callable[[Record], float]:
    children, total = Counter(r.get("parent_id") for r in records), math.log(max(2, len(records)))
    return lambda r: math.sqrt(total / (1 + children[r["node_id"]]))


def uct_parent(records: list[Record], rng: random.Random, state: dict) -> Record:
    explore = _visits(records)
    return max(_valid(records), key=lambda r: max(0.0, _score(r)) + 1.35 * explore(r))


def tree_parent(records: list[Record], rng: random.Random, state: dict) -> Record:
    """Scores fade with depth."""
    explore, by_id = _visits(records), {r["node_id"]: r for r in records}
    return max(_valid(records), key=lambda r: max(0.0, _score(r)) / (1 + 0.12 * _depth(r, by_id)) + 1.1 * explore(r))


def island_parent(records: list[Record], rng: random.Random, state: dict, islands: int = 4) -> Record:
    """Islands take turns; one of an island's best four."""
    turn = state["turn"] = state.get("turn", -1) + 1
    pool = _valid(records)
    own = [r for r in pool if r.get("island", 0) == turn % islands] or pool
    return rng.choice(sorted(own, key=_score, reverse=True)[:4])


def niche_parent(records: list[Record], rng: random.Random, state: dict) -> Record:
    """The best of a niche, rare niches more often; one in five picks is any valid record."""
    pool, niches = _valid(records), defaultdict(list)
    for r in pool:
        niches[str(r.get("niche") or "root")].append(r)
    names = list(niches)
    chosen = rng.choices(names, [1 / math.sqrt(len(niches[n])) for n in names])[0]
    return rng.choice(pool) if rng.random() < 0.2 else max(niches[chosen], key=_score)


def clade_parent(records: list[Record], rng: random.Random, state: dict) -> Record:
    """Thompson sampling of clades.

    A clade's chance is Beta distributed by its members at and below the median score of all; .08 over the root of its size
    favours small clades. One of the five best members of the clade with the luckiest draw is taken.
    """
    pool = _valid(records)
    if len(pool) < 3:
        return pool[-1]
    middle = median(map(_score, pool))
    members: dict[str, list[Record]] = defaultdict(list)
    for r in sorted(pool, key=_score, reverse=True):
        members[str(r.get("clade") or "default")].append(r)

    def luck(clade: str) -> float:
        reached = [_score(r) >= middle for r in members[clade]]
        return rng.betavariate(reached.count(True) + 1, reached.count(False) + 1) + 0.08 * len(reached) ** -0.5

    return rng.choice(members[max(members, key=luck)][:5])


POLICIES: dict[str, Callable[[list[Record], random.Random, dict], Record]] = {
    "EoH": best_parent, "ReEvo": best_parent, "HSEvo": best_parent, "HiFo": best_parent, "PUCT": uct_parent, "MCTS": tree_parent, "FunSearch": island_parent, "AlphaEvolve": niche_parent, "Clade": clade_parent,
}


# The families that policies fall back to, one step after the other.
FALLBACKS = {
    "EoH": ("redundancy_prune", "private_coverage"), "ReEvo": ("redundancy_prune",), "HSEvo": ("harmony",), "HiFo": ("two_hop", "private_coverage"), "PUCT": ("private_coverage", "redundancy_prune"),
    "MCTS": ("two_hop",), "FunSearch": ("fast_archive",), "AlphaEvolve": ("harmony", "fast_archive"), "Clade": ("redundancy_prune", "two_hop"),
}
# End of the fixed values.
#: The removal program of each of these families.
FALLBACK_PROGRAMS: dict[str, Program] = {
    "redundancy_prune": local_scores(redundancy=0.1), "private_coverage": PROGRAMS["Local"], "harmony": PROGRAMS["CoreHD-fast"], "two_hop": PROGRAMS["Local-bounded"], "fast_archive": PROGRAMS["HDA-fast"],
}
#: What each policy asks of the next proposal; {best} and {worst} are the families of the best and the weakest candidate.
GUIDANCE = {
    "EoH": "Recombine the ideas of the parent and of {best} into a new one.", "ReEvo": "Reflect on why {best} does better than {worst}, and change the parent accordingly.", "HSEvo": "Tune the parent's weights and keep proposals as different as they are good.",
    "HiFo": "Keep what {best} has shown to work; leave {worst}.", "PUCT": "Extend the parent by one step that hasn't been tried below it.", "MCTS": "Go one level deeper: a small change of the parent.",
    "FunSearch": "Improve the program of this island only.", "AlphaEvolve": "Fill a niche that is rare among candidates so far.", "Clade": "Stay within the parent's clade and improve what its members share.",
}


def fallback_family(name: str, index: int) -> str:
    """The family that a policy takes at a step for which there is no proposal."""
    return FALLBACKS[name][index % len(FALLBACKS[name])]


def guidance(name: str, records: list[Record]) -> str:
    """A policy's words for the next proposal, with the families of the best and the weakest valid record."""
    pool = sorted(_valid(records), key=_score)
    return GUIDANCE[name].format(best=pool[-1]["family"] if pool else "the root", worst=pool[0]["family"] if pool else "the root")


def run_policy(name: str, edges: DataFrame, nodes: DataFrame, root: Program, source: ProposalSource, budget: int, rate: float = 0.3, seed: int = 20260603) -> list[Record]:
    """A search of `budget` candidates by one policy; records are scored again after each."""
    search, rng, state = Search(edges, nodes, source, rate), random.Random(seed), {}
    search.add(root, "root", None, "root")
    for i in range(1, budget + 1):
        scores = {r.node_id: r.adapter_score for r in ranking.adapter_scores(search.log(ranking.STAGE1_WEIGHTS)).collect()}
        view = [r | {"rank_score": scores[r["node_id"]], "parent_id": r["parent_node_id"], "island": n % 4, "niche": r["family"], "clade": r["family"]} for n, r in enumerate(search.records)]
        parent = next(r for r in search.records if r["node_id"] == POLICIES[name](view, rng, state)["node_id"])
        if hear := getattr(source, "hear", None):
            hear(guidance(name, view))
        family, program = source.propose(parent, i, None) or (own := fallback_family(name, i), FALLBACK_PROGRAMS[own])
        search.add(program, family, parent, "policy")
    return search.records
