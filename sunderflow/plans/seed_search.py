"""Programs that choose seeds: validation, scores under fixed worlds, and the search with them.

A program takes a Residual and k and returns nodes, the first to be taken first. It runs per graph in a process beside
the task, which is killed at the time limit; only run code that you trust.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diffusion, ranking, selection
from ..operators.adaptive import Residual
from ..operators.diffusion import SEED
from ..sources.storage import durable, fresh
from .validation import limited

SeedProgram = Callable[[Residual, int], list[int]]
#: Fixed worlds and reverse reachable sets that programs are scored under (fixed values).
WORLDS, SETS, P = 1024, 1024, 0.1


def discounted_degree(p: float = P) -> SeedProgram:
    """The root of searches: degree, less what chosen neighbours make redundant."""

    def choose(g: Residual, k: int) -> list[int]:
        met, chosen = dict.fromkeys(g.alive, 0), []
        for _ in range(min(k, g.n)):
            value = lambda u: g.degree(u) - 2 * met[u] - (g.degree(u) - met[u]) * met[u] * p
            u = max(met.keys() - set(chosen), key=lambda u: (value(u), g.degree(u), g.text[u]))
            chosen.append(u)
            for v in g.near[u]:
                met[v] += 1
        return chosen

    return choose


def largest_degree(g: Residual, k: int) -> list[int]:
    return sorted(g.alive, key=lambda u: (g.degree(u), g.text[u]), reverse=True)[:k]


def spread_apart(g: Residual, k: int) -> list[int]:
    """By degree, without neighbours of chosen nodes as long as there are others."""
    order, chosen, covered = largest_degree(g, g.n), [], set()
    for u in order:
        if u not in covered:
            chosen.append(u)
            covered |= {u, *g.near[u]}
    return [*chosen, *(u for u in order if u not in set(chosen))][:k]


SEED_PROGRAMS: dict[str, SeedProgram] = {"Root": discounted_degree(), "Degree": largest_degree, "Apart": spread_apart}


def register_seeds(name: str, program: SeedProgram) -> None:
    """Makes a program callable by name. It runs as it is: only register code that you trust."""
    SEED_PROGRAMS[name] = program


def budgets(nodes: DataFrame) -> DataFrame:
    """(graph, n, k): each graph's size and seed budget."""
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).withColumn("k", scalars.seed_budget(F.col("n")))


def run_seed_programs(edges: DataFrame, nodes: DataFrame, programs: dict[str, SeedProgram], seconds: float = 60.0) -> DataFrame:
    """(graph, method, valid, error, time_s, raw_seed_size, seeds): what each program answers on each graph.

    seeds are the first k different nodes of the graph in the answer; an answer without any is invalid, as is one that
    isn't a list, takes too long or fails.
    """

    def cell(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = own.sort_values("pos")["id"].tolist()
        g = Residual(ids, zip(pairs["src"].tolist(), pairs["dst"].tolist(), strict=True))
        k = int(own["k"].iloc[0]) if ids else 0
        found, error, took = limited(lambda: list(programs[key[1]](g, k) or []), seconds)
        raw = found or []
        seeds = [ids[u] for u in dict.fromkeys(u for u in raw if isinstance(u, int) and 0 <= u < len(ids))][:k]
        error = error or ("" if seeds else "no seed of the graph")
        return pd.DataFrame({"graph": [key[0]], "method": [key[1]], "valid": [not error], "error": [error], "time_s": [took], "raw_seed_size": [len(raw)], "seeds": [seeds]})

    cells = edges.sparkSession.createDataFrame([(m,) for m in programs], "method string")  # as many rows as programs
    left = nodes.select("graph", "id", "pos").join(budgets(nodes), "graph").join(F.broadcast(cells)).groupBy("graph", "method")
    right = fresh(edges.select("graph", "src", "dst").join(F.broadcast(cells))).groupBy("graph", "method")
    return left.cogroup(right).applyInPandas(cell, "graph string, method string, valid boolean, error string, time_s double, raw_seed_size long, seeds array<bigint>")


@dataclass
class Worlds:
    """Fixed worlds and reverse reachable sets of graphs; every program meets the same."""

    edges: DataFrame
    nodes: DataFrame
    p: float = P
    worlds: int = WORLDS
    sets: int = SETS
    seed: int = SEED
    parts: DataFrame = field(init=False)
    reached: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.parts = durable(diffusion.live_components(diffusion.live_edges(self.edges, self.worlds, self.p, self.seed)), "world-parts")
        arc = durable(diffusion.arcs(self.edges, self.p), "arcs")
        self.reached = durable(diffusion.reverse_sets(self.nodes, arc, self.sets, self.seed), "world-sets")


def evaluate_seeds(worlds: Worlds, programs: dict[str, SeedProgram], seconds: float = 60.0) -> DataFrame:
    """One row per (graph, method): valid, error, time_s, raw_seed_size, seed_nodes, spread_ic and rr_coverage.

    Valid answers are filled up to the budget; invalid rows have no measures.
    """
    found = durable(run_seed_programs(worlds.edges, worlds.nodes, programs, seconds), "seed-cells")
    raw = found.where("valid").select("graph", "method", F.posexplode("seeds").alias("step", "node"))
    full = None
    for r in budgets(worlds.nodes).groupBy("k").agg(F.collect_set("graph").alias("graphs")).collect():  # ten budgets at most
        part = diffusion.normal_seeds(raw.where(F.col("graph").isin(r.graphs)), worlds.nodes, r.k)
        full = part if full is None else full.unionByName(part)
    if full is None:
        return found.drop("seeds").select("*", F.lit(None).cast("array<bigint>").alias("seed_nodes"), F.lit(None).cast("double").alias("spread_ic"), F.lit(None).cast("double").alias("rr_coverage"))
    full = durable(full, "full-seeds")
    named = full.groupBy("graph", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("seed_nodes"))
    spread = diffusion.live_spread(full, worlds.parts, worlds.nodes, worlds.worlds).withColumnRenamed("spread", "spread_ic")
    coverage = diffusion.reverse_coverage(full, worlds.reached, worlds.sets).withColumnRenamed("coverage", "rr_coverage")
    out = found.drop("seeds")
    for part in (named, spread, coverage):
        out = out.join(part, ["graph", "method"], "left")
    return out


_LOG = "node_id string, parent_node_id string, candidate_id string, family string, depth int, tree_branch string, valid boolean, error string, spread_ic double, relative_spread_ic double, rr_coverage double, time_s double"


def run_seed_search(worlds: Worlds, root: SeedProgram, propose: Callable[[dict, int], tuple[str, SeedProgram]], budget: int, spread_only: bool = False, seconds: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(log with rank_score, best and fast candidate) of a search of `budget` candidates from a root program.

    propose takes the parent's record and the step's number and gives a family's name and a program. Measures are means
    over graphs; a candidate that is invalid on one of them is invalid. Relative spread is over the root's.
    """
    spark, records = worlds.edges.sparkSession, []

    def add(program: SeedProgram, family: str, parent: dict | None) -> None:
        one = evaluate_seeds(worlds, {"candidate": program}, seconds).agg(F.every("valid").alias("valid"), F.max("error").alias("error"), *[F.avg(c).alias(c) for c in ("spread_ic", "rr_coverage", "time_s")]).first().asDict()
        base = records[0]["spread_ic"] if records else one["spread_ic"]
        gain = None if one["spread_ic"] is None or base is None else one["spread_ic"] - base
        name = f"seeds-{len(records):04d}"
        records.append({"node_id": name, "parent_node_id": parent and parent["node_id"], "candidate_id": name, "family": family, "depth": parent["depth"] + 1 if parent else 0, "tree_branch": "", "relative_spread_ic": gain, **one})

    def log() -> DataFrame:
        columns = [c.split()[0] for c in _LOG.split(", ")]
        return ranking.spread_scores(spark.createDataFrame([tuple(r[c] for c in columns) for r in records], _LOG), spread_only=spread_only)

    add(root, "root", None)
    for i in range(1, budget + 1):
        chosen = selection.expandable_parent(log()).first()
        if chosen is None:
            raise ValueError("the tree has no valid node to expand")
        parent = next(r for r in records if r["node_id"] == chosen.node_id)
        family, program = propose(parent, i)
        add(program, family, parent)
    ranked = durable(log(), "seed-log")
    return ranked, selection.influence_two(ranked)
