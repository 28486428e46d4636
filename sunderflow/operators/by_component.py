"""Adaptive removal orders by components.

What a program removes next in a component depends on that component alone, and on the phase: how much of the whole graph is
gone, in a few levels. So components are removed in tasks of their own, in bins of several small ones, and the bins' removals
are merged: the bin whose next key is smallest goes next. Behind a bin's largest key so far all that it offers goes at once,
so a merge is a sort by each bin's running maximum. Where a phase ends the bins go on from where the merge has come to.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.projections import both_ways
from ..sources.storage import durable, fresh
from .components import connected_components
from .ordering import numbered, running_sum

#: One thing that a program does: its key, which is compared (smaller goes first) and whose tie belongs to one component, and the
#: node that goes, or -1 where it only renews a key. What it does happens after it was yielded.
Event = tuple[tuple[float, ...], int, int]
Events = Callable[["Residual"], Iterator[Event]]  # noqa: F821

#: Nodes and edges of a graph up to which it isn't cut; nodes of a component that is a bin of its own; nodes of small ones in a bin.
WHOLE, OWN, SMALL = 100_000, 2_000, 5_000


def by_events(events: Events, levels: tuple[float, ...] = ()) -> Callable[["Residual", int], list[int]]:  # noqa: F821
    """The program of these events; levels are the shares removed at which its phases change."""

    def program(g: Residual, steps: int) -> list[int]:  # noqa: F821
        return list(islice((u for _, _, u in events(g) if u >= 0), max(0, steps)))

    program.events, program.levels = events, levels
    return program


def bins_of(edges: DataFrame, nodes: DataFrame, own: int = OWN, small: int = SMALL) -> DataFrame:
    """(graph, id, bin): a component of `own` nodes is a bin, others share one, by a hash."""
    ends = [F.struct("graph", F.col(c).alias("id")).alias(c) for c in ("src", "dst")]
    parts = connected_components(edges.select(*ends)).select("id.graph", "id.id", F.col("component.id").alias("part"))
    known = durable(nodes.select("graph", "id").join(parts, ["graph", "id"], "left").withColumn("part", F.coalesce("part", "id")), "node-parts")
    return binned(known, own, small)


def binned(known: DataFrame, own: int = OWN, small: int = SMALL) -> DataFrame:
    """(graph, id, bin) of known(graph, id, part): a part of `own` nodes is a bin, others share one, by a hash."""
    sizes = known.groupBy("graph", "part").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.where(F.col("n") < own).groupBy("graph").agg(F.ceil(F.sum("n") / small).alias("shared"))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("part"), F.col("shared")).cast("string"))
    named = fresh(sizes.join(rest, "graph", "left")).select("graph", "part", F.when(F.col("n") >= own, F.concat(F.lit("c"), F.col("part").cast("string"))).otherwise(shared).alias("bin"))
    return durable(known.join(named, ["graph", "part"]).select("graph", "id", "bin"), "bins")


def binned_edges(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, bin): edges with their components' bins."""
    ids = both_ways(edges).select("graph", F.col("s").alias("id")).distinct()
    bins = fresh(bins_of(edges, ids)).withColumnRenamed("id", "src")
    return edges.select("graph", "src", "dst").join(bins, ["graph", "src"]).select("graph", "src", "dst", "bin")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to all tasks by these columns, however few bytes they are: each group is long work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _segments(n: int, rate: float, levels: tuple[float, ...]) -> tuple[list[int], list[float]]:
    """The numbers of removals at which phases begin, with the last one's end; and the shares removed that tell phases."""
    steps = max(1, min(n, round(n * rate)))
    share = lambda i: 1.0 - (n - i) / n
    begins = {0}
    for level in levels:
        at = max(0, int(level * n) - 2)
        while at < steps and share(at) < level:
            at += 1
        if at < steps:
            begins.add(at)
    return [*sorted(begins), steps], [share(i) for i in sorted(begins)]


class Offers:
    """Events that a bin offers, in arrays: their numbers, running maxima of their keys and ties, and ids, or none."""

    def __init__(self):
        self.seq, self.tie, self.node, self.renews = array("q"), array("q"), array("q"), array("b")
        self.score, self.ends, self.more = array("d"), array("i", [0]), False

    def add(self, seq: int, score: tuple[float, ...], tie: int, node: int | None) -> None:
        self.seq.append(seq)
        self.score.extend(float(x) + 0.0 for x in score)
        self.ends.append(len(self.score))
        self.tie.append(tie)
        self.node.append(0 if node is None else node)
        self.renews.append(node is None)

    def table(self, graph: pa.Scalar, method: pa.Scalar, name: pa.Scalar) -> pa.Table:
        n = len(self.seq)
        last = np.zeros(n, dtype=bool)
        if n and self.more:
            last[-1] = True
        columns = [
            *[pa.repeat(x, n) for x in (graph, method, name)], pa.array(np.array(self.seq, "int64")), pa.ListArray.from_arrays(np.array(self.ends, "int32"), np.array(self.score, "float64")),
            pa.array(np.array(self.tie, "int64")), pa.array(np.array(self.node, "int64"), mask=np.array(self.renews, "bool")), pa.array(last), pa.repeat("", n), pa.repeat(0.0, n),
        ]
        return pa.table(columns, names=["graph", "method", "bin", "seq", "score", "tie", "node", "last", "error", "time_s"])


def _pairs(links: pa.Table) -> Iterator[tuple[int, int]]:
    for b in links.select(["src", "dst"]).to_batches(max_chunksize=10_000):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def merged_orders(edges: DataFrame, nodes: DataFrame, bins: DataFrame, programs: dict[str, Callable], rate: float, limit: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(orders(graph, method, step, node) up to rate, bins' runs(graph, method, bin, error, time_s)) of programs with events.

    limit runs a call and gives (answer, error, seconds). A bin first runs for thrice its share of a phase's removals; if the merge
    uses up what a bin offers while it has more, the phase is run again for more.
    """
    from .adaptive import Residual

    spark = edges.sparkSession
    sizes = {r.graph: r.n for r in nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).collect()}
    plans = {(g, m): _segments(n, rate, p.levels) for g, n in sizes.items() for m, p in programs.items()}
    binned = nodes.select("graph", "id", "pos").join(fresh(bins), ["graph", "id"])
    own = durable(numbered(binned, ["graph"], [F.col("id").cast("string")], "text"), "binned-nodes")
    pairs = durable(edges.select("graph", "src", "dst").join(fresh(bins).withColumnRenamed("id", "src"), ["graph", "src"]), "binned-edges")
    size = own.groupBy("graph", "bin").agg(F.count(F.lit(1)).alias("many"))
    methods = spark.createDataFrame([(m,) for m in programs], "method string")
    marks = durable(size.crossJoin(F.broadcast(methods)).select("graph", "method", "bin", "many", F.array().cast("array<long>").alias("done"), F.array().cast("array<boolean>").alias("mine")), "marks")

    def run(phase: int, factor: int) -> Callable:
        def events(key: tuple, rows: pa.Table, links: pa.Table) -> pa.Table:
            graph, method = key[0].as_py(), key[1].as_py()
            rows = rows.sort_by("pos")
            begins, shares = plans[graph, method]
            ids, done, mine = rows["id"].to_pylist(), rows["done"][0].as_py(), rows["mine"][0].as_py()
            first, segment = done[-1] if done else 0, begins[phase + 1] - begins[phase]
            quota = min(segment, factor * -(-segment * len(ids) // sizes[graph]) + 64)

            def schedule(seq: int) -> tuple[float, float]:
                at = bisect_right(done, seq)
                return shares[at], shares[at + 1] if at < len(done) and mine[at] and seq == done[at] - 1 else shares[at]

            def offered() -> dict:
                g = Residual(ids, _pairs(links), rows["text"].to_pylist())
                g.schedule = schedule
                out, taken, top = Offers(), 0, None
                for seq, (score, tie, u) in enumerate(programs[method].events(g)):
                    if seq >= first:
                        if taken == quota:
                            out.more = True
                            break
                        top = (score, tie) if top is None else max(top, (score, tie))
                        out.add(seq, *top, ids[u] if u >= 0 else None)
                        taken += u >= 0
                return vars(out)  # arrays, which limit can send from a process

            found, error, took = limit(offered) if limit else (offered(), "", 0.0)
            out, ran = Offers(), Offers()
            vars(out).update(found or {})
            answer = out.table(*key)
            if not limit:
                return answer
            ran.add(-1, (), 0, None)
            ran = ran.table(*key).drop_columns(["error", "time_s"]).append_column("error", pa.array([error], "string")).append_column("time_s", pa.array([took], "double"))
            return pa.concat_tables([answer, ran])

        return events

    schema = "graph string, method string, bin string, seq long, score array<double>, tie long, node long, last boolean, error string, time_s double"
    orders, runs = [], []
    for phase in range(max((len(b) - 1 for b, _ in plans.values()), default=0)):
        ends = [(g, m, b[phase], b[phase + 1] - b[phase]) for (g, m), (b, _) in plans.items() if phase + 1 < len(b)]
        limits = spark.createDataFrame(ends, "graph string, method string, begin long, take long")
        now = marks.join(F.broadcast(limits.select("graph", "method")), ["graph", "method"])
        left = own.join(fresh(now.select("graph", "method", "bin", "done", "mine")), ["graph", "bin"]).groupBy("graph", "method", "bin")
        right = fresh(pairs.join(fresh(now.select("graph", "method", "bin")), ["graph", "bin"])).groupBy("graph", "method", "bin")
        factor = 3
        while True:
            found = durable(left.cogroup(right).applyInArrow(run(phase, factor), schema), "events")
            order = [F.col("score"), F.col("tie"), F.col("bin"), F.col("seq")]
            placed = running_sum(found.where("seq >= 0").select("graph", "method", "bin", "seq", "score", "tie", "node", "last"), ["graph", "method"], order, F.col("node").isNotNull().cast("long"), "place")
            placed = placed.drop("score", "tie").join(F.broadcast(limits), ["graph", "method"])
            taken = durable(placed.where("place < take OR (place = take AND node IS NOT NULL)").drop("score", "tie"), "taken")
            if taken.where("last AND place < take").isEmpty():
                break
            factor *= 4
        orders.append(taken.where("node IS NOT NULL").select("graph", "method", (F.col("begin") + F.col("place")).alias("step"), "node"))
        runs.append(found.where("seq < 0").select("graph", "method", "bin", "error", "time_s"))
        reached = taken.groupBy("graph", "method", "bin").agg((F.max("seq") + 1).alias("_upto"), F.max(F.col("place") == F.col("take")).alias("_mine"))
        at = F.coalesce("_upto", F.element_at("done", -1) if phase else F.lit(0).cast("long"))
        marks = durable(now.join(fresh(reached), ["graph", "method", "bin"], "left").select("graph", "method", "bin", "many", F.array_append("done", at).alias("done"), F.array_append("mine", F.coalesce("_mine", F.lit(False))).alias("mine")), "marks", marks)
    if not orders:
        empty = spark.createDataFrame([], "graph string, method string, bin string, error string, time_s double")
        return spark.createDataFrame([], "graph string, method string, step long, node long"), empty
    return reduce(DataFrame.unionByName, orders), reduce(DataFrame.unionByName, runs)
