"""Removal programs and seed programs as table functions, for SQL and for lateral joins.

    SELECT * FROM removal_order(TABLE(edges), 'HDA', 0.3D)
    SELECT * FROM seed_order(TABLE(edges), 'Degree', 5)

The table has graph, src and dst (more columns may follow); each graph is a partition of its own, and its nodes are those of
its edges, by id. Null ends are left out, loops and repeated edges count once or not at all. A program that fails or takes
too long gives one row with its error; a name that isn't known is an error of the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from ..operators.adaptive import PROGRAMS, Residual
from .seed_search import SEED_PROGRAMS
from .validation import limited

_RESULT = "graph string, method string, step bigint, node bigint, error string"


def _checked(schema: StructType, edges: AnalyzeArgument, method: AnalyzeArgument, known: set[str]) -> AnalyzeResult:
    if not edges.isTable or not {"graph", "src", "dst"} <= set(edges.dataType.names):
        raise ValueError("the first argument is a table of edges: graph, src, dst")
    if method.value not in known:
        raise ValueError(f"no program {method.value!r}; there are {', '.join(sorted(known))}")
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("graph")])


def _function(programs: dict[str, Callable], schema: StructType, amount: Callable[[int, float | None], int], whole: bool, seconds: float) -> type:
    """A table function's class; what it needs goes with it to the executors."""
    known = set(programs)

    class Order:
        def __init__(self) -> None:
            self.graph: str | None = None
            self.method, self.limit, self.pairs = "", None, set()

        @staticmethod
        def analyze(edges: AnalyzeArgument, method: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
            return _checked(schema, edges, method, known)

        def eval(self, row: Row, method: str, limit: float | None) -> None:
            self.graph, self.method, self.limit = row["graph"], method, limit
            a, b = row["src"], row["dst"]
            if a is not None and b is not None and a != b:
                self.pairs.add((min(a, b), max(a, b)))

        def terminate(self) -> Iterator[tuple]:
            ids = sorted({x for pair in self.pairs for x in pair})
            if not ids:
                return
            g = Residual(ids, self.pairs)
            many = amount(len(ids), self.limit)
            found, error, _ = limited(lambda: list(programs[self.method](g, many) or []), seconds)
            order = [u for u in dict.fromkeys(found or []) if isinstance(u, int) and 0 <= u < len(ids)][:many]
            if not error and not order:
                error = "no node of the graph"
            if error:
                yield self.graph, self.method, None, None, error
                return
            if whole:
                taken = set(order)
                order += [u for u in range(len(ids)) if u not in taken]
            for step, u in enumerate(order, 1):
                yield self.graph, self.method, step, ids[u], None

    return Order


def removal_order(programs: dict[str, Callable] = PROGRAMS, seconds: float = 60.0) -> UserDefinedTableFunction:
    """removal_order(edges, method, rate): complete orders; beyond rate (null: .3) nodes go by id."""
    steps = lambda n, rate: max(1, min(n, round(n * (0.3 if rate is None else float(rate)))))
    return udtf(_function(dict(programs), StructType.fromDDL(_RESULT), steps, True, seconds))


def seed_order(programs: dict[str, Callable] = SEED_PROGRAMS, seconds: float = 60.0) -> UserDefinedTableFunction:
    """seed_order(edges, method, k): k seeds of each graph (null: its budget)."""
    many = lambda n, k: min(n, int(k) if k is not None else max(3, min(12, round(0.05 * n))))
    return udtf(_function(dict(programs), StructType.fromDDL(_RESULT), many, False, seconds))


def register_functions(spark: SparkSession, seconds: float = 60.0, removal: dict[str, Callable] = PROGRAMS, seeding: dict[str, Callable] = SEED_PROGRAMS) -> None:
    """Makes both known to a session's SQL by their names."""
    spark.udtf.register("removal_order", removal_order(removal, seconds))
    spark.udtf.register("seed_order", seed_order(seeding, seconds))
