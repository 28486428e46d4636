"""Connected components by local forests and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges that one task joins by itself.
LOCAL = 100_000


def _keys(column: pa.Array) -> list:
    rows = column.to_pylist()
    return [tuple(r.values()) for r in rows] if pa.types.is_struct(column.type) else rows


def _column(keys: list, kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind] if pa.types.is_struct(kind) else None
    return pa.array([dict(zip(names, k, strict=True)) for k in keys] if names else keys, kind)


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """Each task's edges (a, b) as stars around the smallest ids that they join; a task holds at most `most` at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x: object) -> object:
            top = x
            while above.get(top, top) != top:
                top = above[top]
            while above.get(x, x) != top:
                above[x], x = top, above[x]
            return top

        def stars(kind: pa.DataType) -> pa.RecordBatch:
            found = [(x, r) for x in above if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([_column([x for x, _ in found], kind), _column([r for _, r in found], kind)], ["a", "b"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for x, y in zip(_keys(b.column(0)), _keys(b.column(1)), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    if len(above) >= most:
                        yield stars(kind)
                        above.clear()
        if above:
            yield stars(kind)

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local: int = LOCAL) -> DataFrame:
    """(id, component) for every endpoint of an edge; component is the smallest id reachable.

    First every task replaces its `local` edges, a range of them, as near ids are often joined, by the forest of stars that joins the
    same ids; where one task has them all, that is the result. Otherwise each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and
    itself (small star). All steps are aggregations and equi-joins, without broadcasts; a hub's neighbours are never gathered. Rounds are
    written tables and go on until the edges don't change any more, when they are stars around the components' smallest ids.
    """
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("a"))
    now = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    now = durable(now, "stars")
    parts = -(-now.count() // local)
    if parts:
        now = durable(_forests(now.select("a", "b").repartitionByRange(parts, "a", "b"), 2 * local), "stars", now)
    before = _mark(now) if parts > 1 else (0, None)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        met = large.join(least.hint("merge"), F.col("a") == F.col("u"))
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = durable(small.distinct(), "stars", now)
        if (after := _mark(now)) == before:
            break
        before = after
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    known = found.unionByName(roots)
    return known.unionByName(alone.join(known.select("id").hint("merge"), "id", "left_anti")).distinct()
