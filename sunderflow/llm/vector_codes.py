"""Vector code compression: product codes whose nearest entries are found by a VA-file over the codebook.

Vectors become whole numbers (floor(1024 x)) and are cut into PARTS equal parts; each part position has a codebook of up
to ENTRIES entries, refined in ROUNDS rounds. The nearest entry of a part is found in two steps. Each coordinate of the
entries is cut into 2^BITS cells; for a part (the query) tables hold, per coordinate and cell, the least and greatest
squared distance to anything in that cell, so that the sums over an entry's cells bound its distance from below and
above. Only entries whose lower bound is within the least upper bound are refined with whole-number distances.

Spark moves no vector: they are written once as whole numbers, each round maps over them with the codebooks (ENTRIES times
a vector's length, whatever the rows) as a broadcast, and sums and counts per entry are added up per task and then by a
grouped aggregation. All arithmetic is in whole numbers, so the result doesn't depend on the order of rows or tasks.

Rows whose vector is null or holds null, NaN or an infinity are dropped. Of the others the commonest length that PARTS
divides (of ties the greatest) is the table's; rows of other lengths, empty ones included, are kept with null code and
error and take no part. Whole numbers beyond +-2^24 (components beyond 16,384) count as that bound, so that squared
distances of vectors of up to 4,096 components fit 64 bits; sums of errors that don't end at 2^63 - 1. The first entries
are those of the smallest vec_ids, repeated ids in order of their vectors, a null id last; with fewer rows there are fewer
entries. Repeated rows are rows of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, durable

PARTS, ENTRIES, ROUNDS, BITS = 4, 256, 4, 4
SCALE, MOST = 1024, 1 << 24
_QUERIES = 1024


class CellFile:
    """The entries of one part position by cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        count, width = entries.shape
        cells = 1 << bits
        # Cells hold equal shares of a coordinate's distinct values; a cell reaches from its least to its greatest value.
        self.cell = np.empty((width, count), np.intp)
        self.low, self.high = np.zeros((2, width, cells), np.int64)
        for j in range(width):
            values, place = np.unique(entries[:, j], return_inverse=True)
            of = np.arange(len(values)) * cells // len(values)
            self.cell[j] = of[place]
            self.low[j, of[::-1]] = values[::-1]
            self.high[j, of] = values

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible squared distance of every entry (rows) to every query (columns)."""
        shape = (len(self.entries), len(queries))
        least, most = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for j, x in enumerate(queries.T):
            below, above = self.low[j, :, None] - x, x - self.high[j, :, None]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)
            least += (near * near)[self.cell[j]]
            most += (far * far)[self.cell[j]]
        return least, most

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry, of ties the first, and its squared distance."""
        least, most = self.bounds(queries)
        query, entry = np.nonzero((least <= most.min(axis=0)).T)
        away = queries[query] - self.entries[entry]
        distance = np.einsum("ij,ij->i", away, away)
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        best = np.minimum.reduceat(distance, starts)
        at = np.flatnonzero(distance == np.repeat(best, np.diff(np.r_[starts, len(query)])))
        first = at[np.r_[True, query[at][1:] != query[at][:-1]]]
        return entry[first], best


def assigned(vectors: np.ndarray, books: list[CellFile]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part of every vector."""
    width = vectors.shape[1] // len(books)
    codes, errors = np.empty((2, len(vectors), len(books)), np.int64)
    for a in range(0, len(vectors), _QUERIES):
        for p, book in enumerate(books):
            codes[a : a + _QUERIES, p], errors[a : a + _QUERIES, p] = book.nearest(vectors[a : a + _QUERIES, p * width : (p + 1) * width])
    return codes, errors


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)


def _finite(v: Column) -> Column:
    x = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return v.isNotNull() & ~F.exists(v, x)


def _whole(v: Column) -> Column:
    return F.transform(v, lambda e: F.least(F.greatest(F.floor(e.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that are kept, their components as whole numbers."""
    rows = embeddings.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector")).where(_finite(F.col("vector")))
    return rows.withColumn("vector", _whole(F.col("vector")))


def _length(rows: DataFrame, parts: int) -> int | None:
    """The table's length of vectors."""
    kinds = rows.groupBy(F.size("vector").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    most = kinds.orderBy(F.desc("count"), F.desc("n")).first()
    return most and most.n


def _refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the floor of its parts' mean, unused ones as they were."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in books]
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            found = _matrix(batch.column(0))
            codes, _ = assigned(found, files)
            for p, (total, count) in enumerate(zip(totals, counts, strict=True)):
                np.add.at(total, codes[:, p], found[:, p * width : (p + 1) * width])
                count += np.bincount(codes[:, p], minlength=len(count))
        rows = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "total"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    total = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry at most
        out[r.part][r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
    return out


def _encoded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds code and error."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        files = [CellFile(b) for b in books]
        for batch in batches:
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["code", "error"])
                continue
            codes, errors = assigned(_matrix(batch), files)
            yield pa.StructArray.from_arrays([pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(errors.sum(axis=1))], ["code", "error"])

    found = F.arrow_udf(encode, "code string, error long")("vector")
    return vectors.withColumn("_c", found).select("vec_id", "label", "_c.code", "_c.error")


def codebooks(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, an array of entries by components, learned from all vectors of that length."""
    first = vectors.select("vector", "vec_id").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    whole = np.array([r.vector for r in first], np.int64)
    books = [whole[:, a : a + length // parts] for a in range(0, length, length // parts)]
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) for every kept row, the codebooks). entries is 256 at most: a code is a byte a part."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte a part: entries must be 1 to 256")
    rows = durable(whole_vectors(embeddings), "whole-vectors")
    length = _length(rows, parts)
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if length is None:
        return rows.select("vec_id", "label", *none), []
    fit = F.size("vector") == length
    books = codebooks(rows.where(fit), length, parts, entries, rounds)
    return _encoded(rows.where(fit), books).unionByName(rows.where(~fit).select("vec_id", "label", *none)), books


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds vector: the entries that a code names, as components of the original scale; null without a code."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([None if t is None else np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(t), strict=True)]) / SCALE for t in texts], pa.list_(pa.float64()))

    return codes.withColumn("vector", F.arrow_udf(run, "array<double>")("code"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = durable(codes, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = durable(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    met = codes.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds one after another: a<r> the assignment in round r, b<r> the codebooks after it."""
    near = """
a{r} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM p JOIN b{r} b ON b.part = p.part)
  GROUP BY rid, part),"""
    book = """
u{s} AS MATERIALIZED (
  SELECT part, entry, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS x
  FROM (SELECT a.part, a.entry, i, (sum(p.x[i]) - ((sum(p.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
        FROM a{r} a JOIN p ON p.rid = a.rid AND p.part = a.part, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i)
        GROUP BY a.part, a.entry, i)
  GROUP BY part, entry),
b{s} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{s} u ON u.part = b.part AND u.entry = b.entry),"""
    rounds = "".join(near.format(r=r) + book.format(r=r, s=r + 1) for r in range(ROUNDS)) + near.format(r=ROUNDS)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {ENTRIES}),{rounds}
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM a{ROUNDS} a JOIN v ON v.rid = a.rid GROUP BY v.rid, v.vec_id, v.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""


OP11_SQL = _sql()
