"""Line deduplication: lines that many documents share go, but for one document's.

Lines are exploded, normalised and hashed (128 bits); a hash held by at least min_docs documents loses all its lines
except those of the smallest doc_id holding it. Rows meet again by position: only the dropped positions travel to the
text, which moves once.

A null or empty text is one empty line. A null doc_id counts as one document that comes last. Rows that repeat a
doc_id belong to one document for the counts, and each gets its own result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, ascii_lower, documents, durable, key128, trimmed

MIN_POINTS, MIN_DOCS = 10, 2
_LAST = 2**63 - 1


def lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(_id, _th, _at, _h1, _h2): every line whose key has at least min_points code points."""
    rows = docs.select(_id(), _text_hash(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_at", "_line"))
    stripped = rows.withColumn("_line", trimmed(F.col("_line"))).where(F.length("_line") >= min_points)
    return stripped.select("_id", "_th", "_at", *key128(ascii_lower(F.col("_line"))))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id")


def _text_hash() -> Column:
    return F.xxhash64("text").alias("_th")


def _kept(drop: Column) -> Column:
    """The lines of _lines outside the sorted positions in drop: slices between them, so linear in the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    ends = F.concat(drop, F.array(F.size("_lines")))
    return F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice("_lines", x["s"] + 1, x["e"] - x["s"])))


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row."""
    found = durable(lines(docs, min_points), "lines")
    common = found.groupBy("_h1", "_h2").agg(F.countDistinct("_id").alias("_docs"), F.min("_id").alias("_owner")).where(F.col("_docs") >= min_docs)
    common = durable(common.select("_h1", "_h2", "_owner"), "common-lines")  # so that the join can split a hot line
    dropped = found.join(common, ["_h1", "_h2"]).where(F.col("_id") != F.col("_owner"))
    positions = dropped.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_at")).alias("_drop"))
    rows = docs.select("doc_id", _id(), _text_hash(), "text")
    met = rows.join(positions.hint("shuffle_hash"), ["_id", "_th"], "left")
    drop = F.coalesce("_drop", F.array().cast("array<int>"))
    split = met.select("doc_id", drop.alias("_drop"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.when(F.size("_drop") == 0, F.col("_text")).otherwise(F.array_join(_kept(F.col("_drop")), "\n"))
    return split.select("doc_id", kept.alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
c AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.owner AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
