"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources share the budget by weight; a source whose share exceeds its cap (max_epochs times its size) is clamped there
and the excess goes to the others by weight, until none is above. Clamping in order of cap over weight reaches that
state in one sorted pass: the clamped sources are a prefix of that order. A source is then taken whole
floor(target / size) times, and the remaining fraction as a seeded sample of whole documents: those first in an
order shuffled by doc_id and text that fit, then the one document whose size best fills what is left.

Null text has size 0 and is never sampled; null sources are one source, last in order. Rows that agree in everything
are interchangeable. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import F, Window, bucket_count, documents, durable, hex_bucket, null_safe_key, running_total, seeded, word_count

SEED, MAX_EPOCHS, WEIGHTS = 29, 3, (5, 2, 1)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(_sn, _sv, source_size) -> also target: words that the mix takes of the source. One row per source."""
    big = "decimal(38,0)"
    everything = Window.partitionBy("_all")
    named = sizes.withColumn("_all", F.lit(0)).withColumn("_i", F.row_number().over(everything.orderBy("_sn", "_sv")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast(big)
    named = named.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * max_epochs).cast(big))
    for total, of in (("_words", F.col("source_size").cast(big)), ("_weights", F.col("_w"))):
        named = named.withColumn(total, F.sum(of).over(everything).cast(big))
    filled = everything.orderBy((F.col("_cap") / F.col("_w")).cast("double"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    for before, of in (("_caps_before", "_cap"), ("_weights_before", "_w")):
        named = named.withColumn(before, F.coalesce(F.sum(of).over(filled), F.lit(0)).cast(big))
    named = named.withColumn("_clamped", F.expr("_cap * (_weights - _weights_before) <= (_words - _caps_before) * _w"))
    left = F.col("_words") - F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0)).over(everything)
    heavy = F.col("_weights") - F.sum(F.when(F.col("_clamped"), F.col("_w")).otherwise(0)).over(everything)
    level = left.cast("double") / F.nullif(heavy.cast("double"), F.lit(0.0)) * F.col("_w").cast("double")
    return named.withColumn("target", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(level)).select("_sn", "_sv", "source_size", "target")


def repetitions(rows: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes the row) to rows with doc_id, size, _sn, _sv, _k."""
    plan = targets(rows.groupBy("_sn", "_sv").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), max_epochs, weights)
    plan = plan.withColumn("_whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    plan = durable(plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-plan")
    buckets = bucket_count(rows.count())
    order = [F.col("_k"), F.col("doc_id"), F.col("size")]
    summed = running_total(rows.withColumn("_b", hex_bucket(F.col("_k"), buckets)), ["_sn", "_sv"], "_b", order, F.col("size"), "_cum")
    summed = durable(summed.drop("_b").join(plan, ["_sn", "_sv"]).withColumn("_in", (F.col("_cum") <= F.col("_rest")) & (F.col("size") > 0)), "mix-sums")
    used = summed.groupBy("_sn", "_sv").agg(F.max("_rest").alias("_rest"), F.coalesce(F.max(F.when(F.col("_in"), F.col("_cum"))), F.lit(0)).alias("_used"))
    gaps = durable(used.select("_sn", "_sv", (F.col("_rest") - F.col("_used")).alias("_gap")), "mix-gaps")
    offered = summed.where(~F.col("_in") & (F.col("size") > 0)).join(gaps, ["_sn", "_sv"]).withColumn("_miss", F.abs(F.col("size") - F.col("_gap")))
    fills = offered.where(F.col("_miss") < F.col("_gap")).groupBy("_sn", "_sv").agg(F.min(F.struct("_miss", "_cum")).alias("_fill"))
    out = summed.join(durable(fills, "mix-fills"), ["_sn", "_sv"], "left")  # a table, so that a hot source can be split
    extra = F.col("_in") | F.coalesce((F.col("_fill._cum") == F.col("_cum")) & (F.col("size") > 0), F.lit(False))
    return out.withColumn("copies", F.col("_whole") + extra.cast("long")).drop("_whole", "_rest", "_cum", "_in", "_fill")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    rows = docs.select("doc_id", word_count(F.col("text")).alias("size"), *null_safe_key(F.col("source")), seeded(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("_k"))
    out = repetitions(durable(rows, "mix-rows"), max_epochs, weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS sv, md5(concat_ws('|', '29', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT sn, sv, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sn, sv),
w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY sn, sv) - 1) % 3 + 1 AS BIGINT)] AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS words FROM s),
o AS (
  SELECT *, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before FROM w
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, sn, sv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (weights - weights_before) <= (words - caps_before) * weight AS clamped FROM o),
t AS (
  SELECT *, CASE WHEN clamped THEN CAST(cap AS DOUBLE)
       ELSE CAST(words - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS DOUBLE)
            / CAST(weights - sum(CASE WHEN clamped THEN weight ELSE 0 END) OVER () AS DOUBLE) * weight END AS target FROM c),
e AS (SELECT sn, sv, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
q AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
         CAST(sum(size) OVER (PARTITION BY d.sn, d.sv ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN e ON d.sn = e.sn AND d.sv = e.sv),
u AS (SELECT *, cum <= rest AND size > 0 AS taken_once FROM q),
g AS (SELECT sn, sv, max(rest) - coalesce(max(cum) FILTER (WHERE taken_once), 0) AS gap FROM u GROUP BY sn, sv),
m AS (
  SELECT u.sn, u.sv, arg_min(cum, {'miss': abs(size - gap), 'cum': cum}) AS fill FROM u JOIN g ON u.sn = g.sn AND u.sv = g.sv
  WHERE NOT taken_once AND size > 0 AND abs(size - gap) < gap GROUP BY u.sn, u.sv)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN taken_once OR (size > 0 AND cum IS NOT DISTINCT FROM fill) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u LEFT JOIN m ON u.sn = m.sn AND u.sv = m.sv
"""
