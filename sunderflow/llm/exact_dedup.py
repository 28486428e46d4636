"""Exact deduplication by recipes of content-defined chunks (DataFrame functions only).

A text, without its white space, is cut where its content says so; chunks get verified identifiers, and texts are
equal when their ordered identifier lists are. A chunk's bytes move once, to be verified; recipes (8 bytes a chunk)
move from then on, never the documents.

Null text counts as empty; empty texts are equal to each other. Rows that repeat a doc_id are rows of their own: of
rows that tie in length and doc_id one stays. A null doc_id comes after all others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, Window, documents, durable, without_spaces

#: A chunk ends after any of these letter pairs once it has MIN_CHUNK characters, and at MAX_CHUNK at the latest.
BOUNDARY = "[aeiouy\\x{e0}-\\x{ff}][.,;:!?0-9]|[b-df-hj-np-tv-z][A-Z]|[\\x{3002}\\x{ff0c}\\x{640}]"
MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def cut(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text as an array, in order; they join to the text again."""
    pattern = f"(?s).{{{least},{most}}}?(?:{BOUNDARY})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashing_chunks(chunks: DataFrame) -> DataFrame | None:
    """(_h, chunk, _rank): the chunks whose hash other chunks have too, numbered within it; None if there are none."""
    seen = chunks.groupBy("_h", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    several = durable(seen.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h"), "chunk-clashes")
    if several.isEmpty():
        return None
    w = Window.partitionBy("_h").orderBy("chunk")
    return seen.join(several, "_h", "left_semi").select("_h", "chunk", F.row_number().over(w).cast("long").alias("_rank"))


def recipes(docs: DataFrame, hashed: Callable[[Column], Column] = chunk_hash, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, n_points, text_sha256, recipe): recipe lists the verified identifiers of the text's chunks.

    An identifier is the chunk's hash; where different chunks share one (found by comparing the chunks themselves),
    the chunk's number among them follows it in the list.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("n_points"), without_spaces(text).alias("_norm"))
    chunks = rows.select(F.explode(cut(F.col("_norm"), least, most)).alias("chunk")).select(hashed(F.col("chunk")).alias("_h"), "chunk")
    clashes = clashing_chunks(chunks)
    parts = rows.select("doc_id", "n_points", F.sha2("_norm", 256).alias("text_sha256"), cut(F.col("_norm"), least, most).alias("_chunks"))
    plain = parts.withColumn("recipe", F.transform("_chunks", lambda c: hashed(c)))
    if clashes is None:
        return plain.drop("_chunks")
    # Some hashes stand for several texts: the documents with such chunks get numbered identifiers.
    named = plain.withColumn("_row", F.struct("doc_id", "n_points", "text_sha256"))
    flat = named.select("_row", F.posexplode("_chunks").alias("_at", "chunk")).withColumn("_h", hashed(F.col("chunk")))
    marks = flat.join(clashes, ["_h", "chunk"]).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("_at", "_rank"))).alias("_marks"))
    suffix = F.coalesce(F.flatten(F.transform("_marks", lambda m: F.array(m["_at"].cast("long"), m["_rank"]))), F.array().cast("array<bigint>"))
    return named.join(marks, "_row", "left").withColumn("recipe", F.concat("recipe", suffix)).select("doc_id", "n_points", "text_sha256", "recipe")


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = chunk_hash, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those that agree once white space is deleted; the longest original (in code points), then the
    smallest doc_id stays.
    """
    all_rows = recipes(docs, hashed, least, most).withColumn("_rk", F.xxhash64("recipe"))
    all_rows = durable(all_rows.withColumns({"_last": F.col("doc_id").isNull(), "_row": F.monotonically_increasing_id()}), "recipes")
    order = F.struct((-F.col("n_points")).alias("a"), F.col("_last").alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"), F.col("_row").alias("d"))
    groups = all_rows.groupBy("_rk", "recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("_best"))
    groups = durable(groups, "recipe-groups")  # so that the join can split a hot group
    joined = all_rows.join(groups, ["_rk", "recipe"]).drop("recipe")
    keep_id = F.when(~F.col("_best.b"), F.col("_best.c"))
    return joined.select("doc_id", keep_id.alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.d")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
