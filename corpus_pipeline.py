"""From raw documents to shards: language ID, near-deduplication, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. Empty tables pass through;
what nulls, repeated rows and empty texts come to is said with each stage and its operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sunderflow.llm import decontaminate, language_id, mixing, near_copies, sharding
from sunderflow.llm.common import documents, durable, null_safe_key, seeded, word_count

LEAST_SCORE = 0.5
_NOBODY = -(2**63)


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The documents' columns as one, doc, so that no name clashes, with further columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in more.items()])


def _keys() -> dict[str, Column]:
    """What tells rows apart, but for repeated ones; never null."""
    return {"key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY)), "key_text": F.coalesce(F.xxhash64("text"), F.lit(0))}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: not und, and a score of LEAST_SCORE or more.

    With no row to learn from, nothing can be told and all rows with a letter stay.
    """
    model = language_id.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = _packed(docs, found=language_id.identify(F.col("text"), model, spark))
    return known.where((F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by doc_id, of each group of near copies (five-word shingles of a Jaccard similarity of 0.8
    or more); of repeated rows one."""
    first = near_copies.first_copies(docs).select(F.coalesce("doc_id", F.lit(_NOBODY)).alias("key_id"), F.col("_th").alias("key_text"))
    kept = _packed(docs, **_keys()).join(durable(first, "first-copies").hint("shuffle_hash"), ["key_id", "key_text"], "left_semi")
    same = Window.partitionBy("key_id", "key_text").orderBy("doc.source", "doc.lang")
    return kept.withColumn("copy", F.row_number().over(same)).where("copy = 1").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by the benchmark; others stay as they are."""
    packed = _packed(docs, text=F.col("text"))
    found = decontaminate.judged(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "found")
    return found.where(~F.col("found.contaminated")).select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, which may be never.

    Rows that agree in doc_id and text are told apart by their other columns; of rows that agree in all, any stands for
    another, and those taken most often come first.
    """
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text"]
    other = F.xxhash64(*plain)
    own = _keys() | dict(zip(("_sn", "_sv"), null_safe_key(F.col("source")), strict=True)) | {"key_row": other}
    keys = list(own)
    rows = _packed(docs, doc_id=F.col("doc_id"), size=word_count(F.col("text")), _k=seeded(mixing.SEED, F.col("doc_id"), other, own["key_text"]), **own).drop("doc")
    taken = mixing.repetitions(durable(rows, "mix-rows"))
    kinds = taken.groupBy(*keys, "copies").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*keys).orderBy(F.desc("copies")))
    plan = kinds.withColumn("upto", upto).where("copies > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("upto", F.col("copies").cast("int").alias("copies")))).alias("plan"))
    met = _packed(docs, **own).join(durable(plan, "mix-copies").hint("shuffle_hash"), keys)
    numbered = met.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("key_row")))
    step = F.get(F.filter("plan", lambda x: F.col("row") <= x["upto"]), F.lit(0))
    times = F.coalesce(step["copies"], F.lit(0))
    return numbered.select("doc", F.explode(F.array_repeat(F.lit(0), times)).alias("time")).select("doc.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it, as sharding.shard gives them."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: SQL can express neither language ID nor groups of near copies; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
