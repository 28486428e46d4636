"""Graphs in the relational tables. edges(graph, src, dst) with src < dst; nodes(graph, id, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import numbered


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _canonical(pairs: DataFrame, name: str) -> DataFrame:
    kept = pairs.where("a <> b").select(F.lit(name).alias("graph"), F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return kept.distinct()


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order that ship in the same month."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.trunc("l_shipdate", "month").alias("m"), "l_partkey")
    other = items.select("l_orderkey", "m", F.col("l_partkey").alias("b"))
    return _canonical(items.withColumnRenamed("l_partkey", "a").join(other, ["l_orderkey", "m"]).where("a < b"), "part")


def copart_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    return _canonical(items.join(items.withColumnRenamed("a", "b"), "l_orderkey").where("a < b"), "copart")


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers (10^9 + key) of large returned items in open orders."""
    items = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity >= 45")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    return _canonical(pairs, "trade")


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of purchases that follow each other within a minute. Only each day's last purchase meets another day's."""
    buys = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", "user_id", F.to_date("ts").alias("_day"))
    within = Window.partitionBy("_day").orderBy("ts", "event_id")
    inside = buys.withColumn("_u", F.lead("user_id").over(within)).withColumn("_t", F.lead("ts").over(within))
    edge = F.struct("ts", "event_id", "user_id")
    ends = buys.groupBy("_day").agg(F.min(edge).alias("_first"), F.max(edge).alias("_last"))
    after = ends.withColumn("_next", F.lead("_first").over(Window.orderBy("_day")))
    bridges = after.select(F.col("_last.user_id").alias("a"), F.col("_next.user_id").alias("b"), F.col("_last.ts").alias("s"), F.col("_next.ts").alias("t"))
    pairs = inside.select(F.col("user_id").alias("a"), F.col("_u").alias("b"), F.col("ts").alias("s"), F.col("_t").alias("t")).unionByName(bridges)
    return _canonical(pairs.where("t <= s + INTERVAL 60 SECONDS"), "user")


def nodes_of(edges: DataFrame) -> DataFrame:
    """nodes(graph, id, pos) of an edge table without file order; pos follows the id."""
    ids = edges.select("graph", F.col("src").alias("id")).unionByName(edges.select("graph", F.col("dst").alias("id"))).distinct()
    return numbered(ids, ["graph"], [F.col("id")], "pos")


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph, s, d): each edge in both directions."""
    return edges.select("graph", F.col("src").alias("s"), F.col("dst").alias("d")).unionByName(edges.select("graph", F.col("dst").alias("s"), F.col("src").alias("d")))
