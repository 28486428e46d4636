"""Edge lists and node sequences as text files; checks and writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import numbered
from .storage import durable


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(graph, line_no, line) of one file or a folder of them; graph is the file's name without its ending.

    Files are split between tasks; lines are numbered by where their split begins and their place in it.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    rows = spark.read.text(path).select(name.alias("graph"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    placed = numbered(rows, ["graph"], [F.col("_file"), F.col("_split"), F.col("_row")], "line_no")
    return placed.select("graph", (F.col("line_no") - 1).alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds u, v, kind to (graph, line_no, line): kind is skipped, bad, selfloop or edge."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", ",", " "), r"\s+", " "))
    cells = F.split(bare, " ")
    number = lambda i: F.coalesce(F.get(cells, F.lit(i)).try_cast("long"), F.get(cells, F.lit(i)).try_cast("double").try_cast("long"))
    skipped = (bare == "") | bare.startswith("#") | bare.startswith("%")
    out = lines.withColumn("u", F.when(~skipped, number(0))).withColumn("v", F.when(~skipped, number(1)))
    kind = F.when(skipped, "skipped").when(F.col("u").isNull() | F.col("v").isNull(), "bad").when(F.col("u") == F.col("v"), "selfloop").otherwise("edge")
    return out.withColumn("kind", kind)


def line_counts(parsed: DataFrame) -> DataFrame:
    """Per graph: raw, bad, selfloop and usable lines, and different edges."""
    count = lambda *k: F.count_if(F.col("kind").isin(*k))
    pair = F.when(F.col("kind") == "edge", F.struct(F.least("u", "v"), F.greatest("u", "v")))
    return parsed.groupBy("graph").agg(count("edge", "bad", "selfloop").alias("raw"), count("bad").alias("bad"), count("selfloop").alias("selfloop"), count("edge").alias("usable"), F.countDistinct(pair).alias("edges"))


def edges_of(parsed: DataFrame) -> DataFrame:
    """edges(graph, src, dst) of parsed lines."""
    found = parsed.where("kind = 'edge'").select("graph", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"))
    return found.distinct()


def file_nodes(parsed: DataFrame) -> DataFrame:
    """nodes(graph, id, pos): pos numbers first appearances in the file."""
    ends = parsed.where("kind IN ('edge', 'selfloop')").select("graph", F.explode(F.array(F.struct((F.col("line_no") * 2).alias("at"), F.col("u").alias("id")), F.struct((F.col("line_no") * 2 + 1).alias("at"), F.col("v").alias("id")))).alias("e"))
    first = ends.groupBy("graph", "e.id").agg(F.min("e.at").alias("at"))
    return numbered(first, ["graph"], [F.col("at")], "pos").select("graph", "id", "pos")


#: Edges of a graph whose text a task hashes, and of a piece of a larger one.
HASHED = 1_000_000


def content_hash(edges: DataFrame, most: int = HASHED) -> DataFrame:
    """(graph, sha256, duplicate_of): graphs with equal sorted "u v" lines are duplicates of the first by name.

    The digest is that of the file's text; of a graph of over `most` edges, that of the digests of its text in pieces of `most` lines.
    """
    sizes = durable(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_m")), "graph-sizes")
    of = lambda large: edges.join(sizes.where((F.col("_m") > most) == large), "graph").select("graph", "src", "dst")
    pairs = F.sort_array(F.collect_list(F.struct("src", "dst")))
    digest = F.sha2(F.concat(F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["src"], p["dst"])), "\n"), F.lit("\n")), 256)
    digests = of(False).groupBy("graph").agg(digest.alias("sha256"))
    if not sizes.where(F.col("_m") > most).isEmpty():
        placed = numbered(of(True), ["graph"], [F.col("src"), F.col("dst")], "_at").withColumn("_piece", F.expr(f"(_at - 1) div {most}"))
        pieces = placed.groupBy("graph", "_piece").agg(digest.alias("_digest"))
        whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_piece", "_digest"))), lambda p: p["_digest"]), "\n"), 256)
        digests = digests.unionByName(pieces.groupBy("graph").agg(whole.alias("sha256")))
    first = F.min("graph").over(Window.partitionBy("sha256"))
    return digests.withColumn("duplicate_of", F.when(first < F.col("graph"), first))


def relabelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with node ids 0 .. n-1 in order of pos."""
    of = numbered(nodes.select("graph", "id", "pos"), ["graph"], [F.col("pos")], "new").select(F.col("graph").alias("g"), "id", (F.col("new") - 1).cast("long").alias("new"))
    a, b = of.alias("a"), of.alias("b")
    met = edges.join(a, (F.col("graph") == F.col("a.g")) & (F.col("src") == F.col("a.id"))).join(b, (F.col("graph") == F.col("b.g")) & (F.col("dst") == F.col("b.id")))
    return met.select("graph", F.least("a.new", "b.new").alias("src"), F.greatest("a.new", "b.new").alias("dst"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """orders(step, node) of a text file: the first number of each line, or a CSV's node column."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    head = lines.where("at = 0").select(F.array_position(F.transform(F.split("line", ","), lambda c: F.lower(F.trim(c))), "node").alias("column")).first()
    column = max(int(head[0]) - 1, 0) if head else 0
    cell = F.get(F.split(F.trim(F.regexp_replace("line", r"[\s]+", ",")), ","), F.lit(column)).try_cast("double").try_cast("long")
    found = lines.select("at", cell.alias("node")).where("node IS NOT NULL")
    return found.select(F.row_number().over(Window.orderBy("at")).alias("step"), "node")


def validate_orders(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (graph, method): missing, extra and duplicate nodes of orders(graph, method, step, node); ok if exact."""
    cells = orders.select("graph", "method").distinct()
    seen = orders.groupBy("graph", "method", "node").agg(F.count(F.lit(1)).alias("times"))
    wanted = cells.join(nodes.select("graph", F.col("id").alias("node")), "graph").withColumn("there", F.lit(True))
    both = seen.join(wanted, ["graph", "method", "node"], "full")
    counts = both.groupBy("graph", "method").agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("there").isNull()).alias("extra"), F.sum(F.greatest(F.coalesce("times", F.lit(1)) - 1, F.lit(0))).alias("duplicates"),
        F.min(F.when(F.col("times").isNull(), F.col("node"))).alias("first_missing"), F.min(F.when(F.col("there").isNull(), F.col("node"))).alias("first_extra"),
    )
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0))


def first_valid_source(sources: list[tuple[str, DataFrame | None]], nodes: DataFrame) -> tuple[str, DataFrame]:
    """The first of (name, orders) that is an exact order; a source that is None is absent. The last is the fallback."""
    for name, orders in sources[:-1]:
        if orders is not None and (report := validate_orders(orders, nodes).agg(F.every("ok")).first()) and report[0]:
            return name, orders
    return sources[-1]


def write_edges(edges: DataFrame, path: str) -> None:
    """One folder of "u v" lines per graph, and a manifest.csv folder of counts beside them."""
    edges.select("graph", F.concat_ws(" ", "src", "dst").alias("value")).repartition("graph").sortWithinPartitions("graph", "value").write.partitionBy("graph").text(f"{path}/edges")
    edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges")).coalesce(1).write.option("header", True).csv(f"{path}/manifest.csv")


def load_graphs(spark: SparkSession, folder: str, number: int = 12) -> DataFrame:
    """edges of all edge lists in a folder, relabelled to 0 .. n-1; raises unless there are `number` of them."""
    parsed = parse_lines(read_lines(spark, folder))
    if (found := parsed.select("graph").distinct().count()) != number:
        raise ValueError(f"{folder} holds {found} graphs, not {number}")
    return relabelled(edges_of(parsed), file_nodes(parsed))
