"""Synthetic graphs as edges(graph, src, dst). Coins are hashes of seed and ends, so reruns agree."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash_uniform
from ..operators.components import connected_components
from ..operators.ordering import numbered
from .projections import nodes_of


def _edges(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.where("u <> v").select(F.lit(name).alias("graph"), F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def block_model(spark: SparkSession, name: str, sizes: list[int], p_in: float, p_out: float, seed: int) -> DataFrame:
    """Every pair is an edge with p_in inside a block and p_out between blocks; for graphs of thousands of nodes."""
    starts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    block = lambda c: sum(((c >= s).cast("int") for s in starts[1:-1]), F.lit(0))
    ids = spark.range(starts[-1])
    pairs = ids.select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(starts[-1]).cast("long"))).alias("v")).where(F.col("v") < starts[-1])
    p = F.when(block(F.col("u")) == block(F.col("v")), F.lit(p_in)).otherwise(F.lit(p_out))
    return _edges(pairs.where(hash_uniform(seed, F.lit(0), F.col("u"), F.col("v")) < p), name)


def sampled_block_model(spark: SparkSession, name: str, sizes: list[int], p_in: float, p_out: float, seed: int) -> DataFrame:
    """A block model by drawing as many edges as it expects; loops drop and repeats collapse. Linear in the edges."""
    starts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    drawn = None
    for i, a in enumerate(sizes):
        for j in range(i, len(sizes)):
            b, p = sizes[j], p_in if i == j else p_out
            m = round(p * (a * (a - 1) / 2 if i == j else a * b))
            end = lambda side, first, n: (F.lit(first) + F.floor(hash_uniform(seed, F.lit(i * len(sizes) + j), F.col("id"), F.lit(side)) * n)).cast("long")  # noqa: E731, B023
            part = spark.range(m).select(end(0, starts[i], a).alias("u"), end(1, starts[j], b).alias("v"))
            drawn = part if drawn is None else drawn.unionByName(part)
    return _edges(drawn, name)


def grid_small_world(spark: SparkSession, name: str, n: int, seed: int, rows: int = 30) -> DataFrame:
    """A grid of `rows` rows and n / rows columns with n / 25 random shortcuts."""
    columns = n // rows
    total = rows * columns
    cell = spark.range(total)
    right = cell.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = cell.where(F.col("id") < total - columns).select(F.col("id").alias("u"), (F.col("id") + columns).alias("v"))
    pick = lambda side: F.floor(hash_uniform(seed, F.lit(side), F.col("id")) * total).cast("long")
    far = spark.range(n // 25).select(pick(0).alias("u"), pick(1).alias("v"))
    return _edges(right.unionByName(down).unionByName(far), name)


def uniform_random(spark: SparkSession, name: str, n: int, degree: float, seed: int) -> DataFrame:
    """n * degree / 2 random pairs; loops drop and repeats collapse."""
    pick = lambda side: F.floor(hash_uniform(seed, F.lit(side), F.col("id")) * n).cast("long")
    return _edges(spark.range(round(n * degree / 2)).select(pick(0).alias("u"), pick(1).alias("v")), name)


def ring_small_world(spark: SparkSession, name: str, n: int, k: int, p: float, seed: int) -> DataFrame:
    """A ring in which each node meets its next k / 2 nodes, each edge's far end moved with probability p."""
    near = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("o"))
    moved = hash_uniform(seed, F.lit(0), F.col("u"), F.col("o")) < p
    other = F.floor(hash_uniform(seed, F.lit(1), F.col("u"), F.col("o")) * n).cast("long")
    return _edges(near.select("u", F.when(moved, other).otherwise((F.col("u") + F.col("o")) % n).alias("v")), name)


def power_law(spark: SparkSession, name: str, n: int, gamma: float, seed: int, k_min: int = 2) -> DataFrame:
    """A configuration model: degrees follow k^-gamma up to 4 sqrt(n); stubs in hashed order are paired.

    A node's degree is the first whose cumulative share passes the node's number. Shares are a table of a row for each degree, cut
    into as many equal bins, so nodes meet them by bin.
    """
    k_max = max(k_min + 1, int(4 * n**0.5))
    bins = k_max - k_min + 1
    upto = list(accumulate(k**-gamma for k in range(k_min, k_max + 1)))
    ends = [t / upto[-1] for t in upto[:-1]] + [1.0]
    shares = spark.createDataFrame([*zip(range(k_min, k_max + 1), [0.0, *ends[:-1]], ends, strict=True)], "degree int, low double, high double")
    shares = shares.where("low < high").withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * bins), F.least(F.floor(F.col("high") * bins), F.lit(bins - 1)))))
    drawn = spark.range(n).withColumn("u", hash_uniform(seed, F.lit(0), F.col("id"))).withColumn("bin", F.floor(F.col("u") * bins))
    degrees = drawn.join(shares, "bin").where("low <= u AND u < high")
    stubs = degrees.select("id", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("stub"))
    shuffled = [hash_uniform(seed, F.lit(1), F.col("id"), F.col("stub")), F.col("id"), F.col("stub")]
    stubs = numbered(stubs.withColumn("all", F.lit(0)), ["all"], shuffled, "at").withColumn("at", F.col("at") - 1)
    pairs = stubs.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min_by("id", "at").alias("u"), F.max_by("id", "at").alias("v"), F.count(F.lit(1)).alias("n"))
    return _edges(pairs.where("n = 2"), name)


def preferential(spark: SparkSession, name: str, n: int, m: int, seed: int) -> DataFrame:
    """Preferential attachment: each node brings m edges to ends of earlier edges, which is by degree.

    Place 2e of the list of ends is edge e's source; place 2e + 1 is a hashed earlier place's end. Places are followed
    back until an even one, all edges at once; half of them end at each step.
    """
    back = lambda p: F.floor(hash_uniform(seed, F.lit(0), p) * p).cast("long")
    even = F.aggregate(F.sequence(F.lit(1), F.lit(64)), back(2 * F.col("id") + 1), lambda p, _: F.when(p % 2 == 1, back(p)).otherwise(p))
    ends = spark.range(m, n * m).select(F.floor(F.col("id") / m).cast("long").alias("u"), F.floor(F.floor(even / 2) / m).cast("long").alias("v"))
    return _edges(ends, name)


def joined_components(edges: DataFrame) -> DataFrame:
    """edges with further ones that chain the smallest nodes of the components, in their order."""
    nodes = nodes_of(edges)
    keyed = connected_components(edges.select(F.struct("graph", F.col("src").alias("id")).alias("src"), F.struct("graph", F.col("dst").alias("id")).alias("dst")))
    first = keyed.select(F.col("component.graph").alias("graph"), F.col("component.id").alias("src")).distinct()
    chain = first.withColumn("dst", F.lead("src").over(Window.partitionBy("graph").orderBy("src"))).where("dst IS NOT NULL")
    return edges.unionByName(chain.join(nodes.select("graph").distinct(), "graph", "left_semi"))


def named(spark: SparkSession, name: str) -> DataFrame:
    """The built-in datasets by name."""
    known = {
        "Powerlaw_500": lambda: joined_components(power_law(spark, name, 500, 2.5, 7)),
        "SynthPL500_g25_s11": lambda: joined_components(power_law(spark, name, 500, 2.5, 11)),
        "SynthPL1000_g22_s17": lambda: joined_components(power_law(spark, name, 1000, 2.2, 17)),
        "SynthComm1000_s23": lambda: joined_components(block_model(spark, name, [250] * 4, 0.03, 0.0015, 23)),
        "SynthGridSW1200_s31": lambda: grid_small_world(spark, name, 1200, 31),
    }
    if name not in known:
        raise ValueError(f"no such dataset: {name}")
    return known[name]()


def scaling_family(spark: SparkSession, kind: str, n: int, seed: int) -> DataFrame:
    """The graphs of the scaling runs: powerlaw, ER (mean degree 6), WS (8 neighbours, .08), SBM (4
    blocks), BA (2 edges a node)."""
    name = f"{kind}_{n}_{seed}"
    made = {
        "powerlaw": lambda: power_law(spark, name, n, 2.5, seed),
        "ER": lambda: uniform_random(spark, name, n, 6.0, seed),
        "WS": lambda: ring_small_world(spark, name, n, 8, 0.08, seed),
        "BA": lambda: preferential(spark, name, n, 2, seed),
        "SBM": lambda: sampled_block_model(spark, name, [n // 4] * 4, 16.0 / n, 2.0 / n, seed),
    }
    return joined_components(made[kind]())


def proxy_graphs(spark: SparkSession, influence: bool = False) -> DataFrame:
    """The small graphs of the compared searches: BA, ER, WS of 120 nodes (160 for influence) and an SBM of 128."""
    n = 160 if influence else 120
    made = [preferential(spark, f"BA{n}", n, 2, 101), uniform_random(spark, f"ER{n}", n, 5.0, 102), ring_small_world(spark, f"WS{n}", n, 4, 0.1, 103), block_model(spark, "SBM128", [32] * 4, 0.18, 0.01, 104)]
    out = made[0]
    for g in made[1:]:
        out = out.unionByName(g)
    return joined_components(out)
