"""SimHash near-deduplication by multi-index hashing.

A text's fingerprint holds, bit by bit, the majority of its shingles' 64-bit hashes. Fingerprints link at radius or
fewer differing bits. The 64 bits are two segments, so linked fingerprints differ in at most half the radius in one of
them: each fingerprint is tabled under the Hamming ball of a quarter of the radius around each segment (for radius 4:
33 values a segment), fingerprints that meet in a table entry are compared in full, and links join to components.

An entry's fingerprints are compared inside one task and leave it as a spanning forest, never as pairs; entries with
more than DENSE fingerprints are linked through the balls of half the radius around the whole fingerprints instead:
two fingerprints are within the radius if and only if those balls meet, and each ball member links to its smallest
fingerprint only. Both ways are exact. Copies collapse to one fingerprint before any of this.

Null, empty and blank texts have no words; their fingerprint is zero and links like any other. A text of fewer words
than a shingle is one shingle. Null doc_ids take part, but name no component unless all of it is null. Rows that
repeat a doc_id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import connected_components
from .common import F, documents, durable, text_batches

SHINGLE, RADIUS, SEED, DENSE = 4, 4, 42, 4096


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """The hash of every shingle of a UTF-8 text, repeats included; none for a text without words."""
    plain = b" ".join(text.lower().split())
    if not plain:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(plain)]
    n = max(1, len(starts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(plain[s:e], seed) for s, e in zip(starts[:n], ends[min(words, len(ends)) - 1 :], strict=True)], np.uint64)


#: A byte's bits in the bytes of a number, so that up to 255 of them add up without carries.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words whose bits are set in over half of the rows' words (n x words, or n for one word)."""
    octets = hashes.view(np.uint8).reshape(len(hashes), -1)
    set_bits = np.zeros(8 * octets.shape[1], np.int64)
    for at in range(0, len(octets), 255):
        set_bits += _SPREAD[octets[at : at + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(2 * set_bits > len(octets), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    hashes = shingle_hashes(text, words, seed)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, _th, _fp): the hash of the text and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in texts]
            yield pa.array(np.array(values, np.uint64).view(np.int64))

    text_batches(docs.sparkSession)
    found = F.arrow_udf(run, "long")(F.col("text").cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th"), found.alias("_fp"))


def _entries(unique: DataFrame, reach: int) -> DataFrame:
    """(_key, _fp): each fingerprint under the ball of `reach` bits around each of its two segments."""
    flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(32), n)]
    masks = F.array(*[F.lit(m).cast("long") for m in flips])
    high = F.shiftrightunsigned("_fp", 32).bitwiseOR(F.lit(1 << 32))
    low = F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.concat(F.transform(masks, lambda m: m.bitwiseXOR(high)), F.transform(masks, lambda m: m.bitwiseXOR(low)))
    return unique.select(F.explode(keys).alias("_key"), "_fp")


def _distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join those of fps (all different) that a chain of steps within the radius joins."""
    links, left = [], fps
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = _distance(left, x) <= radius
            new, left = left[near], left[~near]
            links += [(x, y) for y in new]
            reached += list(new)
    return links


def _entry_links(entries: DataFrame, radius: int, dense: int) -> DataFrame:
    """(src, dst) from entries sorted by key within partitions; dst is null for the fingerprints of entries of more than `dense`.

    A worker holds `dense` fingerprints of an entry and a batch at most: what is crowded leaves it as it comes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(keys)]]))
            twos = starts[sizes == 2]
            a, b = fps[twos], fps[twos + 1]
            near = _distance(a, b) <= radius
            some, many = (sizes > 2) & (sizes <= dense), sizes > dense
            rest = [x for s, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True) for x in _forest(fps[s : s + n], radius)]
            more = np.array(rest, np.int64).reshape(-1, 2)
            a, b = np.concatenate([a[near], more[:, 0]]), np.concatenate([b[near], more[:, 1]])
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            alone = fps[np.repeat(many, sizes)]
            dst = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(alone), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], alone])), dst], ["src", "dst"])

        def marks(fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64())], ["src", "dst"])

        for batch in batches:
            keys, fps = (c.to_numpy() for c in batch.columns)
            if crowded is not None and len(keys):
                cut = int(np.searchsorted(keys, crowded, "right"))
                if cut:
                    yield marks(fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                crowded = None if len(keys) else crowded
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held, fps])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield links(keys[:cut], fps[:cut])
            held_keys, held = keys[cut:], fps[cut:]
            if len(held) > dense:
                yield marks(held)
                crowded, held_keys, held = held_keys[0], held_keys[:0], held[:0]
        if len(held_keys):
            yield links(held_keys, held)

    return entries.select("_key", "_fp").mapInArrow(run, "src long, dst long")


def _ball_links(dense: DataFrame, reach: int) -> DataFrame:
    """(src, dst): fingerprints linked to the smallest one whose ball of `reach` bits theirs meets, for every meeting point."""
    flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(64), n)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in flips])
    balls = dense.select("_fp", F.explode(masks).alias("_m")).select("_fp", F.col("_fp").bitwiseXOR(F.col("_m")).alias("_point"))
    met = balls.groupBy("_point").agg(F.min("_fp").alias("_least"), F.max("_fp").alias("_most")).where("_least < _most")
    return balls.join(met, "_point").where("_fp <> _least").select(F.col("_least").alias("src"), F.col("_fp").alias("dst")).distinct()


def links(unique: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(src, dst): links between different fingerprints that connect all that are within the radius by steps.

    The radius is even: balls of half of it meet exactly where two fingerprints are within it.
    """
    if radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    reach = -(-(radius // 2) // 2)
    entries = _entries(unique, reach).repartition("_key").sortWithinPartitions("_key")
    found = durable(_entry_links(entries, radius, dense), "simhash-links")
    crowded = found.where("dst IS NULL").select(F.col("src").alias("_fp")).distinct()
    balls = _ball_links(crowded, -(-radius // 2)).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
    return found.where("dst IS NOT NULL").unionByName(balls).distinct()


def near_dedup(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """(doc_id, _th, _fp, component_id, first) for every row of docs.

    first: the row is its component's first by (doc_id, _th); rows that agree in both agree in it, too.
    """
    spark = docs.sparkSession
    rows = durable(fingerprints(docs, words, seed), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_th"))
    unique = rows.groupBy("_fp").agg(least.alias("_first")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_fp")
    unique = durable(unique, "unique-fingerprints")
    found = connected_components(links(unique.select("_fp"), radius, dense)).select(F.col("id").alias("_fp"), F.col("component").alias("_c"))
    named = unique.join(found, "_fp", "left").withColumn("_c", F.coalesce("_c", "_fp"))
    named = durable(named, "named-fingerprints")
    firsts = named.groupBy("_c").agg(F.min("_first").alias("_first"))
    labels = durable(named.select("_fp", "_c").join(firsts, "_c").select("_fp", "_first"), "components")
    first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_th") == F.col("_first._th"))
    return rows.join(labels, "_fp").select("doc_id", "_th", "_fp", F.col("_first.doc_id").alias("component_id"), first.alias("first"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
