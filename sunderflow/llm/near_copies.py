"""Near copies by wide SimHash fingerprints and multi-index hashing, with similarity verified on the shingles; for the pipeline.

Texts link where the sets of their five-word shingles have a Jaccard similarity of SIMILAR or more; groups are what links
join. 64 bits, as the query op9_simhash has them, tell that similarity only roughly: at 0.8 about 10 of them differ, and
between 3 and 18 do. So this stage takes the same fingerprint from more bits: SEGMENTS segments of BITS bits, and CHECK more.
Each text is tabled under the Hamming ball of one bit around each segment, so two texts meet where a segment differs in two
bits at most; at a similarity of 0.8 they miss each other in all segments 2 to 3 times in 1,000, and less above. Texts that meet
are compared by the check bits, and what FAR or fewer differing ones join (at 0.8, 20 are usual and 34 are 3.7 standard
deviations above) is a group of candidates.

Links are verified on the shingles: a group's texts are reached from its first one, step by step, each step comparing those
not reached yet; so a chain of similar texts is found whole, and no pair is compared that a chain joins already. Pairs whose
whole fingerprints differ in over a quarter of their bits (5 standard deviations above what 0.8 gives) need no comparison.

Entries of more than DENSE texts, and groups of more than LOCAL texts or MOST shingles, are dealt into blocks, and each pair of
blocks is a task's work. Nothing is capped, and the links join the same texts.

Texts of equal shingle sets collapse first. Null, empty and blank texts have no shingle and are copies of each other; a
text of fewer words than a shingle is one shingle. Null doc_ids take part; a repeated doc_id names rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from ..operators.components import connected_components
from .common import F, durable, text_batches
from .simhash import majority

WORDS, SIMILAR, SEED = 5, (4, 5), 42
BITS, SEGMENTS, CHECK, FAR = 20, 12, 128, 34
DENSE, LOCAL, MOST = 4096, 256, 2_000_000
#: Runs of an entry up to this length are compared all at once.
_SHORT = 48
_ROWS, _KNOWN = 1 << 18, 400_000
_INDEX_WORDS = SEGMENTS // (64 // BITS)
_WORDS = _INDEX_WORDS + CHECK // 64
_FAR_AT_ALL = 64 * _WORDS // 4
#: Odd multipliers, one a fingerprint word, that turn a shingle's hash into further ones.
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(_WORDS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[-1]
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Words and their places in `hashes`; those that are met first get the next place."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, self.hashes])
        self.hashes[at] = xxhash.xxh64_intdigest(word, SEED)
        return at


def shingle_set(text: bytes, known: Words | None = None) -> np.ndarray:
    """The sorted 64-bit hashes of a UTF-8 text's different shingles, from those of their words, which `known` keeps."""
    known, words = Words() if known is None else known, text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > _KNOWN:
        known.clear()
    places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    each = known.hashes[places]
    size = min(WORDS, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        out += each[i : len(each) - size + 1 + i] * _ODD[i]
    return np.unique(_mixed(out))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The words of a set's fingerprint: those of the segments, then those of the check bits."""
    if not len(shingles):
        return np.zeros(_WORDS, np.uint64)
    return majority(_mixed(shingles[:, None] * _ODD))


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _text_key() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, _set, _n, _fp): hashes of the text and of its shingle set, its size and its fingerprint's words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Words()
        for texts in batches:
            sets = [shingle_set(_bytes(x), known) for x in texts]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            words = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, _WORDS).view(np.int64)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * _WORDS), pa.array(words.ravel()))
            yield pa.StructArray.from_arrays([pa.array(names), pa.array([len(s) for s in sets], pa.int64()), parts], ["name", "n", "words"])

    text_batches(docs.sparkSession)
    found = F.arrow_udf(run, "name long, n long, words array<long>")(F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), _text_key().alias("_th"), found.alias("_s"))
    return rows.select("doc_id", "_th", F.col("_s.name").alias("_set"), F.col("_s.n").alias("_n"), F.col("_s.words").alias("_fp"))


def segments(unique: DataFrame) -> DataFrame:
    """(_segment, _c1, _c2): every segment of every fingerprint, by number and bits, with the check words."""
    own, mask = 64 // BITS, (1 << BITS) - 1
    values = [F.shiftrightunsigned(F.col("_fp")[i // own], BITS * (i % own)).bitwiseAND(F.lit(mask)) + F.lit(i << BITS) for i in range(SEGMENTS)]
    nodes = unique.select("_fp").distinct()
    return nodes.select(F.explode(F.array(*values)).alias("_segment"), F.col("_fp")[_INDEX_WORDS].alias("_c1"), F.col("_fp")[_INDEX_WORDS + 1].alias("_c2"))


def in_ball(rows: DataFrame) -> DataFrame:
    """rows with _segment under each _key that differs from it in one bit at most."""
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(BITS))]]))
    return rows.withColumn("_flip", flips).withColumn("_key", F.col("_segment").bitwiseXOR(F.col("_flip"))).drop("_segment", "_flip")


def crowded_keys(parts: DataFrame, most: int) -> DataFrame:
    """(_key, _m): entries of more than `most` rows, by their number.

    Only segments that hold their share of such an entry can be in one, so few are looked at.
    """
    counts = durable(parts.groupBy("_segment").agg(F.count(F.lit(1)).alias("_n")), "segment-counts")
    keys = in_ball(counts.where(F.col("_n") * (BITS + 1) > most).select("_segment")).distinct()
    near = in_ball(keys.withColumnRenamed("_key", "_segment").withColumn("_of", F.col("_segment"))).select("_of", F.col("_key").alias("_segment"))
    return near.join(counts, "_segment").groupBy(F.col("_of").alias("_key")).agg(F.sum("_n").alias("_m")).where(F.col("_m") > most)


def _node(c1: Column, c2: Column) -> Column:
    return F.xxhash64(c1, c2)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether check words (n x 2) differ in FAR bits at most."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= FAR


def _run_links(words: np.ndarray) -> np.ndarray:
    """Places of links that join what a chain of near ones joins."""
    left, out = np.arange(len(words)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = _near(words[left], words[x])
            new, left = left[near], left[~near]
            out.append(np.stack([np.full(len(new), x), new], 1))
            reached += new.tolist()
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _met(keyed: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): near check words that share a key; a key's rows are in one partition."""

    def links(keys: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
        sizes = np.diff(np.append(starts, len(keys)))
        short = np.repeat(sizes <= _SHORT, sizes)
        pairs = []
        for lag in range(1, int(min(sizes.max(), _SHORT))):
            same = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:])
            hit = same[_near(words[same], words[same + lag])]
            pairs.append(np.stack([hit, hit + lag], 1))
        pairs += [s + _run_links(words[s : s + n]) for s, n in zip(starts[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist(), strict=True)]
        at = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        found = np.unique(np.concatenate([words[at[:, 0]], words[at[:, 1]]], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(4)], ["a1", "a2", "b1", "b2"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < _ROWS):
                continue
            keys, c1, c2 = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            words = np.stack([c1, c2], 1).view(np.uint64)
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield links(keys[:cut], words[:cut])
            held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in (keys, c1, c2)], ["_key", "_c1", "_c2"])] if cut < len(keys) else []

    return keyed.select("_key", "_c1", "_c2").mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _blocked(dense: DataFrame, most: int) -> DataFrame:
    """Rows of crowded entries (with their number _m) under keys of pairs of blocks of about `most` rows."""
    blocks = F.ceil(F.col("_m") / most).cast("int")
    placed = dense.withColumn("_b", F.pmod(F.hash("_c1", "_c2"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select(F.xxhash64("_key", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("_key"), "_c1", "_c2")


def candidates(unique: DataFrame, dense: int = DENSE) -> DataFrame:
    """(_set, _c): sets that entries join, by steps; those that no entry joins with others are left out."""
    spark = unique.sparkSession
    parts = durable(segments(unique), "segments")
    keyed = in_ball(parts)
    crowded = durable(crowded_keys(parts, dense), "crowded-entries")
    number = crowded.count()
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if number:
        small = F.broadcast(crowded) if number <= 100_000 else crowded
        split = _blocked(keyed.join(small, "_key"), dense)
        keyed = keyed.join(small, "_key", "left_anti").unionByName(split)
    met = durable(_met(keyed.repartition(deal, "_key").sortWithinPartitions("_key")), "near-links")
    links = met.select(_node(F.col("a1"), F.col("a2")).alias("src"), _node(F.col("b1"), F.col("b2")).alias("dst")).distinct()
    joined = connected_components(links).select(F.col("id").alias("_node"), F.col("component").alias("_c"))
    nodes = unique.select("_set", _node(F.col("_fp")[_INDEX_WORDS], F.col("_fp")[_INDEX_WORDS + 1]).alias("_node"))
    named = durable(nodes.join(joined, "_node", "left").select("_set", F.coalesce("_c", "_node").alias("_c")), "candidate-groups")
    several = named.groupBy("_c").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_c")
    return named.join(durable(several, "several"), "_c")


def similar(a: np.ndarray, others: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which of the sorted sets have a Jaccard similarity of over / under or more to a."""
    over, under = similar
    out = np.zeros(len(others), bool)
    for i, b in enumerate(others):
        if under * min(len(a), len(b)) >= over * max(len(a), len(b)):
            both = len(a) + len(b) - len(np.union1d(a, b)) if len(a) and len(b) else 0
            out[i] = under * both >= over * (len(a) + len(b) - both)
    return out


def forest(sets: list[np.ndarray], words: np.ndarray) -> list[tuple[int, int]]:
    """Places of links that join all sets (with their fingerprints' words) which a chain of similar ones joins."""
    left, links = np.arange(len(sets)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            maybe = np.bitwise_count(words[left] ^ words[x]).sum(axis=1, dtype=np.int64) <= _FAR_AT_ALL
            hit = np.zeros(len(left), bool)
            hit[maybe] = similar(sets[x], [sets[y] for y in left[maybe].tolist()])
            new, left = left[hit].tolist(), left[~hit]
            links += [(x, y) for y in new]
            reached += new
    return links


def _with_shingles(named: DataFrame) -> DataFrame:
    """named with _shingles in place of text."""

    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Words()
        for texts in batches:
            yield pa.array([shingle_set(_bytes(x), known).tobytes() for x in texts], pa.binary())

    return named.withColumn("_shingles", F.arrow_udf(shingles, "binary")(F.col("text").cast("binary"))).drop("text")


def _verified(sets: DataFrame, sizes: DataFrame, local: int) -> DataFrame:
    """(src, dst): verified links; a task holds two blocks of a group."""
    blocks = F.ceil(F.greatest(F.col("_m") / local, F.col("_s") / MOST)).cast("int")
    number = sizes.select("_c", F.greatest(blocks, F.lit(1)).alias("_blocks"))
    met = sets.join(number, "_c").withColumn("_b", F.pmod(F.hash("_set"), F.col("_blocks")))
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = met.select("_c", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_set", "_fp", "_shingles")

    def run(group: pa.Table) -> pa.Table:
        names = group.column("_set").to_numpy()
        words = group.column("_fp").combine_chunks().flatten().to_numpy().reshape(-1, _WORDS).view(np.uint64)
        pairs = np.array(forest([np.frombuffer(_bytes(x), np.uint64) for x in group.column("_shingles")], words), np.int64).reshape(-1, 2)
        return pa.table({"src": names[pairs[:, 0]], "dst": names[pairs[:, 1]]})

    return dealt.groupBy("_c", "_i", "_j").applyInArrow(run, "src long, dst long")


def first_copies(docs: DataFrame, dense: int = DENSE, local: int = LOCAL) -> DataFrame:
    """(doc_id, _th) of the first text, by (doc_id, _th) with nulls last, of each group of near copies."""
    rows = durable(sketches(docs), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_th"))
    unique = durable(rows.groupBy("_set").agg(least.alias("_first"), F.first("_fp").alias("_fp"), F.first("_n").alias("_n")), "unique-sets")
    named = durable(candidates(unique, dense).join(unique, "_set"), "candidate-sets")
    sizes = durable(named.groupBy("_c").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_s")), "candidate-sizes")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_th"), "text")
    wanted = named.select("_set", "_c", "_fp", F.col("_first.doc_id").alias("_want"), F.col("_first._th").alias("_th"))
    met = texts.join(wanted, "_th").where(F.col("_id").eqNullSafe(F.col("_want"))).dropDuplicates(["_set"])
    sets = durable(_with_shingles(met.select("_c", "_set", "_fp", "text")), "candidate-shingles")
    links = durable(_verified(sets, sizes, local), "copy-links")
    found = connected_components(links).select(F.col("id").alias("_set"), F.col("component").alias("_g"))
    firsts = unique.select("_set", "_first").join(found, "_set", "left").groupBy(F.coalesce("_g", "_set").alias("_g")).agg(F.min("_first").alias("_first"))
    return firsts.select("_first.doc_id", "_first._th")
