"""Removal of byte strings that occur twice, by column-wise suffix order over aligned document contexts.

Every string of `minimum` bytes picks an anchor by its content: of its GRAM-byte pieces the one with the least hash,
the first of these. Equal strings pick equal anchors at equal offsets, so a repeated string lies in the contexts
(minimum - GRAM bytes on each side) of two equal anchors. Contexts are aligned at their anchors and ordered column by
column: each round takes one symbol of every context, updates their order (the positional Burrows-Wheeler transform of
the collection) by a stable sort, and the lengths that neighbours in this order have in common. A context whose common
length with a neighbour reaches `minimum` at some column holds a repeated string that ends there. Rounds are as many
as a context has bytes, whatever the documents' lengths, and read one column at a time in sequence.

Contexts that agree entirely are one context for the rounds and need none themselves: all their strings repeat. An
anchor with more than MAX_GROUP different contexts is settled by counting 128-bit hashes of the strings around it, so
no task holds a common passage's documents.

Null text counts as empty. Rows that repeat a doc_id, or a whole row, are documents of their own, so repeated rows
repeat each other. A null doc_id is kept. Strings shorter than `minimum` are never repeated. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import F, documents, durable, text_batches

MINIMUM, GRAM, MAX_GROUP = 200, 64, 4_000
_NOBODY = -(2**63)
_PIECE, _ROWS = 1 << 18, 16_000
_PAD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Finds the anchors of texts."""

    def __init__(self, minimum: int = MINIMUM, gram: int = GRAM):
        self.minimum, self.gram, self.side = minimum, gram, minimum - gram
        room = _PIECE + 2 * minimum + 1
        self.up, self.down = _powers(_BASE, room), _powers(_UNBASE, room)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each gram; its high bits are the most mixed."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0x9FB21C651E98DF25)

    def first_least(self, h: np.ndarray) -> np.ndarray:
        """For each run of side + 1 hashes, the position of the first of the least (by their high 40 bits)."""
        w = self.side + 1
        low = np.uint64((1 << 24) - 1)
        tagged = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
        padded[: len(h)] = tagged
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in data, gram hashes) of the texts that bounds cut data into, in order, a piece at a time."""
        last = -1
        a, end = int(bounds[0]), int(bounds[-1])
        while end - a >= self.minimum:
            z = min(end, a + _PIECE)
            piece = data[a:z]
            h = self.hashes(piece)
            at = self.first_least(h)
            s = np.arange(a, a + len(at))
            of = np.searchsorted(bounds[:-1], s, "right")
            at = at[s + self.minimum <= bounds[of]]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
            if len(at) and a + at[0] == last:
                at = at[1:]
            if len(at):
                last = a + int(at[-1])
                yield a + at, h[at]
            if z == end:
                return
            a = z - self.minimum + 1


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values begin and end in them."""
    text = column.cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2] or b"", np.uint8), bounds


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY)).alias("_id"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_text"))


def _anchor_hashes(rows: DataFrame, minimum: int, gram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(minimum, gram)
        for b in batches:
            for _, h in find.of(*_texts(b.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["_a"])

    return rows.select("_text").mapInArrow(run, "_a long")


def _anchors(rows: DataFrame, minimum: int, gram: int) -> DataFrame:
    """(_id, _th, _at, _a, _c, _d): every anchor with the 128-bit hash of its context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(minimum, gram)
        digest = xxhash.xxh3_128_digest
        for b in batches:
            data, bounds = _texts(b.column(2))
            view = data.tobytes() if not data.flags.c_contiguous else memoryview(data)
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, h in find.of(data, bounds):
                of = np.searchsorted(bounds, at, "right") - 1
                low, high = np.maximum(at - find.side, bounds[of]), np.minimum(at + minimum, bounds[of + 1])
                c = np.frombuffer(b"".join([digest(view[x:y], z) for x, y, z in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(ths[of]), pa.array(at - bounds[of]), pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1])], ["_id", "_th", "_at", "_a", "_c", "_d"])

    return rows.mapInArrow(run, "_id long, _th long, _at long, _a long, _c long, _d long")


def repeats(columns: np.ndarray, group: np.ndarray, minimum: int) -> np.ndarray:
    """For contexts (the columns' second axis; group: sorted numbers): whether the string of `minimum` symbols that
    starts at each column also stands in another context of the group, at the same columns.

    One round per column: order holds the contexts by what they hold up to it, read backwards; since[i] is the column
    from which context order[i] agrees with order[i - 1].
    """
    width, m = columns.shape
    order = np.arange(m)
    since = np.zeros(m + 1, np.int32)
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    since[:m][fresh] = width + 1
    key = group.astype(np.int64) * 512
    found = np.zeros((max(0, width - minimum + 1), m), bool)
    for j in range(width):
        symbols = columns[j, order]
        whole = key + symbols
        moved = whole[1:] < whole[:-1]
        if moved.any():
            sort = np.argsort(whole, kind="stable")
            same = np.concatenate([[False], whole[sort[1:]] == whole[sort[:-1]]])
            new = np.full(m + 1, j + 1, np.int32)
            at = np.flatnonzero(same)
            low, high = sort[at - 1] + 1, sort[at]
            near = low == high
            new[at[near]] = since[high[near]]
            if not near.all():
                far = at[~near]
                spans = np.stack([low[~near], high[~near] + 1], 1).ravel()
                new[far] = np.maximum.reduceat(since, spans)[::2]
            since, order, symbols = new, order[sort], symbols[sort]
            since[:m][fresh] = width + 1
        else:
            apart = whole[1:] != whole[:-1]
            since[1:m][apart & ~fresh[1:]] = j + 1
        since[:m][symbols == _PAD] = np.maximum(since[:m][symbols == _PAD], j + 1)
        if j >= minimum - 1:
            with_last = since[:m] <= j - minimum + 1
            hit = with_last.copy()
            hit[:-1] |= with_last[1:]
            found[j - minimum + 1, order[hit]] = True
    return found


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, last start) of each run of repeated strings' starts; found: contexts x starts."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    at, first = np.nonzero(edge == 1)
    return at, first, np.nonzero(edge == -1)[1] - 1


def _context_repeats(contexts: DataFrame, minimum: int, gram: int) -> DataFrame:
    """(_id, _th, _from, _to): repeated stretches found in contexts (_a, _id, _th, _start, _left, _need, _bytes)."""
    side = minimum - gram
    width = minimum + side
    names = ["_id", "_th", "_from", "_to"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        data, bounds = _texts(rows.column("_bytes").combine_chunks())
        left = rows.column("_left").to_numpy()
        columns = np.full((len(left), width), _PAD, np.int16)
        for row, at, begin, end in zip(columns, (side - left).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            row[at : at + end - begin] = data[begin:end]
        anchors = rows.column("_a").to_numpy()
        group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
        found = repeats(np.ascontiguousarray(columns.T), group, minimum).T
        found &= rows.column("_need").to_numpy()[:, None]
        at, first, last = _runs(found)
        begin = rows.column("_start").to_numpy()[at] - side + left[at]
        return pa.RecordBatch.from_arrays([pa.array(rows.column("_id").to_numpy()[at]), pa.array(rows.column("_th").to_numpy()[at]), pa.array(begin + first), pa.array(begin + last + minimum)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += len(b)
            if count < _ROWS:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows.column("_a").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield settle(rows.slice(0, cut))
            held, count = rows.slice(cut).to_batches(), len(rows) - cut
        if count:
            yield settle(pa.Table.from_batches(held))

    return contexts.mapInArrow(run, "_id long, _th long, _from long, _to long")


def _contexts(texts: DataFrame, minimum: int, gram: int) -> DataFrame:
    """(_a, _many, _id, _th, _start, _left, _need, _bytes) of the anchors in _wanted; _start: where the bytes begin."""
    side = minimum - gram
    kinds = pa.schema([("_a", pa.int64()), ("_many", pa.bool_()), ("_id", pa.int64()), ("_th", pa.int64()), ("_start", pa.int64()), ("_left", pa.int64()), ("_need", pa.bool_()), ("_bytes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, th, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                whole = text.as_buffer()
                view = memoryview(whole)
                for w in wanted:
                    low, high = max(0, w["_at"] - side), min(len(view), w["_at"] + minimum)
                    out.append((w["_a"], w["_many"], i, th, low, w["_at"] - low, w["_need"], bytes(view[low:high])))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return texts.select("_id", "_th", "_text", "_wanted").mapInArrow(run, "_a long, _many boolean, _id long, _th long, _start long, _left long, _need boolean, _bytes binary")


def _counted_repeats(contexts: DataFrame, minimum: int) -> DataFrame:
    """As _context_repeats, by counting hashes of all strings in the contexts; strings with different places count."""
    starts = F.sequence(F.lit(0), F.octet_length("_bytes") - minimum)
    each = contexts.where(F.octet_length("_bytes") >= minimum).select("_id", "_th", F.col("_start"), "_need", "_bytes", F.explode(starts).alias("_o"))
    strings = each.select("_id", "_th", (F.col("_start") + F.col("_o")).alias("_from"), "_need", F.substring("_bytes", F.col("_o") + 1, F.lit(minimum)).alias("_s"))
    hashed = strings.select("_id", "_th", "_from", "_need", F.xxhash64(F.lit(1), "_s").alias("_h1"), F.xxhash64(F.lit(2), "_s").alias("_h2"))
    hashed = durable(hashed, "crowded-strings")
    places = hashed.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_th", "_from")).alias("_x"), F.max(F.struct("_id", "_th", "_from")).alias("_y")).where("_x <> _y")
    known = hashed.where("_need").join(durable(places.select("_h1", "_h2"), "crowded-repeats"), ["_h1", "_h2"])
    return known.select("_id", "_th", "_from", (F.col("_from") + minimum).alias("_to"))


def suffix_dedup(docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (begin and end of each removed run, flat), kept_sha256."""
    text_batches(docs.sparkSession)
    rows = _rows(docs)
    again = _anchor_hashes(rows, minimum, gram).groupBy("_a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a")
    known = durable(_anchors(rows, minimum, gram).join(durable(again, "repeated-anchors"), "_a"), "anchors")
    distinct = known.groupBy("_a", "_c", "_d").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_th", "_at")).alias("_one"))
    distinct = durable(distinct, "distinct-contexts")
    several = distinct.groupBy("_a").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    unlike = distinct.join(durable(several, "unlike-anchors"), "_a")
    full = known.join(distinct.where("_n > 1").select("_a", "_c", "_d"), ["_a", "_c", "_d"]).select("_id", "_th", "_at", F.lit(None).cast("long").alias("_a"), F.lit(False).alias("_many"), F.lit(False).alias("_need"))
    asked = unlike.select("_one._id", "_one._th", "_one._at", "_a", (F.col("_m") > max_group).alias("_many"), (F.col("_n") == 1).alias("_need"))
    place = F.struct("_at", "_a", "_many", "_need")
    wanted = full.unionByName(asked).groupBy("_id", "_th").agg(F.collect_set(F.when(F.col("_a").isNotNull(), place)).alias("_wanted"), F.collect_set(F.when(F.col("_a").isNull(), F.col("_at"))).alias("_full"))
    met = rows.join(wanted.hint("shuffle_hash"), ["_id", "_th"], "left")
    met = met.select("_id", "_th", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"), F.when(F.col("_wanted").isNotNull(), F.col("_text")).alias("_text"), "_wanted", "_full")
    texts = durable(met, "texts-with-repeats")
    open_texts = texts.where(F.col("_text").isNotNull() & (F.size("_wanted") > 0))
    contexts = durable(_contexts(open_texts, minimum, gram), "contexts")
    few = contexts.where(~F.col("_many")).drop("_many").repartition("_a").sortWithinPartitions("_a")
    found = _context_repeats(few.select("_a", "_id", "_th", "_start", "_left", "_need", "_bytes"), minimum, gram)
    crowded = contexts.where("_many")
    if not crowded.isEmpty():
        found = found.unionByName(_counted_repeats(crowded, minimum))
    found = found.groupBy("_id", "_th").agg(F.collect_set(F.struct("_from", "_to")).alias("_found"))
    out = texts.join(found.hint("shuffle_hash"), ["_id", "_th"], "left")
    return _spans(out, minimum, gram)


def _spans(rows: DataFrame, minimum: int, gram: int) -> DataFrame:
    side = minimum - gram
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, digests = [], []
            for n, sha, text, full, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                pieces = [(max(0, p - side), min(n, p + minimum)) for p in full or ()] + [(x["_from"], x["_to"]) for x in found or ()]
                whole: list[list[int]] = []
                for x, y in sorted(pieces):
                    if whole and x <= whole[-1][1]:
                        whole[-1][1] = max(y, whole[-1][1])
                    else:
                        whole.append([x, y])
                spans.append([p for s in whole for p in s])
                if whole:
                    data, at, kept = memoryview(text.as_buffer()), 0, hashlib.sha256()
                    for x, y in [*whole, [n, n]]:
                        kept.update(data[at:x])
                        at = y
                    sha = kept.hexdigest()
                digests.append(sha)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(digests)], schema=kinds)

    doc_id = F.when(F.col("_id") != _NOBODY, F.col("_id")).alias("doc_id")
    return rows.select(doc_id, "n_bytes", "_sha", "_text", "_full", "_found").mapInArrow(run, "doc_id long, n_bytes long, spans array<bigint>, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate(F.sequence(F.lit(0), F.size("spans").cast("int")), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.get("spans", i), F.lit(0)) * F.when(i % 2 == 0, -1).otherwise(1))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


OP2_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 2398) AS c FROM (SELECT doc_id, h, n, unnest(range(0, n - 199, 1000)) AS p FROM b WHERE n >= 200)),
w AS (SELECT doc_id, p + o AS s, md5(substr(c, 2 * o + 1, 400)) AS k FROM (SELECT doc_id, p, c, unnest(range(0, least(1000, n - 199 - p))) AS o FROM c)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM r)),
isl AS (SELECT doc_id, s, sum(CASE WHEN s <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
        FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM hit)),
sp AS (SELECT doc_id, g, min(s) AS a, max(s) + 200 AS z FROM isl GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM sp),
kept AS (SELECT cut.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(z) AS tail, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans
         FROM cut JOIN b ON b.doc_id = cut.doc_id GROUP BY cut.doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id
"""
