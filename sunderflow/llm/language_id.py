"""Language ID by prediction by partial matching (PPM).

For every language a variable-order byte context tree is learned: how often each byte followed each context of up to
`order` bytes. With these statistics frozen, a text's exact code length in a language is the sum over its bytes of
-log2 of the probability that PPM (method C, without exclusions) gives them: a byte seen in the longest context costs
log2((n + d) / count), n being the context's occurrences and d its different followers; one that isn't costs the
escape log2((n + d) / d) and is coded in the context that is a byte shorter; below the empty context all 256 bytes are
equally likely. A context that a language has never seen escapes for free. The language of the shortest code wins;
the score is its share under equal priors, 2^-length over the sum.

Training takes at most MAX_TRAIN documents a language, those first in a seeded shuffle of the language's eligible
rows, and of these as many as begin within its first MAX_BYTES bytes: bounds on the model's size, whatever the table's.
The shuffle's key comes from doc_id and text, and counts per key range tell which rows can be among the first; so every
language with an eligible row is learned, also where rows share a doc_id. Scoring covers whole texts of all rows. Texts run through
hash tables that hold, for every byte sequence of up to order + 1 that any language has seen, its code lengths in all
languages; so a byte takes a few array reads, not one walk a language.

Null texts and those without a letter get `und` and score 0; so does everything if there is nothing to learn from.
Equal code lengths go to the language first by name. Null doc_ids hash as ''. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, Window, documents, durable, seeded, text_batches

ORDER, MAX_TRAIN, MAX_BYTES, SEED, FOLDS = 3, 1500, 1 << 24, 11, 5
UNKNOWN = "und"
_STRETCH = 1 << 18


def fold() -> Column:
    """0 for held-out documents."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(docs: DataFrame, most: int = MAX_TRAIN, seed: int = SEED, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(lang, text): at most `most` eligible rows of each language, first by shuffle key, that begin within most_bytes.

    Rows are counted by ranges of the key; those up to the range that holds the last one wanted are ranked, first within
    their input partition, so no task ranks all rows of a language or all copies of a row.
    """
    can = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    can = can.select("lang", "text", seeded(seed, F.col("doc_id"), F.xxhash64("text")).alias("_k")).withColumn("_range", F.substring("_k", 1, 4))
    counts = can.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = durable(counts.withColumn("_before", before).where(F.col("_before") < most).groupBy("lang").agg(F.max("_range").alias("_last")), "training-ranges")
    near = can.join(F.broadcast(last) if last.count() <= 10_000 else last, "lang").where(F.col("_range") <= F.col("_last"))
    for by in (["lang", "_part"], ["lang"]):
        near = near.withColumn("_part", F.spark_partition_id()) if "_part" in by else near
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_k"))).where(F.col("_r") <= most)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    return near.withColumn("_size", F.coalesce(size, F.lit(0))).where(F.col("_size") < most_bytes).select("lang", "text")


def _grams(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n-byte sequences of texts that lie one after the other in data, as numbers; sequences don't cross texts."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i].astype(np.uint64)
    keep = np.ones(len(out), bool)
    for back in range(1, n):
        inside = starts[(starts >= back) & (starts - back < len(out))] - back
        keep[inside] = False
    return out[keep]


def gram_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, gram, count) for n from 1 to order + 1."""
    kinds = "lang string, n int, gram long, count long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), [x.as_buffer().to_pybytes() for x in b.column(1)]
            for lang in sorted(set(langs)):
                own = [t for name, t in zip(langs, texts, strict=True) if name == lang]
                data = np.frombuffer(b"".join(own), np.uint8)
                starts = np.cumsum([len(t) for t in own])[:-1]
                for n in range(1, order + 2):
                    grams, counts = np.unique(_grams(data, starts, n), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "n", "gram", "count"])

    counted = sample.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, kinds)
    return counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class _Table:
    """Numbers to rows of `width` values; open addressing in arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rows = np.zeros((1 << bits, rows.shape[1]), np.float32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            first = np.unique(at[left][free], return_index=True)[1]
            put = left[free][first]
            self.keys[at[put]], self.rows[at[put]] = keys[put], rows[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def state(self) -> tuple:
        return self.shift, self.mask, self.keys, self.rows

    @classmethod
    def of(cls, state: tuple) -> _Table:
        out = cls.__new__(cls)
        out.shift, out.mask, out.keys, out.rows = state
        return out

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, at.astype(np.int64), -1)
        left = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (held != np.uint64(2**64 - 1))]
        return out


class PPM:
    """Frozen context trees of several languages, as tables of code lengths in bits."""

    def __init__(self, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """counts: for each language and n, the sorted n-byte sequences and how often they occur."""
        self.order = order
        self.languages = sorted({lang for lang, _ in counts})
        self.codes: list[_Table] = []
        self.escapes: list[_Table] = []
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for n in range(1, order + 2):
            own = [counts.get((lang, n), empty) for lang in self.languages]
            grams = np.unique(np.concatenate([g for g, _ in own])) if own else empty[0]
            contexts = np.unique(grams >> np.uint64(8)) if n > 1 else np.zeros(1, np.uint64)
            escape = np.zeros((len(contexts), len(own)), np.float64)
            code = np.zeros((len(grams), len(own)), np.float64)
            lower = self._lower(grams, n)
            for i, (g, c) in enumerate(own):
                at = np.searchsorted(contexts, g >> np.uint64(8) if n > 1 else np.zeros(len(g), np.uint64))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts)).astype(float)
                known = kinds > 0
                escape[known, i] = np.log2((total + kinds)[known] / kinds[known])
                of = np.searchsorted(contexts, grams >> np.uint64(8) if n > 1 else np.zeros(len(grams), np.uint64))
                code[:, i] = escape[of, i] + lower[:, i]
                seen = np.searchsorted(grams, g)
                code[seen, i] = np.log2((total + kinds)[at] / c)
            self.codes.append(_Table(grams, code.astype(np.float32)))
            self.escapes.append(_Table(contexts, escape.astype(np.float32)))

    def state(self) -> tuple:
        """Plain data for PPM.of."""
        return self.order, self.languages, [t.state() for t in self.codes], [t.state() for t in self.escapes]

    @classmethod
    def of(cls, state: tuple) -> PPM:
        out = cls.__new__(cls)
        out.order, out.languages = state[:2]
        out.codes, out.escapes = ([_Table.of(t) for t in tables] for tables in state[2:])
        return out

    def _lower(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Code lengths of the last byte of n-byte sequences in contexts a byte shorter."""
        if n == 1:
            return np.full((len(grams), len(self.languages)), 8.0)
        out = np.zeros((len(grams), len(self.languages)))
        self._add(out, np.arange(len(grams)), grams & np.uint64((1 << 8 * (n - 1)) - 1), n - 1)
        return out

    def _add(self, out: np.ndarray, where: np.ndarray, grams: np.ndarray, n: int) -> None:
        """Adds to out[where] the code lengths of the last bytes of n-byte sequences in the context before them."""
        while n and len(where):
            at = self.codes[n - 1].find(grams)
            missed = at < 0
            out[where[~missed]] += self.codes[n - 1].rows[at[~missed]]
            where, grams = where[missed], grams[missed]
            context = self.escapes[n - 1].find(grams >> np.uint64(8) if n > 1 else np.zeros(len(grams), np.uint64))
            out[where[context >= 0]] += self.escapes[n - 1].rows[context[context >= 0]]
            n -= 1
            grams = grams & np.uint64((1 << 8 * n) - 1)
        out[where] += 8.0

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths (texts x languages) of the texts that bounds cut data into."""
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        full = self.order + 1
        for a in range(int(bounds[0]), int(bounds[-1]), _STRETCH):
            z = min(a + _STRETCH, int(bounds[-1]))
            texts = slice(int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, z, "left")))
            starts = bounds[texts]
            low = max(int(starts[0]), a - self.order)
            part = data[low:z]
            sums = np.zeros(z - low, np.uint64)
            for i in range(full):
                sums[i:] |= part[: len(part) - i].astype(np.uint64) << np.uint64(8 * i)
            sums = sums[a - low :]
            out = np.zeros((z - a, len(self.languages)), np.float32)
            short = np.zeros(z - a, bool)
            for n in range(1, full):  # the first bytes of a text have shorter contexts
                at = starts + n - 1 - a
                ends = bounds[texts.start + 1 : texts.stop + 1] - a
                at = at[(at >= 0) & (at < z - a) & (at < ends)]
                short[at] = True
                self._add(out, at, sums[at] & np.uint64((1 << 8 * n) - 1), n)
            rest = np.flatnonzero(~short)
            self._add(out, rest, sums[rest], full)
            cuts = np.maximum(starts - a, 0)
            some = np.flatnonzero(bounds[texts.start + 1 : texts.stop + 1] > starts)
            total[texts.start + some] += np.add.reduceat(out, cuts[some], axis=0, dtype=np.float64)
        return total


def learn(docs: DataFrame, order: int = ORDER, most: int = MAX_TRAIN, seed: int = SEED) -> PPM:
    """A PPM from the training sample of docs; its size is bounded by that of the sample."""
    rows = durable(gram_counts(training_sample(docs, most, seed), order), "gram-counts")
    counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for lang in sorted(r[0] for r in rows.select("lang").distinct().collect()):
        for n in range(1, order + 2):
            found = rows.where((F.col("lang") == lang) & (F.col("n") == n)).select("gram", "count").toArrow()
            grams, number = found.column(0).to_numpy().astype(np.uint64), found.column(1).to_numpy()
            sort = np.argsort(grams)
            counts[lang, n] = grams[sort], number[sort]
    return PPM(counts, order)


def identify(text: Column, model: PPM, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a text column."""
    text_batches(spark)
    shipped = spark.sparkContext.broadcast(model.state())

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ppm = PPM.of(shipped.value)
        names = np.array([*ppm.languages, UNKNOWN], object)
        for texts, lettered in batches:
            text = texts.cast(pa.large_binary())
            best, share = np.full(len(text), len(names) - 1), np.zeros(len(text))
            if ppm.languages and len(text):
                bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                bits = ppm.lengths(np.frombuffer(text.buffers()[2] or b"", np.uint8), bounds)
                can = lettered.to_numpy(zero_copy_only=False).astype(bool)
                best[can] = bits.argmin(axis=1)[can]
                share[can] = (1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1))[can]
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(share)], ["lang_pred", "score"])

    found = F.arrow_udf(run, "lang_pred string, score double")
    return found(F.coalesce(text, F.lit("")).cast("binary"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: PPM) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    found = docs.select("doc_id", (fold() == 0).alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
