"""A quality classifier by hierarchical empirical Bayes.

A logistic model of each label (quality, toxicity) reads the document: style measures and indicators of the words that
labelled documents tell most about. Its probabilities are the document's evidence. Each level of the site tree (global,
host, path) then has a rate: the host's is its documents' mean evidence shrunk toward the global rate, the path's is
its own shrunk toward the host's, with a prior strength that the spread between sites on that level gives (method of
moments), so sparse sites stay near their parent. The document's posterior log-odds are its own evidence plus what its
path's rate, without the document, says beyond the global rate; so a document's evidence counts once. Rates are grouped
sums over all documents, labelled or not.

The model learns from at most MAX_LABELS labelled doc_ids, first in a seeded shuffle, outside the held-out fold, and
from one text of each (the first by its hash); words and weights are bounded by WORDS. Everything else covers all rows.

Null and empty texts have the evidence of an empty document. A null host or path is a site of its own. Labels that are
null are not used; of several labels of a doc_id the largest counts. Without labels, or with one class only, the
evidence is the labels' rate (1/2 without any). Rows that repeat a doc_id are rows of their own. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, documents, durable, seeded, text_batches

MAX_LABELS, WORDS, MIN_DOCUMENTS, SEED, FOLDS = 8000, 256, 3, 23, 5
TARGETS = ("quality", "toxic")
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_STOPS = np.array([i in b".!?" for i in range(256)])
_STYLES = 11


def style(text: bytes) -> tuple[list[float], set[bytes]]:
    """(style measures, different words in lower case without marks at their ends)."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.lower().split()
    different = {w.strip(b".,;:!?\"'()*#$%&|") for w in words}
    lines = text.split(b"\n")
    letters = int(counts[_LETTER].sum())
    marks = n - letters - int(counts[_DIGIT].sum()) - int(counts[_SPACE].sum()) if text else 0
    w = max(1, len(words))
    return [
        np.log1p(len(words)), np.log1p(letters / w), counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, marks / n, counts[_STOPS].sum() / w,
        counts[124] / w, len(different) / w, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), max(map(len, words), default=0) / n,
    ], different


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS, seed: int = SEED) -> DataFrame:
    """(text, quality, toxic) of at most `most` labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TARGETS])
    known = known.where(~held_out()).withColumn("_k", seeded(seed, F.col("doc_id")))
    chosen = durable(known.orderBy("_k").limit(most).drop("_k"), "labels")
    # At most `most` rows of three numbers: small enough for every executor.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Rows of one doc_id give one text: the least by hash, nulls last.
    one = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("_t")
    return met.groupBy("doc_id").agg(one, *[F.first(t).alias(t) for t in TARGETS]).select("_t.text", *TARGETS)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _words(rows: DataFrame) -> DataFrame:
    """(word, n, and per target n_<target>, pos_<target>): in how many labelled documents a word stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(style(x.as_buffer().to_pybytes() if x.is_valid else b"")[1]) for x in b.column(0)]
            of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array([w for s in sets for w in s], pa.binary()), *(b.column(i).take(pa.array(of)) for i in (1, 2))], ["word", *TARGETS])

    each = rows.select(F.col("text").cast("binary"), *[F.col(t).cast("int") for t in TARGETS]).mapInArrow(run, "word binary, quality int, toxic int")
    sums = [f(F.col(t)).alias(f"{name}_{t}") for t in TARGETS for f, name in ((F.count, "n"), (F.sum, "pos"))]
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= MIN_DOCUMENTS)


def _telling(rows: DataFrame, words: DataFrame, most: int) -> list[bytes]:
    """The `most` words of each target whose share of positive documents stands out most from the whole's."""
    found: set[bytes] = set()
    for t in TARGETS:
        n, pos = rows.agg(F.count(t), F.sum(F.col(t).cast("int"))).first()
        if n and 0 < pos < n:
            rate = pos / n
            z = F.abs(F.col(f"pos_{t}") - F.col(f"n_{t}") * rate) / F.sqrt(F.col(f"n_{t}") * rate * (1 - rate) + 1)
            found |= {bytes(r[0]) for r in words.orderBy(z.desc(), "word").select("word").limit(most).collect()}
    return sorted(found)


def _features(texts: Iterable[bytes], index: dict[bytes, int]) -> np.ndarray:
    out = []
    for text in texts:
        measures, different = style(text)
        row = np.zeros(_STYLES + len(index) + 1, np.float32)
        row[:_STYLES], row[-1] = measures, 1
        row[[_STYLES + index[w] for w in different if w in index]] = 1
        out.append(row)
    return np.array(out, np.float32).reshape(-1, _STYLES + len(index) + 1)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 2.0, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model with a ridge, by Newton's method; the last is the intercept and bears no penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Evidence:
    """Logistic models of the targets over style and words; plain data, so that it travels."""

    def __init__(self, words: list[bytes], x: np.ndarray, y: np.ndarray):
        self.words = words
        self.mean, self.spread = np.zeros(x.shape[1]), np.ones(x.shape[1])
        if len(x):
            self.mean[:_STYLES], self.spread[:_STYLES] = x[:, :_STYLES].mean(axis=0), x[:, :_STYLES].std(axis=0) + 1e-6
        self.weights, self.rates = [], []
        for t in range(y.shape[1]):
            use = ~np.isnan(y[:, t])
            rate = float(y[use, t].mean()) if use.any() else 0.5
            self.rates.append(rate)
            self.weights.append(_fit(((x - self.mean) / self.spread)[use], y[use, t]) if 0 < rate < 1 and use.any() else None)

    def state(self) -> tuple:
        return self.words, self.mean, self.spread, self.weights, self.rates


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS, words: int = WORDS, seed: int = SEED) -> Evidence:
    rows = durable(labelled(docs, labels, most, seed), "labelled")
    chosen = _telling(rows, durable(_words(rows), "label-words"), words)
    index = {w: i for i, w in enumerate(chosen)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features((v.as_buffer().to_pybytes() if v.is_valid else b"" for v in b.column(0)), index)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *(b.column(i) for i in (1, 2))], ["x", *TARGETS])

    found = rows.select(F.col("text").cast("binary"), *[F.col(t).cast("double") for t in TARGETS]).mapInArrow(run, "x binary, quality double, toxic double").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, _STYLES + len(chosen) + 1)
    y = np.array([[np.nan if v is None else v for v in found.column(t).to_pylist()] for t in TARGETS], float).T.reshape(-1, len(TARGETS))
    return Evidence(chosen, x, y)


def evidence(docs: DataFrame, model: Evidence, host: Column, path: Column) -> DataFrame:
    """(doc_id, _host, _path, p_quality, p_toxic): every row's site and what its text says."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mean, spread, weights, rates = shipped.value
        index = {w: i for i, w in enumerate(words)}
        for b in batches:
            out = [np.empty((0, len(TARGETS)))]
            for at in range(0, len(b), 1000):
                part = b.column(3).slice(at, 1000)
                x = (_features((v.as_buffer().to_pybytes() if v.is_valid else b"" for v in part), index) - mean) / spread
                p = [1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) if w is not None else np.full(len(x), r) for w, r in zip(weights, rates, strict=True)]
                out.append(np.stack(p, 1))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "_host", "_path", "p_quality", "p_toxic"])

    rows = docs.select(F.col("doc_id").cast("long"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, _host string, _path string, p_quality double, p_toxic double")


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _worth(sites: DataFrame, target: str, parent: Column) -> float:
    """How many documents the parent's rate is worth to the sites (_n and s_<target>: sums of evidence).

    The spread between sites beyond what chance gives them tells it, by the method of moments.
    """
    rate = F.col(f"s_{target}") / F.col("_n")
    off = F.sum(F.col("_n") * F.pow(rate - parent, 2))
    row = sites.agg(off.alias("off"), F.sum(parent * (1 - parent)).alias("chance"), F.sum("_n").alias("n"), F.avg(parent * (1 - parent)).alias("one")).first()
    if not row.n:
        return 1.0
    return max(row.one / max((row.off - row.chance) / row.n, 1e-9) - 1, 1.0)


def _shrunk(total: Column, n: Column, worth: Column, parent: Column) -> Column:
    return (total + worth * parent) / (n + worth)


def site_rates(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The path table and the global rates.

    The table has, for every path, (_host, _path), its own and its host's sums (_n, s_<t>, _hn, hs_<t>), what the parents'
    rates are worth (hw_<t>, pw_<t>), and the rates host_<t> and path_<t>.
    """
    paths = scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS])
    paths = durable(paths, "path-sums")
    hosts = durable(paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("_n", *(f"s_{t}" for t in TARGETS))]), "host-sums")
    total = hosts.agg(F.sum("_n"), *[F.sum(f"s_{t}") for t in TARGETS]).first()
    overall = {t: (total[i] / total[0] if total[0] else 0.5) for i, t in enumerate(TARGETS, 1)}
    kept = hosts.select(F.col("_host").alias("_h"), F.col("_n").alias("_hn"), *[F.col(f"s_{t}").alias(f"hs_{t}") for t in TARGETS])
    for t in TARGETS:
        kept = kept.withColumn(f"hw_{t}", F.lit(_worth(hosts, t, F.lit(overall[t]))))
        kept = kept.withColumn(f"host_{t}", _shrunk(F.col(f"hs_{t}"), F.col("_hn"), F.col(f"hw_{t}"), F.lit(overall[t])))
    paths = durable(paths.join(kept, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"), "paths")
    for t in TARGETS:
        paths = paths.withColumn(f"pw_{t}", F.lit(_worth(paths, t, F.col(f"host_{t}"))))
        paths = paths.withColumn(f"path_{t}", _shrunk(F.col(f"s_{t}"), F.col("_n"), F.col(f"pw_{t}"), F.col(f"host_{t}")))
    return durable(paths, "path-rates"), overall


def posterior(evidence: Column, target: str, overall: float) -> Column:
    """A document's probability from its evidence and from its site's rates without it, on a row that has both."""
    host = _shrunk(F.col(f"hs_{target}") - evidence, F.col("_hn") - 1, F.col(f"hw_{target}"), F.lit(overall))
    path = _shrunk(F.col(f"s_{target}") - evidence, F.col("_n") - 1, F.col(f"pw_{target}"), host)
    return 1 / (1 + F.exp(_logit(F.lit(overall)) - _logit(evidence) - _logit(path)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = MAX_LABELS, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, and per target evidence_<t>, host_<t>, path_<t>, score_<t>, is_<t>.

    Scores are posteriors; is_<t> tells whether they reach 1/2.
    """
    text_batches(docs.sparkSession)
    scored = durable(evidence(docs, learn(docs, labels, most, words), host, path), "evidence")
    sites, overall = site_rates(scored)
    there = sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), *[c for c in sites.columns if c not in ("_host", "_path")])
    out = scored.join(there, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    for t in TARGETS:
        out = out.withColumn(f"score_{t}", posterior(F.col(f"p_{t}"), t, overall[t])).withColumn(f"is_{t}", F.col(f"score_{t}") >= 0.5)
    columns = [c for t in TARGETS for c in (F.col(f"p_{t}").alias(f"evidence_{t}"), f"host_{t}", f"path_{t}", f"score_{t}", f"is_{t}")]
    return out.select("doc_id", held_out().alias("held_out"), *columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", "lang"))
    return found.withColumn("kept", F.col("is_quality") & ~F.col("is_toxic"))
