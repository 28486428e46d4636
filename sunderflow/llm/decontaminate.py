"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (ASCII letters in lower case, digits, and everything outside ASCII) and put into one
suffix automaton. Training words stream through it; the length of the longest match that ends at each word tells
where windows (13 item words, or a whole shorter item) occur. Words inside an occurrence are hit; a document whose hit
words reach a share of its words is contaminated.

Items come in blocks of at most MAX_BLOCK words, one automaton each. With several blocks each is a job of its own that
writes what it hit, by the text's 128-bit hash; these tables are then joined and merged. So a task holds one automaton and
the driver one block, whatever the benchmark's size.

Null and wordless texts have no words and are never contaminated; null and wordless items have no window. Items with
equal texts all count; items of one item_id count once, and its windows are those of all of them. A null item_id counts
as ''. Rows that repeat a doc_id are rows of their own. An empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, documents, durable, key128, text_batches

WINDOW, MAX_BLOCK, SHARE = 13, 200_000, 20
#: A word, for Java's regular expressions.
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes that are no part of a word become spaces; A-Z become a-z.
_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class SuffixAutomaton:
    """All substrings of the items' word sequences. State 0 is the empty match.

    at_window[s]: the state of the last `window` words of a match in s, or 0; window_items: the items that hold those;
    ended[s]: the short items that are suffixes of the longest match in s, by their length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], [set()]
        whole: dict[int, dict[int, set[int]]] = {}
        self.names = [name for name, _ in items]
        for at, (_, text) in enumerate(items):
            last = 0
            for word in text:
                last = self._add(last, self.words.setdefault(word, len(self.words)), own)
                own[last].add(at)
            if 0 < len(text) < window:
                whole.setdefault(last, {}).setdefault(len(text), set()).add(at)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        for s in reversed(order[1:]):  # a suffix occurs wherever what it is a suffix of does
            if self.length[self.link[s]] >= window:
                own[self.link[s]] |= own[s]
        # The state of a match's last `window` words: the ancestor whose lengths hold that number.
        self.at_window = [0] * len(self.link)
        ended: list[dict[int, set[int]]] = [{} for _ in self.link]
        for s in order[1:]:
            up = self.link[s]
            self.at_window[s] = self.at_window[up] or (s if self.length[up] < window <= self.length[s] else 0)
            ended[s] = ended[up] | whole.get(s, {}) if s in whole else ended[up]
        # Sets travelled up as far as states whose lengths span `window`, which so hold all items of that window.
        self.window_items = {s: own[s] for s in set(self.at_window)}
        self.ended = ended

    def _add(self, last: int, word: int, own: list[set[int]]) -> int:
        """Extends the item that ends in state `last` by a word; returns the state of the longer prefix."""
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, word, own)
        state = self._state(self.length[last] + 1, {}, own)
        back = last
        while back >= 0 and word not in self.next[back]:
            self.next[back][word] = state
            back = self.link[back]
        if back >= 0:
            there = self.next[back][word]
            self.link[state] = there if self.length[there] == self.length[back] + 1 else self._split(back, there, word, own)
        else:
            self.link[state] = 0
        return state

    def _split(self, back: int, there: int, word: int, own: list[set[int]]) -> int:
        half = self._state(self.length[back] + 1, dict(self.next[there]), own)
        self.link[half] = self.link[there]
        self.link[there] = half
        while back >= 0 and self.next[back].get(word) == there:
            self.next[back][word] = half
            back = self.link[back]
        return half

    def _state(self, length: int, following: dict[int, int], own: list[set[int]]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        own.append(set())
        return len(self.length) - 1

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first, last + 1) of every window occurrence, by end, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        window, state, n = self.window, 0, 0
        following, link, length, at_window, ended = self.next, self.link, self.length, self.at_window, self.ended
        for i, word in enumerate(map(self.words.get, text, repeat(-1))):
            if word < 0:
                state = n = 0
                continue
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = following[state].get(word)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                found |= self.window_items[at_window[state]]
            if ended[state]:
                for size, items in ended[state].items():
                    if size <= n:
                        spans.append((i + 1 - size, i + 1))
                        found |= items
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, max_block: int = MAX_BLOCK) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, in blocks of at most max_block words (or one longer item), read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        text = words_of((row[1] or "").encode())
        if text and block and size + len(text) > max_block:
            yield block
            block, size = [], 0
        if text:
            block.append((row[0], text))
            size += len(text)
    yield block


_MATCHED = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_JUDGED = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
_VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<bigint>"


def _verdict(found: list[dict]) -> dict:
    """The union of what some blocks matched in a document."""
    whole = merged([(m["spans"][i], m["spans"][i + 1]) for m in found for i in range(0, len(m["spans"]), 2)])
    names = sorted({x for m in found for x in m["items"]})
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return {"n_words": found[0]["n_words"], "n_hit": sum(e - a for a, e in whole), "n_items": len(names), "items_sha256": digest, "spans": [p for s in whole for p in s]}


def matched(text: Column, shipped: Broadcast, window: int, final: bool) -> Column:
    """struct(n_words, spans, items) of a text column, for one block of items; spans lists begins and ends.

    final: it is the only block, and the verdict comes at once.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = SuffixAutomaton(shipped.value, window)
        for texts in batches:
            rows = []
            for x in texts:
                words = words_of(x.as_buffer().to_pybytes()) if x.is_valid else []
                where, which = automaton.matches(words)
                row = {"n_words": len(words), "spans": [p for s in merged(where) for p in s], "items": [automaton.names[i] for i in which]}
                rows.append(_verdict([row]) if final else row)
            yield pa.array(rows, _JUDGED if final else _MATCHED)

    return F.arrow_udf(run, _VERDICT if final else "n_words long, spans array<bigint>, items array<string>")(text.cast("binary"))


def _judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in batches:
        yield pa.array([_verdict(found) for found in rows.to_pylist()], _JUDGED)


def _block_hits(docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """(_h1, _h2, _m): what a block of items matched, of each text that it did."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    found = docs.where(F.col("text").isNotNull()).select(*key128(F.col("text")), matched(F.col("text"), shipped, window, False).alias("_m"))
    hits = durable(found.where(F.size("_m.spans") > 0).dropDuplicates(["_h1", "_h2"]), "block-hits")
    shipped.unpersist()
    return hits


def judged(docs: DataFrame, benchmark: DataFrame, out: str, window: int = WINDOW, max_block: int = MAX_BLOCK, share: int = SHARE) -> DataFrame:
    """docs with a column `out`: struct(n_words, n_hit, n_items, items_sha256, spans, contaminated).

    spans lists first and last + 1 of each hit run of words; contaminated: hit words are at least 1 / share of all. With
    one block of items nothing is shuffled; with several, docs are joined with the hits of all.
    """
    spark = docs.sparkSession
    text_batches(spark)
    ahead = blocks(benchmark, max_block)
    first, second = next(ahead), next(ahead, None)
    if second is None:
        rows = docs.withColumn(out, matched(F.col("text"), spark.sparkContext.broadcast(first), window, True))
    else:
        hits = [_block_hits(docs, block, window) for block in chain([first, second], ahead)]
        merged_hits = reduce(DataFrame.unionByName, hits).groupBy("_h1", "_h2").agg(F.collect_list("_m").alias("_m"))
        all_hits = durable(merged_hits, "all-hits")
        words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
        none = F.struct(words.alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
        rows = docs.withColumns(dict(zip(("_h1", "_h2"), key128(F.col("text")), strict=True))).join(all_hits, ["_h1", "_h2"], "left")
        rows = rows.withColumn(out, F.arrow_udf(_judge, _VERDICT)(F.coalesce("_m", F.array(none)))).drop("_h1", "_h2", "_m")
    hit, words = F.col(out)["n_hit"], F.col(out)["n_words"]
    return rows.withColumn(out, F.col(out).withField("contaminated", (hit > 0) & (share * hit >= words)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, spans, contaminated."""
    return judged(docs.select("doc_id", "text"), benchmark, "_j", window, max_block, share).select("doc_id", "_j.*")


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """A text without the runs of words that spans lists, from each run's first byte to its last."""
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", text.translate(_TO_WORDS))]
    kept, at = [], 0
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK, share: int = SHARE) -> DataFrame:
    """doc_id, clean_text and contaminated for every row of docs: the texts without their hit runs of words.

    Texts without a hit stay as they are, null included. contaminated tells whether the hits reach the limit of coverage.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([without_spans(t.as_buffer().to_pybytes(), s.as_py()).decode() for t, s in zip(texts, spans, strict=True)], pa.string())

    found = judged(docs.select("doc_id", "text"), benchmark, "_j", window, max_block, share)
    text = F.when(F.col("_j.n_hit") > 0, F.arrow_udf(run, "string")(F.coalesce("text", F.lit("")).cast("binary"), "_j.spans")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("clean_text"), "_j.contaminated")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(13, len(w)) AS k, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT doc_id, j, dw.k, item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.t = dw.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
