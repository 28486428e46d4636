"""Token counts that follow edits.

A document's pre-tokens are cut into segments, the leaves of a tree of sums (characters, pre-tokens, tokens). An edit
finds its segments by descending the tree, splits only the text around it into pre-tokens again (from the last
pre-token that cannot have looked at the edit to the first old boundary that is met again), encodes the pre-tokens
that changed and updates the sums on the way to the root. So the count after an edit costs the edit's neighbourhood,
not the document, and equals that of encoding the edited text anew.

Trees are kept: stored_trees writes every document with its leaves' sums, edited_counts takes edits to such rows; edited_trees
gives the rows that they make, for the next edits. A tree
that comes from its leaves splits a segment's text into pre-tokens when an edit touches it, and encodes what changed only.

The vocabulary is a file of ranks (byte pairs in base64, rank), read by the driver and shipped once. Edits are
(begin, end, replacement) in code points of the text as it is before that edit; they apply in order.

Null and empty texts have no tokens. An edit beyond the text is cut to it. Rows that repeat a doc_id are rows of their
own; a null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import F, documents, durable, text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that goes with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How many characters beyond its end a pre-token's match may have looked at.
LOOKAHEAD = 3
SEGMENT = 64
_MEMO = 400_000

Edit = tuple[int, int, str]


class Encoder:
    """Counts the tokens of pre-tokens; keeps the counts of those it has met, up to a bound."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("shipped", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.memo: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        counts = [*map(memo.get, pieces)]
        if None in counts:
            if len(memo) > _MEMO:
                memo.clear()
            for i, n in enumerate(counts):
                if n is None:
                    p = pieces[i]
                    if p not in memo:
                        memo[p] = len(self.encoding._encode_single_piece(p))
                    counts[i] = memo[p]
        return counts


class SegmentTree:
    """A text's pre-tokens in segments, under a tree of sums. re_encoded counts the pre-tokens that edits encoded."""

    def __init__(self, text: str, encoder: Encoder):
        self.encoder, self.re_encoded, self.whole = encoder, 0, text
        self._grow(encoder.pattern.findall(text))

    @classmethod
    def of(cls, text: str, leaves: list[tuple[int, int, int]], encoder: Encoder) -> SegmentTree:
        """The tree of a text whose leaves' sums (characters, pre-tokens, tokens) are known; nothing is split or encoded."""
        out = cls.__new__(cls)
        out.encoder, out.re_encoded, out.whole = encoder, 0, text
        ends = [*accumulate(n for n, _, _ in leaves)]
        out.pieces = [*zip([0, *ends[:-1]], ends, strict=True)]
        out._sum_up(leaves)
        return out

    @property
    def leaves(self) -> list[tuple[int, int, int]]:
        return self.sums[self.room : self.room + len(self.pieces)]

    def _own(self, s: int) -> list[str]:
        """A segment's pre-tokens. Those that no edit has touched are found where they begin in the stored text."""
        own = self.pieces[s]
        if isinstance(own, tuple):
            at, end = own
            own = []
            while at < end:
                own.append(self.encoder.pattern.match(self.whole, at).group())
                at += len(own[-1])
            self.pieces[s] = own
        return own

    def _grow(self, pieces: list[str]) -> None:
        counts = self.encoder(pieces)
        self.pieces = [pieces[i : i + SEGMENT] for i in range(0, len(pieces), SEGMENT)] or [[]]
        self._sum_up([(sum(map(len, p)), len(p), sum(counts[i * SEGMENT : (i + 1) * SEGMENT])) for i, p in enumerate(self.pieces)])

    def _sum_up(self, leaves: list[tuple[int, int, int]]) -> None:
        self.room = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [(0, 0, 0)] * self.room + leaves + [(0, 0, 0)] * (self.room - len(leaves))
        for i in range(self.room - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def pretokens(self) -> int:
        return self.sums[1][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    @property
    def text(self) -> str:
        return "".join(p for s in range(len(self.pieces)) for p in self._own(s))

    def _segment(self, at: int) -> tuple[int, int]:
        """The segment that holds character `at`, and where it begins; the last one with text for the text's end."""
        at, begin, i = min(at, self.characters - 1), 0, 1
        while i < self.room:
            i *= 2
            if at - begin >= self.sums[i][0]:
                begin += self.sums[i][0]
                i += 1
        return i - self.room, begin

    def edit(self, begin: int, end: int, replacement: str) -> None:
        begin = max(0, min(begin, self.characters))
        end = max(begin, min(end, self.characters))
        if not self.characters:
            self._grow(self.encoder.pattern.findall(replacement))
            self.re_encoded += self.pretokens
            return
        first, offset = self._segment(max(0, begin - LOOKAHEAD - 1))
        # Pre-tokens that end LOOKAHEAD before the edit stay; the scan begins after the last of them.
        while True:
            at, keep = offset, 0
            for p in self._own(first):
                if at + len(p) + LOOKAHEAD > begin:
                    break
                at += len(p)
                keep += 1
            if keep or not first:
                break
            first -= 1
            offset -= self.sums[self.room + first][0]
        head = self._own(first)[:keep]
        last, tail_at = self._segment(end)
        inside = "".join([*self._own(first)[keep:], *(p for s in range(first + 1, last + 1) for p in self._own(s))])
        stop = tail_at + self.sums[self.room + last][0]
        changed = inside[: begin - at] + replacement + inside[end - at :]
        moved = len(replacement) - (end - begin)
        # Old boundaries after the edit, in the new text's places; the scan ends where it meets one.
        new: list[str] = []
        while True:
            more = "".join(self._own(last + 1)) if last + 1 < len(self.pieces) else ""
            new, met, rest = self._scan(changed, more, begin - at + len(replacement), self._ends(first, keep, last, at, moved))
            if met or last + 1 >= len(self.pieces):
                break
            last += 1
            changed += more
            stop += len(more)
        self.re_encoded += len(new)
        self._put(first, last, [*head, *new, *rest])

    def _ends(self, first: int, keep: int, last: int, at: int, moved: int) -> dict[int, tuple[int, int]]:
        """Where pre-tokens of segments first..last end after the edit, relative to the scan's begin: their segment, number."""
        ends, place = {}, 0
        for s in range(first, last + 1):
            for k, p in enumerate(self._own(s)):
                if s == first and k < keep:
                    continue
                place += len(p)
                ends[place + moved] = (s, k)
        return ends

    def _scan(self, text: str, more: str, after: int, ends: dict[int, tuple[int, int]]) -> tuple[list[str], bool, list[str]]:
        """(new pre-tokens, whether an old boundary was met, the old pre-tokens that follow it)."""
        new: list[str] = []
        limit = len(text)
        for m in self.encoder.pattern.finditer(text + more):
            if m.end() > limit:
                break
            new.append(m.group())
            if m.end() >= after and m.end() in ends:
                s, k = ends[m.end()]
                rest = self._own(s)[k + 1 :]
                done = m.end() + sum(map(len, rest))
                for t in range(s + 1, len(self.pieces)):
                    if done >= limit:
                        break
                    rest = rest + self._own(t)
                    done += sum(map(len, self._own(t)))
                return new, True, rest
        return new, sum(map(len, new)) == limit and not more, []

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """Replaces segments first..last and updates the sums above them."""
        if len(pieces) > 4 * SEGMENT * (last - first + 1):
            before, after = ([p for s in part for p in self._own(s)] for part in (range(first), range(last + 1, len(self.pieces))))
            self._grow([*before, *pieces, *after])
            return
        share = -(-len(pieces) // (last - first + 1)) or 1
        changed = set()
        for n, s in enumerate(range(first, last + 1)):
            own = pieces[n * share : (n + 1) * share]
            if own != self._own(s):
                self.pieces[s] = own
                self.sums[self.room + s] = (sum(map(len, own)), len(own), sum(self.encoder(own)))
                changed.add((self.room + s) // 2)
        while changed:
            for i in sorted(changed, reverse=True):
                if i:
                    self._add(i)
            changed = {i // 2 for i in changed if i > 1}


#: What op1's edits redact: mail addresses, dotted and long numbers, secrets in quotes.
PERSONAL = regex.compile(r"(?<![\w.+-])[\w.+-]{1,64}+@[\w-]{1,64}\.[\w.-]{1,64}|\d[\d .()-]{7,24}\d|\"[0-9a-f]{16,128}\"")


def redactions(text: str) -> list[Edit]:
    """Edits, from the end on, that put a mark in place of personal data."""
    return [(m.start(), m.end(), "<redacted>") for m in PERSONAL.finditer(text)][::-1]


def _shipped(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The vocabulary's bytes; its size is the file's, whatever the tables'."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_LEAF = pa.struct([("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
_LEAVES = "array<struct<n_chars: bigint, n_pretokens: bigint, n_tokens: bigint>>"


def stored_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, n_chars, n_pretokens, n_tokens, leaves) for every row of docs, to be kept as a table."""
    text_batches(docs.sparkSession)
    shipped = _shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        for texts in batches:
            leaves = [[dict(zip(("n_chars", "n_pretokens", "n_tokens"), x, strict=True)) for x in SegmentTree(t.as_py() or "", encoder).leaves] for t in texts]
            yield pa.array(leaves, pa.list_(_LEAF))

    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.arrow_udf(run, _LEAVES)("text").alias("leaves"))
    total = lambda name: F.aggregate("leaves", F.lit(0).cast("long"), lambda n, x: n + x[name]).alias(name)
    return found.select("doc_id", "text", *map(total, ("n_chars", "n_pretokens", "n_tokens")), "leaves")


def edited_counts(trees: DataFrame, edits: Callable[[str], list[Edit]], vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of stored_trees under edits: doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded, n_chars_after, n_tokens_after."""
    shipped = _shipped(trees.sparkSession, vocabulary)
    names = ["n_edits", "n_reencoded", "n_chars_after", "n_tokens_after"]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        for texts, stored in batches:
            out = []
            for t, leaves in zip(texts, stored, strict=True):
                text = t.as_py()
                script = edits(text)
                if not script:
                    out.append((0, 0, None, None))
                    continue
                tree = SegmentTree.of(text, [tuple(x.values()) for x in leaves.as_py()], encoder)
                for e in script:
                    tree.edit(*e)
                out.append((len(script), tree.re_encoded, tree.characters, tree.tokens))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.StructArray.from_arrays(columns, names)

    found = F.arrow_udf(run, ", ".join(f"{n} long" for n in names))("text", "leaves")
    rows = trees.withColumn("_e", found)
    after = [F.coalesce(F.col("_e")[f"{n}_after"], F.col(n)).alias(f"{n}_after") for n in ("n_chars", "n_tokens")]
    return rows.select("doc_id", "n_chars", "n_pretokens", "n_tokens", "_e.n_edits", "_e.n_reencoded", *after)


def edited_trees(trees: DataFrame, edits: Callable[[str], list[Edit]], vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of stored_trees under edits, as stored_trees has them: the edited texts with their leaves' sums, to take further edits.

    n_edits and n_reencoded follow: how many edits there were, and how many pre-tokens they encoded. Segments that no edit has touched
    keep their sums.
    """
    shipped = _shipped(trees.sparkSession, vocabulary)
    kinds = pa.struct([("text", pa.string()), ("leaves", pa.list_(_LEAF)), ("n_edits", pa.int64()), ("n_reencoded", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        for texts, stored in batches:
            out = []
            for t, leaves in zip(texts, stored, strict=True):
                text, sums = t.as_py(), leaves.as_py()
                script, encoded = edits(text), 0
                if script:
                    tree = SegmentTree.of(text, [tuple(x.values()) for x in sums], encoder)
                    for e in script:
                        tree.edit(*e)
                    text, encoded = tree.text, tree.re_encoded
                    sums = [dict(zip(("n_chars", "n_pretokens", "n_tokens"), x, strict=True)) for x in tree.leaves if x[0]] or sums[:0]
                out.append({"text": text, "leaves": sums or [{"n_chars": 0, "n_pretokens": 0, "n_tokens": 0}], "n_edits": len(script), "n_reencoded": encoded})
            yield pa.array(out, kinds)

    found = F.arrow_udf(run, f"text string, leaves {_LEAVES}, n_edits long, n_reencoded long")("text", "leaves")
    rows = trees.select("doc_id", found.alias("_e")).select("doc_id", "_e.*")
    total = lambda name: F.aggregate("leaves", F.lit(0).cast("long"), lambda n, x: n + x[name]).alias(name)
    return rows.select("doc_id", "text", *map(total, ("n_chars", "n_pretokens", "n_tokens")), "leaves", "n_edits", "n_reencoded")


def token_counts(docs: DataFrame, edits: Callable[[str], list[Edit]] = redactions, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs, by stored trees and edits to them; columns as edited_counts has them."""
    return edited_counts(durable(stored_trees(docs, vocabulary), "token-trees"), edits, vocabulary)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
