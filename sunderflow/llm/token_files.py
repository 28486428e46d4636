"""Token ids in binary files of directly addressable codes.

An id is split into chunks of 8 bits, low ones first. A level holds the chunks of all ids that reach it, a bitmap that says
which of them go on, and a directory of ranks: how many go on before every 512th and, from there, every 64th. So id i is
its chunk at level 0 and, if it goes on, the chunk at level 1 at the place that the directory and one word's bits give,
and so on: any token is read by itself, no block is decoded.

A file is a run of segments, each followed by a line feed. A segment, all numbers little-endian: the mark SUNTOK1 and a zero byte; as
64-bit numbers the file's number, the segment's first token in its file, documents, tokens, levels and each level's number
of chunks; then doc_ids (64 bits), a byte each that is 1 for a null doc_id, documents' starts in the segment and the end
(64 bits); then per level chunks, bitmap (64-bit words), ranks of 512 (64 bits), ranks of 64 (16 bits). Every part is
padded to 8 bytes.

Spark sorts the rows by ranges of (doc_id, hash of the text, row), null doc_ids last, and each range becomes a file: Spark's own
text writer commits a file once, whichever attempts of a task were lost, and works in any file system that Spark does. Files are
read back with the binaryFile source. Where a file begins among all ids comes from sums over files. A worker keeps the codes of the words
it has met with the broadcast vocabulary, so that tasks after the first find them; two generations of them bound it.

Words are cut off where the vocabulary's own splitting must cut, too: before a space, and at a line feed, between a printable
ASCII or word character on either side. Texts with other spaces or line feeds go to the tokenizer whole. Null and empty texts have the end id only. Rows that repeat a
doc_id follow each other and are rows of their own. An empty table makes no segments. Extra columns are ignored.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import F, documents, durable, running_total, shared_folder, text_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MARK = b"SUNTOK1\0"
#: Tokens after which a segment ends with its document; bytes of text for which there is a file.
SEGMENT, FILE_BYTES = 1 << 20, 64 << 20
_WORDS_KEPT = 600_000


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def _levels(ids: np.ndarray) -> list[bytes]:
    """The number of levels and their sizes; then per level chunks, bitmap and both directories."""
    sizes, parts = [], []
    while len(ids) or not sizes:
        more = ids > 255
        words = np.packbits(np.r_[more, np.zeros(-len(more) % 64, bool)], bitorder="little").view("<u8")
        before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1]
        far = before[::8]
        near = (before - np.repeat(far, 8)[: len(before)]).astype("<u2")
        sizes.append(len(ids))
        parts += [(ids & 255).astype(np.uint8).tobytes(), words.tobytes(), far.astype("<i8").tobytes(), near.tobytes()]
        ids = ids[more] >> 8
    return [struct.pack(f"<{len(sizes) + 1}q", len(sizes), *sizes), *map(_padded, parts)]


def segment(file: int, first: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of a segment; ids: each document's ids as 32-bit numbers."""
    starts = np.r_[0, np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]
    head = MARK + struct.pack("<4q", file, first, len(ids), int(starts[-1]))
    levels = _levels(np.frombuffer(b"".join(ids), "<u4"))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = _padded(bytes(d is None for d in doc_ids))
    return b"".join([head, levels[0], known, null, starts.astype("<i8").tobytes(), *levels[1:]])


class Segment:
    """Reads a segment that begins at a place in a file's bytes. take() reads any tokens, each by itself."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, begin = data, at
        if data[at : at + 8] != MARK:
            raise ValueError(f"no segment of token ids at byte {at}")
        self.file, self.first, self.documents, self.tokens, levels = struct.unpack_from("<5q", data, at + 8)
        sizes = struct.unpack_from(f"<{levels}q", data, at + 48)
        self.at = begin + 48 + 8 * levels
        self.doc_ids, self.null = self._next("<i8", self.documents), self._next("u1", self.documents)
        self.starts = self._next("<i8", self.documents + 1)
        self.levels = [(self._next("u1", n), self._next("<u8", -(-n // 64)), self._next("<i8", -(-n // 512)), self._next("<u2", -(-n // 64))) for n in sizes]
        self.end = self.at

    def _next(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes + -out.nbytes % 8
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at places of the segment, in any order."""
        out = np.zeros(len(places), "<u4")
        at, whose = np.asarray(places, np.int64), slice(None)
        for level, (chunks, words, far, near) in enumerate(self.levels):
            out[whose] |= chunks[at].astype("<u4") << np.uint32(8 * level)
            word = words[at >> 6]
            bit = (at & 63).astype(np.uint64)
            more = np.flatnonzero((word >> bit) & np.uint64(1))
            if not len(more):
                break
            at, word, bit = at[more], word[more], bit[more]
            whose = more if isinstance(whose, slice) else whose[more]
            at = far[at >> 9] + near[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return out

    def __getitem__(self, place: int) -> int:
        return int(self.take(np.array([place]))[0])


def checksums(found: Segment, tokens: int = 1 << 16) -> list[int]:
    """The crc32 of each document's ids as 32-bit numbers; documents are read together up to that many tokens, or one by itself."""
    out, starts, i = [], found.starts, 0
    while i < found.documents:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + tokens, "right")) - 1)
        ids = memoryview(found.take(np.arange(starts[i], starts[j])).tobytes())
        ends = (4 * (starts[i : j + 1] - starts[i])).tolist()
        out += [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        i = j
    return out


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(data):
        yield (found := Segment(data, at))
        at = found.end + 1


class _Unsafe(Exception):
    """A text can't be cut at its spaces."""


class Words(dict):
    """Ids, as bytes, of words after a prefix; what is missing is encoded. old holds an earlier generation.

    Only words of letters, or of marks, are kept. What else is met is made of them where it can be: letters and the marks after
    them, and the two sides of a line feed, are never one pre-token.
    """

    SAFE = re.compile(r"[!-~\w](?:.*[!-~\w])?", re.S)
    #: ASCII marks, as they stand after letters.
    MARKS = string.punctuation
    #: Latin, Greek and Cyrillic: what is a letter there is one in every version of Unicode since 7.
    LAST_LETTER = "\u052f"

    def __init__(self, tokenizer: Tokenizer, prefix: str, bare: Words | None = None):
        self.tokenizer, self.prefix, self.bare, self.old = tokenizer, prefix, self if bare is None else bare, {}
        self.marks: dict[str, bytes] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = [chr(x) if x in plain else chr(next(others)) for x in range(256)]
        self.lead = "".join(self.letters[x] for x in prefix.encode())
        self.feed = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(self.MARKS)
        if len(letters) < len(word) and letters.isalpha():
            return self[letters] + self.marked(word[len(letters) :])
        if word and not letters:
            return self.kept(word, self.old.get(word) or self.encode(self.prefix + word))
        if not (word.isalpha() and (word.isascii() or max(word) <= self.LAST_LETTER)):
            return self.made(word)
        found = self.old.get(word)
        if found is None:
            piece = word if word.isascii() else "".join([self.letters[x] for x in word.encode()])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(self.lead + piece)])
        return self.kept(word, found)

    def kept(self, word: str, found: bytes) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def marked(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.encode(marks)
            if len(self.marks) < _WORDS_KEPT // 10:
                self.marks[marks] = found
        return found

    def made(self, word: str) -> bytes:
        if "\n" in word:
            first, *rest = word.split("\n")
            for line in (first, *rest):
                if not self.SAFE.fullmatch(line):
                    raise _Unsafe
            return self.feed.join([self[first], *map(self.bare.__getitem__, rest)])
        if not self.SAFE.fullmatch(word):
            raise _Unsafe
        return self.encode(self.prefix + word)


class TextEncoder:
    """The ids, as bytes, of whole texts."""

    def __init__(self, vocabulary: str):
        tokenizer = Tokenizer.from_str(vocabulary)
        self.bare = Words(tokenizer, "")
        self.spaced = Words(tokenizer, " ", self.bare)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        except _Unsafe:
            return self.bare.encode(text)


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, segment_tokens: int = SEGMENT, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of all texts, in ascending doc_id order, as files into a folder that isn't there yet."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size, whatever the tables'
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = getattr(shipped, "encoder", None)
        if encoder is None:
            encoder = shipped.encoder = TextEncoder(shipped.value)
        file, first, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"image": pa.array([segment(file, first, names, ids)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                ids.append(encoder(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= segment_tokens:
                    yield closed()
                    first, names, ids, held = first + held, [], [], 0
        if names:
            yield closed()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_th"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_th"), F.col("_row")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    images = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(pack, "image binary")
    images.select(F.col("image").cast("string")).write.text(folder)


def directory(spark: SparkSession, folder: str, digests: bool = True) -> DataFrame:
    """(file, segment, nth, doc_id, start, n_tokens, ids_crc32), one row per document, from the files; start is that in the file.

    The checksum is of the document's ids as 32-bit numbers, read through the codes; null without digests.
    """
    kinds = [("file", pa.int64()), ("segment", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in segments(content.as_buffer()):
                    n, starts = found.documents, found.starts
                    crc = pa.nulls(n, pa.int64())
                    if digests:
                        crc = pa.array(checksums(found), pa.int64())
                    of = [np.full(n, x) for x in (found.file, found.first)]
                    ids = pa.array(found.doc_ids, mask=found.null.astype(bool))
                    columns = [*map(pa.array, of), pa.array(np.arange(n)), ids, pa.array(found.first + starts[:-1]), pa.array(np.diff(starts)), crc]
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(read, "file long, segment long, nth long, doc_id long, start long, n_tokens long, ids_crc32 long")


def placed(found: DataFrame) -> DataFrame:
    """The directory with start among the ids of all files."""
    found = durable(found, "token-directory")
    sizes = durable(found.groupBy("file").agg(F.sum("n_tokens").alias("_n")), "token-file-sizes")
    bucket = F.floor(F.col("file") / max(1, int(sizes.count() ** 0.5))).alias("_b")
    upto = running_total(sizes.select("file", "_n", bucket, F.lit(0).alias("_all")), ["_all"], "_b", [F.col("file")], F.col("_n"), "_upto")
    starts = durable(upto.select("file", (F.col("_upto") - F.col("_n")).alias("_base")), "token-file-starts")
    return found.join(starts, "file").withColumn("start", F.col("_base") + F.col("start")).drop("_base")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, token) for rows (doc_id, at) of wanted: the at-th token, from 0, of each document of that id; null beyond its end.

    Requests travel to the files in batches of one file each; a file's other tokens aren't read.
    """
    of = directory(spark, folder, digests=False).where("doc_id is not null").select("file", "doc_id", "start", "n_tokens")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at")).join(durable(of, "token-directory"), "doc_id")
    inside = (F.col("at") >= 0) & (F.col("at") < F.col("n_tokens"))
    asked = durable(asked.select("file", "doc_id", "at", F.when(inside, F.col("start") + F.col("at")).alias("place")), "token-requests")
    many = F.floor(F.monotonically_increasing_id() / 4096)
    dealt = asked.where("place is not null").repartition("file", F.pmod(F.xxhash64("place"), F.lit(64))).sortWithinPartitions("file")
    lists = durable(dealt.withColumn("_many", many), "token-request-lists").groupBy("file", "_many").agg(F.collect_list(F.struct("doc_id", "at", "place")).alias("asked"))

    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, places in batches:
            out = []
            for content, at in zip(contents, places, strict=True):
                at, got = np.array(at.as_py(), np.int64), None
                got = np.zeros(len(at), np.int64)
                for found in segments(content.as_buffer()):
                    own = (at >= found.first) & (at < found.first + found.tokens)
                    got[own] = found.take(at[own] - found.first)
                out.append(got)
            yield pa.array(out, pa.list_(pa.int64()))

    number = F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long")
    files = spark.read.format("binaryFile").load(folder).select(number.alias("file"), "content")
    met = lists.join(files, "file").withColumn("got", F.arrow_udf(look_up, "array<long>")("content", "asked.place"))
    flat = met.select(F.explode(F.arrays_zip("asked", "got")).alias("x")).select("x.asked.doc_id", "x.asked.at", F.col("x.got").alias("token"))
    return flat.unionByName(asked.where("place is null").select("doc_id", "at", F.lit(None).cast("long").alias("token")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), folder)
    return placed(directory(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
