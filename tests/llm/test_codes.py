"""Vector codes, token files and fill-in-middle against plain versions, on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sunderflow.llm import fill_in_middle, token_files, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, vector int, code string, _label int, error int"
INF, NAN = float("inf"), float("nan")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def odd_vectors(n=60, width=8):
    rng = random.Random(5)
    some = lambda: [rng.uniform(-1, 1) for _ in range(width)]
    same = some()
    rows = [(i, same if i % 3 == 0 else some(), rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None] * (width // 2), 1), (n + 3, [INF] * width, 2), (n + 4, [NAN] * width, 2), (n + 5, some()[:-1], 2), (n + 6, some() + some(), 1)]
    rows += [(None, some(), None), (None, some(), None), (3, same, 2), (3, same, 2), (4, some(), 2), (n + 7, [3e38, -3e38] * (width // 2), 3), (n + 8, [-0.0, 1e-30, -1e-30, 0.5] * (width // 4), 3)]
    return rows


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [max(-(1 << 24), min(1 << 24, math.floor(1024 * float(np.float32(x))))) for x in v], lab) for i, v, lab in kept]
    lengths = Counter(len(v) for _, v, _ in whole if v and len(v) % parts == 0)
    length = max(lengths, key=lambda n: (lengths[n], n))
    fit = [x for x in whole if len(x[1]) == length]
    cut = lambda v: [tuple(v[p * length // parts : (p + 1) * length // parts]) for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted(fit, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (away(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in fit:
                own[near(cut(v)[p], books[p])].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(o) for c in zip(*o, strict=True)) if o else b for o, b in zip(own, books[p], strict=True)]
    out = []
    for i, v, lab in whole:
        if len(v) != length:
            out.append((i, lab, None, None))
            continue
        codes = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{c:02x}" for c in codes), sum(away(x, books[p][codes[p]]) for p, x in enumerate(cut(v)))))
    return ordered(out), books


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 4), (2, 256, 2), (8, 1, 1), (4, 5, 0)])
def test_vector_codes(spark, parts, entries, rounds):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], VECTORS).repartition(3)
    got, books = vector_codes.compress(df, parts, entries, rounds)
    want, plain = plain_codes(rows, parts, entries, rounds)
    assert ordered(got.select("vec_id", "label", "code", "error").collect()) == want
    assert [[tuple(e) for e in b.tolist()] for b in books] == plain


def test_vectors_come_back(spark):
    df = spark.createDataFrame([(i, [float(i), i / 2, -i / 4, 1.0], 0, 1, "x", 2, 3) for i in range(20)], VECTORS)
    codes, books = vector_codes.compress(df)
    back = {r.vec_id: r.vector for r in vector_codes.decoded(codes, books).collect()}
    assert back == {i: [i, i / 2, -i / 4, 1.0] for i in range(20)}
    assert codes.where("error <> 0").count() == 0


def test_bounds_hold_and_refinement_is_exact():
    rng = np.random.default_rng(3)
    for entries, width, spread in ((256, 16, 200), (256, 4, 3), (7, 1, 50), (1, 5, 9)):
        book = rng.integers(-spread, spread + 1, (entries, width))
        queries = np.r_[rng.integers(-2 * spread, 2 * spread + 1, (300, width)), book[:5]]
        file = vector_codes.CellFile(book)
        exact = ((queries[None] - book[:, None]) ** 2).sum(axis=2)
        least, most = file.bounds(queries)
        assert (least <= exact).all() and (exact <= most).all()
        entry, distance = file.nearest(queries)
        assert (entry == exact.argmin(axis=0)).all() and (distance == exact.min(axis=0)).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none)[0].count() == 0
    bad = spark.createDataFrame([(1, None, 1, 1, "x", 2, 3), (2, [NAN], 1, 1, "x", 2, 3), (3, [1.0], 1, 1, "x", 2, 3)], VECTORS)
    assert ordered(vector_codes.compress(bad)[0].collect()) == [(3, 1, None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(none, entries=257)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_any_token_by_itself(n):
    rng = random.Random(n)
    ids = np.array([rng.randrange(rng.choice([256, 1 << 16, 1 << 24, 1 << 32])) for _ in range(n)], "<u4")
    docs = [ids[: n // 3], ids[n // 3 : n // 3], ids[n // 3 :]]
    data = token_files.segment(3, 7, [5, None, 9], [d.tobytes() for d in docs]) + b"\n" + token_files.segment(3, 7 + n, [1], [ids.tobytes()]) + b"\n"
    one, two = token_files.segments(data)
    assert (one.take(np.arange(n)) == ids).all() and (two.take(np.arange(n)[::-1]) == ids[::-1]).all()
    assert [one[i] for i in range(0, n, 7)] == ids[::7].tolist()
    assert (one.starts.tolist(), one.doc_ids.tolist(), one.null.tolist(), two.first) == ([0, n // 3, n // 3, n], [5, 0, 9], [0, 1, 0], 7 + n)


TRICKY = ["a  b", " a", "a ", "a \n b", "x. y,z . w", "it's 's it 'll", "a b  c", "don't,stop. a1b2 3c.", "\x1c \x1d a", "<|endoftext|> a <|endoftext|>. b", "é, è. ñ.", "a\tb c", "日本 語。 ok.", "ab. " * 40, "　 x", "A. b.c. D,", "", "\n", "a\nb\n", "a.\nB, c\n\nd", "été\nÀ l'été. ωμέγα, слово. Ωx日 ²x x² ǅ ʰ ", "a) b) (c) x:y; ok!? 'tis", "a., b.. c.\n. d"]


def test_words_are_those_of_the_tokenizer():
    with open(token_files.VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    encoder, plain = token_files.TextEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    rng = random.Random(9)
    pool = [*"ab .,'\n\t1é-_ωЖ²)ʰ", "  ", "the", "ing", " ", "\x1f", "日"]
    for t in [*TRICKY, *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(3000))]:
        assert np.frombuffer(encoder(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_WORDS_KEPT", 10)
    with open(token_files.VOCABULARY, encoding="utf-8") as f:
        encoder = token_files.TextEncoder(f.read())
    text = " ".join(f"w{chr(97 + i % 23)}{chr(97 + i % 7)}" for i in range(500))
    assert encoder(text) == encoder.bare.encode(text)
    assert len(encoder.spaced) <= 10 and len(encoder.spaced.old) <= 10


def plain_directory(pairs, plain):
    """(doc_id, start, n_tokens, crc) of texts in order; of repeated ids the order is not told, so starts are by id."""
    out, start = [], 0
    for i, t in sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_tokens", [1, 1000, 1 << 20])
def test_token_files(spark, odd, pairs, tmp_path, segment_tokens):
    folder = f"file://{tmp_path}/files"
    more = [(100 + i, t) for i, t in enumerate(TRICKY)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    token_files.write(docs, folder, segment_tokens=segment_tokens)
    got = token_files.placed(token_files.directory(spark, folder)).orderBy("start").collect()
    want = plain_directory([(i, t) for i, t, *_ in pairs] + more, Tokenizer.from_file(token_files.VOCABULARY))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((i, n, c) for i, _, n, c in want)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_tokens_at(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    texts = [(i, " ".join(f"word{i}x{j}" for j in range(40 * (i % 5)))) for i in range(60)]
    token_files.write(spark.createDataFrame(texts, "doc_id long, text string"), folder, segment_tokens=700)
    plain = Tokenizer.from_file(token_files.VOCABULARY)
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    rng = random.Random(2)
    wanted = [(i, rng.randrange(-1, len(ids[i]) + 2)) for i in [rng.randrange(60) for _ in range(300)] + [7] * 300]
    got = token_files.tokens_at(spark, folder, spark.createDataFrame([*wanted, (999, 0)], "doc_id long, at long")).collect()
    assert ordered(got) == ordered((i, a, ids[i][a] if 0 <= a < len(ids[i]) else None) for i, a in wanted)


def test_no_token_files(spark, nothing, tmp_path):
    folder = f"file://{tmp_path}/files"
    token_files.write(nothing, folder)
    assert token_files.placed(token_files.directory(spark, folder)).count() == 0


SPACE = "\x20\x09-\x0d"


def plain_middle(i, t, seed=42, rate=50, share=80):
    t = t or ""
    found = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(found) + 1), h2 % (len(found) + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return (i, len(found), "plain", None, None, t)
    spm = h4 % 100 < share
    return (i, len(found), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,share", [(50, 80), (100, 50), (100, 0), (0, 80)])
def test_fill_in_middle(spark, odd, pairs, rate, share):
    more = [(200, "a <P> b"), (201, "x<S>"), (202, "<M>"), (203, " \t a  b\n"), (204, "a <P"), (205, "S> < M> b <"), (206, "word " * 100_000), (207, "\n" * 300_000), (208, "é😀 " * 50), (209, "<" * 100)]
    more += [(i, f"<S some P> words {i} <") for i in range(210, 260)] + [(210, "<S some P> words 210 <")] * 30
    docs = odd.select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit(2).alias("ordinal")).unionByName(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in more], "doc_id long, text string, n int, form string, ordinal int"))
    got = fill_in_middle.fill_in_middle(docs, rate=rate, spm_share=share).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    given = [(i, t) for i, t, *_ in pairs] + more
    assert ordered(tuple(r)[:-1] for r in got) == ordered(plain_middle(i, t, rate=rate, share=share) for i, t in given)
    assert ordered((r.doc_id, r.back) for r in got) == ordered((i, t or "") for i, t in given)


def test_no_middles(nothing):
    assert fill_in_middle.fill_in_middle(nothing).count() == 0


def test_words_of_marks_are_encoded_once_and_checksums_taken_together():
    """A mark between spaces costs one call of the tokenizer, however often it comes; ids and checksums are what they were."""
    import zlib

    import numpy as np

    with open(token_files.VOCABULARY, encoding="utf-8") as f:
        encoder = token_files.TextEncoder(f.read())
    text, calls = "one | two, | three!! | (four) | five_ | 6. | seven\n| | ...", []
    for words in (encoder.bare, encoder.spaced):
        words.encode = lambda x, f=words.encode: (calls.append(x), f(x))[1]
    got = encoder(text)
    assert calls.count(" |") == 1
    assert np.frombuffer(got, "<u4").tolist() == encoder.bare.tokenizer.encode(text, add_special_tokens=False).ids
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 300, 0, 70_000, 5)]
    found = token_files.Segment(token_files.segment(0, 0, list(range(5)), ids))
    assert token_files.checksums(found, 400) == token_files.checksums(found) == [zlib.crc32(x) for x in ids]
