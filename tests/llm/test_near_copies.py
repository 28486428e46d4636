"""The pipeline's near copies against brute force over all pairs."""

import random
import re

import corpus_pipeline as p

from sunderflow.llm import near_copies

from .test_exact import SPACE, lower, ordered


def plain_set(t):
    words = [w for w in re.split(SPACE + "+", lower(t or "")) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_firsts(pairs):
    """doc_ids of the first of each group that links of Jaccard similarity 0.8 join; doc_ids are different."""
    sets, left, out = {i: plain_set(t) for i, t in pairs}, {i for i, _ in pairs}, set()
    while left:
        part = [left.pop()]
        for x in part:
            near = {y for y in left if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= near
            part += near
        out.add(min(part))
    return out


def test_near_copies_at_any_distance(spark):
    """Copies with 1 to 8 of 200 words changed, on both sides of 0.8, chains of them, short and blank texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = ["", " \n", None, "one two", "One  two", "one two three four five six", "one two three four five seven"]
    for _ in range(40):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in range(1, 9):
            for at in rng.sample(range(200), changes):
                base[at] = word()
            texts.append(" ".join(base))
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in p.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(plain_firsts(pairs))


def test_near_copies_of_the_tables(spark, data):
    docs = p.documents(spark, data)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_firsts(pairs)
    assert ordered((r.doc_id,) for r in p.near_duplicates(spark, docs, data).collect()) == ordered((i,) for i in want)


def changed_texts(seed, bases, copies, most):
    """Texts in groups: copies of a base with up to `most` of its 200 words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(bases):
        base = [word() for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(copies):
            other = base[:]
            for at in rng.sample(range(200), rng.randint(1, most)):
                other[at] = word()
            out.append(" ".join(other))
    return list(enumerate(out))


def test_large_groups_and_crowded_entries(spark):
    """Blocks of entries and of groups find what one task finds."""
    pairs = changed_texts(5, 3, 40, 4)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = near_copies.first_copies(docs, dense=8, local=6)
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_firsts(pairs))


def test_recall_at_the_edge():
    """Of pairs whose similarity is just over 0.8, at least 99 in 100 meet in an entry and are near by the check bits."""
    met, pairs = 0, [p for i in range(300) for p in [changed_texts(i, 1, 1, 1)[0][1]]]
    rng = random.Random(7)
    for text in pairs:
        words = text.split()
        at = rng.randint(1, 30)
        other = words[:at] + [f"new{j}" for j in range(17)] + words[at + 17 :]  # 21 of 196 shingles differ: 175 / 217 = 0.806
        a, b = (near_copies.wide_fingerprint(near_copies.shingle_set(" ".join(w).encode())) for w in (words, other))
        segments = lambda f: [int(f[i // 3]) >> 20 * (i % 3) & 0xFFFFF for i in range(near_copies.SEGMENTS)]
        meet = any((x ^ y).bit_count() <= 2 for x, y in zip(segments(a), segments(b), strict=True))
        met += meet and sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[4:], b[4:], strict=True)) <= near_copies.FAR
    assert met >= 297
