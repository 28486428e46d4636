import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _th long, _h1 string, doc string, found string, _k string, shard int, spans string"


def rows_of(pairs):
    """(doc_id, text, lang, source) with extra columns whose names operators use inside."""
    return [(i, t, lang, src, len(t or ""), -1, -2, "x", "y", "z", "k", 7, "s") for i, t, lang, src in pairs]


def odd_pairs():
    """Nulls everywhere, empty and blank texts, ties, repeated rows, long texts and near copies."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "epsilon,", "zeta.", "eta", "Theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, passage = prose(30_000), prose(90)
    near = prose(400).split(" ")
    other = [*near[:200], "changed", *near[201:]]
    return [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n", None, "b"), (3, long, "fr", "a"), (3, long, "fr", "a"), (4, long + " end", "fr", None), (None, prose(50), "en", "a"), (None, None, None, None),
        (7, "\n".join([passage[:120], "Short", passage[:120].upper()]), "en", "a"), (8, " " + passage[:120] + "\t\nshort\n", "en", "b"), (9, " ".join(near), "de", "b"), (10, " ".join(other), "de", "b"),
        (11, "a  b", "en", "c"), (12, "ab", "en", "c"), (13, "a\nb ", "en", "c"), (14, prose(300) + passage + prose(10), "en", "a"), (15, passage + prose(200), "en", "a"), (16, "12345 !!! ...", "en", "a"),
        (17, "é" * 500, None, ""), (18, "x" * 5000, "en", "a"), (19, "x" * 5001, "en", "a"), (20, prose(60), "en", "a"), (20, prose(61), "en", "a"), (21, "\x00\x01 odd \x7f", "en", "a"), (22, "😀 𝔘 ﬃ words", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(odd_pairs()), SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    return odd_pairs()
