"""Models and samplers against plain versions, laws and held-out labels."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunderflow.llm import language_id, mixing, quality, sharding, token_counts
from sunderflow.llm.common import documents


@pytest.fixture(scope="module")
def encoder():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.Encoder(f.read())


def test_edits_equal_full_encoding(encoder):
    import random

    rng = random.Random(11)
    bits = ["a", "'", "s", " ", "  ", "\n", "1", "23", ".", "!!", "é", "'ll", "\t \n", "x y", "   ", "word"]
    for start in ["", " ", "   ", "it's  we'll   go\n\n  now 12 3!!", "lorem ipsum " * 300, "x" * 5000, " " * 700]:
        for _ in range(8):
            tree, text = token_counts.SegmentTree(start, encoder), start
            for _ in range(10):
                a = rng.randint(0, len(text))
                b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 40, 900]))
                new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 30, 400])))
                tree.edit(a, b, new)
                text = text[:a] + new + text[b:]
                assert tree.text == text
                assert (tree.characters, tree.pretokens, tree.tokens) == (len(text), len(encoder.pattern.findall(text)), len(encoder.encoding.encode_ordinary(text)))


def test_edits_touch_their_neighbourhood_only(encoder):
    tree = token_counts.SegmentTree("some words in a row " * 5000, encoder)
    tree.edit(50_000, 50_004, "other")
    assert tree.re_encoded < 50


def test_token_counts(odd, pairs, encoder):
    got = sorted(map(tuple, token_counts.token_counts(odd).collect()), key=repr)
    want = []
    for i, t, *_ in pairs:
        t = t or ""
        edits = token_counts.redactions(t)
        after = t
        for a, b, new in edits:
            after = after[:a] + new + after[b:]
        want.append((i, len(t), len(encoder.pattern.findall(t)), len(encoder.encoding.encode_ordinary(t)), len(edits), len(after), len(encoder.encoding.encode_ordinary(after))))
    assert [(*g[:5], *g[6:]) for g in got] == sorted(want, key=repr)


def test_edits_on_edited_trees(odd, pairs, encoder):
    """Three batches of edits, each on the trees that the one before made, and one that empties every text."""
    long = ("some words in a row, " * 3000)
    docs = odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame([(500, long), (501, "x")], "doc_id long, text string"))
    texts = [(i, t or "") for i, t, *_ in pairs] + [(500, long), (501, "x")]
    batches = [
        lambda t: [(len(t) // 2, len(t) // 2 + 3, " new 42 "), (0, 0, "It's ")],
        lambda t: [(5, 9, ""), (len(t), len(t), "\n\n end")] if len(t) > 20 else [],
        lambda t: [(0, 10**9, "")],
        lambda t: [(0, 0, "back again")],
    ]
    trees = token_counts.durable(token_counts.stored_trees(docs), "trees")
    for edits in batches:
        trees = token_counts.durable(token_counts.edited_trees(trees, edits), "trees")
        for n, (i, t) in enumerate(texts):
            for a, b, new in edits(t):
                t = t[:a] + new + t[b:]
            texts[n] = (i, t)
        got = sorted(((r.doc_id, r.text, r.n_chars, r.n_pretokens, r.n_tokens, sum(x.n_tokens for x in r.leaves)) for r in trees.collect()), key=repr)
        want = [(i, t, len(t), len(encoder.pattern.findall(t)), n := len(encoder.encoding.encode_ordinary(t)), n) for i, t in texts]
        assert got == sorted(want, key=repr)


def plain_bits(trees, text, order):
    total = 0.0
    for p, s in enumerate(text):
        context = text[max(0, p - order) : p]
        while True:
            if seen := trees.get(context):
                n, kinds = sum(seen.values()), len(seen)
                if s in seen:
                    total += math.log2((n + kinds) / seen[s])
                    break
                total += math.log2((n + kinds) / kinds)
            if not context:
                total += 8
                break
            context = context[1:]
    return total


@pytest.mark.parametrize("stretch", [1 << 18, 61])
@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths(spark, data, monkeypatch, stretch, order):
    monkeypatch.setattr(language_id, "_STRETCH", stretch)
    docs = documents(spark, data).where("doc_id < 40")
    model = language_id.learn(docs, order)
    trees = defaultdict(lambda: defaultdict(Counter))
    for r in language_id.training_sample(docs).collect():
        t = r.text.encode()
        for p in range(len(t)):
            for k in range(min(p, order) + 1):
                trees[r.lang][t[p - k : p]][t[p]] += 1
    texts = [b"", b"a", "é".encode(), b"the cat and die Katze", b"", b"zzqq\x00\xff " * 30, b"x"]
    bounds = np.cumsum([0, *map(len, texts)])
    got = language_id.PPM.of(model.state()).lengths(np.frombuffer(b"".join(texts), np.uint8), bounds)
    want = [[plain_bits(trees[lang], t, order) for lang in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_language_accuracy(spark, data):
    found = language_id.op3_language_id(spark, data).join(documents(spark, data).select("doc_id", "lang"), "doc_id")
    one = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert one.right >= 0.97


def test_language_of_odd_rows(odd, pairs, nothing):
    model = language_id.learn(odd)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == len(pairs)
    lettered = {t: any(c.isalpha() for c in t or "") for _, t, *_ in pairs}
    got = Counter((r.doc_id, r.lang_pred == "und") for r in rows)
    assert got == Counter((i, not lettered[t]) for i, t, *_ in pairs)
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.learn(nothing)).collect()} == {"und"}


def test_training_is_bounded(spark, data):
    docs = documents(spark, data)
    rows = language_id.training_sample(docs, 5).groupBy("lang").count().collect()
    assert rows and all(r["count"] <= 5 for r in rows)


def check_shards(rows, pairs, shards):
    assert len(rows) == len(pairs)
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(pairs) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("shards", [1, 4, 16, 100])
def test_shards(odd, pairs, nothing, shards):
    check_shards(sharding.shard(odd, shards).collect(), pairs, shards)
    assert sharding.shard(nothing, shards).count() == 0


def test_shards_hold_the_mixture(spark, data):
    docs = documents(spark, data)
    found = sharding.shard(docs, 4).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().collect()
    total = Counter()
    for r in found:
        total[r.source] += r["count"]
    assert all(abs(r["count"] - total[r.source] / 4) <= 2 for r in found)


def plain_targets(sizes, epochs=3, weights=(5, 2, 1)):
    """Clamps and hands on what is left, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: Fraction(weights[i % 3]) for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        left, heavy = total - sum(fixed.values()), sum(w[s] for s in open_)
        share = {s: left * w[s] / heavy for s in open_}
        over = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: Fraction(epochs * sizes[s]) for s in over}


def test_mixing(odd, pairs, nothing):
    rows = mixing.mix(odd).collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, _, s in pairs:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    assert sorted((r.size for r in rows)) == sorted(words(t) for _, t, *_ in pairs)
    assert {round(r.target, 6) for r in rows} == {round(float(x), 6) for x in want.values()}
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in rows)
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(nothing).count() == 0


def test_mix_comes_near_its_targets(spark, data):
    docs = documents(spark, data)
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.t - r.target) <= r.most / 2 for r in found)
    assert sum(abs(r.t - r.target) for r in found) <= 0.05 * sum(r.target for r in found)


def test_quality_on_held_out_labels(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    found = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    one = found.agg(F.avg((F.col("quality") == F.col("is_quality").cast("int")).cast("int")).alias("q"), F.avg((F.col("toxic") == F.col("is_toxic").cast("int")).cast("int")).alias("t")).first()
    assert one.q >= 0.95 and one.t >= 0.85


def test_quality_of_odd_rows(spark, odd, pairs, nothing):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 0, None), (9, 1, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(rows) == len(pairs) and all(0 <= r.score_quality <= 1 for r in rows)
    assert quality.classify(nothing, labels, F.col("source"), F.col("lang")).count() == 0
    none = quality.classify(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {round(r.evidence_quality, 6) for r in none} == {0.5}


def test_sites_shrink_toward_their_parents(spark):
    rows = [(i, "big", "big/a", 0.9, 0.1) for i in range(200)] + [(i, "bad", "bad/a", 0.1, 0.1) for i in range(200)] + [(1000, "tiny", "tiny/a", 0.1, 0.1)]
    sites, overall = quality.site_rates(spark.createDataFrame(rows, "doc_id long, _host string, _path string, p_quality double, p_toxic double"))
    got = {r._host: r.host_quality for r in sites.collect()}
    assert got["bad"] < got["tiny"] < overall["quality"] < got["big"]
    assert abs(got["big"] - 0.9) < abs(got["tiny"] - 0.1)


def test_stored_trees_take_edits(encoder):
    import random

    rng = random.Random(5)
    bits = ["a", "'", "s", " ", "  ", "\n", "1", "23", ".", "!!", "é", "'ll", "\t \n", "x y", "   ", "word"]
    for start in ["", "it's  we'll   go\n\n  now 12 3!! " * 40, "lorem ipsum " * 300, "x" * 5000, " " * 700]:
        tree = token_counts.SegmentTree(start, encoder)
        for _ in range(8):
            text, tree = start, token_counts.SegmentTree.of(start, token_counts.SegmentTree(start, encoder).leaves, encoder)
            for _ in range(6):
                a = rng.randint(0, len(text))
                b = min(len(text), a + rng.choice([0, 1, 5, 40, 900]))
                new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 30, 400])))
                tree.edit(a, b, new)
                text = text[:a] + new + text[b:]
                assert (tree.characters, tree.pretokens, tree.tokens) == (len(text), len(encoder.pattern.findall(text)), len(encoder.encoding.encode_ordinary(text)))
            assert tree.text == text
    tree = token_counts.SegmentTree.of("some words in a row " * 5000, token_counts.SegmentTree("some words in a row " * 5000, encoder).leaves, encoder)
    tree.edit(50_000, 50_004, "other")
    assert tree.re_encoded < 50 and sum(isinstance(s, tuple) for s in tree.pieces) >= len(tree.pieces) - 4


def test_token_counts_of_nothing(nothing):
    assert token_counts.token_counts(nothing).count() == 0


def test_every_language_is_learned_where_rows_share_a_doc_id(spark):
    """10,000 rows under one doc_id, most of them copies of one text, beside a rarer language with ids of its own."""
    en = [(1, "the quick brown fox " + str(i if i < 1000 else 0), "en") for i in range(9_000)]
    de = [(i, f"der schnelle braune Fuchs {i}", "de") for i in range(1_000)]
    for doc_id in (1, 2, 3, 4, 6):
        docs = spark.createDataFrame([(doc_id if lang == "en" else i, t, lang) for i, t, lang in en + de], "doc_id long, text string, lang string")
        if docs.where(language_id.fold() != 0).where("lang = 'en'").isEmpty():
            continue
        n = dict(language_id.training_sample(docs, 100).groupBy("lang").count().collect())
        assert n == {"en": 100, "de": 100}


def test_training_sample_is_the_first_by_key(spark, data):
    docs = documents(spark, data)
    key = language_id.seeded(language_id.SEED, F.col("doc_id"), F.xxhash64("text"))
    can = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (language_id.fold() != 0)).select("lang", "text", key.alias("k")).collect()
    want = Counter()
    for lang in {r.lang for r in can}:
        want.update((r.lang, r.text) for r in sorted((r for r in can if r.lang == lang), key=lambda r: r.k)[:7])
    assert Counter(map(tuple, language_id.training_sample(docs, 7).collect())) == want
    few = language_id.training_sample(docs, 7, most_bytes=1).collect()
    assert len(few) == len({r.lang for r in can})


def plain_rates(rows, target):
    """(score of each row, host and path rates) from rows (doc_id, host, path, {target: evidence})."""
    p = [r[3][target] for r in rows]
    overall = sum(p) / len(p)

    def worth(sites, parent):
        """sites: name to evidence; parent: name to rate."""
        off = sum(len(v) * (sum(v) / len(v) - parent[s]) ** 2 for s, v in sites.items())
        one = [parent[s] * (1 - parent[s]) for s in sites]
        n = sum(map(len, sites.values()))
        return max(sum(one) / len(one) / max((off - sum(one)) / n, 1e-9) - 1, 1.0)

    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, q, e in rows:
        hosts[h].append(e[target])
        paths[h, q].append(e[target])
    hw = worth(hosts, dict.fromkeys(hosts, overall))
    host = {h: (sum(v) + hw * overall) / (len(v) + hw) for h, v in hosts.items()}
    pw = worth(paths, {s: host[s[0]] for s in paths})
    path = {s: (sum(v) + pw * host[s[0]]) / (len(v) + pw) for s, v in paths.items()}
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    scores = []
    for (_, h, q, e), own in zip(rows, p, strict=True):
        rest_h = (sum(hosts[h]) - own + hw * overall) / (len(hosts[h]) - 1 + hw)
        rest_p = (sum(paths[h, q]) - own + pw * rest_h) / (len(paths[h, q]) - 1 + pw)
        scores.append(1 / (1 + math.exp(logit(overall) - logit(own) - logit(rest_p))))
    return scores, host, path


def test_quality_against_plain_rates(spark, odd, pairs, data):
    """Rates, what they are worth, and posteriors of odd rows and of the tables, from the evidence that the query gives."""
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    for docs, known, path in ((odd, labels, F.col("lang")), (documents(spark, data), spark.read.parquet(f"{data}/labels.parquet"), F.concat_ws("/", "source", "lang"))):
        named = docs.select("doc_id", "text", "source", "lang")
        got = quality.classify(named, known, F.col("source"), path).collect()
        scored = quality.evidence(named, quality.learn(named, known), F.col("source"), path).collect()
        rows = [(r.doc_id, r._host, r._path, {"quality": r.p_quality, "toxic": r.p_toxic}) for r in scored]
        for t in quality.TARGETS:
            scores, host, at = plain_rates(rows, t)
            want = sorted((repr(r[0]), r[3][t], host[r[1]], at[r[1], r[2]], s) for r, s in zip(rows, scores, strict=True))
            have = sorted((repr(r.doc_id), r[f"evidence_{t}"], r[f"host_{t}"], r[f"path_{t}"], r[f"score_{t}"]) for r in got)
            assert [w[0] for w in want] == [h[0] for h in have]
            assert np.allclose([w[1:] for w in want], [h[1:] for h in have], atol=1e-9)


def test_labels_of_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(1, "other text"), (2, None), (2, "bad words"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").where(~quality.held_out())
    rows = quality.labelled(docs, labels).collect()
    assert len(rows) == labels.count() and {r.text for r in rows} <= {"good words here", "other text", "bad words", "x"}


def test_null_ids_are_dealt_out(spark):
    """Rows without a doc_id, or with one that most have, fall into many buckets, and the laws hold for them."""
    made = [(None if i % 10 else i, f"text {i} " * (i % 7), "en", "a") for i in range(3000)] + [(7, f"seven {i}", "en", "a") for i in range(1000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    for seed, text in ((sharding.SEED, F.coalesce("text", F.lit(""))), (mixing.SEED, F.coalesce("text", F.lit("")))):
        keys = docs.select(sharding.hex_bucket(sharding.seeded(seed, F.col("doc_id"), F.md5(text)), 60).alias("b")).groupBy("b").count()
        assert keys.agg(F.max("count")).first()[0] < 600  # the empty texts without an id are one key, the others some 57 a bucket
    check_shards(sharding.shard(docs, 16).collect(), made, 16)
    taken = mixing.mix(docs).agg(F.sum("taken"), F.max("target")).first()
    assert abs(taken[0] - taken[1]) <= 20
