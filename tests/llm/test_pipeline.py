"""The pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline as p
import pytest

from .test_exact import ordered, plain_hits
from .test_models import check_shards, plain_targets
from .test_near_copies import plain_firsts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, data):
    docs, out = p.documents(spark, data), []
    for name, stage in p.STAGES:
        out.append(docs)
        docs = p.durable(stage(spark, docs, data), f"test-{name}")
    return [*out, docs]


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(staged):
    assert all(df.columns == COLUMNS for df in staged[:-1])


def test_language_keeps_clean_documents(staged):
    assert ordered(rows(staged[1])) == ordered(r for r in rows(staged[0]) if any(c.isalpha() for c in r[1] or ""))


def test_one_of_each_near_group(staged):
    before, after = rows(staged[1]), rows(staged[2])
    first = plain_firsts([r[:2] for r in before])
    assert ordered(after) == ordered(r for r in before if r[0] in first)


def test_contaminated_documents_go(staged, spark, data):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {h[0] for h in plain_hits([(r[0], r[1], r[2], r[3]) for r in rows(staged[2])], items) if h[-1]}
    assert ordered(rows(staged[3])) == ordered(r for r in rows(staged[2]) if r[0] not in bad)


def test_mixture(staged):
    before, after = rows(staged[3]), Counter(rows(staged[4]))
    words = lambda r: len((r[1] or "").split())
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += words(r)
        taken[r[3]] += words(r) * after[r]
    assert set(after) <= set(before) and max(after.values()) <= 3
    want = plain_targets(sizes)
    assert sum(abs(taken[s] - float(want[s])) for s in sizes) <= 0.1 * sum(sizes.values())


def test_shards(staged):
    check_shards(staged[5].collect(), rows(staged[4]), 16)


def test_stages_take_odd_rows(spark, odd, nothing, data):
    for docs in (odd, nothing):
        for _, stage in p.STAGES[:-1]:
            docs = p.durable(stage(spark, docs, data), "odd")
            assert docs.columns == odd.columns
        p.STAGES[-1][1](spark, docs, data).count()


def test_mixture_repeats_the_same_rows_again(spark, data):
    """Rows that share doc_id, text and source differ in their other columns; the choice among them never changes."""
    made = [(1, "one two three", lang, "a", n) for lang in ("de", "en", None) for n in range(5)] + [(2, "four five " * 20, "en", "b", 1)] * 3 + [(3, "six seven", "en", None, 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    found = [ordered(map(tuple, p.mixture(spark, docs.repartition(n, "n_chars"), data).collect())) for n in (1, 3, 7)]
    assert found[0] and found[0] == found[1] == found[2]
