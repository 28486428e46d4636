"""Exact operators against plain versions, on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sunderflow.llm import decontaminate, exact_dedup, line_dedup, simhash, suffix_dedup

SPACE = "[\x20\x09-\x0d]"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def last_null(i):
    return (i is None, i or 0)


def plain_exact(pairs):
    groups = defaultdict(list)
    for i, t, *_ in pairs:
        groups[re.sub(SPACE, "", t or "")].append((i, len(t or "")))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-x[1], last_null(x[0])))
        left = 1
        for x in own:
            kept = x == keep and left > 0
            left -= kept
            out.append((x[0], keep[0], len(own), kept, sha(norm)))
    return ordered(out)


@pytest.mark.parametrize("hashed", [exact_dedup.chunk_hash, lambda c: F.length(c).cast("long"), lambda c: F.lit(0).cast("long")])
def test_exact_dedup(odd, pairs, hashed):
    got = exact_dedup.exact_dedup(odd, hashed, 8, 40).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert ordered(got) == plain_exact(pairs)


def test_chunks_join_again(odd):
    row = odd.select(F.max(F.col("text") != F.array_join(exact_dedup.cut(F.col("text")), "")).alias("bad")).first()
    assert row.bad is False


def plain_lines(pairs):
    key = lambda s: lower(s.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = defaultdict(set)
    for i, t, *_ in pairs:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                held[key(s)].add(last_null(i))
    out = []
    for i, t, *_ in pairs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(held.get(key(s), ())) > 1 and min(held[key(s)]) != last_null(i))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return ordered(out)


def test_line_dedup(odd, pairs):
    got = line_dedup.line_dedup(odd).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert ordered(got) == plain_lines(pairs)


def plain_spans(pairs, m):
    texts = [(i, (t or "").encode()) for i, t, *_ in pairs]
    seen = Counter(b[s : s + m] for _, b in texts for s in range(len(b) - m + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        upto = 0
        for s in range(len(b) - m + 1):
            if seen[b[s : s + m]] > 1:
                gone[max(s, upto) : s + m] = b"\x01" * (s + m - max(s, upto))
                upto = s + m
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return ordered(out)


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_dedup(odd, pairs, group):
    few = [p for p in pairs if len(p[1] or "") < 10_000]
    rows = suffix_dedup.suffix_dedup(odd.where("text IS NULL OR length(text) < 10000"), max_group=group).collect()
    got = [(r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), len(r.spans) // 2, r.kept_sha256) for r in rows]
    assert ordered(got) == plain_spans(few, 200)


def test_suffix_dedup_long(spark, monkeypatch):
    """Texts longer than a piece, whose repeats lie across pieces."""
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1000)
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(5000))
    pairs = [(1, base, None, None), (2, "q" * 300 + base[1500:3200] + "z", None, None), (3, base[990:1189], None, None), (4, base[990:1190], None, None)]
    df = spark.createDataFrame([(i, t) for i, t, *_ in pairs], "doc_id long, text string")
    rows = suffix_dedup.suffix_dedup(df).collect()
    got = [(r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), len(r.spans) // 2, r.kept_sha256) for r in rows]
    assert ordered(got) == plain_spans(pairs, 200)


def plain_fingerprint(t):
    words = [w for w in re.split(SPACE + "+", lower(t or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{fingerprint: its component's fingerprints}."""
    left, out = set(fps), {}
    while left:
        part = [left.pop()]
        for x in part:
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            part += near
        out |= dict.fromkeys(part, part)
    return out


@pytest.mark.parametrize("dense", [4096, 1, 3])
def test_simhash(odd, pairs, dense):
    few = [p for p in pairs if len(p[1] or "") < 100_000]
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in few]
    parts = plain_components({f for _, f in fps})
    first = {f: min((i for i, g in fps if g in set(parts[f]) and i is not None), default=None) for _, f in fps}
    got = simhash.near_dedup(odd.where("text IS NULL OR length(text) < 100000"), dense=dense).collect()
    assert ordered((r.doc_id, r._fp % (1 << 64), r.component_id) for r in got) == ordered((i, f, first[f]) for i, f in fps)
    assert sum(r.first for r in got) >= len({id(parts[f]) for _, f in fps})


@pytest.mark.parametrize("dense", [4096, 1, 5])
def test_links_join_all_near_fingerprints(spark, dense):
    import random

    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for c in list(fps)[:12]:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(15)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = defaultdict(set)
    for r in simhash.links(spark.createDataFrame(signed, "_fp long"), dense=dense).collect():
        got[r.src % (1 << 64)].add(r.dst % (1 << 64))
        got[r.dst % (1 << 64)].add(r.src % (1 << 64))
    assert all((a ^ b).bit_count() <= 4 for a in got for b in got[a])
    for f, part in plain_components(fps).items():
        reached, todo = {f}, [f]
        for x in todo:
            todo += got[x] - reached
            reached |= got[x]
        assert reached == set(part)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(pairs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(lower(t or ""))
        for k in [tuple(w[j : j + 13]) for j in range(len(w) - 12)] if len(w) >= 13 else [tuple(w)] if w else []:
            windows[k].add("" if i is None else str(i))
    out = []
    for i, t, *_ in pairs:
        w, hit, found = WORDS.findall(lower(t or "")), set(), Counter()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if k := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found.update(k)
        names = sorted(found)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return ordered(out)


@pytest.mark.parametrize("block", [200_000, 20, 1])
def test_decontamination(spark, odd, pairs, block):
    words = WORDS.findall(lower(pairs[9][1]))
    items = [(1, " ".join(words[:12])), (2, " ".join(words[3:30]).upper()), (3, " ".join(words[5:18])), (4, None), (5, "..."), (6, "odd"), (7, " ".join(pairs[14][1].split()[50:90])), (8, "kappa"), (None, "ﬃ words")]
    found = decontaminate.contamination(odd, spark.createDataFrame(items, "item_id long, text string"), max_block=block)
    assert ordered(found.drop("spans").collect()) == plain_hits(pairs, items)


def test_decontamination_without_items(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("n_hit > 0 OR contaminated").count() == 0


def test_empty_tables(nothing, spark):
    for f in (exact_dedup.exact_dedup, line_dedup.line_dedup, suffix_dedup.suffix_dedup, simhash.near_dedup):
        assert f(nothing).count() == 0
    assert decontaminate.contamination(nothing, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [10**6, 15])
def test_items_that_share_an_id(spark, odd, pairs, block):
    words = WORDS.findall(lower(pairs[9][1]))
    items = [("x", " ".join(words[:20])), ("x", " ".join(words[30:60])), ("y", " ".join(words[5:25])), ("x", " ".join(words[:20]))]
    found = decontaminate.contamination(odd, spark.createDataFrame(items, "item_id string, text string"), max_block=block)
    assert ordered(found.drop("spans").collect()) == plain_hits(pairs, items)
    assert found.where("n_items = 2").count() >= 1 and found.where("n_items > 2").count() == 0


def test_many_blocks_give_what_one_gives(spark, odd, pairs):
    """A task of the last job holds no automaton, and each job before it one."""
    words = next(t for i, t, *_ in pairs if i == 14).split()
    items = spark.createDataFrame([(i, " ".join(words[3 * i : 3 * i + 20])) for i in range(50)], "item_id long, text string")
    one, many = (decontaminate.contamination(odd, items, max_block=m) for m in (10**6, 20))
    assert ordered(one.select(sorted(one.columns)).collect()) == ordered(many.select(sorted(one.columns)).collect())
    assert many._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1


def test_spans_are_removed(spark, odd, pairs):
    text = next(t for i, t, *_ in pairs if i == 14)
    words, plain = text.split(), decontaminate.words_of(text.encode())
    assert len(words) == len(plain)
    frame = spark.createDataFrame([(1, " ".join(words[40:70])), (2, " ".join(words[100:120]))], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.cleaned(odd, frame).select("doc_id", "clean_text").collect()]
    left = next(t for i, t in got if i == 14)
    assert decontaminate.words_of(left.encode()) == plain[:40] + plain[70:100] + plain[120:]
    assert sorted((t or "", t is None) for i, t in got if i != 14) == sorted((t or "", t is None) for i, t, *_ in pairs if i != 14)
    again = spark.createDataFrame(got, "doc_id long, text string")
    assert decontaminate.contamination(again, frame).where("n_hit > 0").count() == 0


def test_odd_radii_are_refused(odd):
    with pytest.raises(ValueError):
        simhash.near_dedup(odd, radius=3)


@pytest.mark.parametrize("batch", [2, 5, 1000])
def test_crowded_entries_leave_as_they_come(spark, batch):
    """Entries are dealt once; all fingerprints of those of more than `dense` are marked, wherever batches are cut, the others linked."""
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 9, 6: 1, 7: 12}
    rows = [(k, 1000 * k + (1 << 40) * (1 << i if i else 0)) for k, n in sizes.items() for i in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        entries = spark.createDataFrame(rows, "_key long, _fp long").coalesce(1).sortWithinPartitions("_key")
        got = simhash._entry_links(entries, 4, 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.src for r in got if r.dst is None) == sorted(f for k, f in rows if sizes[k] > 3)
    assert {f for r in got if r.dst is not None for f in (r.src, r.dst)} == {f for k, f in rows if sizes[k] in (2, 3)}
