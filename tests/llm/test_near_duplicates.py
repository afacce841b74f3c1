import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import graph, neardup, shingles
from skerry.llm.shingles import distinct_counts, word_hashes


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def copies(seed=1):
    """Groups of near copies, with a large one, exact copies, and texts that stand alone."""
    r, out = random.Random(seed), []
    for size in (1, 1, 1, 2, 3, 5, 60):
        base = words(r, 150)
        for k in range(size):
            w = list(base)
            if k:
                w[r.randrange(150)] = words(r, 1)[0]
            out.append(" ".join(w))
    out += [out[3]] * 4 + [None, "", "", "one two", "One two.", "one two three", " \n ", "x " * 60_000]
    half = words(r, 100)
    out += [" ".join(half + words(r, 20 * k)) for k in range(6)]
    return list(enumerate(out, 100))


def sets_of(text):
    w = [x for x in (y.strip(shingles.MARKS).lower() for y in (text or "").split()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    """Classes by comparing every two documents, with exact document frequencies."""
    sets = {d: sets_of(t) for d, t in rows}
    df = Counter(s for x in sets.values() for s in x)
    n = len(rows)
    weight = lambda s: 1 + np.log(n / df[s]) / np.log(n)
    of = {d: d for d, _ in rows}

    def find(d):
        while of[d] != d:
            d = of[d]
        return d

    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            x, y = sets[a], sets[b]
            top = sum(max(x[s], y[s]) * weight(s) for s in x | y)
            if (ta or "") == (tb or "") or top and sum(min(x[s], y[s]) * weight(s) for s in x & y) / top >= threshold:
                p, q = sorted((find(a), find(b)))
                of[q] = p
    return {d: find(d) for d, _ in rows}


def test_classes_like_brute_force(spark):
    rows = copies()
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, node long, bucket string").repartition(5)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    same = Counter(t or "" for _, t in rows)
    assert all(r.copies == same[dict(rows)[r.doc_id] or ""] for r in got)
    twice = neardup.near_duplicates(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(rows) and {r.doc_id: r.class_id for r in twice} == brute_classes(rows)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids(spark):
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words than those")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7)]


def test_samples_collide_like_the_similarity():
    rng = np.random.default_rng(5)
    hashes = shingles.mix(np.arange(800, dtype=np.uint64))
    a = rng.uniform(1, 4, 800)
    b = a * rng.choice([1, 1, 1, 0.5, 0.01], 800)
    one, two = (neardup.sample(hashes, np.log(w).astype(np.float32), np.array([0]), 3000)[0] for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab ,\n", max_size=40)), max_size=6))
def test_shingles_like_sets_of_words(texts):
    hashes, text, counts = distinct_counts(*shingles.shingles(*word_hashes(pa.array(texts, pa.string()))))
    got = defaultdict(list)
    for t, c in zip(text.tolist(), counts.tolist(), strict=True):
        got[t].append(c)
    assert {t: sorted(c) for t, c in got.items()} == {i: sorted(s.values()) for i, x in enumerate(texts) if (s := sets_of(x))}
    names = defaultdict(set)
    at = 0
    for i, x in enumerate(texts):
        n = len(sets_of(x))
        names[frozenset(sets_of(x))].add(frozenset(hashes[at : at + n].tolist()))
        at += n
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(90)] + [(7, 7), (None, 3), (2, 1)]
    of = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((find(a), find(b)))
            of[q] = p
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rows = copies()
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, node long, root string")
    got = neardup.one_of_each(docs.unionAll(docs))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_classes(rows).values()))


def test_crowded_bucket_of_many_classes(spark):
    r = random.Random(3)
    template, rows = words(r, 100), []
    for k in range(1000):
        own = words(r, 30)
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join([*template, *own[:-1], "other"]))]
    rows += [(-1, "a b c d e f g"), (-2, "a b c d e f g h"), (-3, "q w e r t y"), (-4, "z x c v b n m")]
    texts = spark.createDataFrame(rows, "node long, text string").repartition(4)
    buckets = texts.selectExpr("if(node < 0, 5, 7) as bucket", "node").selectExpr("cast(bucket as long) as bucket", "node")
    roots = neardup.classes(buckets, texts, None, 0.7)
    got = {x.node: x.root for x in roots.collect()}
    assert got == {n: n - n % 2 for n, _ in rows if n >= 0} | {-1: -2, -2: -2}


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    """A family of texts that are partly alike, in few buckets, with blocks of a few nodes, of long texts and of counts above one."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "CHARS", 20_000)
    r = random.Random(11)
    base, rows = words(r, 60), []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(60)] = words(r, 1)[0]
        rows.append((k, " ".join(w + w[:20] * (k % 3))))
    rows.append((150, " ".join(words(r, 4000))))
    docs = spark.createDataFrame(rows, "node long, text string").repartition(3)
    weights = neardup.corpus_weights(docs)
    buckets = docs.selectExpr("node", "explode(array(node % 2, 5)) as bucket").filter("bucket < 2 or node % 3 = 0")
    got = {x.node: x.root for x in neardup.classes(buckets, docs, weights, 0.8).collect()}
    sets = {n: [x for x in distinct_counts(*shingles.shingles(*word_hashes(pa.array([t]))))] for n, t in rows}
    sets = {n: (h, weights.of(h) * c) for n, (h, _, c) in sets.items()}
    of = {n: n for n, _ in rows}

    def find(n):
        while of[n] != n:
            n = of[n]
        return n

    for i, _ in rows:
        for j in range(i):
            if (i % 2 == j % 2 or i % 3 == j % 3 == 0) and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                p, q = sorted((find(i), find(j)))
                of[q] = p
    assert {n: got.get(n, n) for n in of} == {n: find(n) for n in of} and len({find(n) for n in of}) > 5


def test_document_frequencies_are_exact_whatever_shares_their_counters(spark, monkeypatch):
    r = random.Random(3)
    line = " ".join(words(r, 12))
    texts = [" ".join([*words(r, 30), *([line] if k % 3 == 0 else [])]) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    df = Counter(int(h) for t in texts for h in distinct_counts(*shingles.shingles(*word_hashes(pa.array([t]))))[0])
    total = sum(df.values())
    for common in (1 << 18, 200):  # every shingle of two documents counts, or those of more than m
        monkeypatch.setattr(neardup, "COMMON", common)
        weights, low = neardup.corpus_weights(docs), max(1, total / common)
        assert {int(h) for h in weights.hashes} == {h for h, n in df.items() if n > low} and len(weights.hashes) < common
        names = np.array(sorted(df), np.uint64)
        want = [2 if df[int(h)] <= low else 1 + np.log(300 / df[int(h)]) / np.log(300 / low) for h in names]
        assert np.allclose(weights.of(names), want, atol=1e-5)


def test_weights_of_empty_and_wordless_tables(spark):
    for rows in ([], [(1, None), (2, "")]):
        weights = neardup.corpus_weights(spark.createDataFrame(rows, "doc_id long, text string"))
        assert (weights.of(np.array([5], np.uint64)) == 2).all() and not len(weights.of(np.zeros(0, np.uint64)))


def test_weights_depend_on_shares_alone():
    one = neardup.Weights(np.array([9, 4], np.uint64), np.array([500, 40]), 1000, 2.0)
    large = neardup.Weights(np.array([9, 4], np.uint64), np.array([500_000_000, 40_000_000]), 1_000_000_000, 2e6)
    asked = np.array([4, 9, 7], np.uint64)
    assert np.allclose(one.of(asked), large.of(asked)) and one.of(asked)[2] == 2 and 1 < one.of(asked)[1] < one.of(asked)[0] < 2
