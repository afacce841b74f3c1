import random

from test_near_duplicates import sets_of, words

from skerry.llm import paragraphs


def fixture():
    r = random.Random(4)
    passage = words(r, 60)
    near = list(passage)
    near[30] = "changed"
    shared, common = " ".join(passage), " ".join(words(r, 8))
    own = lambda: " ".join(words(r, 40))
    rows = [(d, "\n".join([own(), shared if d % 2 else own(), common, "short line", own()])) for d in range(1, 30)]
    rows += [(40, own() + "\n" + " ".join(near)), (41, shared), (42, None), (43, ""), (44, "\n\n" + shared + "\n" + shared + "\n"), (None, common + "\n" + own()), (3, rows[2][1]), (50, "\n".join(own() for _ in range(3000)))]
    r.shuffle(rows)
    return rows


def brute(rows, threshold=0.8):
    paras = sorted(((d is None, d or 0, k, p) for d, t in dict.fromkeys(rows) if t is not None for k, p in enumerate(t.split("\n")) if len(p.split()) >= 5))
    sets = {p: set(sets_of(p)) for *_, p in paras}
    distinct = list(sets)
    of = {p: p for p in distinct}

    def find(p):
        while of[p] != p:
            p = of[p]
        return p

    small = [p for p in distinct if p.count(" ") != 39]
    for i, a in enumerate(small):
        for b in small[:i]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                of[find(a)] = find(b)
    first, gone = {}, {}
    for none, d, k, p in paras:
        if find(p) in first:
            gone.setdefault((none, d), set()).add(k)
        else:
            first[find(p)] = k
    return {(d, t): [k for k in range(t.count("\n") + 1) if k in gone.get((d is None, d or 0), ())] if t is not None else [] for d, t in rows}


def test_like_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, [1], 5) for d, t in rows], "doc_id long, text string, removed array<int>, place int").repartition(4)
    want = brute(rows)
    got = paragraphs.without_repeats(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "removed", "place"}
    for (d, t), removed in want.items():
        mine = [r for r in got if r.doc_id == d and (r.text == (t if not removed else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed)))]
        assert mine and all(r.removed == removed for r in mine), (d, removed)
    assert paragraphs.without_repeats(docs.limit(0)).count() == 0


def test_bands():
    n = paragraphs.bands_for(0.8, 0.998, 2)
    assert 1 - (1 - 0.64) ** n >= 0.998 > 1 - (1 - 0.64) ** (n - 1)
