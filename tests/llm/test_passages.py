import random

import numpy as np
from test_near_duplicates import words

from skerry.llm import passages


def fixture():
    r = random.Random(6)
    own = lambda n=80: words(r, n)
    line = lambda *parts: " ".join(w for p in parts for w in p)
    p, q, short, tail = own(70), own(60), own(49), own(30)
    rows = [(d, line(own(), p, own())) for d in (1, 2, 3)]
    # 4 and 5 share with 1 only a part of the passage, too short by itself, and with each other more
    rows += [(4, line(own(), p[-35:], tail, own())), (5, line(own(), p[-35:], tail, own()))]
    rows += [(6, line(own(), q, own(), q, own())), (7, line(own(), short, own())), (8, line(own(), short, own()))]
    rows += [(9, line(own(), [p[0].upper() + ","], p[1:], own()) + "\nlast line of nine"), (10, "x " * 300), (11, None), (12, ""), (None, line(own(), q, own())), (3, rows[2][1])]
    return rows


def brute(rows):
    """Cut texts as lists of words, by every window of every text in order."""
    seen, out = {}, {}
    for d, t in sorted(dict.fromkeys(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").split()
        plain = [x.strip(",").lower() for x in w]
        gone = set()
        for i in range(len(w) - 49):
            key = tuple(plain[i : i + 50])
            first = seen.setdefault(key, (d, i))
            if first != (d, i):
                gone |= set(range(max(i, first[1] + 50) if first[0] == d else i, i + 50))
        out[d, t] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_passage_within_one_line(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, spans int").repartition(4)
    want = brute(rows)
    got = passages.without_passages(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, (r.text or "").split()) for r in got) == sorted((d or -1, want[d, t]) for d, t in rows)
    by = {r.doc_id: r.text for r in got}
    assert len(by[2].split()) == 160 and by[9].endswith("\nlast line of nine") and len(by[10].split()) == 50 and by[11] is None
    assert len(by[5].split()) == 160 and len(by[8].split()) == 209
    assert passages.without_passages(docs.limit(0)).count() == 0


def test_query_cuts_passages(spark, tmp_path):
    from skerry.llm.queries import op9_paragraph_minhash_dedup

    rows = [(d, t) for d, t in fixture() if d in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text.split() for r in op9_paragraph_minhash_dedup(spark, str(tmp_path)).collect()}
    assert {d: len(w) for d, w in got.items()} == {1: 230, 2: 160}


def test_equal_windows_have_equal_prints():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 2**63, 50, np.uint64)
    texts = [np.concatenate([rng.integers(0, 2**63, k, np.uint64), p, rng.integers(0, 2**63, 9, np.uint64)]) for k in (0, 3, 70)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, of, prints = passages.windows(np.concatenate(texts), ends)
    mine = {int(prints[(at - ends[of] == k) & (of == i)][0]) for i, k in enumerate((0, 3, 70))}
    assert len(mine) == 1
    places, text = passages.print_places(np.concatenate(texts), ends)
    assert all((places[text == i] == mine.copy().pop()).sum() == 1 for i in range(3))
