import numpy as np

from skerry.llm import qalsh


def brute(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((float(v), i) for v, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def recall(got, want):
    return sum(len({i for _, i in want[q]} & {i for _, i in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((20, 32)), 100, axis=0) + 0.7 * rng.standard_normal((2000, 32))
    x = x.astype(np.float32).astype(float)
    x[50:90] = x[50]
    ids = list(range(2000))
    rows = [(i, v.tolist(), 1.0, 3) for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None), (5100, [0.0] * 32), (5200, [1.0, None] + [0.0] * 30), (5300, [float("nan")] * 32), (5400, [float("inf")] * 32), (None, [1.0] * 32), (5500, []), (5600, [1.0, 2.0]), (5601, [1.0, 4.0])]
    v = spark.createDataFrame(rows + [(i, e, 0.0, 0) for i, e in odd], "vec_id long, embedding array<float>, score double, rank int")
    got = {}
    for r in qalsh.neighbours(v, v.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert got.pop(5600) == [(2.0, 5601)]
    want = brute(ids, x, range(0, 2000, 100), 10)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    for q, found in got.items():
        assert found == sorted(found) and all(abs(s - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for s, i in found)
    assert qalsh.neighbours(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id < 4")
    assert qalsh.neighbours(few, few.filter("vec_id = 0")).count() == 3


def test_ties_go_to_the_smaller_id():
    x = np.ones((30, 8))
    x[0] = 2
    found = qalsh.search(np.arange(30)[::-1].copy(), x, np.array([99]), np.ones((1, 8)), 5)
    assert [i for _, i, _ in found] == [0, 1, 2, 3, 4]


def test_scattered_vectors_in_several_pieces():
    x = np.random.default_rng(3).standard_normal((20_000, 16))
    ids = np.arange(len(x))
    asked = ids[::2000]
    got = {}
    for q, i, d in qalsh.search(ids, x, asked, x[asked], 10):
        got.setdefault(int(q), []).append((d, i))
    want = brute(ids.tolist(), x, asked.tolist(), 10)
    assert recall(got, want) >= 0.9
    assert all(found == sorted(found) and len(found) == 10 for found in got.values())
    assert all(abs(d - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for q, found in got.items() for d, i in found)


def test_windows_count_each_place_once():
    x = np.random.default_rng(4).standard_normal((500, 8))
    index = qalsh.Index(x)
    asked = x[:3] @ index.axes
    halves = index.halves(asked)
    low, high = index.windows(asked, halves)
    places = x @ index.axes
    for t, half in enumerate(halves):
        inside = ((places[None] >= asked[:, None] - half) & (places[None] <= asked[:, None] + half)).sum(axis=1)
        assert ((high - low)[:, t] == inside).all()
    assert (np.diff(low, axis=1) <= 0).all() and (np.diff(high, axis=1) >= 0).all()


def test_numbers_whose_squares_overflow():
    x = np.eye(4) * 1e200
    with np.errstate(all="ignore"):
        found = qalsh.search(np.arange(4), x, np.array([0]), x[:1], 2)
    assert [(i, d) for _, i, d in found] == [(1, np.inf), (2, np.inf)]
