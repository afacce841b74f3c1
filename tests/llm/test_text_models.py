import itertools
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import langid, toxicity

TALK = {"en": "the river runs under this old stone bridge while children throw bread".split(), "de": "über dem alten Fluß steht eine große Brücke und Kinder werfen Brötchen".split(), "ru": "река течёт под старым каменным мостом и дети бросают хлеб".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(TALK[lang]) for _ in range(n))


def docs(spark):
    rows = [(i, prose(lang, 30, i), lang) for i, lang in enumerate(list(TALK) * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, prose("en", 40, 1) + "\n" + prose("ru", 60, 2), None), (104, "x" * 50_000 + " " + prose("de", 400, 3), None), (5, prose("ru", 30, 5), None), (None, prose("en", 20, 9), None)]
    return spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, score int, spans string")


def test_language_id(spark):
    d = docs(spark)
    model = langid.fit(d)
    assert model.languages == ["de", "en", "ru"]
    rows = langid.label(d, model).collect()
    assert len(rows) == d.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].lang_pred == lang and got[i][0].score == 1.0 for i, lang in enumerate(list(TALK) * 20))
    assert [(got[i][0].lang_pred, got[i][0].score, got[i][0].spans) for i in (100, 101, 102)] == [("und", 0.0, [])] * 3
    mixed = got[103][0]
    text = prose("en", 40, 1) + "\n" + prose("ru", 60, 2)
    assert [s.lang for s in mixed.spans] == ["en", "ru"] and text[mixed.spans[1].start] in "рктпсмидбх" and mixed.spans[-1].end == len(text)
    assert mixed.lang_pred == "ru" and 0 < mixed.score < 1
    assert got[None][0].lang_pred == "en" and len(got[5]) == 2
    assert langid.label(d.limit(0), model).count() == 0
    nothing = langid.fit(d.filter("doc_id = 100"))
    assert {r.lang_pred for r in langid.label(d, nothing).collect()} == {"und"}


def test_scripts_without_spaces(spark):
    chinese, r = "河流在古老的石桥下流淌孩子们向水里扔面包", random.Random(8)
    run = lambda n: "".join(r.choice(chinese) for _ in range(n))
    rows = [(i, prose(lang, 30, i), lang) for i, lang in enumerate(list(TALK) * 10)] + [(100 + i, run(80), "zh") for i in range(10)]
    texts = [prose("en", 30, 1) + " " + run(180) + " " + prose("en", 30, 2), "the" + run(90) + prose("en", 20, 3), prose("en", 50, 4) + " " + run(2) + " " + prose("en", 50, 5), run(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in langid.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[0].spans] == ["en", "zh", "en"] and got[0].spans[1].letters == 180
    a, b = got[0].spans[1].start, got[0].spans[1].end
    assert set(texts[0][a:b].strip()) <= set(chinese) and texts[0][a] in chinese
    assert got[1].lang_pred in ("en", "zh") and [s.lang for s in got[1].spans][-2:] == ["zh", "en"] and got[1].spans[-2].letters >= 90
    assert [s.lang for s in got[2].spans] == ["en"] and (got[3].lang_pred, got[3].score) == ("zh", 1.0)


def test_pieces():
    assert langid.pieces("Don't,") == [(0, "dont")] and langid.pieces("12") == [(0, "")] and langid.pieces("—") == [(0, "")]
    assert langid.pieces("(мирpeace)мир") == [(0, "мир"), (4, "peace"), (10, "мир")]
    assert langid.pieces("石桥下流淌ab") == [(0, "石桥下流"), (4, "淌"), (5, "ab")]
    short = langid.Labeller(langid.Model([], np.zeros((langid.BUCKETS, 0)), {}), 3)
    for text in ("a b c", "石桥下流淌 d e", "f 石桥下流淌水"):
        assert short.label(pa.array([text]))[0][0] == "und"
    assert short.letters[: short.used].sum() == 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.floats(-7, 0, width=32), min_size=3, max_size=3), min_size=1, max_size=7), st.floats(0.5, 10))
def test_viterbi_is_the_best_path(scores, switch):
    s = np.array(scores, np.float32)

    def worth(path):
        return sum(s[t, k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))

    best = max(map(worth, itertools.product(range(3), repeat=len(s))))
    assert abs(worth(langid.viterbi(s, switch).tolist()) - best) < 1e-4


def test_viterbi_without_the_language_of_the_best_sum():
    assert langid.viterbi(np.array([[0, -3, -1], [-4, -1, -2]], np.float32), 1.0).tolist() == [0, 1]
    # a text half in the first language and half in the second, where the third is second best throughout
    halves = np.repeat(np.array([[0, -7, -3], [-7, 0, -3]], np.float32), 4, axis=0)
    assert langid.viterbi(halves, 14.0).tolist() == [0] * 4 + [1] * 4


def subsequences(s, n):
    for at in itertools.combinations(range(len(s)), n):
        yield "".join(s[i] for i in at), at[-1] - at[0] + 1


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=2, max_size=7), st.text("abc", min_size=2, max_size=7))
def test_string_kernel(a, b):
    def plain(x, y):
        return sum(w * toxicity.DECAY ** (i + j) for n, w in ((2, toxicity.PAIRS), (3, 1.0)) for u, i in subsequences(x, n) for v, j in subsequences(y, n) if u == v)

    want = plain(a, b) / np.sqrt(plain(a, a) * plain(b, b))
    assert abs(toxicity.kernel([a, b], [b])[0, 0] - want) < 1e-4 and abs(toxicity.kernel([a], [a])[0, 0] - 1) < 1e-5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcü🙂\x02", min_size=1, max_size=9), max_size=6), st.lists(st.text("abcdü🙂\x02", min_size=1, max_size=11), max_size=12), st.randoms())
def test_margins_are_kernel_sums(landmarks, units, r):
    weights = np.array([r.uniform(-3, 3) for _ in landmarks], np.float32)
    got = toxicity.Model(landmarks, weights, 0.25, 1.0, 0.0, -2.0).margins(units)
    assert got.shape == (len(units),) and np.allclose(got, toxicity.kernel(units, landmarks) @ weights + 0.25, atol=1e-4)


def test_margins_cost_the_same_for_more_landmarks(monkeypatch):
    r, cells, plain = random.Random(2), [], toxicity._kernel
    made = lambda n: sorted({"".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(n)})
    units = made(500)

    def counted(u, t):
        cells.append(int(np.prod(np.broadcast_shapes(u.shape[:-1], t.shape[:-1]))))
        return plain(u, t)

    monkeypatch.setattr(toxicity, "_kernel", counted)
    for n in (5, 40):
        landmarks = made(n)
        toxicity.Model(landmarks, np.ones(len(landmarks), np.float32), 0.0, 1.0, 0.0, -2.0).margins(units)
        assert sum(cells) <= len(units) + len(landmarks)
        cells.clear()


INSULTS = ("blockhead", "numbskull", "dimwit")


def labelled():
    r, out = random.Random(3), []
    words = sorted({"".join(r.choice(["ka", "to", "mi", "ren", "sol", "vap", "ud"]) for _ in range(r.randint(1, 4))) for _ in range(3000)})
    for i in range(360):
        w = [r.choice(words) for _ in range(40)]
        if i % 3 == 0:
            for x in r.sample(INSULTS, 2):
                w.insert(r.randrange(len(w)), x)
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_toxicity(spark):
    rows = labelled()
    d = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    y = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    extra = [(1000, "we say b-l-o-c-k-h-e-a-d here"), (1001, "you n u m b s k u l l you"), (1002, "a dim*wit came"), (1003, None), (1004, ""), (1005, " 12 !! "), (1006, "kato miren " * 20_000 + "NUMBSKULL!"), (1007, "kato miren solvap"), (1007, "kato miren solvap"), (None, "dimwit")]
    got = {}
    for r in toxicity.score(spark.createDataFrame(extra, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].score >= 0.3 for i in (1000, 1001, 1002, 1006, None)), got
    assert all(got[i][0].score < 0.3 for i in (1003, 1004, 1005, 1007)) and len(got[1007]) == 2
    assert got[1003][0].score == got[1004][0].score == got[1005][0].score and got[1006][0].worst == "numbskull"
    right = sum((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in toxicity.score(d, model).collect())
    assert right >= 0.97 * len(rows)
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.fit(d, y.filter("toxic = 0")) is None and {r.score for r in toxicity.score(d, None).collect()} == {0.0}


def test_words_are_split_like_python(spark):
    from skerry.llm.common import split_words

    texts = [None, "", "  a b  a ", "\x1cx\x85y　z", "one"]
    distinct, at, ends = split_words(pa.array(texts))
    words = distinct.to_pylist()
    assert [[words[i] for i in at[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [(t or "").split() for t in texts]
