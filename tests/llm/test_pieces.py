import functools
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import pieces

TEXTS = ["Hello  world\n a", " x", "", "a\tb", "   ", "ﬁ Ａ é", "\x00a\x01", "▁a ▁", "a  ", "中文 x 🙂", "The quick brown foxes' internationalisation, don't!", "x" * 400 + " " + "ab" * 300, None, "a " * 50]


@functools.cache
def coder(rate=0.0, seed=1, variants=4):
    return pieces.Encoder(pieces.default_path(), rate, seed, variants)


@functools.cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def encode(c, texts):
    return [x.tolist() for x in c.encode(pa.array(texts, pa.string()), np.arange(len(texts), dtype=np.uint64))]


def test_without_dropout_like_the_library():
    plain = [t for t in TEXTS if t is not None and "▁" not in t]
    assert encode(coder(), plain) == [library().encode(t) for t in plain]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("athe inore▁\n.é中🙂́S"), max_size=30), max_size=4), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_lossless(texts, rate):
    c = coder(rate)
    for text, ids in zip(texts, encode(c, texts), strict=True):
        assert c.decode(np.array(ids, np.int64)).decode() == text
        if not rate and "▁" not in text:
            assert ids == library().encode(text)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="athenorisg", min_size=1, max_size=40), st.integers(0, 2**63), st.sampled_from([0.0, 0.2, 0.6]))
def test_lockstep_is_the_agenda(word, key, rate):
    v = coder().v
    symbols = [v.space, *(int(v.of_char[ord(c)]) for c in word)]
    sym, alive = pieces.lockstep(v, np.array([symbols]), np.array([len(symbols)]), np.array([key], np.uint64), rate)
    assert sym[alive].tolist() == pieces.agenda(v, symbols, key, rate)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="athenorisg", min_size=1, max_size=20), min_size=1, max_size=8), st.lists(st.integers(-0x110002, -1), max_size=4))
def test_many_units_at_once(words, strange):
    v = coder().v
    units = [[v.space, *(int(v.of_char[ord(c)]) for c in w)] for w in words] + [[v.space, x, x, v.space] for x in strange]
    n = np.array(list(map(len, units)))
    dense = np.full((len(units), n.max()), -1, np.int64)
    for row, u in zip(dense, units, strict=True):
        row[: len(u)] = u
    keys = np.arange(len(units), dtype=np.uint64)
    sym, alive = pieces.lockstep(v, dense, n, keys, 0.2)
    assert [s[a].tolist() for s, a in zip(sym, alive, strict=True)] == [pieces.agenda(v, u, k, 0.2) for k, u in enumerate(units)]


def test_pairs_are_found():
    v, r = coder().v, np.random.default_rng(5)
    a, b = (np.concatenate([[k >> 16 for k in v.pairs] if left else [k & 65535 for k in v.pairs], r.integers(-0x110002, 32000, 20_000), [-1, -1, 5]]) for left in (True, False))
    want = [v.pairs.get(x << 16 | y, -1) if min(x, y) >= 0 else -1 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert v.join(a, b).tolist() == want and sum(x >= 0 for x in want) >= len(v.pairs)


def test_pairs_are_looked_up_once_a_round(monkeypatch):
    v, calls, plain = coder().v, [], pieces.Vocabulary.join
    symbols = np.array([[v.space, *(int(v.of_char[ord(c)]) for c in w)] for w in ("internationalisation", "understandablenesses")])
    monkeypatch.setattr(pieces.Vocabulary, "join", lambda self, a, b: calls.append(len(a)) or plain(self, a, b))
    _, alive = pieces.lockstep(v, symbols, np.array([21, 21]), None, 0.0, np.zeros((2, 0), np.int64))[:2]
    assert len(calls) == 1 + (21 - alive.sum(axis=1)).max()


def test_dropout_varies_and_repeats():
    text = ["internationalisation of the understanding " * 40]
    one, two, other = encode(coder(0.3), text), encode(coder(0.3), text), encode(coder(0.3, 2), text)
    assert one == two != other and len(one[0]) > len(encode(coder(), text)[0])
    cuts = {tuple(one[0][a : a + 4]) for a in range(len(one[0]) - 3)}
    assert len(cuts) > 20
    assert all(i < 259 or len(coder().decode(np.array([0, i]))) <= 3 for i in encode(coder(1.0), ["understand"])[0])


def test_query(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (10, TEXTS[10], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = pieces.encode(docs, pieces.default_path())
    got = pieces.digests(encoded, pieces.default_path()).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[10][0] == by[10][1] and by[12][0].n_tokens == 0
    assert all(by[i][0].text_crc32 == zlib.crc32((t or "").encode()) for i, t, _ in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == by[r.doc_id][0].ids_crc32 for r in encoded.collect())
    assert pieces.digests(pieces.encode(docs.limit(0), pieces.default_path()), pieces.default_path()).count() == 0


def test_each_occurrence_is_drawn_anew():
    c = pieces.Encoder(pieces.default_path(), 0.1, 1)
    v, word = c.v, "internationalisation"
    text = " ".join([word] * 400)
    ids = encode(c, [text, text])
    symbols = [v.space, *(int(v.of_char[ord(x)]) for x in word)]
    place = pieces.mix(np.arange(400, dtype=np.uint64) + np.uint64(1))
    unit = pieces.string_hashes(pa.array([chr(pieces._MARK) + word]))
    for doc in (0, 1):
        with np.errstate(over="ignore"):
            keys = pieces.mix(unit + pieces.mix(pieces.mix(np.uint64(doc) + place) + np.uint64(1)))
        each = [pieces.agenda(v, symbols, int(k), 0.1) for k in keys]
        assert ids[doc] == [i for x in each for i in x]
        assert len({tuple(x) for x in each}) > 20
    assert ids[0] != ids[1]
