import functools
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from skerry.llm import dac, packing, tiff
from skerry.llm.wordids import default_path, word_ids

SCHEMA = "doc_id long, text string, lang string, score double, start long"
ROWS = [(5, "One two, three's 42!", "en", 1.0, 9), (3, None, None, None, None), (4, "", "", 0.0, 0), (9, "word " * 9000, "en", 1.0, 1), (5, "One two, three's 42!", "en", 1.0, 9), (7, "é\x1cñ <|endoftext|> ünï 中文 \n\n x", "fr", 2.0, 3), (None, "no id", None, None, None)]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB'sté \n\t\x1c\x85 .,!9中Σς́<|endoftext|>")), max_size=5))
@example(["Öl Straße, ÉCOLE. Σίσυφος ΑΣ İstanbul ǅ e\u0301té don't I'm x.y a. , ... I.", "नमस्ते 한국어, 日本。 naïve"])
def test_words_by_themselves_give_the_ids_of_the_whole(texts):
    for text, ids in zip(texts, word_ids(default_path()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_any_token_is_read_without_the_others(ids, data):
    segment = dac.Segment(dac.encode(np.array(ids, np.uint32), [1, None], np.array([0, 0, len(ids)])))
    assert segment.all().tolist() == ids and segment.doc_ids == [1, None]
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        assert segment[i] == ids[i]
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_token_file(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in dac.token_file(docs, default_path()).collect())
    at, want = 0, []
    for d, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), 2]
        want.append((at, len(ids), d, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert dac.token_file(docs.limit(0), default_path()).count() == 0


def one_by_one(lengths, size):
    """Best-fit decreasing, document by document."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in lengths}
    steps = packing.plan(histogram, 20).tolist()
    used = defaultdict(list)
    for k, (length, rank, first, each, offset) in enumerate(steps):
        end = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == length else histogram[length]
        for r in range(end - rank):
            used[first + r // each].append((offset + r % each * length, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 20
    assert sorted(20 - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, 20)


def test_pack(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack(docs, default_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for spans in by_sequence.values():
        at = 0
        for r in sorted(spans, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    for d, text in {r[0]: r[1] for r in ROWS}.items():
        ids = np.array([*ids_of(text), 1], "<u4")
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))] * (2 if d == 5 else 1)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == sorted(want)
    assert len(by_sequence) == len(one_by_one([r.length for r in rows], 4096))
    assert packing.pack(docs.limit(0), default_path()).count() == 0


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, (16, 16), (64, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(scheme, tile, predictor):
    rng = np.random.default_rng(scheme)
    for pixels in (rng.integers(0, 256, (37, 50), np.uint8), rng.integers(0, 3, (64, 128), np.uint8), np.full((90, 100), 7, np.uint8)):
        page, second = tiff.read_pages(tiff.write_pages([(pixels, scheme, predictor, tile, 10), (pixels[:5], scheme, predictor, tile, 2)]))
        assert (page.pixels[:, :, 0] == pixels).all() and (second.pixels[:, :, 0] == pixels[:5]).all() and second.number == 1


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_codings(data, n):
    data *= n
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.un_lzw(tiff.to_lzw(data), len(data)) == data


def test_lzw_beyond_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.un_lzw(tiff.to_lzw(data), len(data)) == data


def test_big_endian_sixteen_bits():
    import struct

    values = np.array([[1000, 2000, 500]], ">u2")
    diff = np.diff(values.astype(np.uint16), axis=1, prepend=np.zeros((1, 1), np.uint16)).astype(">u2").tobytes()
    entries = [(256, 3), (257, 1), (258, 16), (259, 1), (273, 8), (277, 1), (278, 1), (279, 6), (317, 2)]
    blob = b"MM\0*" + struct.pack(">I", 14) + diff + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in entries) + b"\0\0\0\0"
    (page,) = tiff.read_pages(blob)
    assert page.pixels[0, :, 0].tolist() == [1000, 2000, 500]


def test_tiff_query(spark):
    text = "x é 中" * 9000
    docs = spark.createDataFrame([*ROWS, (11, text, "en", 0.0, 0), (12, text, "de", None, None)], SCHEMA)
    rows = tiff.digests(tiff.page_rows(tiff.media(docs))).collect()
    assert len(rows) == len(ROWS) + 2
    for r in rows:
        t = next(x[1] for x in [*ROWS, (11, text), (12, text)] if x[0] == r.doc_id) or ""
        payload = t.encode()
        payload += b"\xff" * (-len(payload) % 576 or (576 if not payload else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    twins = [r[1:] for r in rows if r.doc_id in (11, 12)]
    assert twins[0] == twins[1] and twins[0][4] > 0
    assert tiff.page_rows(tiff.media(docs.filter("doc_id = 11"))).count() > 1


def test_damaged_media(spark):
    good = tiff.store(b"\x01" * 576)
    files = spark.createDataFrame([(1, 0, bytearray(b"nonsense")), (2, 0, bytearray(good[: len(good) // 2])), (3, 0, None), (4, 576, bytearray(good))], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in tiff.page_rows(files).collect()}
    assert set(rows) == {1, 2, 4} and rows[1].page == -1 and rows[2].error and rows[4].error is None
