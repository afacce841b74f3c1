"""Hashed word shingles of whole texts, and counters over all of a corpus in a table of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, forget, mix, split_words

#: Words in a shingle.
WORDS = 5
#: Trimmed from both ends of words, which are also lower-cased.
MARKS = ".,;:!?\"'()[]{}|*$%&#"
_STEP = U64(0x9E3779B97F4A7C15)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an array without nulls: its bytes, as random numbers, weighted by powers of their places."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    cuts = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    lengths = np.diff(cuts)
    if not len(raw):
        return mix(lengths.astype(U64))
    of_byte = mix(np.arange(256, dtype=U64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _STEP))
        terms = of_byte[raw] * powers[np.arange(len(raw)) - np.repeat(cuts[:-1], lengths)]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        return mix(sums[cuts[1:]] - sums[cuts[:-1]] + lengths.astype(U64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and where each text's begin and end.

    Words that are nothing but marks don't count.
    """
    distinct, at, ends = split_words(texts)
    plain = pc.utf8_lower(pc.utf8_trim(distinct, MARKS))
    full = np.asarray(pc.not_equal(plain, "").to_numpy(zero_copy_only=False), bool)[at]
    return string_hashes(plain)[at[full]], np.concatenate([[0], np.cumsum(full)])[ends]


def shingles(words: np.ndarray, ends: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the text that each is of. A text with fewer words than a shingle has its words as one."""
    n = len(words)
    lengths = np.diff(ends)
    with np.errstate(over="ignore"):
        code = np.zeros(max(n - size + 1, 0), U64)
        for k in range(size):
            code = code * _STEP + words[k : n - size + 1 + k] if len(code) else code
        of = np.repeat(np.arange(len(lengths)), lengths)
        whole = np.arange(len(code)) + size <= ends[1:][of[: len(code)]] if len(code) else np.zeros(0, bool)
        out, text = mix(code[whole]), of[: len(code)][whole]
        short = np.flatnonzero((lengths > 0) & (lengths < size))
        if len(short):
            few = np.array([sum(int(w) * pow(int(_STEP), i + 1, 1 << 64) for i, w in enumerate(words[ends[t] : ends[t + 1]])) % (1 << 64) for t in short], U64)
            out, text = np.concatenate([out, mix(few)]), np.concatenate([text, short])
            order = np.argsort(text, kind="stable")
            out, text = out[order], text[order]
    return out, text


#: Bits of a shingle's hash that are kept, so that it sorts in one number with its text's place in the batch.
HASH_BITS = 48


def distinct_counts(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text (HASH_BITS bits), sorted within it, their texts and their counts; at most 65,536 texts."""
    keys = np.sort(text.astype(U64) << U64(HASH_BITS) | hashes >> U64(64 - HASH_BITS))
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    kept = keys[at]
    return kept & U64((1 << HASH_BITS) - 1), (kept >> U64(HASH_BITS)).astype(np.int64), np.diff(np.append(at, len(keys)))


_CHUNK = 1 << 14


def count_cells(rows: DataFrame, cells: int, which: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often `which` names each of a fixed number of cells over all rows.

    Tasks count for themselves and send compressed blocks of _CHUNK cells; each block is summed as a stream, so memory
    depends on the number of cells alone. The driver gets `cells` numbers of 32 bits (saturated).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        totals = np.zeros(cells, np.int64)
        for batch in batches:
            totals += np.bincount(which(batch), minlength=cells)
        some = [k for k in range(cells // _CHUNK) if totals[k * _CHUNK : (k + 1) * _CHUNK].any()]
        if some:
            yield _blocks(some, [totals[k * _CHUNK : (k + 1) * _CHUNK] for k in some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(block), "<u4").astype(np.int64)
        if sums:
            yield _blocks(list(sums), list(sums.values()))

    summed = rows.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(cells, np.uint32)
    for r in summed.collect():  # cells / _CHUNK rows
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(zlib.decompress(bytes(r["counts"])), "<u4")
    return out


def _blocks(keys: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(np.minimum(b, 2**32 - 1).astype("<u4").tobytes(), 1) for b in blocks], pa.binary())], ["chunk", "counts"])


#: Bits of the filter that `key_filter` makes.
FILTER_CELLS = 1 << 21


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each cell that a key of keys(key) falls in: FILTER_CELLS bits, whatever keys holds."""
    return count_cells(keys.select("key"), FILTER_CELLS, lambda b: _cell(b.column(0))) > 0


def _cell(keys: pa.Array) -> np.ndarray:
    return (mix(keys.to_numpy(zero_copy_only=False).view(U64)) % U64(FILTER_CELLS)).astype(np.int64)


def sifted(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """rows without most of those whose key (a long) the filter wasn't made of; none is lost that it was. Too many keys let more rows through."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    at, schema = rows.columns.index(column), rows.schema

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value[_cell(batch.column(at))]))

    return rows.filter(F.col(column).isNotNull()).mapInArrow(sift, schema)
