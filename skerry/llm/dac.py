"""Token-id output as directly addressable codes (DAC).

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap
that says which of them go on at level k+1. A rank directory (ones before each block of 512 bits) turns a place in
one level into a place in the next without decoding what lies before it, so any single token can be read.

A segment (one file record) holds whole documents:

    magic "DAC1" | u32 documents | u64 tokens | u32 levels | i64 document ids | u8 null-id flags | u64 document starts
    (documents + 1) | for each level: u64 entries, chunk bytes, bitmap bytes, u32 ranks

All numbers are little-endian. Segments are records of a Parquet table in the shared folder, which any store that
Spark can write takes. Defined results: null text counts as empty, an empty document holds the end id alone, a null doc_id sorts
first, repeated rows are separate documents, an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import arrow, new_folder
from skerry.llm.wordids import word_ids

_BLOCK = 512
_MAGIC = b"DAC1"
#: A segment closes with the document that takes it to so many tokens.
SEGMENT_TOKENS = 1 << 18


def _bits(n: int) -> int:
    return (n + 7) // 8


def encode(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One segment; starts has an entry for each document and the end."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest >= 256
        ones = np.concatenate([np.zeros(1, np.int64), np.cumsum(more)])[:: _BLOCK][: len(rest) // _BLOCK + 1]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + ones.astype("<u4").tobytes())
        rest = rest[more] >> 8
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(levels))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.asarray(starts, "<u8").tobytes(), *levels])


class Segment:
    """A segment opened for reading: `segment[i]` for one token, `all()` for every one."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a DAC segment")
        n, self.tokens, levels = struct.unpack_from("<IQI", blob, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n), take("u1", n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", blob, at)
            at += 8
            self.levels.append((take("u1", count), take("u1", _bits(count)), take("<u4", count // _BLOCK + 1)))

    def __len__(self) -> int:
        return self.tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // _BLOCK
            before = np.unpackbits(bitmap[block * _BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - block * _BLOCK]
            i, shift = int(ranks[block]) + int(before.sum()), shift + 8
        raise ValueError("a code goes on after the last level")

    def all(self) -> np.ndarray:
        above = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= above << 8
            above = here
        return above


_SEGMENTS = "part int, segment int, documents long, tokens long, dac binary"
_DOCUMENTS = "doc_id long, part int, segment int, place long, local_start long, n_tokens long, ids_crc32 long"


def write_segments(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every text and writes the segments, in ascending doc_id order, as a Parquet table at folder."""
    arrow(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, number = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])]).astype(np.int64)
            blob = encode(np.frombuffer(b"".join(held), "<u4"), doc_ids, starts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([blob], pa.binary())], ["part", "segment", "documents", "tokens", "dac"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                doc_ids.append(d)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment_tokens:
                    yield close()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, _SEGMENTS).write.parquet(folder)


def read_segments(spark, folder: str) -> DataFrame:
    """One row for each document of the files at folder, with its place among all ids."""
    arrow(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                segment = Segment(blob)
                ids, starts = segment.all().astype("<u4"), segment.starts
                n = len(segment.doc_ids)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.doc_ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "part", "segment", "place", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(_SEGMENTS).parquet(folder)
    # Parts are as many as a shuffle makes, so their totals fit one task; segments are summed within their part.
    totals = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    of_part = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_start"))
    of_segment = files.select("part", "segment", (F.sum("tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("tokens")).alias("segment_start"))
    places = of_segment.join(F.broadcast(of_part), "part")
    rows = files.select("part", "segment", "dac").mapInArrow(documents, _DOCUMENTS)
    return rows.join(places, ["part", "segment"]).select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "place")


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of docs(doc_id, text) as DAC files and returns what is read back, one row for each document."""
    folder = new_folder(docs.sparkSession, "dac")
    write_segments(docs, tokenizer, folder, end_id)
    return read_segments(docs.sparkSession, folder)
