"""Best-fit-decreasing packing of tokenised documents into sequences.

Bins with equal remaining capacity are interchangeable, so best-fit decreasing over all documents needs only the
histogram of their lengths (at most `size` counts, whatever the corpus holds). The planner walks the lengths from the
longest down; a segment tree over the remaining capacities 0..size finds the tightest capacity that has an open bin
in logarithmic time, and a run of equal lengths goes to a run of equal bins in one step. That is what placing document by document does:
a bin just filled that still takes the same length is the tightest one, so each bin takes as many of that length as fit.

Each document then needs its rank among the documents of its length. Ranks are made within (length, salt) groups and
shifted by the counts of the salts before, so a length that a third of all documents share is spread over all tasks.

Defined results: null text is empty, an empty document is its end id alone; repeated rows are separate documents; an
empty table gives no rows. Only documents longer than `size` are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import arrow, checkpoint, width
from skerry.llm.wordids import word_ids

SEQUENCE = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over capacities 0..size; each leaf holds runs of bins (first bin, how many) with that much room."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = np.zeros(2 * self.base, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int) -> None:
        i = room + self.base
        self.open[i] = bool(self.runs[room])
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def put(self, room: int, first: int, bins: int) -> None:
        self.runs[room].append((first, bins))
        if len(self.runs[room]) == 1:
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room)
        return run

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least need that has an open bin."""
        i = need + self.base
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, first bin, documents a bin, offset in the bin), sorted by length and rank."""
    tree, bins, steps = CapacityTree(size), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit a sequence of {size}")
        while left:
            room = tree.tightest(length)
            if room is None:
                each = size // length
                first, count, room = bins, -(-left // each), size
                bins += count
            else:
                first, count = tree.take(room)
            each = room // length
            steps.append((length, rank, first, each, size - room))
            full, part = divmod(min(left, each * count), each)
            if full:
                tree.put(room - each * length, first, full)
            if part:
                tree.put(room - part * length, first + full, 1)
            if (used := full + bool(part)) < count:
                tree.put(room, first + used, count - used)
            rank += full * each + part
            left -= full * each + part
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """Every document's ids with the end id, cut into pieces where it is longer than a sequence."""
    arrow(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in batches:
            out = []
            for d, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    out.append((d, k, a // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


def place(items: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """items(length, …) with sequence_id and offset; the other columns stay.

    All columns together tell the rows apart; rows equal in all of them are interchangeable.
    """
    spark = items.sparkSession
    arrow(spark)
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    steps = plan(histogram, size)
    shared = spark.sparkContext.broadcast((steps[:, 0] * (1 << 44) + steps[:, 1], steps))
    columns = items.columns
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(4 * width(spark))))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*columns)).cast("long") - 1)
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = ranked.join(before, ["length", "_salt"]).select(*columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, steps = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "_rank"))
            found = steps[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            beyond = rank - found[:, 1]
            at = [pa.array(found[:, 2] + beyond // found[:, 3]), pa.array(found[:, 4] + beyond % found[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *at], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(locate, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """Packs docs(doc_id, text); the pieces are kept in the shared folder, so texts are tokenised once."""
    return place(checkpoint(pieces(docs, tokenizer, size, end_id)), size)
