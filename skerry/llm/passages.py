"""Removal of repeated passages inside lines: every run of PASSAGE words that stands somewhere before is cut.

Words are those of the shingles (lower-cased, without marks at their ends). A text's windows of PASSAGE words each have a print: the least of
the hashes of the window's runs of PRINT words. Equal windows have equal prints, so only windows whose print is met at two places or more can
be repeated; nothing is sampled. These windows are then compared by 128 bits of hash of all their words, and every one but the first by
(doc_id, text, place) is cut, so a longer repeated run goes as a whole, as the union of its windows. No window is compared with a
representative: of a passage that several documents share in parts, each part is found.

Defined results: null texts stay; null doc_ids come after all others; repeated rows (same doc_id and text) count as one document and are cut
alike; a window that overlaps its first one in the same text loses only what stands behind that one. White space after a cut goes up to a new line.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, arrow, checkpoint, forget, mix, release, unused, written
from skerry.llm.shingles import MARKS, key_filter, sifted, word_hashes

#: Words in a window, and in the runs that give it its print.
PASSAGE, PRINT = 50, 25
#: Rows whose windows are made at a time.
PART = 512
_STEPS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def run_hashes(words: np.ndarray, size: int, step: int = _STEPS[0]) -> np.ndarray:
    """A hash of the `size` words from each place on, at every place that has so many behind it."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, step, U64)]))
        back = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - size, pow(step, -1, 1 << 64), U64)]))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * powers, dtype=U64)])
        return mix((sums[size:] - sums[: n - size + 1]) * back)


def sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick over each `width` neighbours."""
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def windows(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of all texts begin, the text of each, and its print."""
    n = len(words) - PASSAGE + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    at = np.flatnonzero(np.arange(n) + PASSAGE <= ends[1:][of])
    return at, of[at], sliding(run_hashes(words, PRINT), PASSAGE - PRINT + 1, np.minimum)[at]


def print_places(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prints of all texts' windows, once for each place that gives one, and the text of each."""
    at, _, prints = windows(words, ends)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    runs, wide = run_hashes(words, PRINT), PASSAGE - PRINT
    # a place gives a print if it holds the least hash of one of the windows around it
    around = np.zeros(len(words) - PASSAGE + 1 + 2 * wide, U64)
    around[at + wide] = prints
    given = np.zeros(len(around), bool)
    given[at + wide] = True
    chosen = np.flatnonzero((runs == sliding(around, wide + 1, np.maximum)) & sliding(given, wide + 1, np.logical_or))
    return runs[chosen], np.searchsorted(ends, chosen, "right") - 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, as a text has many windows."""
    for batch in batches:
        for a in range(0, batch.num_rows, PART):
            yield batch.slice(a, PART)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in _parts(batches):
        prints, of = print_places(*word_hashes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(of)), pa.array(prints.view(np.int64))], ["row_key", "print"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in _parts(batches):
        words, ends = word_hashes(batch.column("text"))
        at, of, prints = windows(words, ends)
        lists = batch.column("prints")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        with np.errstate(over="ignore"):
            known = mix(lists.flatten().to_numpy().view(U64) + mix(owner.astype(U64)))
            met = np.isin(mix(prints + mix(of.astype(U64))), known)
        at, of = at[met], of[met]
        one, two = (run_hashes(words, PASSAGE, step)[at].view(np.int64) for step in _STEPS)
        rows = pa.array(of)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "row_key")), pa.array((at - ends[of]).astype(np.int32)), pa.array(one), pa.array(two)], ["doc_id", "row_key", "place", "one", "two"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, row_key, spans), a row for each document that loses words: the words [begin, end) of each span, which may overlap."""
    arrow(docs.sparkSession)
    texts = _texts(docs)
    # the two large tables go to Parquet, which is less than half of a checkpoint's size
    prints = written(texts.select("row_key", "text").mapInArrow(_prints, "row_key long, print long"), "prints")
    several = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    met = checkpoint(prints.join(several, "print").groupBy("row_key").agg(F.collect_set("print").alias("prints")))
    release(prints)
    few = sifted(texts, "row_key", key_filter(met.select(F.col("row_key").alias("key")))).join(met, "row_key")
    every = written(few.select("doc_id", "row_key", "text", "prints").mapInArrow(_windows, "doc_id long, row_key long, place int, one long, two long"), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "place")
    firsts = every.groupBy("one", "two").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = every.join(firsts, ["one", "two"]).filter(order != F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    begin = F.when(same, F.greatest("place", F.col("first.place") + PASSAGE)).otherwise(F.col("place"))
    spans = again.select("doc_id", "row_key", F.struct(begin.alias("begin"), (F.col("place") + PASSAGE).alias("end")).alias("span"))
    return spans.filter("span.begin < span.end").groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def cut(text: str | None, spans: list | None) -> str | None:
    """text without the words of the spans, which are sorted by where they begin."""
    if text is None or not spans:
        return text
    words = [m for m in re.finditer(r"\S+", text) if m.group().strip(MARKS)]
    out, done, at, last = [], 0, 0, len(spans)
    while at < last:
        begin, end = spans[at]
        while at < last and spans[at][0] <= end:
            end, at = max(end, spans[at][1]), at + 1
        out.append(text[done : words[begin].start()])
        done = words[end - 1].end()
        while done < len(text) and text[done].isspace() and text[done] != "\n":
            done += 1
    return "".join([*out, text[done:]])


def without_passages(docs: DataFrame) -> DataFrame:
    """All columns of docs, with repeated passages cut from text."""
    of, row, spans = unused(docs, "_of", "_row", "_spans")
    found = repeated_spans(docs).select(F.col("doc_id").alias(of), F.col("row_key").alias(row), F.col("spans").alias(spans))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(row)), "left")
    # as no filter on text may move below it, it runs once a row; run twice in a task it would take a second Python worker, which stays and fills a memory of its own
    changed = F.udf(cut, "string").asNondeterministic()(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(changed).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns))
