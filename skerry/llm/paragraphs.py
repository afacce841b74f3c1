"""Removal of repeated paragraphs by MinHash banding.

A paragraph is a line of a text. Paragraphs of MIN_WORDS words or more are hashed into five-word shingles; MinHash values in bands find candidates,
with the number of bands tuned for recall. Colliding paragraphs are compared with the bucket's hubs, and a pair links if its exact Jaccard
similarity is 0.8 or more. Links make classes (paragraphs equal in every byte are one node from the start). Of each class the first
paragraph by (doc_id, place) stays where it is; all the others are removed.

Defined results: null and empty texts have no paragraphs and stay as they are; shorter paragraphs stay; a document all of whose
paragraphs go has the empty text; null doc_ids come after all others; repeated rows (same doc_id and text) count as one document and keep alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, arrow, forget, mix, release, unused, written
from skerry.llm.neardup import band_keys, classes
from skerry.llm.shingles import distinct_counts, shingles, word_hashes

THRESHOLD, MIN_WORDS, RECALL, ROWS = 0.8, 5, 0.998, 2


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of `rows` values that finds a pair at the threshold with probability `recall`."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def minhash(hashes: np.ndarray, begins: np.ndarray, samples: int) -> np.ndarray:
    """The least values of `samples` hash functions over each set."""
    out = np.empty((len(begins), samples), np.uint32)
    for k in range(samples):
        salt = mix(np.array([k + 1], U64))
        out[:, k] = np.minimum.reduceat((hashes ^ salt) * (salt | U64(1)) >> U64(32), begins)
    return out


def signed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs(doc_id, text) as a row for each paragraph of enough words: (doc_id, row_key, place, node, bands)."""
    arrow(docs.sparkSession)
    bands = bands_for(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                words, ends = word_hashes(part.column("para"))
                enough = np.diff(ends) >= MIN_WORDS
                hashes, text, _ = distinct_counts(*shingles(words, ends))
                begins = np.flatnonzero(np.diff(text, prepend=-1))
                keys = band_keys(minhash(mix(hashes), begins, bands * ROWS), bands, ROWS) if len(begins) else np.zeros((0, bands), np.int64)
                keys = keys[enough[text[begins]]]
                kept = part.filter(pa.array(enough))
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("doc_id", "row_key", "place", "node")), lists], ["doc_id", "row_key", "place", "node", "bands"])

    return lines(docs).mapInArrow(run, "doc_id long, row_key long, place int, node long, bands array<long>")


def lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, row_key, place, para, node), a row for each line."""
    split = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("place", "para"))
    return split.withColumn("node", F.xxhash64("para"))


def repeats(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The places to remove: (doc_id, row_key, places), a row for each document that loses a paragraph."""
    arrow(docs.sparkSession)
    every = written(signed(docs, threshold).select("doc_id", "row_key", "place", "node", "bands"), "signed")
    # each text once, however often a line is repeated
    rows = every.select("node", "bands").distinct().select("node", F.explode("bands").alias("bucket"))
    texts = lines(docs).select("node", F.col("para").alias("text"))
    roots = classes(rows, texts, None, threshold)
    # null ids stand behind the others: the order is (is null, id, row, place)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "place")
    classed = every.select("doc_id", "row_key", "place", "node").join(roots, "node", "left").select("doc_id", "row_key", "place", F.coalesce("root", "node").alias("root"))
    keep = classed.groupBy("root").agg(F.min(order).alias("keep"), F.count("*").alias("n")).filter("n > 1").select("root", "keep")
    gone = classed.join(keep, "root").filter(order != F.col("keep"))
    places = written(gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("place")).alias("places")), "places")
    release(every)
    return places


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD, removed: str = "removed") -> DataFrame:
    """All columns of docs with repeated paragraphs cut from text, and the places of the lines that went, in a column called `removed`.

    A column of docs that has that name is replaced; choose another name to keep it.
    """
    of, row, places = unused(docs, "_of", "_row", "_places")
    found = repeats(docs, threshold).select(F.col("doc_id").alias(of), F.col("row_key").alias(row), F.col("places").alias(places))
    cut = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: ~F.array_contains(places, x["at"])), lambda x: x["line"]), "\n")
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(row)), "left")
    others = [c for c in docs.columns if c != removed]
    texts = F.when(F.col(places).isNull(), F.col("text")).otherwise(cut).alias("text")
    return joined.select(*(texts if c == "text" else F.col(f"`{c}`") for c in others), F.coalesce(places, F.array().cast("array<int>")).alias(removed))
