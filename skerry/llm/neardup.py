"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is the weighted set of its five-word shingles: weight = count x idf, where idf = 1 + ln(N / df) / ln(N / m) from 1 to 2, and 2 for
shingles of at most m documents; N is the number of documents, T that of all their distinct shingles, m = max(1, T / COMMON). Fewer than COMMON
shingles can stand in more than m documents, so these are known with their exact df whatever the size of the corpus, and for large ones idf depends
on the share of documents alone. Two rows of CELLS counters find them without loss: a counter is never below the df of a shingle that it counts. ICWS draws samples that two documents share with
probability equal to their weighted Jaccard similarity; samples are banded, and documents that share a band are candidates.

Within a band's bucket every document is first compared with two hubs drawn for the bucket. Where classes are still apart in a bucket, its
documents of different classes are then compared each with each, in blocks that give links alone and never pairs (`open_links`). A pair links if its exact weighted Jaccard similarity is 0.8 or more. Links make classes; texts equal in every byte are one node from the start.

Defined results: null text counts as empty; texts without words are like only to equal ones; texts with fewer words than a shingle count
as one shingle; repeated rows are copies; class_id is the least doc_id of the class (null only if all ids are null); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import U64, arrow, checkpoint, forget, mix, release, tidy, unused, written
from skerry.llm.graph import components
from skerry.llm.shingles import HASH_BITS, count_cells, distinct_counts, key_filter, shingles, sifted, word_hashes

THRESHOLD = 0.8
#: Bands and samples in each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**8 = 0.997.
BANDS, ROWS = 8, 3
#: Nodes and characters in a block when all of a bucket's are compared, and shingles in a matrix there.
BLOCK, CHARS, _WIDE = 512, 4_000_000, 2048
#: Counters in each of two rows, and shingles above m at most.
CELLS, COMMON = 1 << 20, 1 << 18


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & U64(CELLS - 1)).astype(np.int64), CELLS + (hashes >> U64(HASH_BITS) - U64(20)).astype(np.int64)


class Weights:
    """Shingle weights from the document frequencies of the shingles in more than `low` documents."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, documents: int, low: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        spread = np.log(max(documents / low, 2))
        self.idf = np.clip(1 + np.log(documents / df[order]) / spread, 1, 2).astype(np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), 2, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.idf[at], np.float32(2))


def corpus_weights(docs: DataFrame) -> Weights:
    """Counts every document's distinct shingles; the driver gets 2 * CELLS counters, then fewer than COMMON shingles with their exact df."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def which(batch: pa.RecordBatch) -> np.ndarray:
        hashes, _, _ = distinct_counts(*shingles(*word_hashes(batch.column(0))))
        return np.concatenate(_cells(hashes))

    counters = count_cells(texts, 2 * CELLS, which)
    low = max(1.0, float(counters[:CELLS].sum(dtype=np.int64)) / COMMON)
    held = spark.sparkContext.broadcast(np.packbits(counters > low))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        over = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            hashes, _, _ = distinct_counts(*shingles(*word_hashes(batch.column(0))))
            one, two = _cells(hashes)
            found, n = np.unique(hashes[over[one] & over[two]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    common = texts.mapInArrow(frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df")).filter(F.col("df") > low).toArrow()
    return Weights(common.column("shingle").to_numpy().astype(U64), common.column("df").to_numpy(), docs.count(), low)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """2^16 quantiles of the Gamma(2, 1) distribution, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high.astype(np.float32), np.log(high).astype(np.float32)


def sample(hashes: np.ndarray, log_weights: np.ndarray, begins: np.ndarray, samples: int) -> np.ndarray:
    """ICWS samples, as 32-bit names of (shingle, level), a row for each text; begins are where the texts' shingles begin.

    For each sample a shingle's r and c are Gamma(2, 1) and beta uniform, all from its hash; level t = floor(ln w / r + beta); the
    least ln c - r (t - beta + 1) wins. It is over -64, so with 64 added its bits keep its order; they and the name travel in one 64-bit
    number, and one minimum finds both.
    """
    gamma, log_gamma = _tables()
    out = np.empty((len(begins), samples), np.uint32)
    best, step = np.empty(len(hashes), U64), U64(0xD6E8FEB86659FD93)
    for k in range(samples):
        for a in range(0, len(hashes), 1 << 15):
            h = mix(hashes[a : a + (1 << 15)] ^ mix(np.array([k + 1], U64)))
            r = gamma[h & U64(0xFFFF)]
            beta = (h >> U64(32)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(log_weights[a : a + (1 << 15)] / r + beta)
            value = log_gamma[(h >> U64(16)) & U64(0xFFFF)] - r * (t - beta + np.float32(1)) + np.float32(64)
            name = (h + t.astype(np.int64).view(U64) * step) >> U64(32)
            best[a : a + (1 << 15)] = value.view(np.uint32).astype(U64) << U64(32) | name
        out[:, k] = np.minimum.reduceat(best, begins) & U64(0xFFFFFFFF)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    keys = np.empty((len(samples), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(samples), U64(b + 1))
            for r in range(rows):
                key = mix(key + samples[:, b * rows + r].astype(U64) * U64(0x9E3779B97F4A7C15))
            keys[:, b] = key
    return keys.view(np.int64)


def sketches(docs: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, node, bands): node names the text, bands is empty for a text without words."""
    arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            hashes, text, counts = distinct_counts(*shingles(*word_hashes(batch.column("text"))))
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            keys = np.zeros((0, bands), np.int64)
            if len(hashes):
                keys = band_keys(sample(hashes, np.log(held.value.of(hashes) * counts).astype(np.float32), begins, bands * rows), bands, rows)
            sizes = np.zeros(batch.num_rows, np.int32)
            sizes[text[begins]] = bands
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), lists], ["doc_id", "node", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, node long, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each (sorted hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    least = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least))


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights | None, threshold: float = THRESHOLD) -> DataFrame:
    """pairs(a, b) whose similarity is at least threshold; texts(node, text) has the text of each. Without weights: plain Jaccard of shingle sets."""
    held = pairs.sparkSession.sparkContext.broadcast(weights)
    named = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for side in ("a", "b"):
                nodes, where = np.unique(batch.column(side).to_numpy(), return_index=True)
                hashes, text, counts = distinct_counts(*shingles(*word_hashes(batch.column(f"text_{side}").take(pa.array(where)))))
                cuts = np.searchsorted(text, np.arange(len(nodes) + 1))
                w = held.value.of(hashes) * counts if held.value else np.ones(len(hashes), np.float32)
                sets |= {int(n): (hashes[x:y], w[x:y]) for n, x, y in zip(nodes, cuts, cuts[1:], strict=False)}
            good = [weighted_jaccard(sets[a], sets[b]) >= threshold for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_hubs(rows: DataFrame) -> DataFrame:
    """rows(bucket, node) of buckets that hold several nodes, with two hubs drawn for the bucket: (bucket, node, low, high)."""
    drawn = lambda c: F.col(c).bitwiseXOR(F.col("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min(drawn("node")).alias("low"), F.max(drawn("node")).alias("high")).filter("low < high")
    return rows.join(hubs.select("bucket", drawn("low").alias("low"), drawn("high").alias("high")), "bucket")


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(bucket, node) of buckets that hold several classes, with the root of each node."""
    classed = rows.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return classed.join(several.select("bucket"), "bucket", "left_semi")


def dealt(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Open rows(bucket, node, root) as the units of work that compare all nodes of different classes: (bucket, i, j, side, node, root).

    In a bucket the nodes of its largest class are dealt over blocks, and so are all others; every block of others meets itself (i = j), every later
    one and every block of the largest class. A block has about BLOCK nodes and CHARS characters, so no bucket has to fit into one task.
    """
    sized = left.join(texts.select("node", F.length("text").cast("long").alias("chars")), "node")
    totals = sized.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"))
    plan = totals.groupBy("bucket").agg(F.max(F.struct("m", "root", "chars")).alias("top"), F.sum("m").alias("m"), F.sum("chars").alias("chars"))
    blocks = lambda m, chars: F.greatest(F.ceil(m / BLOCK), F.ceil(chars / CHARS), F.lit(1)).cast("int")
    plan = plan.select("bucket", F.col("top.root").alias("main"), blocks(F.col("m") - F.col("top.m"), F.col("chars") - F.col("top.chars")).alias("others"), blocks(F.col("top.m"), F.col("top.chars")).alias("mains"))
    rows = left.join(plan, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    unit = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_main = F.transform(upto("others"), lambda i: unit(i, F.col("others") + F.col("own"), F.lit(1)))
    as_other = F.concat(F.transform(upto("others"), lambda j: unit(F.least("own", j), F.greatest("own", j), j < F.col("own"))), F.transform(upto("mains"), lambda j: unit(F.col("own"), F.col("others") + j, F.lit(0))))
    return rows.select("bucket", "node", "root", F.explode(F.when(F.col("root") == F.col("main"), as_main).otherwise(as_other)).alias("u")).select("bucket", "u.i", "u.j", "u.side", "node", "root")


def shared_weights(texts: pa.Array, weights: Weights | None, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight that each text of left has in common with each of right, as a matrix, and every text's whole weight."""
    hashes, text, counts = distinct_counts(*shingles(*word_hashes(texts)))
    w = weights.of(hashes).astype(np.float64) if weights else np.ones(len(hashes))
    if weights:  # a shingle that stands c times counts as c things
        again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes, text, w = (np.repeat(x, counts) for x in (hashes, text, w))
        hashes = mix(hashes + again.astype(U64) * U64(1 << HASH_BITS))
    whole = np.bincount(text, w, len(texts))
    _, column, holders = np.unique(hashes, return_inverse=True, return_counts=True)
    several = np.cumsum(holders > 1) - 1
    kept = holders[column] > 1
    column, text, w = several[column[kept]], text[kept], np.sqrt(w[kept])
    order = np.argsort(column, kind="stable")
    column, text, w = column[order], text[order], w[order]
    common = np.zeros((len(left), len(right)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDE):
        x, y = np.searchsorted(column, (a, a + _WIDE))
        dense = np.zeros((len(texts), _WIDE))
        dense[text[x:y], column[x:y] - a] = w[x:y]
        common += dense[left] @ dense[right].T
    return common, whole


def spanning(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component, from a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def open_links(left: DataFrame, texts: DataFrame, weights: Weights | None, threshold: float) -> DataFrame:
    """Links (a, b) between roots of open rows(bucket, node, root): of all nodes that share a bucket and are of different classes, so many that
    what is alike hangs together."""
    held = left.sparkSession.sparkContext.broadcast(weights)

    def compare(unit: pa.Table) -> pa.Table:
        forget()
        side, roots = unit.column("side").to_numpy(), unit.column("root").to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if unit.column("i")[0] == unit.column("j")[0]:
            two = one
        pairs = []
        if len(one) and len(two):
            common, whole = shared_weights(unit.column("text").combine_chunks(), held.value, one, two)
            alike = (common > 0) & (common >= threshold * (whole[one][:, None] + whole[two][None] - common) - 1e-9) & (roots[one][:, None] != roots[two][None])
            named, number = np.unique(roots, return_inverse=True)
            x, y = np.nonzero(alike)
            linked = np.zeros((len(named), len(named)), bool)
            linked[number[one[x]], number[two[y]]] = True
            label = spanning(linked | linked.T)
            pairs = [(named[k], named[label[k]]) for k in np.flatnonzero(label != np.arange(len(named)))]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([p for _, p in pairs], pa.int64())})

    return dealt(left, texts).join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def classes(rows: DataFrame, texts: DataFrame, weights: Weights | None, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct rows(bucket, node) and texts(node, text): (node, root) of nodes with links.

    Nodes meet their buckets' hubs; then the nodes of different classes in a bucket are compared, each with each.
    """
    met = written(with_hubs(rows), "met")
    candidates = met.select("node", F.explode(F.array("low", "high")).alias("hub")).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = key_filter(wanted.withColumnRenamed("node", "key"))
    needed = sifted(texts, "node", bits).dropDuplicates(["node"])
    needed = written(needed.join(wanted, "node", "left_semi"), "texts")
    roots = components(verified(candidates, needed, weights, threshold))
    left = checkpoint(open_rows(met.filter("node <> low and node <> high").select("bucket", "node"), roots))
    release(met)
    more = None if left.isEmpty() else checkpoint(open_links(left, needed, weights, threshold))
    release(needed)
    if more is None or more.isEmpty():
        return roots
    # the classes so far are stars, so little is left to do
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, with all its columns: that with the least doc_id, nulls last; of equal ones any one."""
    keep, _ = _nodes(docs, threshold)
    first, named = unused(docs, "_first", "_named")
    order = F.struct(F.col("first").isNull(), "first", "node")
    chosen = keep.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.first").alias(first), F.col("o.node").alias(named))
    rows = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(first)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(named)), "inner")
    return rows.dropDuplicates([first, named]).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) as (doc_id, class_id, copies): copies are documents with the very same text."""
    nodes, sketched = _nodes(docs, threshold)
    ids = nodes.groupBy("root").agg(F.min("first").alias("class_id"))
    by_node = nodes.join(ids, "root").select("node", "class_id", "copies")
    return sketched.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "copies")


def _nodes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, first, copies, root) for each distinct text, and the documents' sketches."""
    arrow(docs.sparkSession)
    weights = corpus_weights(docs)
    sketched = checkpoint(sketches(docs, weights))
    tidy(docs.sparkSession)
    rows = sketched.select("node", F.explode("bands").alias("bucket")).distinct()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    roots = classes(rows, texts, weights, threshold)
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    nodes = nodes.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    return checkpoint(nodes), sketched
