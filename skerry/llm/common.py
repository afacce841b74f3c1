"""What the operators share: table access, checkpoints in the shared folder, Arrow batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows and bytes of an Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2500, 5 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skerry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets go of shuffles and checkpoints that nothing refers to any more; else their files stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to be no column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read back."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    tidy(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave, once all that is made of them is itself written or checkpointed. Other tables stay."""
    for df in tables:
        if path := _FOLDERS.pop(df, None):
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    """The number of partitions that a shuffle makes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in the open interval (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch of texts, the words of all texts as places in that list, and where each text's begin and end.

    Words are what str.split() gives; null texts have none.
    """
    parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = parts.flatten().dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    ends = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts.offsets) else 0)
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # white space at an end of a text
        full = at != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        at = at[full]
    return distinct, at, ends


_HELD: dict = {}


def only(key, make):
    """What make() gives, kept for later tasks of this worker process until another key is asked for: a worker holds one such thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Lets go of what this worker process holds."""
    if _HELD:
        only(None, lambda: None)


#: Words that a memory learns at a time.
SLICE = 1 << 14


class Memo(dict):
    """Word -> value, filled in bulk by `fill(words)`; starts anew beyond `most` words, so memory is bounded."""

    def __init__(self, fill, most: int = 600_000):
        super().__init__()
        self.fill, self.most = fill, most

    def learn(self, words) -> None:
        words = set(words)
        new = list(words.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        for a in range(0, len(new), SLICE):  # what fill needs for a while depends on SLICE alone
            part = new[a : a + SLICE]
            self.update(zip(part, self.fill(part), strict=True))


