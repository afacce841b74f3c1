"""A training corpus from raw documents: language ID, toxicity, near-duplicates, repeated paragraphs, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it as written and read again. All but the last return the
columns of docs. Filters run on the rows themselves, so extra columns, repeated rows and null ids pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import langid, neardup, packing, paragraphs, passages, toxicity
from skerry.llm.common import crc_of_id, release, table, unused, written
from skerry.llm.wordids import default_path

#: A document needs this share of letters in its main language, and stays below this toxicity score.
MAIN_LANGUAGE, TOXIC = 0.5, 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a main language; those without letters, or of no language for the most part, go."""
    model = langid.fit(docs.filter(crc_of_id() % 5 != 0))
    return langid.kept(docs, model, MAIN_LANGUAGE)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of TOXIC or more; the model learns from the labelled documents that are there."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_of_id() % 4 != 2))
    return toxicity.kept(docs, model, TOXIC)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the least doc_id, and of its repeated rows one."""
    return neardup.one_of_each(docs)


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines, then repeated passages within lines, from texts; a document that has nothing left goes. Other columns stay as they are."""
    removed, blank = unused(docs, "_removed", "_blank")
    cut = paragraphs.without_repeats(docs, removed=removed).filter((F.size(removed) == 0) | (F.trim("text") != ""))
    lines = written(cut.drop(removed), "lines")
    # a first passage stays, so a text that is empty now was so before or has lost all its words
    left = passages.without_passages(lines.withColumn(blank, F.trim("text") == ""))
    return left.filter(F.col(blank) | F.col("text").isNull() | (F.trim("text") != "")).drop(blank)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of 4096."""
    return packing.pack(docs, default_path())


STAGES = [
    ("language_id", language_id),
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_paragraphs", without_repeated_paragraphs),
    ("best_fit_packing", packed),
]

#: The stages' models and samples can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
