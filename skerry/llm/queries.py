"""The queries opN_… over the whole tables. None of them can be expressed in SQL; tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import dac, html, langid, neardup, packing, paragraphs, passages, pieces, qalsh, tiff, toxicity
from skerry.llm.common import crc_of_id, table, written
from skerry.llm.wordids import default_path


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_of_id() % 4 != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_path())


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.page_rows(tiff.media(table(spark, sf_dir, "documents"))))


def op4_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pieces.default_path()
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), path), path)


def op5_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return qalsh.neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_boosted_tree_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_mixed_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = langid.label(docs, langid.fit(docs.filter(crc_of_id() % 5 != 0)))
    return labelled.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_weighted_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_paragraph_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = written(paragraphs.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", F.size("removed").alias("n_removed"), "removed", "text"), "lines")
    return passages.without_passages(lines)


def op10_dac_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_file(table(spark, sf_dir, "documents"), default_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_string_kernel_toxicity, op2_best_fit_packing, op3_tiff_pages, op4_merge_dropout_pieces, op5_collision_counting_neighbours, op6_boosted_tree_main_text, op7_mixed_language_id, op8_weighted_minhash_neardup, op9_paragraph_minhash_dedup, op10_dac_token_ids)}


def oracle_sql() -> dict[str, str]:
    return {}
