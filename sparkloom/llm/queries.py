"""The ten operators as named queries over whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, exact, html, language, licenses, mixing, neardup, pieces, substring, tokenfile

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer lies; every machine has the files at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_output(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer(PIECES))
    return encoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "n_chunks", "round_trip", "n_best", F.crc32("best_ids").alias("best_crc32"), "best_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_language_id, op3_token_files, op4_exact_dedup, op5_html_extraction, op6_nearest_neighbours, op7_substring_dedup, op8_source_mix, op9_near_dedup, op10_sentencepiece)
}
ORACLE: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op4_exact_dedup": exact.ORACLE, "op7_substring_dedup": substring.ORACLE, "op8_source_mix": mixing.ORACLE, "op9_near_dedup": neardup.ORACLE}
