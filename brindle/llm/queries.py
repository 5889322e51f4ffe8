"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, license_scan, minhash_dedup, mixing, quality_rules, token_binary, token_counts, toxicity

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEPARATOR_ID = 49407  # <|endoftext|>; texts never encode to it, see token_counts


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "shared", "total")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.learn(documents, _read(spark, sf_dir, "labels")))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_digest(_read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path(), SEPARATOR_ID)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _read(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.Mixture(_read(spark, sf_dir, "documents"), "lang").rated()
    return rated.select("doc_id", "n_tokens", "domain", F.round("rate", 6).alias("rate"), "copies")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_decontaminate, op3_language_id, op4_license_scan, op5_quality_rules, op6_token_binary, op7_token_counts, op8_toxicity, op9_mixing, op10_html_text)}
ORACLE_SQL: dict[str, str] = {}
