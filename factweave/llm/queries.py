"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fill_middle, html_text, language_id, merkle, minhash_dedup, phrase_mining, quality_rules, record_files, secret_scan, sentencepiece_codec, url_filter
from ._shared import table
from .source_mixing import op1_source_mixing


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files are; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = language_id.references(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, learnt)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(spark, docs, table(spark, sf_dir, "labels")))


def op10_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.export(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(table(spark, sf_dir, "documents"))


def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_url_filter, op3_sentencepiece, op4_html_text, op5_secret_scan, op6_minhash_dedup, op7_embedding_dedup, op8_language_id, op9_quality_rules, op10_record_files, op11_phrase_mining, op12_merkle_fingerprints, op13_fill_middle)}
ORACLE_SQL = {
    "op2_url_filter": url_filter.oracle(),
    "op11_phrase_mining": phrase_mining.oracle(),
    "op12_merkle_fingerprints": merkle.oracle(),
    "op13_fill_middle": fill_middle.oracle(),
}
