"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, and encoding, each over all that the last kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it back as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import minhash_dedup, quality_rules, secret_scan, sentencepiece_codec, source_mixing
from factweave.llm._shared import fresh_path, table
from factweave.llm.queries import tokenizer_path

#: Shares of the tokens after mixing.
WEIGHTS = {"clean": 0.98, "toxic": 0.02}


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id a verdict keeps; rows without one follow the verdicts on null ids."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")  # docs may have a kept_id too


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.train(spark, docs, table(spark, sf_dir, "labels"))
    return _keep(docs, quality_rules.judge(docs, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return _keep(docs, minhash_dedup.dedup(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are put out; every document stays."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as its rate says; rows that share a doc_id as often as the highest of theirs."""
    labels = table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    labelled = labels.select("doc_id", domain.alias("domain")).where("domain is not null")
    mixed = source_mixing.mix(docs, labelled, WEIGHTS).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # its own columns may have any names
    joined = rows.join(mixed, F.col("row.doc_id").eqNullSafe(F.col("mixed_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what stays, with digests of ids and decoded text."""
    return sentencepiece_codec.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("secret scans", secrets), ("mixing to target weights", mixing), ("SentencePiece encoding", encoding)]

#: The classifiers and the encoder have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
