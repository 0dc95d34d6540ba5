"""Files and strings as documents, behind the guards on path and size. Everything goes through Spark's readers, so that a
path may be on any file system that Spark knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import detect, detect_file, source_info

MAX_PATH, MAX_BYTES = 4096, 10 << 20
#: A source longer than this, or of several lines, is a text and no path.
MAX_AUTO = 500
CONTAINERS = ("PDF", "DOCX", "XLSX", "PPTX")


def guard(path: str) -> None:
    if len(path) > MAX_PATH:
        raise ValueError(f"path too long: {len(path)} > {MAX_PATH}")
    if ".." in path.split("/"):
        raise ValueError(f"suspicious path: {path}")


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, skip_large: bool = False) -> DataFrame:
    """(doc_id, path, text, kind) of the files below a path; doc_id is a hash of the path.

    A file over the bound is an error, found by the listing alone, unless `skip_large` leaves such files out. Containers
    (PDF, DOCX, XLSX, PPTX) need readers of their own and give a marker."""
    guard(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not skip_large and (large := raw.where(F.col("length") > max_bytes).select("path", "length").first()):
        raise ValueError(f"file too large: {large['path']} has {large['length']} bytes, over {max_bytes}")
    raw = raw.where(F.col("length") <= max_bytes)
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    read = raw.select(F.xxhash64("path").alias("doc_id"), "path", decoded(F.col("content")).alias("text")).withColumn("kind", detect_file(F.col("path"), F.col("text")))
    marker = F.concat(F.lit("["), F.col("kind"), F.lit(": "), name, F.lit(" - no reader installed]"))
    return read.withColumn("text", F.when(F.col("kind").isin(*CONTAINERS), marker).otherwise(F.col("text")))


def is_file(spark: SparkSession, source: str) -> bool:
    """Whether a source of one short line names what is there."""
    if len(source) >= MAX_AUTO or "\n" in source or not source:
        return False
    jvm = spark.sparkContext._jvm
    try:
        where = jvm.org.apache.hadoop.fs.Path(source)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    except Exception:  # a text that is no path on any file system
        return False


def load_source(spark: SparkSession, source: str, kind: str = "auto", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, kind, uri, hash_sha256, size_bytes) of a file, or of the string itself: by `kind` "file", "string", or
    "auto", which takes for a file what is there. A file's address is its path, a string's a hash."""
    if kind not in ("auto", "file", "string"):
        raise ValueError(f"unknown source type {kind}")
    if kind == "file" or (kind == "auto" and is_file(spark, source)):
        guard(source)
        found = spark.read.format("binaryFile").load(source)
        rows = found.select("path", "length").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"not one regular file: {source}")
        if rows[0]["length"] > max_bytes:
            raise ValueError(f"file too large: {rows[0]['length']} > {max_bytes}")
        read = found.select(F.xxhash64("path").alias("doc_id"), decoded(F.col("content")).alias("text"), F.col("path").alias("uri"), F.sha2("content", 256).alias("hash_sha256"), F.col("length").alias("size_bytes"))
        return read.select("doc_id", "text", detect_file(F.col("uri"), F.col("text")).alias("kind"), "uri", "hash_sha256", "size_bytes")
    text = spark.createDataFrame([(source,)], "text string")
    return text.select(F.xxhash64("text").alias("doc_id"), "text", detect(F.col("text")).alias("kind"), *source_info(F.col("text")))
