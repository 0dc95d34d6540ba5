"""Documents that arrive in a stream, compiled version by version; an extension beyond the batch operators.

The store lists, for each version of a document, the chunks it has, and holds the nodes of each chunk once. Each micro-batch
brings new versions of some documents: chunks whose hash the last version has keep their nodes and ids, changed ones are
compiled and numbered on from the highest kept instance, and those that vanished go, as in `versions.recompile`. A batch
writes the nodes of what it compiled and the chunks of its documents under its own number, so a batch that runs again after
a failure replaces its own output and nothing is doubled; what counts of a document is what its latest batch lists.

Defined results: of several rows of one document in a batch the one with the greatest text counts; a document without
chunks has no nodes from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.functions.columns import coord_parts
from factweave.operators import lexing, versions
from factweave.operators.graph import ensure_checkpoints

STATE = {
    "documents": "doc_id long",
    "chunks": "doc_id long, chunk_id string, content_hash string",
    "nodes": "doc_id long, node_id string, label string, value_str string, unit string, content_hash string, chunk_id string, value_kind string, value_num double",
}


def _stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """What all batches have written of a table, with their numbers; empty before the first one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    schema = f"{STATE[name]}, batch long"
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{store}/{name}")
    return spark.createDataFrame([], schema)


def latest(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """(doc_id, batch): the last batch that brought each document, of those before a number."""
    batches = _stored(spark, store, "documents")
    return (batches if before is None else batches.where(F.col("batch") < before)).groupBy("doc_id").agg(F.max("batch").alias("batch"))


def current_chunks(spark: SparkSession, store: str, last: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, content_hash) of the last versions, or of those that `last` names."""
    last = latest(spark, store) if last is None else last
    batches = [r["batch"] for r in last.select("batch").distinct().collect()]  # numbers of batches, by which files are left out
    return _stored(spark, store, "chunks").where(F.col("batch").isin(batches)).join(last, ["doc_id", "batch"]).drop("batch")


def current_nodes(spark: SparkSession, store: str, chunks: DataFrame | None = None) -> DataFrame:
    """The nodes of the chunks of the last versions, or of these chunks. A chunk's name says which batch compiled it."""
    chunks = current_chunks(spark, store) if chunks is None else chunks
    made = chunks.select("doc_id", "chunk_id", F.substring_index("chunk_id", "@", -1).cast("long").alias("batch"))
    batches = [r["batch"] for r in made.select("batch").distinct().collect()]
    return _stored(spark, store, "nodes").where(F.col("batch").isin(batches)).join(made, ["doc_id", "chunk_id", "batch"], "left_semi").drop("batch")


def compile_batch(docs: DataFrame, batch_id: int, store: str) -> None:
    spark = docs.sparkSession
    ensure_checkpoints(docs)
    docs = docs.groupBy("doc_id").agg(F.max("text").alias("text")).checkpoint()
    last = latest(spark, store, batch_id).join(docs.select("doc_id"), "doc_id", "left_semi").checkpoint()
    # Chunks are named by the batch too: a reused one and a new one may have the same number.
    chunks = lexing.lex(docs).withColumn("chunk_id", F.concat("chunk_id", F.lit(f"@{batch_id}"))).checkpoint()
    old = current_chunks(spark, store, last).checkpoint()
    planned = versions.plan(old, chunks).checkpoint()
    old_nodes = current_nodes(spark, store, old).select("*", *coord_parts(F.col("node_id")))
    nodes = versions.recompile(planned, old_nodes, chunks, ("value_kind", "value_num"))
    names = [x.split()[0] for x in STATE["nodes"].split(", ")]
    nodes.where("origin = 'compiled'").select(*names).write.mode("overwrite").parquet(f"{store}/nodes/batch={batch_id}")
    held = old.select("doc_id", "chunk_id", "content_hash").unionByName(chunks.select("doc_id", "chunk_id", "content_hash"))
    held.join(planned.where("action <> 'remove'").select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi").write.mode("overwrite").parquet(f"{store}/chunks/batch={batch_id}")
    # Written last: from now on the batch counts.
    docs.select("doc_id").write.mode("overwrite").parquet(f"{store}/documents/batch={batch_id}")


def start(stream: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """`stream` has doc_id and text."""
    writer = stream.writeStream.foreachBatch(lambda df, n: compile_batch(df, n, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
