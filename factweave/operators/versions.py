"""Differences between versions, incremental recompilation by chunk hash, and merging of programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.columns import coord_id

from . import emission, extraction
from .scans import unsent


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, node_id, change): added, removed, changed or same, by node id and content hash."""
    a = old.select("doc_id", "node_id", F.col("content_hash").alias("old"))
    b = new.select("doc_id", "node_id", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, ["doc_id", "node_id"], "full_outer").select("doc_id", "node_id", change.alias("change"))


def plan(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, action): previous chunks to reuse or remove, new chunks to recompile. Of previous chunks with
    one hash the last stands for all; a paragraph that is twice in the new version is reused twice."""
    last = old_chunks.groupBy("doc_id", "content_hash").agg(F.max("chunk_id").alias("old_id"))
    key = ["doc_id", "content_hash"]
    reuse = new_chunks.join(unsent(last), key).select("doc_id", F.col("old_id").alias("chunk_id"), F.lit("reuse").alias("action"))
    recompile = new_chunks.join(unsent(last), key, "left_anti").select("doc_id", "chunk_id", F.lit("recompile").alias("action"))
    remove = old_chunks.select("doc_id", "chunk_id").join(unsent(reuse.select("doc_id", "chunk_id")), ["doc_id", "chunk_id"], "left_anti").withColumn("action", F.lit("remove"))
    return reuse.unionByName(recompile).unionByName(remove)


def efficiency(planned: DataFrame) -> DataFrame:
    """Counts of each action and the share that was reused; 1.0 where there was nothing to do."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    done = planned.groupBy("doc_id").agg(n("reuse").alias("reused"), n("recompile").alias("recompiled"), n("remove").alias("removed"))
    total = F.col("reused") + F.col("recompiled") + F.col("removed")
    return done.withColumn("efficiency", F.round(F.when(total == 0, 1.0).otherwise(F.col("reused") / total), 6))


def copy_unchanged(planned: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """Nodes of the reused chunks, with their ids."""
    reused = planned.where("action = 'reuse'").select("doc_id", "chunk_id").distinct()
    return old_nodes.join(unsent(reused), ["doc_id", "chunk_id"], "left_semi")


def copy_relations(kept_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends were kept."""
    ids = kept_nodes.select("doc_id", "node_id")
    out = edges.join(ids.withColumnRenamed("node_id", "subject_id"), ["doc_id", "subject_id"], "left_semi")
    return out.join(ids.withColumnRenamed("node_id", "object_id"), ["doc_id", "object_id"], "left_semi")


def recompile(planned: DataFrame, old_nodes: DataFrame, new_chunks: DataFrame, extra: tuple[str, ...] = (), max_tier: int = 2) -> DataFrame:
    """Nodes of the new version: those of reused chunks keep their ids, those of changed chunks are numbered on from the
    highest kept instance and join unless an equal node was kept. Provenance is named by generation, so that a reused
    and a changed chunk with one number do not meet. `extra` names further columns of nodes to return."""
    kept = copy_unchanged(planned, old_nodes)
    fresh = new_chunks.join(unsent(planned.where("action = 'recompile'").select("doc_id", "chunk_id")), ["doc_id", "chunk_id"], "left_semi")
    made = emission.assign_coords(extraction.extract(fresh, max_tier)).withColumn("key", F.concat_ws("|", "label", F.coalesce("value_str", F.lit("None")), F.coalesce("unit", F.lit("None"))))
    top = kept.groupBy("doc_id", "major", "type", "subtype").agg(F.max("instance").alias("top"))
    made = made.join(unsent(top), ["doc_id", "major", "type", "subtype"], "left").withColumn("instance", F.col("instance") + F.coalesce("top", F.lit(0)))
    made = made.withColumn("content_hash", F.substring(F.sha2("key", 256), 1, 16)).join(unsent(kept.select("doc_id", "content_hash")), ["doc_id", "content_hash"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy("ext_seq"))
    made = made.withColumn("r", first).where("r = 1")
    node_id = coord_id(F.col("major"), F.col("type"), F.col("subtype"), F.col("instance"))
    columns = ["doc_id", "node_id", "label", "value_str", "unit", "content_hash", "chunk_id", "origin", *extra]
    return kept.withColumn("origin", F.lit("reused")).select(*columns).unionByName(made.withColumn("node_id", node_id).withColumn("origin", F.lit("compiled")).select(*columns))


def merge_provenance(programs: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The provenance that merged nodes name: all of every program's, its ids followed by the program's number, from 0."""
    if not programs:
        raise ValueError("no programs to merge")
    out = None
    for n, (_, prov) in enumerate(programs):
        part = prov.withColumn("prov_id", F.concat("prov_id", F.lit(f"_p{n}")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge(programs: list[tuple[DataFrame, DataFrame]], priority: str = "adapter") -> DataFrame:
    """Nodes of several (nodes, provenance) programs as one. Of equal nodes the most confident wins, the first on ties
    ("adapter"), or the last ("latest"). Results stand in the order in which each content was first seen and are numbered
    anew; provenance is named by the winner's own program. Relations, derivations and the rest do not come along."""
    if not programs:
        raise ValueError("no programs to merge")
    if priority not in ("adapter", "latest"):
        raise ValueError(f"unknown priority {priority}")
    all_ = None
    for n, (nodes, prov) in enumerate(programs):
        conf = nodes.join(prov.select("doc_id", "prov_id", "confidence"), ["doc_id", "prov_id"], "left")
        part = conf.select("doc_id", "major", "type", "subtype", "label", "value_str", "unit", "content_hash", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.struct(F.lit(n).alias("program"), F.col("node_seq")).alias("at"), F.concat("prov_id", F.lit(f"_p{n}")).alias("prov_id"))
        all_ = part if all_ is None else all_.unionByName(part)
    row = F.struct("major", "type", "subtype", "label", "value_str", "unit", "prov_id", "confidence")
    # A later equal node replaces an earlier one only if it is more confident: the maximum, the earliest on ties.
    order = F.struct("confidence", (-F.col("at.program")).alias("p"), (-F.col("at.node_seq")).alias("s")) if priority == "adapter" else F.col("at")
    won = all_.groupBy("doc_id", "content_hash").agg(F.max_by(row, order).alias("w"), F.min("at").alias("first")).select("doc_id", "content_hash", "first", "w.*")
    numbered = won.withColumn("instance", F.row_number().over(Window.partitionBy("doc_id", "major", "type", "subtype").orderBy("first")))
    return numbered.select("doc_id", coord_id(F.col("major"), F.col("type"), F.col("subtype"), F.col("instance")).alias("node_id"), "label", "value_str", "unit", "prov_id", "confidence", "content_hash")
