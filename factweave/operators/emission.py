"""Extractions to a program: provenance, coordinates, nodes, indexes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.columns import coord_id, dedup_key, short_hash
from factweave.functions.patterns import ENTITY_COORDS

from .scans import scan


def provenance(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", F.concat(F.lit("prov_"), "chunk_id").alias("prov_id"), "chunk_id", F.concat(F.lit("tier"), F.col("tier").cast("string"), F.lit(":"), "chunk_type").alias("extractor"),
        "tier", "confidence", F.col("start").alias("source_start"), F.col("end").alias("source_end"),
    )


def assign_coords(ext: DataFrame, segment: int | None = None, n: int | None = None) -> DataFrame:
    """Coordinates by entity type where the table has it, and the instance's number, before any deduplication.

    With `segment` instances are counted in segments of so many extractions, so that one coordinate of one document
    may fill many tasks, `n` of them."""
    own = F.struct("major", "type", "subtype")
    table = F.create_map(*(x for k, v in ENTITY_COORDS.items() for x in (F.lit(k), F.struct(*(F.lit(c).alias(n) for c, n in zip(v, ("major", "type", "subtype"), strict=True))))))
    mapped = ext.withColumn("coord", F.coalesce(F.try_element_at(table, F.col("entity_type")), own)).drop("major", "type", "subtype").select("*", "coord.*").drop("coord")
    key = ["doc_id", "major", "type", "subtype"]
    if segment:
        counted = scan(mapped, key, "ext_seq", segment, sums={"earlier": F.lit(1)}, n=n)
        numbered = counted.withColumn("instance", (F.col("earlier") + 1).cast("int")).drop("earlier")
    else:
        numbered = mapped.withColumn("instance", F.row_number().over(Window.partitionBy(*key).orderBy("ext_seq")))
    checked = F.when(F.col("instance") > 9999, F.raise_error(F.lit("more than 9999 instances of one coordinate")).cast("int")).otherwise(F.col("instance"))
    return numbered.withColumn("instance", checked)


def nodes(ext: DataFrame) -> DataFrame:
    """Nodes after first-wins deduplication by label, value and unit; numbers have gaps where duplicates stood."""
    return distinct_nodes(assign_coords(ext))


def distinct_nodes(numbered: DataFrame) -> DataFrame:
    """The same of extractions that have their coordinates."""
    e = numbered.withColumn("key", dedup_key(F.col("label"), F.col("value_str"), F.col("unit")))
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("ext_seq"))
    kept = e.withColumn("rank", first).where("rank = 1")
    return kept.select(
        "doc_id", coord_id(F.col("major"), F.col("type"), F.col("subtype"), F.col("instance")).alias("node_id"), "major", "type", "subtype", "instance", "label",
        F.concat(F.lit("prov_"), "chunk_id").alias("prov_id"), "value_kind", "value_str", "value_num", "unit", short_hash(F.col("key")).alias("content_hash"), "chunk_id", F.col("ext_seq").alias("node_seq"),
    )


def chunk_index(nodes_: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "node_id"))), lambda x: x["node_id"])
    return nodes_.groupBy("doc_id", "chunk_id").agg(F.array_join(ids, ",").alias("node_ids"), F.count(F.lit(1)).alias("n_nodes"))


def find_by_label(nodes_: DataFrame) -> DataFrame:
    return nodes_.groupBy("doc_id", "label").agg(F.min_by("node_id", "node_seq").alias("node_id"))


def tier_stats(prov: DataFrame) -> DataFrame:
    return prov.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def integrity_violations(nodes_: DataFrame, prov: DataFrame, edges: DataFrame, derivations: DataFrame | None = None, alignments: DataFrame | None = None, forks: DataFrame | None = None) -> DataFrame:
    """(doc_id, what, id): nodes without provenance, and edges, derivations, alignments and forks that name a node or a
    provenance that isn't there."""
    key = ["doc_id", "prov_id"]
    bad_nodes = nodes_.join(prov.select(*key), key, "left_anti").select("doc_id", F.lit("node provenance").alias("what"), F.col("node_id").alias("id"))
    ids = nodes_.select("doc_id", "node_id")
    out = bad_nodes
    for end in ("subject_id", "object_id"):
        gone = edges.join(ids.withColumnRenamed("node_id", end), ["doc_id", end], "left_anti")
        out = out.unionByName(gone.select("doc_id", F.lit(f"relation {end}").alias("what"), F.col(end).alias("id")))
    gone = edges.join(prov.select(*key), key, "left_anti").select("doc_id", F.lit("relation provenance").alias("what"), F.col("prov_id").alias("id"))
    out = out.unionByName(gone)
    named = []
    if derivations is not None:
        named += [("derivation result", derivations.select("doc_id", F.col("result_id").alias("node_id"))), ("derivation operand", derivations.select("doc_id", F.explode("operands").alias("node_id")))]
    if alignments is not None:
        named += [(f"alignment {c}", alignments.select("doc_id", F.col(c).alias("node_id"))) for c in ("subject_id", "reference_id")]
    if forks is not None:
        named.append(("fork option", forks.select("doc_id", F.explode("options.node_id").alias("node_id"))))
    for what, rows in named:
        out = out.unionByName(rows.join(ids, ["doc_id", "node_id"], "left_anti").select("doc_id", F.lit(what).alias("what"), F.col("node_id").alias("id")))
    for what, rows in (("derivation provenance", derivations), ("alignment provenance", alignments)):
        if rows is not None and "prov_id" in rows.columns:
            out = out.unionByName(rows.join(prov.select(*key), key, "left_anti").select("doc_id", F.lit(what).alias("what"), F.col("prov_id").alias("id")))
    return out
