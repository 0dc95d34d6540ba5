"""Queries over nodes, provenance and edges: filters, lookups and aggregates. Each takes and gives DataFrames, so that
one plan serves one space (doc_id) or all of them, and filters reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.patterns import MAJORS

NODE_KEY = ("doc_id", "node_id")


def where(nodes: DataFrame, major: int | None = None, type_: int | None = None, subtype: int | None = None, label_contains: str | None = None, value_gt: float | None = None, value_lt: float | None = None) -> DataFrame:
    """All conditions at once; bounds are exclusive and leave out values that aren't numbers, while NaN passes them."""
    tests: list[Column] = []
    for name, value in (("major", major), ("type", type_), ("subtype", subtype)):
        if value is not None:
            tests.append(F.col(name) == value)
    if label_contains is not None:
        tests.append(F.lower("label").contains(label_contains.lower()))
    v = F.col("value_num")
    for bound, test in ((value_gt, lambda b: v > b), (value_lt, lambda b: v < b)):
        if bound is not None:
            tests.append(v.isNotNull() & (F.isnan(v) | test(bound)))
    return nodes.where(reduce(lambda a, b: a & b, tests)) if tests else nodes


def get(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.col("node_id").startswith(prefix))


def first(nodes: DataFrame) -> DataFrame:
    """The first node of each space by insertion order: one row a space, so a partial aggregate rather than a sort."""
    return nodes.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "label"), "seq").alias("n")).select("doc_id", "n.*")


def limit(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The first n nodes; each partition keeps n at most before they meet."""
    return nodes.orderBy("doc_id", "seq").limit(n)


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("subject_id") == node_id)


def incoming(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("object_id") == node_id)


def alignments(found: DataFrame, subject_id: str) -> DataFrame:
    """The temporal alignments of one subject."""
    return found.where(F.col("subject_id") == subject_id)


def fork_best(forks: DataFrame) -> DataFrame:
    """(doc_id, fork_id, node_id, confidence) of the most confident option, the first on ties; options is an array."""
    best = F.reduce(F.slice("options", 2, F.greatest(F.size("options") - 1, F.lit(0))), F.get("options", F.lit(0)), lambda a, b: F.when(b["confidence"] > a["confidence"], b).otherwise(a))
    return forks.select("doc_id", "fork_id", best.alias("best")).select("doc_id", "fork_id", "best.node_id", "best.confidence")


def base_confidence(nodes: DataFrame, prov: DataFrame, missing: float | None = 1.0) -> DataFrame:
    """Each node with its provenance's confidence; `missing` stands where there is none, None leaves such nodes null."""
    joined = nodes.join(prov.select("doc_id", "prov_id", "confidence"), ["doc_id", "prov_id"], "left")
    return joined.withColumn("confidence", F.coalesce("confidence", F.lit(missing))) if missing is not None else joined


def count_by_major(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "major").agg(F.count(F.lit(1)).alias("n"))


def sum_values(nodes: DataFrame, **conditions) -> DataFrame:
    """Sum of numeric values of each space; 0.0 where there is none. Cents are summed as integers, exactly."""
    cents = F.round(F.col("value_num") * 100).cast("decimal(20,0)")
    hit = where(nodes, **conditions).groupBy("doc_id").agg(F.sum(cents).alias("cents"))
    spaces = nodes.select("doc_id").distinct()
    return spaces.join(hit, "doc_id", "left").select("doc_id", (F.coalesce("cents", F.lit(0)).cast("double") / 100).alias("total"))


def distinct_labels(nodes: DataFrame, major: int) -> DataFrame:
    return nodes.where(F.col("major") == major).select("doc_id", "label").distinct()


def avg_confidence(nodes: DataFrame, prov: DataFrame) -> DataFrame:
    """Mean over the nodes with provenance, 0.0 without any."""
    mean = base_confidence(nodes, prov, None).groupBy("doc_id").agg(F.avg("confidence").alias("mean"))
    return mean.select("doc_id", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("avg_confidence"))


def majors(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.createDataFrame(list(MAJORS.items()), "major int, name string")


def stats_major(nodes: DataFrame) -> DataFrame:
    """Count and share of all eight categories."""
    counted = majors(nodes).join(nodes.groupBy("major").agg(F.count(F.lit(1)).alias("c")), "major", "left").withColumn("n", F.coalesce("c", F.lit(0)))
    total = nodes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return counted.join(F.broadcast(total)).select("major", "name", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))


def samples(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(major, name, rank, doc_id, node_id, label, value_str): the first nodes of each of the eight categories."""
    out = None
    for number, name in MAJORS.items():
        first = nodes.where(F.col("major") == number).orderBy("doc_id", "node_seq").limit(most).select("doc_id", "node_id", "node_seq", "label", "value_str")
        rank = F.row_number().over(Window.orderBy("doc_id", "node_seq"))  # over at most `most` rows
        part = first.select(F.lit(number).alias("major"), F.lit(name).alias("name"), rank.alias("rank"), "doc_id", "node_id", "label", "value_str")
        out = part if out is None else out.unionByName(part)
    return out


def stats_quantity(nodes: DataFrame) -> DataFrame:
    v = F.col("value_num")
    return nodes.where((F.col("major") == 7) & v.isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v.cast("decimal(20,2)")).cast("double").alias("total"))


def kb_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("value_num").alias("valued"), F.count_distinct("major").alias("categories"))
    e = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations"))
    return n.join(e, "doc_id", "left").select("doc_id", "nodes", "valued", "categories", F.coalesce("relations", F.lit(0)).alias("relations"))
