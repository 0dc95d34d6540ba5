"""Connected components of a distributed edge table: the least node reachable from each node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node of each one's component."""
    nodes, spot = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = spot[: len(a)], spot[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around the least node: as many as nodes, whatever the paths were."""
    for b in batches:
        nodes, least = least_labels(b.column(0).to_numpy(), b.column(1).to_numpy())
        far = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), two long columns without nulls.

    Rounds of: the least label among the neighbours, then the label of one's label. Labels and edges are Parquet tables
    in the shared folder, so that each join shuffles both sides and a hub's rows can be split over tasks; what meets
    under one key was reduced to its minimum before the shuffle. The driver sees one count a round."""
    stars = edges.where(F.col("a") != F.col("b")).mapInArrow(_contract, "a long, b long")
    both = materialize(stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        jump = told.join(labels.select(F.col("node").alias("near"), F.col("label").alias("far")), "near")
        new = materialize(jump.select("node", "was", F.least("near", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where(F.col("was") != F.col("label")).limit(1).count():
            return labels.withColumnRenamed("label", "component")
