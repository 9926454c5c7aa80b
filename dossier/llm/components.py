"""Connected components of a graph of any size, by contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import drop, materialize

#: Edges that one task takes.
IN_ONE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect just what the given edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _ends(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *(f[0] for f in found)]), np.concatenate([empty, *(f[1] for f in found)])


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges as many as connect the same: a batch at a time, fewer than nodes."""
    for batch in batches:
        a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of all edges with the smallest node of its component."""
    a, b = _ends(batches)
    nodes, roots = forest(a, b)
    tops = np.unique(roots)
    yield pa.record_batch([pa.array(np.concatenate([nodes, tops])), pa.array(np.concatenate([roots, tops]))], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is one node of the component, the same for all.

    Edges that a task's own others make needless go first.  Up to IN_ONE edges one task labels them all (16 MB); beyond,
    each round joins every node to its smallest neighbour and contracts; the nodes that still have an edge at
    least halve, so rounds grow with the logarithm of the graph.  Edges are at most those given, minima are summed
    up before the shuffle, and each round is written to the shared folder.
    """
    once = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_spanning, "a long, b long"))
    if once.count() <= IN_ONE:
        labels = materialize(once.coalesce(1).mapInArrow(_labelled, "node long, root long"))
        drop(once)
        return labels
    both = materialize(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    drop(once)
    labels = None
    while not both.isEmpty():
        parent = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        if labels is None:
            new = materialize(parent.select(F.col("a").alias("node"), F.col("to").alias("root")))
        else:
            step = parent.withColumnRenamed("a", "root")
            new = materialize(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            drop(labels)
        left = both.join(parent, "a").select(F.col("to").alias("a"), "b")
        moved = left.join(parent.withColumnRenamed("a", "b"), "b").select("a", F.col("to").alias("b"))
        rest = materialize(moved.where("a <> b").distinct())
        drop(both, parent)
        both, labels = rest, new
    drop(both)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, root long")
