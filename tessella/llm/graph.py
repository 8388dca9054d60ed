"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, lean, ship


#: So many edges, contracted within partitions, meet in one task; more go through rounds of joins, to the same result.
ONE_TASK = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars; what connects stays connected."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        a, b = roots(a, b)
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b), BIGINT; the root is the component's least node.

    Large-star and small-star steps in turn until nothing changes; their number grows with the logarithm of the
    nodes. Each step is written to a checkpoint. Without edges the result is empty; loops and repeats are harmless, but a
    node that has loops only isn't in it.
    """
    ship(edges.sparkSession)
    edges = cut(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a is not null and b is not null and a != b"))
    # Contracted in a stage of its own: edges that come from Python would hold two workers a core at once.
    edges = cut(edges.mapInArrow(lean(_contract), "a bigint, b bigint"))
    if edges.count() <= ONE_TASK:
        edges = cut(edges.coalesce(1).mapInArrow(lean(_contract), "a bigint, b bigint"))
    else:
        edges = _rounds(edges)
    found = edges.selectExpr("a as node", "b as root")
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def _rounds(edges: DataFrame) -> DataFrame:
    """Edges as stars around the least nodes. A node of many edges is joined with its least neighbour, never gathered."""
    before = None
    while True:
        both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, "u").selectExpr("v as u", "least(u, m) as v").filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").selectExpr("v as a", "m as b").union(low.selectExpr("u as a", "m as b")).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def rows_of(of: DataFrame, found: DataFrame) -> DataFrame:
    """(id, class_id, n_links), a row for each of (id, class), which are distinct; class may be null.

    found: (class, root, links) of classes that are linked with others: the least class that these connect it with, and
    how many ids they lead to. Ids of one class are linked among themselves. class_id is the least id of all that is connected.
    """
    classes = of.filter("class is not null").groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    joined = classes.join(found, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    groups = joined.groupBy("root").agg(F.min("first").alias("class_id"))
    named = joined.join(groups, "root").select("class", "class_id", "n_links")
    return of.join(named, "class", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
