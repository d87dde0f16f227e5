"""Connected components: locally by label hooking, over the cluster by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in place; label[i] <= i leads to the least member, in one step afterwards."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


#: Up to so many edges, 16 MB of them, one task finds the components; beyond that all tasks do, with the same result.
ONE_TASK = 1 << 20


def _alone(it):
    tables = [pa.Table.from_batches([b]) for b in it]
    if tables:
        table = pa.concat_tables(tables)
        u, v = (table.column(c).to_numpy() for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        union(label, at[: len(u)], at[len(u) :])
        some = np.flatnonzero(label != np.arange(len(nodes)))
        yield from pa.table({"u": nodes[some], "v": nodes[label[some]]}).to_batches()


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): root is the least node that can be reached.

    Each round puts every node's larger neighbours under its least one, then every node under its least smaller one.
    Edges never grow in number, rounds are few (their number grows as the logarithm of the longest path at worst
    squared; they go on until nothing changes), and no task gets a whole component: stars are made by a partial minimum and a join that AQE can split.
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    if e.count() <= one_task:
        out = stage(e.repartition(1).mapInArrow(_alone, "u long, v long"), "small")
        release(e)
        return out.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        following = stage(small.distinct(), "small")
        release(large)
        release(e)
        e = following
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
