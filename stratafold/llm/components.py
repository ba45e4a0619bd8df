"""Connected components of an edge table, by alternating large-star and small-star steps.

(Kiveris et al., "Connected components in MapReduce and beyond".) Each step is a
grouped minimum, which combines before it shuffles, and an equi-join, which AQE
can split at a hot node. Nothing is collected but a number of changed links a
round. `Forest` and `spanning_forest` do the same for links that one task holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.shared import dropped, saved


class Forest:
    """Labels of nodes 0..n-1 under added links; the label is the least node of its class."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, high[apart], low[apart])
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b make a spanning forest."""
    label, kept, some = np.arange(n), [], np.arange(len(a))
    while len(some):
        x, y = label[a[some]], label[b[some]]
        some, x, y = some[x != y], x[x != y], y[x != y]
        if not len(some):
            break
        high, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(some[first])
        label[high] = np.minimum(x, y)[first]
        while not np.array_equal(up := label[label], label):
            label = up
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _relabelled(near: DataFrame, self_too: bool) -> DataFrame:
    """Links (v, least of u and the v beside it) of links (u, v)."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if self_too:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) of longs; root is the least node of the component, and a root itself isn't listed."""
    now = saved(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u != v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        next_ = saved(_relabelled(large, self_too=True))
        changed = next_.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(next_, ["u", "v"], "left_anti").limit(1).count()
        dropped(now)
        now = next_
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
