"""Connected components by contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.columns import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is one node of the component, the same for all of it.

    Each round hangs every node under its smallest neighbour if that is smaller, follows one more step, and
    contracts the edges. Chains halve at least, stars vanish at once; every round is written to the shared folder.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "graph-edges")
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "graph-nodes")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        above = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        up = stored(up.join(above, "up").select("a", F.col("top").alias("up")), "graph-up")
        nodes = stored(nodes.join(up.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "graph-nodes")
        ends = edges.join(up.withColumnRenamed("up", "x"), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "graph-edges")
    return nodes


def forest(linked) -> list[tuple[int, int]]:
    """A spanning set of edges (i, smallest reachable) of a symmetric Boolean matrix."""
    import numpy as np

    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == label).all():
            return [(i, int(r)) for i, r in enumerate(label) if i != r]
        label = low


def spanning(n: int, a, b):
    """Positions of the edges (a, b) between nodes 0 to n - 1 that make a spanning forest of them, and a number for each node that tells its tree."""
    import numpy as np

    label, left, kept = np.arange(n), np.arange(len(a)), []
    while True:
        one, two = label[a[left]], label[b[left]]
        joins = one != two
        left, low, high = left[joins], np.minimum(one, two)[joins], np.maximum(one, two)[joins]
        if not len(left):
            return np.concatenate([left, *kept]), label
        least = np.full(n, n)
        np.minimum.at(least, high, low)
        to_least = np.flatnonzero(low == least[high])
        edge = np.full(n, -1)
        edge[high[to_least]] = to_least  # one for each label that hangs itself under a smaller one
        edge = edge[edge >= 0]
        up = np.arange(n)
        up[high[edge]] = low[edge]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        kept.append(left[edge])
