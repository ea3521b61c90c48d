"""Connected components, inside one task and over the cluster."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, stored


def local_components(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the least position that the pairs connect it with."""
    least = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(least[a], least[b])
            before = least.copy()
            np.minimum.at(least, before[a], low)
            np.minimum.at(least, before[b], low)
            while True:  # every position points at the least one of its tree
                jumped = least[least]
                if np.array_equal(jumped, least):
                    break
                least = jumped
            open_ = least[a] != least[b]
            a, b = a[open_], b[open_]
    return least


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``); a component is
    named by its least node. Nodes without links do not occur.

    Alternating large-star and small-star steps: each step takes a minimum for each node
    (added up before the shuffle) and joins it back to the links, which stay as many or
    fewer; the links of a hub are not one task's work (``joined``). The number of steps grows
    with the logarithm of a component's size; a graph that does not settle in ``most_rounds``
    of them is an error, never a cut result. Each step is stored, so a lost executor costs
    one step. Nothing is collected but counts and sums.
    """
    edges = stored(_ordered(links.select("a", "b")), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.count("*").alias("links"))
        large = joined(both.where("b > a"), least, ["a"], "large-star", "links")
        large = stored(_ordered(large.select(F.col("b").alias("a"), F.col("least").alias("b"))), "large")
        # a > b in each: every node points to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("links"))
        small = joined(large, low, ["a"], "small-star", "links")
        to_least = small.select(F.col("b").alias("a"), F.col("least").alias("b"))
        made = to_least.unionByName(small.select("a", F.col("least").alias("b")))
        after = stored(_ordered(made), "edges")
        if _sums(after) == _sums(edges):
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        edges = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _ordered(links: DataFrame) -> DataFrame:
    """The distinct links with the larger node first."""
    return (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _sums(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
