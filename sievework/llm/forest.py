"""Leaves of search trees that are still too large get trees of their own, in executors.

A tree grown on a bounded sample of a corpus has a bounded number of leaves, so that leaves
grow with the corpus. ``parted`` draws a sample of each large leaf, grows a tree on it and
sends the leaf's rows down that tree; the callers repeat this until no leaf is too large or
no tree parts it. The number of levels grows with the logarithm of the number of rows
(thousands of leaves for each), and no table of trees goes to the driver or to all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

_MIX = np.uint64(0x9E3779B97F4A7C15)


def named_leaves(leaf: int, numbers: np.ndarray) -> np.ndarray:
    """Names of a leaf's own leaves. Two that fell together by chance would be one leaf,
    which costs comparisons and loses nothing."""
    with np.errstate(over="ignore"):
        mixed = np.uint64(leaf & 2**64 - 1) * _MIX + numbers.astype(np.uint64) + np.uint64(1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def parted(
    rows: DataFrame,
    large: DataFrame,
    point: str,
    sample: int,
    slice_rows: int,
    grow: Callable[[pd.Series, int], tuple[object, int]],
    route: Callable[[object, pd.Series], list[tuple[int, np.ndarray]]],
    name: str,
    level: int,
) -> DataFrame:
    """``rows`` (leaf and other columns) of the ``large`` leaves (leaf, n) with ``into``, a
    leaf of the leaf's own tree (some rows go into several), and ``leaves``, their number.

    ``grow`` gets a sample of a leaf's points and n and gives a tree and its number of
    leaves; ``route`` gives the positions that each leaf of a tree gets."""
    n_large = large.count()
    many = rows.join(sized(large, n_large), "leaf")
    # A fixed share of the hash range: a sample that no order of rows decides. It is another
    # one at each level, as the leaves were made to hold few points of the earlier samples.
    share = (F.lit(2.0**62) * F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))).cast("long")
    drawn = many.where(F.xxhash64(F.lit(100 + level), point).bitwiseAND(F.lit(2**62 - 1)) <= share).select("leaf", "n", point)

    def grown(own: pd.DataFrame) -> pd.DataFrame:
        tree, leaves = grow(own[point], int(own["n"].iloc[0]))
        return pd.DataFrame({"leaf": own["leaf"].iloc[:1], "tree": [pickle.dumps(tree)], "leaves": [leaves]})

    trees = stored(drawn.groupBy("leaf").applyInPandas(grown, "leaf long, tree binary, leaves int"), f"{name}-trees")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    cut = many.withColumn("slice", F.pmod(F.xxhash64(F.lit(12), point), slices).cast("int")).drop("n")
    sent = trees.join(sized(large, n_large), "leaf").select(
        "leaf", "tree", "leaves", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    )

    def routed(own: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(tree):  # a leaf without a tree would be lost: never, as n > sample share
            return own.assign(into=own["leaf"], leaves=1).drop(columns="slice")
        made = []
        for number, at in route(pickle.loads(tree["tree"].iloc[0]), own[point]):
            part = own.iloc[at].drop(columns="slice")
            part["into"] = named_leaves(int(own["leaf"].iloc[0]), np.array([number]))[0]
            part["leaves"] = int(tree["leaves"].iloc[0])
            made.append(part)
        return pd.concat(made)

    fields = [f"{field.name} {field.dataType.simpleString()}" for field in rows.schema]
    return stored(
        cut.groupBy("leaf", "slice")
        .cogroup(sent.groupBy("leaf", "slice"))
        .applyInPandas(routed, ", ".join([*fields, "into long", "leaves int"])),
        f"{name}-parted",
    )
