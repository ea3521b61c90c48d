"""Near-duplicate vectors by a forest of random-projection trees.

1. Equal vectors (by two 64-bit hashes) are one class; everything below works on classes.
2. Trees are fitted on a bounded sample (``SAMPLE``): a node projects on a random direction
   (of ``DIRECTIONS`` the one of the fewest copies) and splits at the median. Every vector is
   indexed, and one that lies within ``SPILL`` of a split goes to both sides. Where nearly all
   would (dense groups), the node stays a leaf. A leaf that got more than twice ``LEAF`` vectors gets a
   tree of its own, fitted on a sample of the leaf in an executor, level by level; so leaves
   do not grow with the number of vectors.
3. Each vector carries the names of all its leaves. In each leaf all vectors are compared:
   single precision decides what is clear, double precision what lies near the limit. A leaf
   beyond ``CHUNK`` vectors is cut into chunks; each chunk is compared inside itself in one
   task, and each two chunks against each other in another.
4. A pair that meets in several leaves counts in the one of least name. So a task gives each
   vector a number of links and one link to the least vector it is connected with there:
   numbers of rows, not of pairs, however dense a group is.
5. A vector's links are those of its class, weighted with class sizes, and its copies.
   Classes are joined to components by the links.

Recall is measured against brute force in the tests (at least 0.99). Vectors that are
null, zero, or hold null or non-finite values link with nothing, and so do vectors of
unlike length and rows without vec_id. Vectors of doubles are taken as doubles. Repeated
rows are further copies; rows that share a vec_id are rows of their own. Further columns
are ignored, whatever their names; there are no texts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, sized, stored
from .forest import parted
from .graph import components, local_components
from .simhash import in_chunks

SIMILARITY = 0.95
TREES = 5
#: Vectors on which trees are fitted, and vectors that a leaf should get.
SAMPLE = 20_000
LEAF = 1_400
DIRECTIONS = 4
#: Of a projection of unit vectors; linked ones differ by 0.04 in the usual case.
SPILL = 0.01
#: Vectors of a leaf above which it is cut into chunks that meet two by two.
CHUNK = 4_096
BLOCK = 1_024
#: Single precision is this near to double precision, with a wide margin.
MARGIN = 1e-4


def exact(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the scale of the values is taken out first."""
    vectors = vectors.astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def unit(vectors: np.ndarray) -> np.ndarray:
    return exact(vectors).astype(np.float32)


class Tree:
    """Nodes in arrays: direction, split, and the children (a leaf is ``~number``)."""

    def __init__(self, sample: np.ndarray, leaf: float, spill: float, rng: np.random.Generator):
        self.directions: list[np.ndarray] = []
        self.splits: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, spill, rng)

    def _grow(self, sample: np.ndarray, leaf: float, spill: float, rng: np.random.Generator) -> int:
        if len(sample) > leaf:
            most, chosen = 0.9 * len(sample), None
            for direction in rng.standard_normal((DIRECTIONS, sample.shape[1])).astype(np.float32):
                direction /= np.linalg.norm(direction)
                seen = sample @ direction
                split = float(np.median(seen))
                sides = seen - split <= spill, seen - split > -spill
                larger = max(side.sum() for side in sides)
                if larger < most:
                    most, chosen = larger, (direction, split, sides)
            if chosen is not None:
                at = len(self.splits)
                self.directions.append(chosen[0])
                self.splits.append(chosen[1])
                self.children.append((0, 0))
                low, high = (self._grow(sample[side], leaf, spill, rng) for side in chosen[2])
                self.children[at] = (low, high)
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, vectors: np.ndarray, spill: float) -> Iterator[tuple[int, np.ndarray]]:
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, at = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            away = vectors[at] @ self.directions[node] - self.splits[node]
            low, high = self.children[node]
            waiting += [(low, at[away <= spill]), (high, at[away > -spill])]


def forest(sample: np.ndarray, leaf: float, trees: int, spill: float = SPILL, seed: int = 5) -> list[Tree]:
    return [Tree(sample, leaf, spill, np.random.default_rng(seed + k)) for k in range(trees)]


def _indexed(trees, spill: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                vectors = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)
                vectors = unit(vectors)
                for k, tree in enumerate(trees.value[int(size)]):
                    for leaf, at in tree.route(vectors, spill):
                        rows.append(own[at])
                        leaves.append(np.full(len(at), (int(size) << 36) + (k << 28) + leaf))
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            order = np.argsort(row, kind="stable")
            offsets = np.concatenate([[0], np.bincount(row, minlength=batch.num_rows).cumsum()])
            named = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(leaf[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, named], [*batch.schema.names, "leaves"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of ``a`` have a cosine of ``similarity`` or more with which of ``b``; both
    hold unit vectors in double precision."""
    cosine = a.astype(np.float32) @ b.astype(np.float32).T
    found = cosine >= similarity
    at, other = np.nonzero(np.abs(cosine - np.float32(similarity)) <= MARGIN)
    for begin in range(0, len(at), 65_536):
        x, y = at[begin : begin + 65_536], other[begin : begin + 65_536]
        found[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= similarity
    return found


def met_before(leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """For each vector a row of marks, one for each leaf of a lesser name than ``leaf`` that
    it shares with another of these vectors."""
    row = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    name = np.concatenate(leaves)
    row, name = row[name < leaf], name[name < leaf]
    _, column, seen = np.unique(name, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    marks = np.zeros((len(leaves), int(column.max()) + 1 if len(column) else 0), np.float32)
    marks[row[shared], column] = 1
    return marks


def _leaf_links(similarity: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        vectors = exact(np.stack(rows["embedding"].to_numpy()))
        copies, n = rows["copies"].to_numpy(), len(rows)
        marks = met_before(int(rows["leaf"].iloc[0]), list(rows["leaves"].to_numpy()))
        first, own = rows["first"].iloc[0], rows["own"].to_numpy()
        # Chunks that meet: only vectors of unlike chunks are compared.
        sides = [(own == first, own != first)] if first != rows["second"].iloc[0] else [(own == first, own == first)]
        others, links = np.zeros(n, np.int64), []
        for left, right in sides:
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            mixed = len(left) and len(right) and left[0] != right[0]
            for begin in range(0, len(left), BLOCK):
                a = left[begin : begin + BLOCK]
                found = similar(vectors[a], vectors[right], similarity)
                if not mixed:
                    found[np.arange(len(a)), begin + np.arange(len(a))] = False  # a vector and itself
                links.append((a, right, found))
                counted = found & ~(marks[a] @ marks[right].T > 0)
                others[a] += counted @ copies[right]
                if mixed:
                    others[right] += copies[a] @ counted
        pairs = ((a[x], right[y]) for a, right, found in links for x, y in [np.nonzero(found)])
        least = local_components(n, pairs)
        told = (others > 0) | (least != np.arange(n))
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"a": ids[told], "b": ids[least[told]], "others": others[told]})

    return run


def _grown() -> Callable[[pd.Series, int], tuple[Tree, int]]:
    most = LEAF

    def run(points: pd.Series, n: int) -> tuple[Tree, int]:
        sample = unit(np.stack(points.to_numpy()))
        tree = Tree(sample, max(8.0, most * len(sample) / n), SPILL, np.random.default_rng(n))
        return tree, tree.leaves

    return run


def _sent_down(spill: float) -> Callable[[Tree, pd.Series], list[tuple[int, np.ndarray]]]:
    def run(tree: Tree, points: pd.Series) -> list[tuple[int, np.ndarray]]:
        return list(tree.route(unit(np.stack(points.to_numpy())), spill))

    return run


def indexed(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """``classes`` (id, copies, embedding) with ``leaves``, the names of all leaves of each."""
    spark = classes.sparkSession
    counts = classes.groupBy(F.size("embedding").alias("size")).count().collect()  # lengths of vectors: few
    total = sum(row["count"] for row in counts)
    share = F.lit(int(2**63 * min(1.0, SAMPLE / max(total, 1))) - 1)
    of_hash = F.xxhash64(F.lit(13), "embedding").bitwiseAND(F.lit(2**63 - 1))
    sample = classes.where(of_hash <= share).select("embedding").limit(2 * SAMPLE).toArrow()
    by_size: dict[int, list[np.ndarray]] = {}
    for vector in sample.column("embedding").to_pylist():
        by_size.setdefault(len(vector), []).append(np.array(vector))
    fitted = {}
    for size, n in counts:
        own = unit(np.stack(by_size[size])) if size in by_size else np.zeros((0, size), np.float32)
        fitted[size] = forest(own, max(8.0, LEAF * len(own) / n), trees)
    kind = classes.schema["embedding"].dataType.simpleString()
    rows = classes.select("id", "copies", "embedding").mapInArrow(
        _indexed(spark.sparkContext.broadcast(fitted), SPILL), f"id long, copies long, embedding {kind}, leaves array<long>"
    )
    rows = stored(rows, "indexed")
    dense = None
    for level in count(1):
        sizes = rows.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
        sizes = sizes.where(F.col("n") > 2 * LEAF)
        large = stored(sizes if dense is None else sizes.join(dense, "leaf", "left_anti"), "large-leaves")
        n_large = large.count()
        if not n_large:
            return rows
        there = rows.select("id", "embedding", F.explode("leaves").alias("leaf")).join(
            sized(large.select("leaf"), n_large), "leaf", "left_semi"
        )
        parts = parted(there, large, "embedding", SAMPLE, LEAF, _grown(), _sent_down(SPILL), "vectors", level)
        stuck = stored(parts.where("leaves < 2").select("leaf").distinct(), "dense-leaves")  # no projection parts these
        dense = stuck if dense is None else dense.unionByName(stuck)
        moves = parts.where("leaves > 1").groupBy("id").agg(
            F.collect_set("leaf").alias("left"), F.collect_set("into").alias("into"), F.lit(1).alias("_one")
        )
        after = joined(rows, moves, ["id"], "moves", "_one", "left")
        empty = F.array().cast("array<long>")
        named = F.concat(F.array_except("leaves", F.coalesce("left", empty)), F.coalesce("into", empty))
        rows = stored(after.select("id", "copies", "embedding", F.array_distinct(named).alias("leaves")), "indexed")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", embedding.alias("embedding"))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(finite & some & F.col("vec_id").isNotNull(), F.lit(False)))
    key = ["_key_1", "_key_2"]
    sound = rows.where("sound").select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("_key_1"), F.xxhash64(F.lit(1), "embedding").alias("_key_2")
    )
    classes = sound.groupBy(*key).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    dealt = in_chunks(
        indexed(classes, trees).withColumn("leaf", F.explode("leaves")).withColumn("size", F.size("embedding")), "leaf", "id", CHUNK
    )
    found = stored(
        dealt.groupBy("leaf", "size", "first", "second").applyInPandas(
            _leaf_links(similarity), "a long, b long, others long"
        ),
        "vector-links",
    )
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("others").alias("others"), F.lit(1).alias("_one"))
    groups = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "id").withColumn("_one", F.lit(1))
    own = joined(classes.drop("embedding"), links, ["id"], "link-counts", "_one", "left")
    own = joined(own, groups, ["id"], "vector-groups", "_one", "left")
    own = stored(own.withColumn("component", F.coalesce("component", "id")), "grouped-vectors")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = joined(own, least, ["component"], "vector-group-names", "members").select(
        *key, "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = joined(sound.drop("embedding"), named, key, "named-vectors", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
