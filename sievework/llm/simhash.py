"""SimHash near-duplicates by vantage-point trees over Hamming distances.

1. ``fingerprints``: 64 bits for each text from the XXH64 hashes of its word shingles.
2. Rows with one fingerprint are one point; everything below works on distinct points.
3. ``grow``: a vantage-point tree is grown on a bounded sample of the points. An inner
   node has a vantage point and a radius: points within the radius go to one side, the
   others to the other side. Radii are chosen where few points lie just inside.
4. ``routed``: every point goes down the tree. Two linked points (``radius`` bits apart or
   less) on different sides of a node lie within ``radius`` of its boundary, by the
   triangle inequality, and the inner one is sent to the outer side as well. So each
   linked pair meets in some leaf, exactly, and the leaves are the shards. A leaf that got
   more than twice ``LEAF`` points gets a tree of its own, grown on a sample of the leaf in
   an executor, level by level; so leaves do not grow with the corpus.
5. In a leaf a vantage-point tree of the leaf's own points leaves blocks small enough to
   compare. A leaf beyond ``CHUNK`` points (also one of near copies that no vantage point
   parts) is cut into chunks; each chunk is compared inside itself in one task, and each two
   chunks against each other in another. A leaf gives each point the least point it is
   connected to there, not pairs.
6. ``components``: these links are joined over the leaves by alternating star steps.

Null and empty texts have fingerprint zero and are linked like any other. Texts are taken
whole, however long. Repeated rows are returned row by row; further columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, joined, sized, stored, texts
from .forest import parted
from .graph import components, local_components

WORDS = 3
RADIUS = 3
#: Points on which a tree is grown, and points that a leaf should get, copies included.
SAMPLE = 20_000
LEAF = 24_000
#: Points of a leaf above which it is cut into chunks that meet two by two.
CHUNK = 8_000
#: Size below which a block is compared point by point.
BLOCK = 512


def shingle_hashes(text: str, n_words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a text of fewer words is one shingle,
    a text without words none."""
    own = text.encode().lower().split()  # bytes: only A-Z is lower-cased
    if len(own) <= n_words:
        parts = [b" ".join(own)] if own else []
    else:
        parts = map(b" ".join, zip(*(own[k:] for k in range(n_words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(part, seed) for part in parts], np.uint64)


#: Odd multipliers that make further independent hashes out of one.
LANES = np.array([2 * xxhash.xxh64_intdigest(b"lane", k) + 1 & 2**64 - 1 for k in range(64)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            found = [fingerprint(shingle_hashes(text, n_words)) for text in texts(batch)]
            values = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "point"])

    return run


def fingerprints(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """``doc_id, point`` (the 64 bits as a signed long) of every row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(n_words), f"doc_id {doc_id}, point long")


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each point differs from ``one``; a point is a row of 64-bit lanes."""
    return np.bitwise_count(points ^ one).sum(axis=-1, dtype=np.int64)


class Node:
    """Inner: vantage point, radius, the two sides. Leaf: its number."""

    __slots__ = ("vantage", "radius", "inner", "outer", "leaf")

    def __init__(self, leaf: int = -1):
        self.leaf = leaf
        self.vantage, self.radius, self.inner, self.outer = None, -1, None, None


def split(
    points: np.ndarray, reach: int, rng: np.random.Generator, cost: Callable, most: float
) -> tuple[np.ndarray, int] | None:
    """The vantage point and radius of the least ``cost(inner, outer)``, given the shares
    of points that each side gets (the outer side with those ``reach`` inside the radius).
    None if no split costs less than ``most`` or makes both sides smaller."""
    best, bits = None, 64 * points.shape[1]
    for vantage in points[rng.integers(len(points), size=12)]:
        inner = np.bincount(distances(points, vantage), minlength=bits + 1).cumsum() / len(points)
        outer = 1 - np.concatenate([np.zeros(reach), inner[:-reach]])
        real = np.flatnonzero((inner >= 0.02) & (inner <= 0.98) & (outer <= 0.98))
        if len(real):
            costs = cost(inner[real], outer[real])
            at = int(costs.argmin())
            if costs[at] < most:
                best, most = (vantage, int(real[at])), costs[at]
    return best


def _copies_per_bit(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Points sent to both sides for the information that a shared split gains."""
    gain = -(inner * np.log2(inner) + (1 - inner) * np.log2(1 - inner))
    return (inner + outer - 1) / gain


def _comparisons(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Comparisons left by a split, as a share of those without it."""
    return inner**2 + outer**2


def grow(sample: np.ndarray, leaf: float, reach: int = RADIUS, seed: int = 1) -> tuple[Node, int]:
    """The tree whose leaves get up to about ``leaf`` of the sample, points that cross
    boundaries included, and the number of leaves."""
    rng, leaves = np.random.default_rng(seed), 0

    def below(points: np.ndarray) -> Node:
        nonlocal leaves
        found = split(points, reach, rng, _copies_per_bit, 0.9) if len(points) > leaf else None
        if found is None:
            leaves += 1
            return Node(leaves - 1)
        node = Node()
        node.vantage, node.radius = found
        away = distances(points, node.vantage)
        node.inner, node.outer = below(points[away <= node.radius]), below(points[away > node.radius - reach])
        return node

    return below(sample), leaves


def route(node: Node, points: np.ndarray, at: np.ndarray, reach: int, out: list[tuple[int, np.ndarray]]) -> None:
    """Collects (leaf, positions of the points that it gets)."""
    if not len(at):
        return
    if node.inner is None:
        out.append((node.leaf, at))
        return
    away = distances(points[at], node.vantage)
    route(node.inner, points, at[away <= node.radius], reach, out)
    route(node.outer, points, at[away > node.radius - reach], reach, out)


def _routed(tree, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("point").to_numpy().view(np.uint64)[:, None]
            out: list[tuple[int, np.ndarray]] = []
            route(tree.value, points, np.arange(len(points)), reach, out)
            for leaf, at in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf, np.int64)), pa.array(points[at, 0].view(np.int64))],
                    ["leaf", "point"],
                )

    return run


def close_pairs(
    points: np.ndarray, reach: int, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions (a, b) of points ``reach`` bits apart or less; together they
    connect what is connected. Blocks above ``BLOCK`` are split by vantage points. Where
    ``side`` is given, only points of unlike sides are compared."""
    rng = np.random.default_rng(len(points))
    waiting = [np.arange(len(points))]
    while waiting:
        at = waiting.pop()
        if side is not None and not 0 < side[at].sum() < len(at):
            continue
        found = split(points[at], reach, rng, _comparisons, 0.85) if len(at) > BLOCK else None
        if found is None:
            left, right = (at, at) if side is None else (at[~side[at]], at[side[at]])
            for begin in range(0, len(left), BLOCK):
                rows = left[begin : begin + BLOCK]
                rest = right[begin:] if side is None else right
                away = np.zeros((len(rows), len(rest)), np.uint16)
                for lane in range(points.shape[1]):
                    away += np.bitwise_count(points[rows, lane][:, None] ^ points[rest, lane][None, :])
                a, b = np.nonzero(away <= reach)
                if side is None:
                    later = b > a
                    a, b = a[later], b[later]
                yield rows[a], rest[b]
            continue
        vantage, radius = found
        away = distances(points[at], vantage)
        waiting += [at[away <= radius], at[away > radius - reach]]


def _leaf_links(reach: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points, first = np.unique(rows["point"].to_numpy(), return_index=True)
        mixed = rows["first"].iloc[0] != rows["second"].iloc[0]
        side = (rows["own"].to_numpy() != rows["first"].iloc[0])[first] if mixed else None
        least = local_components(len(points), close_pairs(points.view(np.uint64)[:, None], reach, side))
        other = least != np.arange(len(points))
        return pd.DataFrame({"a": points[other], "b": points[least[other]]})

    return run


def in_leaves(points: DataFrame, reach: int = RADIUS) -> DataFrame:
    """``leaf, point``: the distinct ``points``, each with every leaf that gets it."""
    spark = points.sparkSession
    n = points.count()
    # A fixed share of the hash range: a sample that no order of rows decides.
    share = F.lit(int(2**63 * min(1.0, SAMPLE / max(n, 1))) - 1)
    of_hash = F.xxhash64(F.lit(11), "point").bitwiseAND(F.lit(2**63 - 1))
    table = points.where(of_hash <= share).select("point").limit(2 * SAMPLE).toArrow()
    sample = np.sort(table.column("point").to_numpy()).view(np.uint64)[:, None]
    tree, _ = grow(sample, _leaf_of_sample(len(sample), n), reach)
    sent = spark.sparkContext.broadcast(tree)
    open_ = stored(points.select("point").mapInArrow(_routed(sent, reach), "leaf long, point long"), "routed")
    settled = []
    for level in count(1):
        sizes = open_.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF)
        large = stored(sizes, "large-leaves")
        n_large = large.count()
        if not n_large:
            break
        settled.append(open_.join(sized(large, n_large), "leaf", "left_anti"))
        parts = parted(open_, large, "point", SAMPLE, LEAF, _grown(reach), _sent_down(reach), "simhash", level)
        settled.append(parts.where("leaves < 2").select("leaf", "point"))  # no vantage point parts these
        open_ = parts.where("leaves > 1").select(F.col("into").alias("leaf"), "point")
    for more in settled:
        open_ = open_.unionByName(more)
    return open_


def _leaf_of_sample(drawn: int, n: int) -> float:
    """Points of a sample that stand for ``LEAF`` of all."""
    return max(16.0, LEAF * drawn / max(n, 1))


def _grown(reach: int) -> Callable[[pd.Series, int], tuple[Node, int]]:
    most = LEAF

    def run(points: pd.Series, n: int) -> tuple[Node, int]:
        sample = np.sort(points.to_numpy()).view(np.uint64)[:, None]
        return grow(sample, max(16.0, most * len(sample) / n), reach)

    return run


def _sent_down(reach: int) -> Callable[[Node, pd.Series], list[tuple[int, np.ndarray]]]:
    def run(tree: Node, points: pd.Series) -> list[tuple[int, np.ndarray]]:
        out: list[tuple[int, np.ndarray]] = []
        route(tree, points.to_numpy().view(np.uint64)[:, None], np.arange(len(points)), reach, out)
        return out

    return run


def linked(points: DataFrame, reach: int = RADIUS) -> DataFrame:
    """``a, b``: links between distinct points that connect what ``reach`` connects.

    ``points`` has the distinct points in a column ``point``.
    """
    return (
        in_chunks(in_leaves(points, reach), "leaf", "point", CHUNK)
        .groupBy("leaf", "first", "second")
        .applyInPandas(_leaf_links(reach), "a long, b long")
    )


def in_chunks(rows: DataFrame, shard: str, point: str, chunk: int) -> DataFrame:
    """Rows of a shard of more than ``chunk`` rows dealt so that each two chunks meet in a
    task (``first``, ``second``); ``own`` is the row's chunk."""
    sizes = rows.groupBy(shard).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1")
    sizes = stored(sizes, "chunks")
    dealt = rows.join(sized(sizes, sizes.count()), shard, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(9), point), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("first", F.least("own", "_other")).withColumn("second", F.greatest("own", "_other")).drop(
        "chunks", "_other"
    )


def near_duplicates(docs: DataFrame, n_words: int = WORDS, reach: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; ``component_id`` is the least
    doc_id that can be reached over links, the row itself included."""
    return grouped(stored(fingerprints(docs, n_words), "fingerprints"), reach)


def grouped(prints: DataFrame, reach: int = RADIUS) -> DataFrame:
    """The same of rows that have their fingerprints already (``doc_id, point``, stored)."""
    points = prints.groupBy("point").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    points = stored(points, "points")
    links = stored(linked(points, reach), "links")
    return _classes(prints, points, links)


def _classes(prints: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    groups = components(links).withColumnRenamed("node", "point").withColumn("_one", F.lit(1))
    own = joined(points, groups, ["point"], "point-groups", "_one", "left")
    own = stored(own.withColumn("component", F.coalesce("component", "point")), "grouped-points")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = joined(own, least, ["component"], "group-names", "members").select("point", "component_id", "copies")
    bits = F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint")
    return joined(prints, named, ["point"], "named-points", "copies").select("doc_id", bits, "component_id")
