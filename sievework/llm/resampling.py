"""Quality by importance resampling over hashed n-grams.

Two bag-of-n-grams models are estimated: one of target text (rows labelled as good, a
bounded sample) and one of the raw corpus (every row, whole texts). The importance of a
text is the ratio of its likelihoods under the two; Gumbel noise is added to its
logarithm, and the k texts with the largest sums are kept: sampling without replacement,
in proportion to importance.

n-grams are words and punctuation runs and their neighbouring pairs, hashed to
``BUCKETS``. k is the number of rows times the share of good rows among the labelled ones,
at the upper end of its interval (``Z`` standard errors), so that clean texts are not
lost to the sampling error of the share. The k-th largest sum is found by narrowing
histograms; rows that tie with it are kept too.

The noise comes from a hash of doc_id and text, so runs agree and repeated rows share
their fate. Null and empty texts have importance 1. Texts are taken whole, however long.
Where labels contradict each other, a text is good if all of its labels say so. Without
target rows all importances are 1; without labels, or without bad ones, all rows are kept.
Further columns, whatever their names, are ignored or kept as they are. An empty table
gives no rows.

Texts are split three times where rows are filtered (model, scores, rows), as shuffling or
storing them would cost more at scale than the splitting.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, batched, stored, texts

BUCKETS = 10_000
SAMPLE = 20_000
Z = 3.0
_TOKEN = regex.compile(r"\w+|[^\w\s]+")


class Hashed:
    """Buckets of a text's words and word pairs, with a bounded memo of word hashes."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        own = []
        for token in _TOKEN.findall(text):
            value = memo.get(token)
            if value is None:
                value = memo[token] = zlib.crc32(token.encode())
            own.append(value)
        one = np.array(own, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) >> np.uint64(7)
        return np.concatenate([one, two]) % np.uint64(self.buckets)


def _bucket_counts(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batched(batches):
            for text in texts(batch):
                total += np.bincount(hashed(text).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def model(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Smoothed logarithms of the n-gram probabilities; each task sends one row per bucket."""
    rows = (
        docs.select("text").mapInArrow(_bucket_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    )
    counts = np.ones(buckets)
    for bucket, n in rows.collect():
        counts[bucket] += n
    return np.log(counts / counts.sum())


def good_share(n_good: int, n: int, z: float = Z) -> float:
    if not n:
        return 1.0
    share = n_good / n
    return min(1.0, share + z * (share * (1 - share) / n) ** 0.5)


def _scores(ratio, seed: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    hashed = Hashed(len(ratio.value))

    def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        importance, noise = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            importance.append(float(ratio.value[hashed(text).astype(np.int64)].sum()))
            value = xxhash.xxh64_intdigest(f"{doc_id}\n{text}".encode(), seed)
            noise.append(-np.log(-np.log((value + 0.5) / 2.0**64)))
        return np.array(importance), np.array(importance) + np.array(noise)

    return score


def _scored(ratio, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(ratio, seed)
        for batch in batched(batches):
            importance, noisy = score(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(importance), pa.array(noisy)], ["doc_id", "log_weight", "score"]
            )

    return run


def _kept(ratio, seed: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(ratio, seed)
        for batch in batched(batches):
            yield batch.filter(pa.array(score(batch)[1] >= least))

    return run


def kth_largest(scores: DataFrame, k: int, steps: int = 1024, rounds: int = 6) -> float:
    """The k-th largest ``score``, by histograms over an ever narrower range."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return float("-inf")
    low, high, above = ends["low"], ends["high"], 0
    for _ in range(rounds):
        width = (high - low) / steps
        if width <= 1e-12 * max(1.0, abs(high)):
            break
        inside = scores.where(F.col("score").between(low, high))
        step = F.least(F.floor((F.col("score") - low) / width), F.lit(steps - 1))
        bins = inside.groupBy(step.alias("step")).agg(
            F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
        )
        for row in sorted(bins.collect(), key=lambda row: -row["step"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        if low == high:
            break
    return float(low)


def _prepared(docs: DataFrame, labels: DataFrame, sample: int, seed: int):
    """The broadcast log-ratio, the stored scores and the least score that is kept."""
    spark = docs.sparkSession
    chosen = (
        labels.where("quality is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers go to all tasks; the texts are not shuffled.
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality"), "quality-sample")
    rows, _ = at_most(rows, sample)
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    raw = model(docs)
    target = model(rows.where("quality = 1")) if good else raw
    ratio = spark.sparkContext.broadcast(target - raw)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    scores = stored(
        docs.select("doc_id", "text").mapInArrow(
            _scored(ratio, seed), f"doc_id {doc_id}, log_weight double, score double"
        ),
        "importance",
    )
    k = int(np.ceil(good_share(good, n) * scores.count()))
    return ratio, scores, kth_largest(scores, k)


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> DataFrame:
    """``doc_id, log_weight, score, kept`` of every row."""
    _, scores, least = _prepared(docs, labels, sample, seed)
    return scores.withColumn("kept", F.col("score") >= F.lit(least))


def kept_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    ratio, _, least = _prepared(docs, labels, sample, seed)
    return docs.mapInArrow(_kept(ratio, seed, least), docs.schema)
