"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are the words of a text and the beginnings of its words (3 to 8 letters), as
present or absent; whole texts are read. Those that tell the labelled classes apart best
are kept (by the likelihood-ratio statistic, ``FEATURES`` at most), counted over the
labelled sample by the executors.

The model has one weight for each feature and ordered thresholds t1 <= t2 <= ..., with
P(grade >= k) = sigmoid(w.x - t_k): all thresholds share the weights. The output is the
expected grade, that is the sum of these probabilities.

Labels say toxic or not. Grades are 0 for clean texts; toxic texts are split into 1 and 2
at the median number of their distinct words with a typical feature. A text is
rejected at an expected grade of ``REJECT`` or more.

The model is fitted on ``SAMPLE`` labelled rows at most, chosen by a hash of doc_id.
Null and empty texts have no features and so the grade of the intercept. Rows without a
label, labels without a row and null labels take no part in fitting; where labels of one
doc_id contradict each other, one that says toxic decides. Without both classes every text
gets grade 0. Texts are taken whole, however long. Repeated rows are scored row by row;
further columns, whatever their names, are ignored or kept as they are; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, batched, stored, texts

SAMPLE = 20_000
FEATURES = 2_048
#: Likelihood-ratio statistic that a feature needs; chance reaches it in about one of two million.
LEAST_GAIN = 25.0
REJECT = 0.35
_WORD = regex.compile(r"[^\W\d_]+")
_LENGTHS = range(3, 9)


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by ``^``."""
    return [word, *("^" + word[:n] for n in _LENGTHS if n <= len(word))]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Ordinal:
    """Weights by feature, and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def scorer(self) -> Callable[[str], float]:
        memo: dict[str, tuple[str, ...]] = {}
        weights, thresholds = self.weights, np.array(self.thresholds)

        def score(text: str) -> float:
            found: set[str] = set()
            for word in words_of(text):
                own = memo.get(word)
                if own is None:
                    if len(memo) > 500_000:
                        memo.clear()
                    own = memo[word] = tuple(x for x in features_of(word) if x in weights)
                found.update(own)
            total = sum(weights[x] for x in sorted(found))
            return float((1 / (1 + np.exp(thresholds - total))).sum())

        return score


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        names = list(all_)
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([all_[x] for x in names]), pa.array([toxic[x] for x in names], pa.int64())],
            ["feature", "n", "n_toxic"],
        )

    all_: Counter = Counter()
    toxic: Counter = Counter()
    for batch in batched(batches):
        for text, label in zip(texts(batch), batch.column("toxic").to_pylist()):
            found = {x for word in words_of(text) for x in features_of(word)}
            all_.update(found)
            if label:
                toxic.update(found)
            if len(all_) > 200_000:
                yield made()
                all_, toxic = Counter(), Counter()
    if all_:
        yield made()


def _sparse(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: k for k, name in enumerate(names)}
        for batch in batched(batches):
            rows, marked = [], []
            for text in texts(batch):
                own = [[at[x] for x in features_of(word) if x in at] for word in words_of(text)]
                rows.append(sorted({x for found in own for x in found}))
                marked.append(sum(map(bool, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.int32())), pa.array(marked, pa.int64())],
                ["toxic", "features", "marked"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Ordinal:
    """Fits the model on the labelled rows of ``docs``."""
    chosen = (
        labels.where("toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers go to all tasks; the texts are not shuffled.
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    rows, _ = at_most(rows, sample)
    sizes = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = sizes["n"] or 0, sizes["toxic"] or 0
    if not 0 < toxic < n:
        return Ordinal({}, [1e9, 1e9])
    counts = (
        rows.mapInArrow(_feature_counts, "feature string, n long, n_toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .where("n >= 5")
    )
    found = _surplus(F.col("n_toxic"), F.col("n"), toxic / n) + _surplus(F.col("n") - F.col("n_toxic"), F.col("n"), 1 - toxic / n)
    best = counts.withColumn("gain", found).where((F.col("n_toxic") / F.col("n") > toxic / n) & (F.col("gain") >= LEAST_GAIN))
    names = [row["feature"] for row in best.orderBy(F.desc("gain"), "feature").limit(features).collect()]
    if not names:
        return Ordinal({}, [1e9, 1e9])
    table = rows.mapInArrow(_sparse(names), "toxic int, features array<int>, marked long").toArrow()
    label = table.column("toxic").to_numpy().astype(np.int64)
    marked = table.column("marked").to_numpy()
    grade = np.where(label > 0, 1 + (marked > np.median(marked[label > 0])), 0)
    lists = table.column("features").combine_chunks()
    sizes_of = np.diff(lists.offsets.to_numpy())
    weights, thresholds = regress(sizes_of, lists.values.to_numpy(), grade, len(names))
    return Ordinal({name: float(w) for name, w in zip(names, weights)}, [float(t) for t in thresholds])


def _surplus(seen: Column, n: Column, share: float) -> Column:
    """One class's part of the likelihood-ratio statistic: what is seen against its share."""
    return F.when(seen > 0, 2 * seen * F.log(seen / (n * share))).otherwise(0.0)


def regress(
    sizes: np.ndarray, columns: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 600, decay: float = 3e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model with a quadratic penalty, by Adam.

    Row ``i`` has the next ``sizes[i]`` of ``columns`` as its present features. The first
    threshold and the logarithm of the gap to the next are free, so thresholds stay ordered.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((row, columns))
    row, columns = row[order], columns[order]
    w, t = np.zeros(n_features), np.array([2.0, 0.5])
    m, v = np.zeros(n_features + 2), np.zeros(n_features + 2)
    n = len(sizes)
    for step in range(1, steps + 1):
        x = np.bincount(row, weights=w[columns], minlength=n)
        cut = np.array([t[0], t[0] + np.exp(t[1])])
        p = [1 / (1 + np.exp(np.clip(c - x, -35, 35))) for c in cut]
        # Likelihood of a grade is the difference of neighbouring cumulative probabilities.
        upper = np.where(grade == 0, 1.0, np.where(grade == 1, p[0], p[1]))
        lower = np.where(grade == 0, p[0], np.where(grade == 1, p[1], 0.0))
        like = np.maximum(upper - lower, 1e-9)
        slope = [q * (1 - q) for q in p]
        d_upper = np.where(grade == 0, 0.0, np.where(grade == 1, slope[0], slope[1]))
        d_lower = np.where(grade == 0, slope[0], np.where(grade == 1, slope[1], 0.0))
        d_x = -(d_upper - d_lower) / like
        # Threshold 1 bounds grade 0 from above and grade 1 from below; threshold 2 likewise.
        d_1 = np.where(grade == 0, -slope[0], np.where(grade == 1, slope[0], 0.0)) / like
        d_2 = np.where(grade == 1, -slope[1], np.where(grade == 2, slope[1], 0.0)) / like
        gradient = np.concatenate(
            [
                np.bincount(columns, weights=d_x[row], minlength=n_features) / n + decay * w,
                [(d_1 + d_2).mean(), d_2.mean() * np.exp(t[1])],
            ]
        )
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:-2], t - move[-2:]
    return w, np.array([t[0], t[0] + np.exp(t[1])])


def _scored(model, reject: float, keep_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batched(batches):
            severity = np.array([score(text) for text in texts(batch)], np.float64)
            if keep_rows:
                yield batch.filter(pa.array(severity < reject))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(severity), pa.array(severity >= reject)],
                    ["doc_id", "severity", "rejected"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``doc_id, severity, rejected`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scored(model, reject, False), f"doc_id {doc_id}, severity double, rejected boolean"
    )


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_scored(model, reject, True), docs.schema)
