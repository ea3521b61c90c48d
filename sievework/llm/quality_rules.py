"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good or bad, or abstains where the
measure is between its two bounds or the text has no words. Expectation-maximisation over
the votes of all rows estimates the share of good texts and, for each rule and class, how
often it votes which way (abstaining says nothing). The verdict is the posterior
probability of the good class; it replaces the demand that every rule be met.

Only the numbers of rows with each combination of votes go to the driver: at most
3 to the power of the number of rules, whatever the size of the corpus.

A text fails the base rules if it has under 20 words, or if over 30 % of its words lie in
8-word windows found twice or more in it. Null and empty texts have no words and fail.
Texts are taken whole, however long. Repeated rows are judged row by row; further columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batched, stored, texts

#: Rules: name, the measure up to which it votes good, the measure from which it votes bad.
RULES = [
    ("symbols per word", 0.02, 0.1),
    ("share of words with a symbol", 0.02, 0.15),
    ("share of words in repeated windows", 0.15, 0.3),
    ("words equal to the one before", 0.02, 0.1),
    ("share of the most frequent word", 0.15, 0.25),
    ("share of capitals", 0.2, 0.5),
    ("exclamation marks per word", 0.02, 0.1),
    ("distance of the mean word length from 6", 4.0, 9.0),
    ("share of repeated lines", 0.2, 0.5),
    ("share of characters that are no letters", 0.08, 0.14),
]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_NO_LETTER = regex.compile(r"[^\p{L}\x20\x09-\x0D]")
_SYMBOL = regex.compile(rb"[#*$%&|<>]")
_CAPITAL = regex.compile(r"\p{Lu}")


def repeated_words(own: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that are found twice or more."""
    n = len(own) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.array([ids.setdefault(word, len(ids)) for word in own], np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x100000001B3) ^ (numbers[k : k + n] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    seen: dict[tuple[bytes, ...], list[int]] = {}  # the hash only chose candidates
    for at in np.flatnonzero(twin):
        seen.setdefault(tuple(own[at : at + window]), []).append(at)
    covered = np.zeros(len(own) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            covered[places] += 1
            covered[np.array(places) + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measures(text: str) -> tuple[list[int], list[float] | None]:
    """The base counts, and the measure of each rule (None without words)."""
    raw = text.encode()
    own = raw.split()
    n = len(own)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines: dict[str, int] = {}
    with_words = duplicates = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            with_words += 1
            if line in lines:
                duplicates += 1
            lines[line] = 1
    repeats = repeated_words(own)
    base = [n, chars, symbols, duplicates, repeats]
    if not n:
        return base, None
    adjacent = sum(map(bytes.__eq__, own, own[1:]))
    marked = sum(map(bool, map(_SYMBOL.search, own))) if symbols else 0
    strange = len(_NO_LETTER.findall(text))
    capitals = len(_CAPITAL.findall(text))
    return base, [
        symbols / n,
        marked / n,
        repeats / n,
        adjacent / n,
        max(Counter(own).values()) / n,
        capitals / max(1, chars - strange),
        text.count("!") / n,
        abs(chars / n - 6),
        duplicates / with_words,
        strange / chars,
    ]


def vote_code(found: list[float] | None) -> int:
    """The votes as digits to the base of 3: 0 abstains, 1 good, 2 bad."""
    code = 0
    for value, (_, good, bad) in zip(found or [], RULES):
        code = code * 3 + (1 if value <= good else 2 if value >= bad else 0)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    digits = [codes // 3**k % 3 for k in range(len(RULES) - 1, -1, -1)]
    return np.stack(digits, axis=1)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good texts, and P(vote good | class, not abstaining) by class and rule.

    ``votes`` has a row for each combination and ``weight`` its number of texts. The start
    takes rules to be mostly right, and so names the classes.
    """
    share, right = 0.8, np.stack([np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.6)])
    for _ in range(rounds):
        good = posterior(votes, share, right)
        before = right
        right = np.stack(
            [
                ((weight * q) @ (votes == 1) + prior * 10) / ((weight * q) @ (votes > 0) + 10)
                for q, prior in ((good, 0.95), (1 - good, 0.6))
            ]
        )
        share = float((weight * good).sum() + 8) / (weight.sum() + 10)
        if np.abs(right - before).max() < 1e-9:
            break
    return share, right


def posterior(votes: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    odds = np.log(share) - np.log(1 - share)
    odds = odds + (votes == 1) @ (np.log(right[0]) - np.log(right[1]))
    odds = odds + (votes == 2) @ (np.log1p(-right[0]) - np.log1p(-right[1]))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches):
        rows, codes = [], []
        for text in texts(batch):
            base, found = measures(text)
            rows.append(base)
            codes.append(vote_code(found))
        table = np.array(rows, np.int64).reshape(-1, len(_NAMES))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(column.copy()) for column in table.T), pa.array(codes, pa.int32())],
            ["doc_id", *_NAMES, "votes"],
        )


def _judged(good: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probability = [good[code] for code in batch.column("votes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(probability, pa.float64())], [*batch.schema.names, "p_good"]
            )

    return run


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``p_good`` and ``kept`` of every row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, " + ", ".join(f"{name} long" for name in _NAMES) + ", votes int"
    rows = stored(docs.select("doc_id", "text").mapInArrow(_measured, schema), "rule-votes")
    counts = rows.groupBy("votes").count().collect()
    codes = np.array([row["votes"] for row in counts], np.int64)
    votes = votes_of(codes)
    share, right = estimate(votes, np.array([row["count"] for row in counts], np.float64))
    good = dict(zip(codes.tolist(), posterior(votes, share, right).tolist()))
    judged = rows.mapInArrow(_judged(good), schema + ", p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.drop("votes").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= least)
    )
