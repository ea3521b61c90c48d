"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

1. ``pieces``: each document becomes its token ids plus an end id; only documents longer
   than a sequence are cut, so that all pieces but the first are full.
2. ``plan``: packing depends on lengths alone. The lengths of all pieces make a histogram
   with at most one entry for each length, whatever the size of the corpus. On it,
   best-two-fit builds one *pattern* of lengths at a time: the longest piece left, then
   again and again the longest that fits; then the pattern's smallest piece is replaced by
   two unpacked pieces if these fill the widened gap more tightly. A pattern is used as
   often as its lengths last, as packing one sequence after the other would do.
3. ``pack``: a piece's rank among the pieces of its length picks its place in the plan.
   Ranks come from two levels of counts, so a length that a third of all rows share is
   still spread over many tasks.

Null and empty texts make a piece of the end id alone. Repeated rows are packed row by
row; the pieces of rows with one doc_id are told apart. Texts are taken whole, however long.
Further columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, gapless, stored, texts, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SEQUENCE = 2048
END = 0
#: Characters for which all versions of the Unicode tables agree; other texts are left to
#: the library that the vocabulary file is for.
_COMMON = regex.compile(r"[\x00-˿Α-ΡА-я‐-‧ぁ-ゖ一-龥]*")


class Encoder:
    """Ids as the library for ``vocabulary`` gives them. ``ranks`` holds the same
    vocabulary for a faster library, which takes the texts of common characters."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as file:
            by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_rank, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text and _COMMON.fullmatch(text):
            return self.fast.encode_to_numpy(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    return Encoder(vocabulary_path(vocabulary), vocabulary_path(ranks))


def cuts(length: int, most: int) -> list[int]:
    """Lengths of a document's pieces; all but the first are full."""
    first = length % most or most
    return [first] + [most] * ((length - first) // most)


def _cut_texts(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder()
        for batch in batched(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts(batch)):
                ids = np.append(tool.ids(text), END).astype("<u4")
                at = 0
                for k, n in enumerate(cuts(len(ids), most)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(taken),
                    batch.column("uid").take(taken),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "uid", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, most: int = SEQUENCE) -> DataFrame:
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .withColumn("uid", F.monotonically_increasing_id())
        .mapInArrow(
            _cut_texts(most),
            f"doc_id {doc_id}, uid long, piece int, start long, length long, ids_crc32 long",
        )
    )


def plan(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, longest first) and how often each is used."""
    left = np.zeros(most + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[list[int], int]] = []
    top = most
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return made
        free = left.copy()
        pattern, gap = [top], most - top
        free[top] -= 1
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        if gap and len(pattern) > 1:
            pattern = _two_for_one(pattern, gap, free)
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        made.append((sorted(pattern, reverse=True), times))


def _two_for_one(pattern: list[int], gap: int, free: np.ndarray) -> list[int]:
    """Puts two unpacked pieces in the place of the smallest, if the gap shrinks."""
    smallest = min(pattern)
    room = gap + smallest
    there = np.flatnonzero(free[:room])
    if not len(there):
        return pattern
    at = np.searchsorted(there, room - there, side="right") - 1  # the longest partner that fits
    good = at >= 0
    first, second = there[good], there[at[good]]
    single = (first == second) & (free[first] < 2)
    if single.any():  # the only piece of its length needs a shorter partner
        lower = np.searchsorted(there, first[single]) - 1
        second = second.copy()
        second[single] = np.where(lower >= 0, there[lower], -room)
    both = first + second
    if not len(both) or both.max() <= smallest:
        return pattern
    k = int(both.argmax())
    rest = pattern.copy()
    rest.remove(smallest)
    return [*rest, int(first[k]), int(second[k])]


def _places(made: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its ranks begin in each pattern, the pieces of this length in
    the pattern, the pattern's first sequence, and the offset of the first such piece."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in made:
        offset = 0
        for length in dict.fromkeys(pattern):
            uses = pattern.count(length)
            at = ranks.get(length, 0)
            found.setdefault(length, []).append((at, uses, sequence, offset))
            ranks[length] = at + uses * times
            offset += uses * length
        sequence += times
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in found.items()}


def _placed(places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                begin, uses, first, at = places.value[int(n)]
                k = np.searchsorted(begin, rank[own], side="right") - 1
                turn, slot = np.divmod(rank[own] - begin[k], uses[k])
                sequence[own] = first[k] + turn
                offset[own] = at[k] + slot * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, most), "pieces")
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, most)))
    ranked = gapless(cut, "length", ["uid", "piece"], "rank", parts=16)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(places),
        f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
