"""Token counts of whole texts, each distinct pre-token being split into pieces once.

1. ``_occurrences``: every pre-token of the corpus with its number of occurrences, added
   up inside each task before the shuffle.
2. ``dictionary``: each distinct pre-token is cut into pieces once by the library's model;
   only (64-bit key, pieces, occurrences) are kept. Keys that collide are detected, and
   the dictionary is made again with another seed.
3. ``token_counts``: the frequencies of each document are joined to the dictionary and
   ``frequency x pieces`` is summed; token ids are never made. The most frequent
   ``head`` entries (a fixed bound, 16 bytes each) are sent to all tasks, which resolves
   hot pre-tokens without a shuffle. The others, rare by construction, are joined in a
   shuffle. Both parts are exact, at every size of corpus.

Texts are split twice, once for the dictionary and once for their frequencies: storing or
shuffling the frequencies of all documents would cost more than splitting again.

Null and empty texts have 0 bytes and 0 tokens. Texts are taken whole, however long.
Repeated rows are counted row by row. Columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, byte_lengths, stored, texts, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Entries of the dictionary that every task holds (keys and counts: 12 bytes each).
HEAD = 2_000_000
#: Texts of these characters alone need no library call for normalising: composition
#: leaves them as they are, and lower-casing goes character by character.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įĲ-˿]*")


class PreTokenizer:
    """Splits a text as the vocabulary file's own normaliser and first splitter do."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.plain = regex.compile(pattern)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        counting = Tokenizer.from_file(path)
        counting.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if counting.normalizer is not None:
            from tokenizers import normalizers

            counting.normalizer = normalizers.Sequence([])
        self.counting = counting

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain.findall(text.lower())
        found: list[str] = []
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                found.append(part)
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                found.extend(piece for piece, _ in self.splitter.pre_tokenize_str(normal))
        return found

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        encoded = self.counting.encode_batch(pre_tokens, add_special_tokens=False)
        return [len(x) for x in encoded]


@lru_cache(maxsize=2)
def _pre_tokenizer(vocabulary: str) -> PreTokenizer:
    return PreTokenizer(vocabulary_path(vocabulary))


def _occurrences(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _pre_tokenizer(vocabulary).split, Counter()
        for batch in batched(batches):
            for text in texts(batch):
                seen.update(split(text))
                if len(seen) > 300_000:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    return run


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "occurrences"]
    )


def _keys(pre_tokens: Iterable[str], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in pre_tokens], np.uint64).view(np.int64)


def _cut(vocabulary: str, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _pre_tokenizer(vocabulary)
        for batch in batched(batches, column="pre_token"):
            names = batch.column("pre_token").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_keys(names, seed)),
                    pa.array(tool.pieces(names), pa.int32()),
                    batch.column("occurrences"),
                ],
                ["key", "pieces", "occurrences"],
            )

    return run


def dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> tuple[DataFrame, int, int]:
    """The stored dictionary, its seed, and the least number of occurrences of its head."""
    counts = (
        docs.select("text")
        .mapInArrow(_occurrences(vocabulary), "pre_token string, occurrences long")
        .groupBy("pre_token")
        .agg(F.sum("occurrences").alias("occurrences"))
    )
    for seed in range(8):
        entries = stored(
            counts.mapInArrow(_cut(vocabulary, seed), "key long, pieces int, occurrences long"), "pieces"
        )
        sizes = (
            entries.groupBy("key")
            .agg(F.count("*").alias("n"), F.max("occurrences").alias("occurrences"))
            .groupBy(F.floor(F.log2("occurrences") * 8).alias("step"))
            .agg(F.count("*").alias("entries"), F.max("n").alias("most"), F.min("occurrences").alias("least"))
            .collect()
        )
        if max((row["most"] for row in sizes), default=1) == 1:
            break
    else:
        raise RuntimeError("distinct pre-tokens share a key under eight seeds")
    total, least = 0, 2**62
    for row in sorted(sizes, key=lambda row: -row["step"]):
        total += row["entries"]
        if total > head:
            break
        least = row["least"]
    return entries, seed, least


def _resolve(vocabulary: str, seed: int, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _pre_tokenizer(vocabulary).split
        known, pieces = head.value
        for batch in batched(batches):
            own: list[str] = []
            times: list[int] = []
            ends = []
            for text in texts(batch):
                frequency = Counter(split(text))
                own.extend(frequency.keys())
                times.extend(frequency.values())
                ends.append(len(own))
            keys, times = _keys(own, seed), np.array(times, np.int64)
            offsets = np.array([0, *ends], np.int64)
            order = np.argsort(keys)  # sorted look-ups touch the head in order
            at = np.empty(len(keys), np.int64)
            at[order] = np.searchsorted(known, keys[order])
            found = np.zeros(len(keys), bool)
            if len(known):
                found = known[np.minimum(at, len(known) - 1)] == keys
            made = np.zeros(len(keys), np.int64)
            made[found] = times[found] * pieces[at[found]]
            totals = np.concatenate([[0], np.cumsum(made)])
            left = np.concatenate([[0], np.cumsum(~found)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("uid"),
                    pa.array(byte_lengths(batch.column("text"))),
                    pa.array(np.diff(totals[offsets])),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(keys[~found])),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(times[~found])),
                ],
                ["doc_id", "uid", "n_bytes", "n_head", "rest", "times"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048, head: int = HEAD) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    spark = docs.sparkSession
    entries, seed, least = dictionary(docs, vocabulary, head)
    top = entries.where(F.col("occurrences") >= least).select("key", "pieces").toArrow()
    known = top.column("key").to_numpy()
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], top.column("pieces").to_numpy()[order].astype(np.int32)))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    counted = stored(
        docs.select("doc_id", "text")
        .withColumn("uid", F.monotonically_increasing_id())
        .mapInArrow(
            _resolve(vocabulary, seed, sent),
            f"doc_id {doc_id}, uid long, n_bytes long, n_head long, rest array<long>, times array<long>",
        ),
        "token-counts",
    )
    rare = counted.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x"))
    rare = rare.select("uid", F.col("x.rest").alias("key"), F.col("x.times").alias("times"))
    tail = entries.where(F.col("occurrences") < least).select("key", "pieces")
    added = rare.join(tail, "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_tail"))
    n_tokens = (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long")
    return counted.drop("rest", "times").join(added, "uid", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
