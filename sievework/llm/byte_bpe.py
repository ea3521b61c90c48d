"""Byte-level BPE by longest match and backtracking, in time linear in the text.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over all tokens
finds every token inside a piece of text in one pass. Encoding then takes the longest
token at each place, and steps back to shorter ones where it has to: a sequence of tokens
is what the merges make of its bytes if and only if each two adjacent tokens are
*compatible*, that is, if the merges turn the joined bytes of the two into just these two.
Compatibility is decided by the merges themselves and memoised; a place from which no
compatible continuation exists is marked once and never visited again.

A match that is a token as a whole is that token, as with the tiktoken library.
Null and empty texts give no ids. Nothing is shuffled; each row, repeated or not, is encoded
by itself. Very long texts take linear time; further columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batched, texts, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries at which a memo is emptied; it bounds the memory of a task.
MEMO = 300_000


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Tokens that the merges can make; the others occur only as whole matches.
        self.sound = {token for token in ranks if self.merged(token) == [ranks[token]]}
        self.automaton = ahocorasick.Automaton()
        for token in self.sound:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self._shorter: dict[bytes, bytes | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges, step by step: the definition, used on one or two tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[part] for part in parts]

    def fits(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[pair] = self.merged(left + right) == [self.ranks[left], self.ranks[right]]
        return known

    def shorter(self, token: bytes) -> bytes | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self._shorter:
            prefixes = (token[:n] for n in range(len(token) - 1, 0, -1))
            self._shorter[token] = next((p for p in prefixes if p in self.sound), None)
        return self._shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest: list[bytes | None] = [None] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(token)
            if longest[start] is None or len(longest[start]) < len(token):
                longest[start] = token
        open_at = bytearray(b"\1") * (len(piece) + 1)  # places not yet found to be dead ends
        made: list[bytes] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None and not (
                open_at[at + len(token)] and (not made or self.fits(made[-1], token))
            ):
                token = self.shorter(token)
            if token is not None:
                made.append(token)
                at += len(token)
                token = longest[at] if at < len(piece) else None
            else:
                open_at[at] = 0
                token = made.pop()
                at -= len(token)
        return [self.ranks[token] for token in made]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def byte_pairs(vocabulary: str = VOCABULARY) -> BytePairs:
    import public_tokenizers

    with open(vocabulary_path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return BytePairs(ranks, public_tokenizers.PATTERN)


def _digests(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_pairs(vocabulary)
        memo: dict[str, list[int]] = {}  # of short pieces, which come again and again
        for batch in batched(batches):
            n, ids_sha, decoded_sha = [], [], []
            for text in texts(batch):
                ids: list[int] = []
                for piece in tool.pattern.findall(text):
                    own = memo.get(piece)
                    if own is None:
                        own = tool.encode_piece(piece.encode())
                        if len(piece) <= 32:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[piece] = own
                    ids += own
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each text is encoded, its ids are decoded again, and both are digested."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _digests(vocabulary), f"doc_id {doc_id}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _ids(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_pairs(vocabulary)
        for batch in batched(batches):
            ids = [tool.encode(text) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_ids(vocabulary), f"doc_id {doc_id}, ids array<int>")


def _texts(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_pairs(vocabulary)
        for batch in batches:
            made = [tool.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows of ids; a null list is an empty text."""
    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_texts(vocabulary), f"doc_id {doc_id}, text string")
