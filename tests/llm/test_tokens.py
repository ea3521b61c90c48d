import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from sievework.llm import byte_bpe, packing, token_counts


def sparse(df):
    return [row.asDict() for row in df.collect()]


def test_token_counts_are_the_library_s(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(
        (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
        for r in docs.select("doc_id", "text").collect()
    )
    for head in (token_counts.HEAD, 4, 0):  # all from the sent head, some, all by the join
        found = token_counts.token_counts(docs, head=head).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in found)


def test_token_counts_of_a_whole_table(tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = tables("documents")
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows).collect()}
    assert found == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in rows.collect()}


def test_plain_split_is_the_library_s_for_every_sign():
    tool = token_counts.PreTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for point in [*range(1, 0x250), 0x300, 0x3A3, 0x2028, 0x1F600]:
        text = f"A{chr(point)}b{chr(point)} {chr(point)}7"
        want = tool.library.encode(text, add_special_tokens=False).ids
        assert sum(tool.pieces(tool.split(text))) == len(want), hex(point)


def test_token_counts_of_nothing(no_docs):
    assert token_counts.token_counts(no_docs).count() == 0


def reference():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_backtracking_makes_the_exact_merges():
    tool, library, source = byte_bpe.byte_pairs(), reference(), random.Random(7)
    signs = ["ab", "the in", "éß€\n\t  ", "日本語한", "'st ll", "aA1_-", "\x00\xff "]
    for alphabet in signs:
        for n in (1, 2, 7, 60, 900):
            for _ in range(8):
                text = "".join(source.choice(alphabet) for _ in range(n))
                ids = tool.encode(text)
                assert ids == library.encode_ordinary(text)
                assert tool.decode(ids) == text.encode()
    assert tool.encode("a" * 50_000) == library.encode_ordinary("a" * 50_000)


def test_encode_decode(docs, no_docs):
    library = reference()
    want = []
    for row in docs.collect():
        ids = library.encode_ordinary(row.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((row.doc_id, len(ids), digest, hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.encode_decode(docs).collect())) == sorted(want)
    assert byte_bpe.encode_decode(no_docs).count() == 0


def test_round_trip_of_texts(docs):
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_cuts():
    assert packing.cuts(1, 4) == [1]
    assert packing.cuts(4, 4) == [4]
    assert packing.cuts(9, 4) == [1, 4, 4]


def test_two_for_one_fills_the_gap():
    # Greedy fills 10 with 7 + 2; 7 is kept and 2 is replaced by two pieces of 1 and 2.
    made = packing.plan({7: 1, 2: 2, 1: 1}, 10)
    assert made[0] == ([7, 2, 1], 1)
    made = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(made[0][0]) == [2, 2, 6]  # 6 + 3 leaves 1; 2 + 2 leave nothing


def test_plan_uses_every_piece_once():
    source = random.Random(3)
    for _ in range(20):
        counts = {n: source.randrange(1, 40) for n in source.sample(range(1, 65), 20)}
        made = packing.plan(counts, 64)
        used = dict.fromkeys(counts, 0)
        for pattern, times in made:
            assert sum(pattern) <= 64
            for n in pattern:
                used[n] += times
        assert used == counts
        assert sum(times for _, times in made) <= 1.02 * best_fit(counts, 64) + 1


def best_fit(counts, most):
    """Sequences that best fit in decreasing order needs."""
    gaps = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fitting = [(gap, k) for k, gap in enumerate(gaps) if gap >= n]
        if fitting:
            gaps[min(fitting)[1]] -= n
        else:
            gaps.append(most - n)
    return len(gaps)


def check_packing(docs, found, most=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for row in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, n in enumerate(packing.cuts(len(ids), most)):
            want.append((row.doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(by_sequence), -(-sum(w[3] for w in want) // most)


def test_packing(docs, no_docs, tables):
    check_packing(docs, packing.pack(docs).collect())
    n, least = check_packing(tables("documents"), packing.pack(tables("documents")).collect())
    assert n <= least + 2
    assert packing.pack(no_docs).count() == 0
