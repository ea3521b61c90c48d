import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievework.llm import common, embedding_dedup, graph, simhash, simhash_text


def closure(n, pairs):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(k) for k in range(n)]


def brute_fingerprint(text):
    own = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        own = own.replace(blank, " ")
    own = [word for word in own.split(" ") if word]
    parts = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(part.encode(), 42) for part in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def check_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = closure(len(rows), pairs)
    least = {}
    for group, row in zip(groups, rows):
        least[group] = min(least.get(group, row.doc_id), row.doc_id)
    want = sorted((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_is_brute_force(docs, no_docs, tables):
    check_simhash(docs)
    check_simhash(tables("documents"))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_vantage_point_tree_loses_no_link(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = points[:500].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 63, len(near)).astype(np.uint64)
    points = np.unique(np.concatenate([points, near]))
    found = simhash.local_components(len(points), simhash.close_pairs(points[:, None], 3))
    away = np.bitwise_count(points[:, None] ^ points[None, :])
    want = closure(len(points), zip(*np.nonzero(np.triu(away <= 3, 1))))
    assert found.tolist() == want
    # Over the cluster, with many leaves.
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    old = simhash.LEAF
    simhash.LEAF = 60
    try:
        links = [(r.a, r.b) for r in simhash.linked(rows).collect()]
    finally:
        simhash.LEAF = old
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    assert closure(len(points), [(at[a], at[b]) for a, b in links]) == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    links = spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "a long, b long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert graph.components(links.where("false")).count() == 0


def shingles(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def test_deduplicate_is_brute_force(docs, no_docs, tables):
    for rows in (docs, tables("documents"), tables("documents", "sf0.01")):
        given = [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]
        distinct = sorted({text for _, text in given})
        sets = [shingles(text) for text in distinct]
        pairs = []
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    pairs.append((a, b))
        group = dict(zip(distinct, closure(len(distinct), pairs)))
        want = {}
        for doc_id, text in given:
            want[group[text]] = min(want.get(group[text], doc_id), doc_id)
        kept = simhash_text.deduplicate(rows)
        assert kept.columns == rows.columns
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want.values())
    assert simhash_text.deduplicate(no_docs).count() == 0


def test_chunks_of_a_shard_meet(docs, monkeypatch):
    monkeypatch.setattr(simhash_text, "CHUNK", 1)
    kept = {r.doc_id for r in simhash_text.deduplicate(docs).collect()}
    monkeypatch.undo()
    assert kept == {r.doc_id for r in simhash_text.deduplicate(docs).collect()}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((1500, 64))
    near = base[:300] + rng.standard_normal((300, 64)) * 0.2
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(np.concatenate([base, near]))]
    rows += [(5000 + k, rows[7][1]) for k in range(20)] + [(6000, [2 * x for x in rows[8][1]])]
    odd = [(7000, None), (7001, [0.0] * 64), (7002, [float("nan")] + [1.0] * 63), (7003, [1.0, None]), (7004, []), (7005, [1.0]), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS least", "1 AS leaf", "1 AS a")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.repartition(4)).collect()}
    assert len(found) == len(rows) + len(odd)
    matrix = np.array([v for _, v in rows], np.float32).astype(np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    links = matrix @ matrix.T >= 0.95
    got = np.array([found[i].n_links for i, _ in rows])
    want = links.sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    for vec_id, _ in odd:
        assert found[vec_id].n_links == 0 and found[vec_id].component_id == vec_id and found[vec_id].kept
    assert {found[5000 + k].component_id for k in range(20)} == {7}
    assert found[6000].component_id == 8 and not found[6000].kept
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_dense_points_end(spark):
    """Points of which many lie within the reach of each other part no further, and end."""
    rng = np.random.default_rng(5)
    dense = np.zeros(2000, np.uint64)
    for _ in range(2):
        dense ^= np.uint64(1) << rng.integers(0, 63, len(dense)).astype(np.uint64)
    points = np.unique(np.concatenate([dense, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    found = simhash.local_components(len(points), simhash.close_pairs(points[:, None], 3))
    away = np.bitwise_count(points[:, None] ^ points[None, :])
    assert found.tolist() == closure(len(points), zip(*np.nonzero(np.triu(away <= 3, 1))))


def edited_copies(seed, copies=150, words=80, run=3):
    """A text and copies of it with a run of adjacent words replaced."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10**9, words)]
    made = [" ".join(base)]
    for _ in range(copies):
        at = rng.integers(0, words - run + 1)
        new = [f"n{k}" for k in rng.integers(0, 10**9, run)]
        made.append(" ".join(base[:at] + new + base[at + run :]))
    return made[1:]


def groups_of(texts):
    sets = [shingles(text) for text in texts]
    return closure(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash_text.deduplicate(df.repartition(4)).select("doc_id").collect())


def test_false_candidates_hide_no_pair_of_edited_copies(spark):
    texts = [text for seed in range(6) for text in edited_copies(seed)]
    assert kept_ids(spark, texts) == sorted(set(groups_of(texts)))


def test_two_passes_over_large_shards_lose_no_link(spark, monkeypatch):
    """Groups in which many classes stay outside of the largest component."""
    texts = [text for seed in range(2) for text in edited_copies(seed)]
    want = sorted(set(groups_of(texts)))
    for chunk in (7, 40):
        monkeypatch.setattr(simhash_text, "CHUNK", chunk)
        left, plain = [], simhash_text._left_over
        monkeypatch.setattr(simhash_text, "_left_over", lambda *given: left.append(plain(*given)) or left[-1])
        assert kept_ids(spark, texts) == want
        assert left[0].count() > 0
        monkeypatch.undo()


def test_one_large_group_needs_no_second_pass(spark, monkeypatch):
    """One word of 200 differs, so every chunk is linked with the first."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(200)]
    monkeypatch.setattr(simhash_text, "CHUNK", 10)
    left, met = [], []
    plain_left, plain_met = simhash_text._left_over, simhash_text._met
    monkeypatch.setattr(simhash_text, "_left_over", lambda *given: left.append(plain_left(*given)) or left[-1])
    monkeypatch.setattr(simhash_text, "_met", lambda *given: met.append(given[0]) or plain_met(*given))
    assert kept_ids(spark, texts) == [0]
    assert left[0].count() == 0
    rows = met[0].groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("others")).alias("dealt"))
    assert all(r.dealt <= 4 * r.n for r in rows.collect())  # in proportion, not one copy for each chunk


def test_short_texts_with_few_words_more_are_linked(spark):
    rng = np.random.default_rng(3)
    texts = []
    for words, more in ((8, 1), (9, 1), (16, 3)):
        for _ in range(300):
            base = [f"w{k}" for k in rng.integers(0, 10**9, words + more)]
            texts += [" ".join(base[:words]), " ".join(base)]
    assert kept_ids(spark, texts) == list(range(0, len(texts), 2))


def test_links_of_sets_are_brute_force():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 40, 120):
        base = rng.integers(0, 2**62, 30)
        sets = [np.unique(np.where(rng.random(30) < 0.08, rng.integers(0, 2**62, 30), base)) for _ in range(n)]
        a, b = simhash_text.similar_links(sets, 0.8)
        pairs = [(i, j) for i in range(n) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
        assert closure(n, zip(a, b)) == closure(n, pairs)
        assert len(a) == n - len(set(closure(n, pairs)))


def test_groups_of_edited_copies_near_the_threshold(spark):
    """300 groups of 10 texts with a block of words replaced in each: similarities around 0.8."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(300):
        base = [f"w{k}" for k in rng.integers(0, 10**9, 300)]
        for _ in range(10):
            run = int(rng.integers(11, 15))
            at = int(rng.integers(0, 300 - run))
            texts.append(" ".join(base[:at] + [f"n{k}" for k in rng.integers(0, 10**9, run)] + base[at + run :]))
    sets = [shingles(text) for text in texts]
    pairs = []
    for group in range(0, 3000, 10):
        for a in range(group, group + 10):
            for b in range(group, a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    pairs.append((a, b))
    groups = closure(3000, pairs)
    assert 1000 < len(set(groups)) < 3000 or len(pairs) > 5000
    assert kept_ids(spark, texts) == sorted(set(groups))


def test_leaves_do_not_grow_with_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    near = points[:4000] ^ (np.uint64(1) << rng.integers(0, 63, 4000).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long").repartition(8)
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    monkeypatch.setattr(simhash, "LEAF", 4_000)
    leaves = simhash.in_leaves(rows).toPandas()
    # The first tree has a dozen leaves or so; without trees of their own they hold tens of thousands.
    assert leaves.groupby("leaf").size().max() <= 2 * simhash.LEAF
    assert set(leaves.point) == set(points.view(np.int64).tolist())
    found = {frozenset((r.a, r.b)) for r in simhash.linked(rows).collect()}
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    have = closure(len(points), [tuple(at[x] for x in pair) for pair in found if len(pair) == 2])
    want = [(at[int(a)], at[int(b)]) for a, b in zip(near.view(np.int64), (near ^ near).view(np.int64)) if int(b) in at]
    order = np.sort(points)
    pairs = []
    for bit in range(64):  # pairs one bit apart; two or three bits apart do not occur by chance
        twins = order ^ (np.uint64(1) << np.uint64(bit))
        hit = np.isin(twins, order)
        pairs += [(at[int(a)], at[int(b)]) for a, b in zip(order[hit].view(np.int64), twins[hit].view(np.int64))]
    assert have == closure(len(points), pairs + want)


def test_chunks_of_a_dense_leaf_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = np.zeros(3000, np.uint64)
    for _ in range(4):
        dense ^= np.uint64(1) << rng.integers(0, 63, len(dense)).astype(np.uint64)
    points = np.unique(np.concatenate([dense, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "CHUNK", 300)
    monkeypatch.setattr(simhash, "LEAF", 600)
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    links = [(at[r.a], at[r.b]) for r in simhash.linked(rows).collect()]
    away = np.bitwise_count(points[:, None] ^ points[None, :])
    assert closure(len(points), links) == closure(len(points), zip(*np.nonzero(np.triu(away <= 3, 1))))


def brute_links(vectors):
    matrix = np.asarray(vectors, np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix @ matrix.T >= 0.95


def check_vectors(spark, vectors, least_recall=0.99, kind="float"):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")
    found = embedding_dedup.near_duplicates(df.repartition(4)).toPandas().sort_values("vec_id")
    links = brute_links(vectors)
    want = links.sum(axis=1) - 1
    got = found.n_links.to_numpy()
    assert (got <= want).all() and got.sum() >= least_recall * want.sum()
    groups = np.array(closure(len(vectors), zip(*np.nonzero(np.triu(links, 1)))))
    assert (found.component_id.to_numpy() == groups).mean() >= least_recall
    assert (found.kept == (found.vec_id == found.component_id)).all()


def test_vectors_with_small_samples_leaves_and_chunks(spark, monkeypatch):
    """Leaves with trees of their own, dense leaves, and chunks that meet, give the same links."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3000, 32))
    dense = rng.standard_normal(32) + rng.standard_normal((700, 32)) * 0.05
    edge = rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.22  # cosines around 0.95
    vectors = np.float32(np.concatenate([base, base[:500] + rng.standard_normal((500, 32)) * 0.1, dense, edge]))
    for name, value in (("SAMPLE", 300), ("LEAF", 150), ("CHUNK", 200)):
        monkeypatch.setattr(embedding_dedup, name, value)
    check_vectors(spark, vectors)


def test_vectors_of_the_table(spark, tables):
    for sf in ("sf0.01", "check_s"):
        table = tables("embeddings", sf).toPandas().sort_values("vec_id")
        found = embedding_dedup.near_duplicates(tables("embeddings", sf)).toPandas().sort_values("vec_id")
        links = brute_links(np.stack(table.embedding))
        assert found.n_links.sum() >= 0.99 * (links.sum() - len(links)) and (found.n_links <= links.sum(axis=1) - 1).all()


def test_vectors_of_doubles_and_repeated_ids(spark):
    rows = [(1, [1e-60, 2e-60]), (2, [1e-60, 2e-60]), (3, [1e200, 2e200]), (4, [-1.0, 0.5]), (4, [-2.0, 1.0]), (5, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert found == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True),
    ]


def test_hot_keys_give_the_same_join(spark, monkeypatch):
    left = spark.createDataFrame([(k % 7 if k % 3 else 100, k) for k in range(300)] + [(None, 1)], "key int, x int")
    right = left.where("key is not null and key <> 5").groupBy("key").agg({"*": "count"}).toDF("key", "n").selectExpr("key", "n", "key * 2 AS y")
    want = {how: sorted(map(str, left.join(right.drop("n"), "key", how).collect())) for how in ("inner", "left", "left_anti")}
    for few, hot in ((1000, 10), (3, 50), (0, 50), (5, 1), (0, 1000)):
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(common, "HOT", hot)
        for how, rows in want.items():
            assert sorted(map(str, common.joined(left, right, ["key"], "right", "n", how).collect())) == rows


def test_simhash_of_larger_tables_is_brute_force(tables):
    """Groups by all pairs of distinct fingerprints, block by block."""
    for sf in ("sf0.1", "check_h"):
        found = simhash.near_duplicates(tables("documents", sf)).toPandas()
        points, at = np.unique(np.array([int(x, 16) for x in found.fingerprint], np.uint64), return_inverse=True)
        pairs = []
        for begin in range(0, len(points), 2000):
            a, b = np.nonzero(np.bitwise_count(points[begin : begin + 2000, None] ^ points[None, :]) <= 3)
            pairs.append((a + begin, b))
        groups = simhash.local_components(len(points), pairs)
        least = found.assign(group=groups[at]).groupby("group").doc_id.min()
        assert (found.component_id.to_numpy() == least.loc[groups[at]].to_numpy()).all()


def exact_groups(rows):
    """Least doc_ids of groups of distinct texts, by an exact join: similar sets share one of
    their rarest shingles."""
    of_text = {}
    for doc_id, text in rows:
        of_text[text or ""] = min(doc_id, of_text.get(text or "", doc_id))
    texts = list(of_text)
    sets = [np.unique(simhash.shingle_hashes(text, 5)) for text in texts]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    index, pairs = {}, []
    for k in sorted(range(len(texts)), key=lambda k: len(sets[k])):
        own, n = sets[k], len(sets[k])
        rare = own[np.lexsort((own, counts[np.searchsorted(values, own)]))][: n - int(np.ceil(0.8 * n)) + 1].tolist()
        for other in {j for value in rare for j in index.get(value, ())} if n else ():
            common = len(np.intersect1d(own, sets[other], assume_unique=True))
            if common >= 0.8 * (n + len(sets[other]) - common):
                pairs.append((k, other))
        for value in rare if n else ():
            index.setdefault(value, []).append(k)
    least = {}
    for text, group in zip(texts, closure(len(texts), pairs)):
        least[group] = min(of_text[text], least.get(group, of_text[text]))
    return sorted(least.values())


def test_deduplicate_of_a_larger_table_is_an_exact_join(tables):
    rows = tables("documents", "sf0.1")
    kept = sorted(r.doc_id for r in simhash_text.deduplicate(rows).select("doc_id").collect())
    assert kept == exact_groups([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()])
