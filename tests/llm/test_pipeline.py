import numpy as np
from test_duplicates import brute_fingerprint, closure, shingles

import corpus_pipeline
from sievework.llm import common, queries


def test_stages_and_queries():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "simhash near-dedup", "best-fit packing"]
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 11)]


def test_pipeline_runs_and_keeps_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns
        assert 0.5 * before < rows.count() <= before
    left = {r.doc_id for r in rows.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left


def test_stages_take_awkward_rows(spark, docs, no_docs):
    for given in (docs, no_docs):
        rows = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "/root/testdata/sf0.001")
            assert rows.columns == given.columns
            rows.count()


def test_run_takes_awkward_and_empty_tables(spark, docs, no_docs, labels, tmp_path):
    for name, given in (("awkward", docs), ("empty", no_docs)):
        folder = tmp_path / name
        given.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(folder))
        assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (rows.count() > 0) == (name == "awkward")


def test_tables_of_few_parts_are_dealt(spark, docs, no_docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = common.texts_table(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.columns == docs.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))
    no_docs.write.parquet(str(tmp_path / "none.parquet"))
    assert common.texts_table(spark, str(tmp_path), "none").count() == 0


def test_near_copies_are_those_of_fingerprints_and_of_shingle_sets(spark, docs, no_docs):
    """Groups by all pairs: op7's fingerprints 3 bits apart or less, and similar shingle sets."""
    rng = np.random.default_rng(17)

    def edited(words, times):
        words = list(words)
        for at in rng.choice(len(words), times, replace=False):
            words[at] = f"n{rng.integers(0, 10**9)}"
        return words

    texts = []
    for _ in range(250):
        base = [f"w{k}" for k in rng.integers(0, 10**9, 200)]
        other = edited(base, 6)  # below 0.8
        texts += [" ".join(words) for words in (base, other, edited(other, 2))]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rows in (made, docs, no_docs):
        given = [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]
        distinct = sorted({text for _, text in given})
        prints, sets = [brute_fingerprint(text) for text in distinct], [shingles(text) for text in distinct]
        close, similar = [], []
        for a in range(len(distinct)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    close.append((a, b))
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    similar.append((a, b))
        group = dict(zip(distinct, closure(len(distinct), close + similar)))
        want = {}
        for doc_id, text in given:
            want[group[text]] = min(want.get(group[text], doc_id), doc_id)
        kept = corpus_pipeline.drop_near_copies(spark, rows, "")
        assert kept.columns == rows.columns
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want.values())
        if rows is made:  # each kind of link joins groups that the other leaves apart
            n_groups = len(set(group.values()))
            assert n_groups < len(set(closure(len(distinct), close)))
            assert n_groups < len(set(closure(len(distinct), similar)))
