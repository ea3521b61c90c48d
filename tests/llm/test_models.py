import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sievework.llm import quality_rules, resampling, sharding, toxicity, url_filter


def in_sql(sql, sf="sf0.01"):
    names = ("documents", "pages")
    with_ = ", ".join(f"{name} AS (SELECT * FROM '/root/testdata/{sf}/{name}.parquet')" for name in names)
    return duckdb.sql(f"WITH {with_} {sql}").fetchall()


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_sharding(docs, no_docs, tables):
    for rows in (docs, tables("documents"), tables("documents", "sf0.01")):
        found = sharding.assign(rows).toPandas()
        assert len(found) == rows.count()
        bytes_of = found.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
        assert bytes_of.max() - bytes_of.min() <= found["size"].max()
        for _, slots in found.groupby("shard").slot:
            assert sorted(slots) == list(range(len(slots)))
        assert set(found.law) <= {"bytes"} and found.grown_shard.isna().all()
    whole = tables("documents", "sf0.01").select("doc_id", "text").toPandas().merge(found, on="doc_id")
    assert (whole.groupby("text").shard.nunique() > 1).mean() < 0.01
    assert sharding.assign(no_docs).count() == 0


def test_a_group_larger_than_a_shard_is_split_into_few(spark):
    rows = [(k, "hot text " * 5) for k in range(600)] + [(1000 + k, f"text {k} " * 5) for k in range(1200)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = found.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() / size.mean() < 1.02
    hot = found[found.doc_id < 600].groupby("shard").size()
    assert len(hot) <= 12  # the least is 8


def test_quality_counts(docs):
    assert quality_rules.repeated_words(b"a b c d e f g h".split() * 2) == 16
    assert quality_rules.repeated_words(b"a b c d e f g h".split()) == 0
    base, _ = quality_rules.measures("x #y\n\n x #y\nx #y\nx #y |")
    assert base == [9, 13, 5, 1, 0]
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for k in (0, 1, 2):
        assert rows[k].n_words == 0 and rows[k].base_failed and not rows[k].kept
    for r in rows.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def brute_repeats(words, width=8):
    windows = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({k + j for k, w in enumerate(windows) if w in twice for j in range(width)})


def test_repeats_are_brute_force():
    rng = np.random.default_rng(1)
    for n in (5, 9, 40, 120):
        for _ in range(20):
            words = [b"ab"[k : k + 1] for k in rng.integers(0, 2, n)]
            assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_quality_against_labels(tables):
    found = quality_rules.judge(tables("documents", "sf0.1")).toPandas().merge(tables("labels", "sf0.1").toPandas(), on="doc_id")
    found = found[~found.base_failed]
    assert found[found.quality == 1].kept.mean() > 0.98
    assert found[found.quality == 0].kept.mean() < 0.15


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables("documents", "sf0.1"), tables("labels", "sf0.1")
    half = "pmod(xxhash64(doc_id), 2) = "
    found = toxicity.score(docs, labels.where(half + "0")).toPandas()
    found = found.merge(labels.where(half + "1").toPandas(), on="doc_id")
    assert found[found.toxic == 1].rejected.mean() > 0.8
    assert found[found.toxic == 0].rejected.mean() < 0.02


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 3, 3000)
    rows = [[k for k in range(3) if rng.random() < (0.1, 0.5, 0.9)[g]] for g in grade]
    weights, cuts = toxicity.regress(np.array([len(r) for r in rows]), np.array([c for r in rows for c in r]), grade, 3)
    assert cuts[0] < cuts[1] and (weights > 0.5).all()


def test_models_take_awkward_rows(docs, no_docs, labels):
    for rows in (docs, no_docs):
        assert toxicity.score(rows, labels).count() == rows.count()
        assert toxicity.score(rows, labels.where("false")).where("rejected").count() == 0
        assert resampling.resample(rows, labels).count() == rows.count()
        assert resampling.resample(rows, labels.where("false")).where("not kept").count() == 0
        assert toxicity.clean(rows, labels).columns == rows.columns
        assert resampling.kept_rows(rows, labels).columns == rows.columns


def test_resampling_keeps_good_texts(tables):
    docs, labels = tables("documents", "sf0.1"), tables("labels", "sf0.1")
    half = "pmod(xxhash64(doc_id), 2) = "
    found = resampling.resample(docs, labels.where(half + "0")).toPandas()
    share = found.kept.mean()
    found = found.merge(labels.where(half + "1").toPandas(), on="doc_id")
    assert found[found.quality == 1].kept.mean() > 0.99
    assert found[found.quality == 0].kept.mean() < 0.25
    assert 0.8 < share < 0.95


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(500), rng.standard_normal(500) * 1e6, [1.5] * 50])
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    ordered = np.sort(values)[::-1]
    for k in (1, 7, 500, 525, 1049):
        assert resampling.kth_largest(df, k) == ordered[k - 1]
    assert resampling.kth_largest(df, 1050) == float("-inf")


def test_share_of_good_rows():
    assert resampling.good_share(0, 0) == 1.0
    assert 0.85 < resampling.good_share(850, 1000) < 0.9


def test_urls(spark):
    urls = [
        (0, "HTTPS://Sub.Example.ORG/es/x?q#f"), (1, "http://a.org/"), (2, "http://example.org/en/12"),
        (3, "http://x.com/de/1"), (4, "http://x.com/fr/1#z"), (5, "no scheme"), (6, None), (7, "http://notorg/x"),
        (8, "http://pokerlottery.example.net/en/1"), (9, "http://library.example.net/en/1"), (10, "x://y://z/w"),
        (11, "http://host?q=/a"), (12, "http://notexample.org/es/"),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS score")
    found = {r.page_id: r for r in url_filter.judge(df).collect()}
    want = {
        0: ("sub.example.org", "/es/x", "example.org/es/", "block"), 1: ("a.org", "/", "org/", "allow"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("x.com", "/de/1", "com/de/", "block"),
        4: ("x.com", "/fr/1", "com/fr/", "allow"), 5: ("", "", None, None), 6: ("", "", None, None),
        7: ("notorg", "/x", None, None), 8: ("pokerlottery.example.net", "/en/1", None, "block"),
        9: ("library.example.net", "/en/1", None, "allow"), 10: ("y:", "//z/w", None, None),
        11: ("host", "", None, None), 12: ("notexample.org", "/es/", "org/", "allow"),
    }
    for k, (host, path, rule, verdict) in want.items():
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule), k
        assert verdict is None or found[k].verdict == verdict
    assert url_filter.judge(df.where("false")).count() == 0


URL_SQL = """
, parts AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS rest FROM parts),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM split JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT s.page_id, host, path, rule, verdict FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND n = 1"""


def test_rules_of_whole_tables_are_those_of_sql(tables):
    for sf in ("sf0.001", "sf0.1"):
        found = url_filter.judge(tables("pages", sf)).toPandas()
        want = {row[0]: row[1:] for row in in_sql(URL_SQL, sf)}
        assert len(found) == len(want)
        for r in found.itertuples():
            host, path, rule, verdict = want[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def verdicts(weights, urls):
    return np.array([url_filter.score(weights, *url_filter.split_url(url)) > 0 for url in urls])


def test_subjects_that_the_table_lacks():
    """Hosts of unseen words, in shapes of their kind, and unseen pairs of seen words."""
    caught, false = [], []
    for bad, good in zip(url_filter.BLOCKED_WORDS, url_filter.ALLOWED_WORDS):
        weights = url_filter.train(url_filter.labelled_urls(without=(bad, good)))
        caught.append(verdicts(weights, url_filter._urls_of(url_filter.BLOCKED_WORDS[bad].split(), 1, common=False)).mean())
        false.append(verdicts(weights, url_filter._urls_of(url_filter.ALLOWED_WORDS[good].split(), 0, common=False)).mean())
    assert min(caught) >= 0.9 and max(false) <= 0.05
    weights = url_filter.train(url_filter.labelled_urls())
    seen = {url for url, _ in url_filter.labelled_urls()}
    for subjects, least, most in ((url_filter.BLOCKED_WORDS, 0.9, 1), (url_filter.ALLOWED_WORDS, 0, 0.05)):
        for names in subjects.values():
            pairs = [f"https://{a}{b}.com/" for a in names.split() for b in names.split() if a != b]
            assert least <= verdicts(weights, [url for url in pairs if url not in seen]).mean() <= most


def test_the_labelled_table_shares_no_word_with_the_tables(tables):
    ends = {"www", "m", "blog", "com", "net", "org", "en", "fr", "de"}
    words = {x for names in (*url_filter.BLOCKED_WORDS.values(), *url_filter.ALLOWED_WORDS.values()) for x in names.split()}
    hosts = {url_filter.split_url(r.url or "")[0] for sf in ("sf0.001", "sf0.01", "sf0.1") for r in tables("pages", sf).select("url").collect()}
    parts = {part for host in hosts for part in re.split("[^a-z]+", host)} - ends - {""}
    assert not parts & words
    assert not [word for word in words for part in parts if len(part) > 3 and part in word]


def test_long_and_repeated_urls(spark):
    urls = [(1, "https://a.com/" + "x" * 2_000_000), (2, "https://b.org/"), (2, "https://b.org/"), (None, None)]
    df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS verdict")
    found = url_filter.judge(df).collect()
    assert len(found) == 4 and [r.rule for r in found if r.page_id == 2] == ["org/"] * 2
    assert max(len(r.path) for r in found) == 2_000_001


def brute_measures(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_base_counts_are_brute_force(docs, no_docs, tables):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for rows in (docs, tables("documents"), tables("documents", "sf0.01")):
        want = sorted((r.doc_id, *brute_measures(r.text)) for r in rows.select("doc_id", "text").collect())
        assert rows_of(quality_rules.judge(rows), *names) == want
    assert quality_rules.judge(no_docs).count() == 0


def test_estimation_finds_rules_that_were_planted():
    rng = np.random.default_rng(9)
    n_rules, good = len(quality_rules.RULES), rng.random(20_000) < 0.7
    right = rng.uniform(0.75, 0.95, (2, n_rules))
    says_good = np.where(good[:, None], rng.random((20_000, n_rules)) < right[0], rng.random((20_000, n_rules)) > right[1])
    votes = np.where(rng.random((20_000, n_rules)) < 0.2, 0, np.where(says_good, 1, 2))
    share, found = quality_rules.estimate(votes, np.ones(len(votes)))
    assert abs(share - good.mean()) < 0.02
    assert np.abs(found[0] - right[0]).max() < 0.02 and np.abs(found[1] - (1 - right[1])).max() < 0.03
    assert ((quality_rules.posterior(votes, share, found) > 0.5) == good).mean() > 0.97


def test_shards_of_whole_tables_against_sql_and_the_least_cut(tables):
    sizes = "SELECT doc_id, coalesce(strlen(text), 0) + 8 FROM documents"
    for sf in ("sf0.001", "sf0.01"):
        rows = tables("documents", sf)
        found = sharding.assign(rows)
        assert rows_of(found, "doc_id", "size") == sorted(in_sql(sizes, sf))
        text_of = {r.doc_id: r.text for r in rows.collect()}
        for r in found.collect():
            assert r.text_crc32 == zlib.crc32((text_of[r.doc_id] or "").encode())
        # Brute force: groups that fit into a shard need not be cut at all.
        place = {r.doc_id: r.shard for r in found.collect()}
        shards = {}
        for doc_id, text in text_of.items():
            if text is not None:
                shards.setdefault(text, set()).add(place[doc_id])
        cut = [text for text, where in shards.items() if len(where) > 1]
        room = sum(len((text or "").encode()) + 8 for text in text_of.values()) / sharding.SHARDS
        members = Counter(text_of.values())
        assert not [text for text in cut if members[text] * (len(text.encode()) + 8) < room / 2]


def test_hashed_models_are_sums(spark, tables):
    """The model's counts and a text's weight, against plain sums."""
    rows = tables("documents").where("doc_id < 60")
    hashed = resampling.Hashed(resampling.BUCKETS)
    counts = np.ones(resampling.BUCKETS)
    for r in rows.collect():
        tokens = [zlib.crc32(t.encode()) for t in resampling._TOKEN.findall(r.text or "")]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) % 2**64) >> 7 for a, b in zip(tokens, tokens[1:])]
        for value in tokens + pairs:
            counts[value % resampling.BUCKETS] += 1
        assert sorted(hashed(r.text or "").tolist()) == sorted(v % resampling.BUCKETS for v in tokens + pairs)
    assert np.allclose(resampling.model(rows), np.log(counts / counts.sum()))


def test_expected_grades_are_sums_of_sigmoids():
    model = toxicity.Ordinal({"bad": 1.5, "^awf": 0.5}, [1.0, 2.0])
    for text, x in (("", 0.0), ("bad bad", 1.5), ("awful bad", 2.0), ("awf", 0.5), ("good", 0.0)):
        assert model.scorer()(text) == pytest.approx(sum(1 / (1 + np.exp(t - x)) for t in (1.0, 2.0)))


def test_contradicting_labels_have_a_rule(spark):
    docs = spark.createDataFrame([(k, f"text {k} bad" if k % 2 else f"text {k} good") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    against = labels.selectExpr("doc_id", "1 AS quality", "0 AS toxic").where("doc_id % 2 = 1")
    for given in (labels.unionByName(against), against.unionByName(labels)):
        found = toxicity.score(docs, given).toPandas()
        assert (found.rejected == (found.doc_id % 2 == 1)).all()
        first = resampling.resample(docs, given).toPandas().sort_values("doc_id").log_weight.to_numpy()
        assert np.allclose(first, resampling.resample(docs, labels).toPandas().sort_values("doc_id").log_weight.to_numpy())
