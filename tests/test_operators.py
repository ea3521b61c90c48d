"""Operators on DataFrames: samplers, readers and writers, flows, judges, streams."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from sievework import schemas, streaming
from sievework.functions import columns as C
from sievework.functions import udfs
from sievework.operators import features, filtering, joining, judging, preparing, reports, sampling, scoring
from sievework.plans import flows
from sievework.sources import generators, readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"t{k:03d}", "JSON" if k % 3 else "TOML", f"f|X|k|{k % 7 if k < 60 else 'rare'}") for k in range(62)]
    return spark.createDataFrame(data, "task_id string, output_type string, task_key string")


def ids(df):
    return sorted(r.task_id for r in df.select("task_id").collect())


# --- Sampling -------------------------------------------------------------------------


def test_ranks_are_gapless_and_stable(rows):
    found = sampling.ranked(rows, ["task_key"], 1, "task_id")
    again = sampling.ranked(rows.repartition(7), ["task_key"], 1, "task_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    for (_,), group in found.toPandas().groupby(["task_key"]):
        assert sorted(group["rank"]) == list(range(1, len(group) + 1))
        assert (group["size"] == len(group)).all()
    other = sampling.ranked(rows, ["task_key"], 2, "task_id")
    assert sorted(map(tuple, found.collect())) != sorted(map(tuple, other.collect()))


@pytest.mark.parametrize(("strategy", "fixed", "each"), [("min", None, 2), ("max", None, 9), ("fixed_n", 20, 20)])
def test_balanced_groups_repeat_in_turn(rows, strategy, fixed, each):
    found = sampling.balanced(rows, "task_key", strategy, fixed).toPandas()
    for _, group in found.groupby("task_key"):
        assert len(group) == each
        times = group.task_id.value_counts()
        assert times.max() - times.min() <= 1


def test_faulty_strategies(rows):
    with pytest.raises(ValueError):
        sampling.balanced(rows, strategy="median")
    with pytest.raises(ValueError):
        sampling.balanced(rows, strategy="fixed", fixed=0)


def test_targets():
    for value in (None, "all", "*", "-1", True, False, -3):
        assert sampling.target(value) is None
    assert sampling.target(3.9) == 3 and sampling.target(" 12 ") == 12 and sampling.target(0) == 0
    for value in ("many", [1]):
        with pytest.raises(ValueError):
            sampling.target(value)


def test_family_targets_and_their_order(spark):
    data = [(f"{f}{t}{k}", f, t, None) for f in ("one", "two") for t in ("JSON", "XML") for k in range(10)]
    df = spark.createDataFrame(data, "task_id string, task_family string, output_type string, task_key string")
    families = {"One": {"targets": {"json": 3}, "default_target": 1}, "other": {"targets": {"XML": 2}}}
    found = sampling.per_family(df, families, {"XML": 4}, 5)
    counts = {(r.task_family, r.output_type): r["count"] for r in found.groupBy("task_family", "output_type").count().collect()}
    assert counts == {("one", "JSON"): 3, ("one", "XML"): 4, ("two", "JSON"): 5, ("two", "XML"): 2}


def test_splits_are_disjoint(rows):
    for split in (sampling.training_split(rows.withColumn("output", F.lit("x")), 0.1), sampling.task_split(rows, 0.1)):
        train, valid = map(ids, split)
        assert not set(train) & set(valid) and len(train) + len(valid) == 62 and len(valid) == 6
    train, valid = sampling.task_split(rows.limit(1), 0.1)
    assert train.count() == 0 and valid.count() == 1


def test_limits(rows):
    assert ids(sampling.limited(rows, 5)) == [f"t{k:03d}" for k in range(5)]
    assert sampling.limited(rows, 0).count() == 62
    seeded = ids(sampling.limited(rows, 5, seed=3))
    assert seeded == ids(sampling.limited(rows.repartition(5), 5, seed=3)) != [f"t{k:03d}" for k in range(5)]
    assert sampling.limited_per_type(rows, 4, ["TOML"], seed=1).count() == 4


def test_selection_modes(rows):
    base = rows.withColumn("task_family", F.lit("f"))
    assert sampling.selected(base, sampling.Selection()).count() == 62
    balanced = sampling.Selection(mode="balance_by_task", least=3)
    assert sampling.selected(base, balanced).count() == 7 * 8
    assert sampling.selected(base, balanced.with_environment({"BALANCE_STRATEGY": "fixed", "BALANCE_FIXED_N": "2"})).count() == 14
    per_type = sampling.Selection(mode="per_output_type", targets={"JSON": 3, "TOML": 2})
    assert sampling.selected(base, per_type).count() == 5
    assert sampling.source_block({"online_dataset": {"use": False}, "offline_dataset": {"use": True}}) == "offline"
    assert sampling.source_block({}) == "legacy" and sampling.source_block({}, "online") == "online"


def test_steps_and_draws():
    assert sampling.steps(101, 4, 5, 2.0) == {"effective_batch": 20, "steps_per_epoch": 6, "total_steps": 12}
    space = {"a": {"values": [1, 2]}, "b": {"type": "log_uniform", "low": 1e-5, "high": 1e-3}, "c": {"type": "int", "low": 1, "high": 3}}
    draw = sampling.drawn(space, 1)
    assert draw == sampling.drawn(space, 1) and 1e-5 <= draw["b"] <= 1e-3 and draw["c"] in (1, 2, 3)


# --- Sources --------------------------------------------------------------------------


def test_json_lines_round_trip(spark, tmp_path):
    text = 'title = "a \\"quoted\\" word"\nnext = 1 é'
    df = spark.createDataFrame([("q", text, None)], "query string, output string, output_type string")
    path = str(tmp_path / "rows")
    writers.json_lines(df, path)
    raw = "".join(open(os.path.join(path, n), encoding="utf-8").read() for n in os.listdir(path) if n.startswith("part"))
    assert "é" in raw and '"output_type":null' in raw
    assert readers.json_lines(spark, path, schemas.SFT_ROW).first().output == text


def test_bad_lines(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    open(path, "w").write('{"task_id": "a", "generation": "x"}\n\n{broken\n')
    assert readers.json_lines(spark, path, schemas.INFERENCE_ROW, lenient=True).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, path, schemas.INFERENCE_ROW).collect()


def test_json_arrays(spark, tmp_path):
    path = str(tmp_path / "tasks.json")
    json.dump([{"task_id": "a", "generation": "x"}, {"task_id": "b"}], open(path, "w"))
    assert readers.records(spark, path, "structeval-t", schemas.INFERENCE_ROW).count() == 2
    with pytest.raises(ValueError):
        readers.records(spark, path, "parquet", schemas.INFERENCE_ROW)
    made = str(tmp_path / "made.json")
    assert writers.json_array(spark.range(3).toDF("task_id"), made, indent=2) == 3
    assert [x["task_id"] for x in json.load(open(made))] == [0, 1, 2]
    with pytest.raises(ValueError):
        writers.json_array(spark.range(3), made, most=2)


def test_files_and_paths(tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("b.jsonl", "a.jsonl", "c.txt", "e/z.jsonl"):
        (tmp_path / "d" / name).write_text("")
    found = readers.data_files([str(tmp_path / "d" / "b.jsonl"), str(tmp_path / "d")], ".jsonl")
    assert [os.path.basename(x) for x in found] == ["b.jsonl", "a.jsonl", "z.jsonl"]
    assert readers.first_existing([None, str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    assert readers.file_format_for("x.json", "jsonl") == "structeval_json"
    assert readers.file_format_for(None, "jsonl") == "jsonl"
    assert readers.split_name("train", ["test"]) == "test"
    with pytest.raises(ValueError):
        readers.split_name("dev", ["test"])


def test_summaries(spark, tmp_path):
    stats = spark.createDataFrame([("d", "XML", "xml_amp", 2, 1, 1, 1, 3, 2)], schemas.ESCAPE_STATS)
    writers.csv_with_header(stats, str(tmp_path / "csv"), stats.columns)
    found = readers.csv_summaries(spark, str(tmp_path / "csv"))
    assert found.first().occurrences_total == 3 and found.first().source_file.endswith(".csv")
    writers.csv_with_header(stats.drop("format"), str(tmp_path / "less"), [c for c in stats.columns if c != "format"])
    with pytest.raises(ValueError, match="format"):
        readers.csv_summaries(spark, str(tmp_path / "less"))
    run = tmp_path / "runs" / "20240101_000000_sft_abc"
    run.mkdir(parents=True)
    (run / "a.summary.json").write_text('{"n": 3, "avg_final_eval_score": 0.5}')
    (run / "b.summary.json").write_text("{broken")
    runs = readers.run_summaries(spark, str(tmp_path / "runs"))
    assert [(r.run_id, r.stage, r.n) for r in runs.collect()] == [("20240101_000000_sft_abc", "sft", 3)]
    assert reports.run_stats(runs).first().best == 0.5


def test_experiments(spark, tmp_path):
    path = str(tmp_path / "e.csv")
    open(path, "w").write("file,how,score\na,base_model,80\nb,sft,95\n")
    base, others = readers.experiments(spark, path, {"how": "method"}, [("file", "b", "score", "96")])
    assert base.count() == 1 and others.first().score == "96"


def test_writers(spark, tmp_path, rows):
    writers.by_task(rows, str(tmp_path / "tasks"))
    assert any(name.startswith("task_dir=") for name in os.listdir(tmp_path / "tasks"))
    writers.by_column(rows, str(tmp_path / "types"), "output_type")
    writers.append_lines(rows, str(tmp_path / "log"))
    writers.append_lines(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 124
    pseudo = spark.createDataFrame([("a", (True,)), ("", (True,)), ("b", (False,))], "output string, meta struct<parse_ok:boolean>")
    writers.valid_lines(pseudo, str(tmp_path / "valid"))
    assert spark.read.json(str(tmp_path / "valid")).count() == 1
    folder = writers.run_folder(str(tmp_path), "sft", "abc", "x")
    assert re.search(r"/\d{8}_\d{6}_sft_abc_x$", folder)
    assert "task_id:\nt000" in writers.shown(rows.orderBy("task_id"), 1)
    writers.scored(rows, rows.agg(F.count("*").alias("n")), str(tmp_path / "scored"))
    writers.failures(rows, F.col("output_type") == "TOML", str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 21


def test_generators(spark):
    assert generators.tasks(spark, 4, ["json", "csv"]).orderBy("task_id").first().task_id == "000500"
    found = generators.training_rows(spark, 20)
    assert found.where(~udfs.article_checks(F.col("output"))["authors_items_ok"]).count() == 0
    seeds = spark.createDataFrame([(i, o) for i, _, _, o in generators.NESTED_TOML], "i string, o string")
    assert seeds.where(C.has_deep_toml("o")).count() == len(generators.NESTED_TOML)


# --- Plans ----------------------------------------------------------------------------


def test_one_python_node_for_a_filtered_struct(spark, capsys):
    df = spark.range(5).select(F.lit("{}").alias("t"))
    df.withColumn("p", udfs.parse("t", F.lit("JSON"))).where("p.ok").select("p.ok", "p.used").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_scores_are_one_python_pass(spark, capsys):
    scoring.evaluated(generators.completions(spark.read.parquet(f"{SF}/part.parquet"))).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") <= 3


def test_projection_reaches_the_scan(spark, capsys):
    reports.by_type(spark.read.parquet(f"{SF}/documents.parquet").select(F.upper("lang").alias("output_type"), F.lit(None).cast("string").alias("task_key"))).explain()
    assert "ReadSchema: struct<lang:string>" in capsys.readouterr().out


# --- Flows ----------------------------------------------------------------------------

META = "format type schema complexity prompt output final_output answer gold target".split()


def chat_rows(spark):
    def meta(**given):
        return tuple(given.get(name) for name in META)

    turns = [("system", "S"), ("user", "U"), ("assistant", "a: 1")]
    data = [
        ("chat-a/x", turns, meta(format="TOML", type="Gen", schema="s", prompt="Write TOML", output='Output:\n{"b": 1, "a": 2}')),
        ("chat-a/x", turns, meta(format="JSON", prompt="Write JSON", output="{broken")),
        ("chat-a/x", turns, meta(format="JSON", output="{}")),
        ("chat-b/y", [("user", "Write YAML"), ("assistant", "Sure\na: 1")], meta(format="yml")),
        ("chat-b/y", [("user", "Convert from JSON to YAML:\n{\"a\": 1}"), ("assistant", "a: 2")], meta(format="YAML")),
    ]
    return spark.createDataFrame(data, f"dataset string, {schemas.CHAT_WITH_METADATA}")


def test_import_flow(spark):
    found = flows.imported(chat_rows(spark)).orderBy("output").collect()
    kept = {(r.query, r.output, r.output_type) for r in found if r.keep}
    assert kept == {("Write TOML", "a = 2\nb = 1\n", "TOML"), ("Write YAML", "a: 1", "YAML")}
    assert [r.reason for r in found if not r.keep] == ["equiv_fail:semantic_mismatch"]
    assert {r.task_key for r in found if r.keep} == {"a|TOML|gen|s", "b|YAML|unknown|unknown"}
    selected = flows.training_rows(chat_rows(spark), sampling.Selection(mode="per_output_type", targets={"TOML": 1}, default=0))
    assert [r.output_type for r in selected.collect()] == ["TOML"] and selected.first().task_id.startswith("hf_")


def test_supplement_in_the_import(spark):
    query = flows.imported(chat_rows(spark), supplement=True).where("output_type = 'TOML'").first().query
    assert query.startswith("Write TOML\n\n---\n") and "TASK_KEY: a|TOML|gen|s" in query


def test_analysis_flow(spark):
    made = flows.analysed(chat_rows(spark))
    stats = {r.task_key: r for r in made.tasks.collect()}
    assert sum(r.total for r in stats.values()) == 5
    assert made.escapes.where("format = 'YAML'").count() == 9
    assert made.toml.first().avg_table_headers == 0.0


def test_score_flow(spark):
    tasks = generators.completions(spark.read.parquet(f"{SF}/part.parquet")).withColumn("task_id", F.col("id"))
    found, summary = flows.scored(tasks, seed=1, limit=20)
    assert found.count() == 20 and summary.first().n == 20
    empty = flows.scored(tasks.where("false"))[1].first()
    assert (empty.n, empty.avg_final_eval_score) == (0, 0.0)


def test_bundles_end_with_the_shorter_list(spark):
    df = spark.createDataFrame(
        [("d", [[("user", "a")], [("user", "b")]], [("x",) + (None,) * 9])], f"dataset string, {schemas.CHAT_BUNDLED}"
    )
    found = preparing.unbundled(df).collect()
    assert [(r.part, r.messages[0].content, r.metadata.format) for r in found] == [(0, "a", "x")]


def test_offline_flow_and_tasks(spark):
    data = [("q", "[a.b.c]\nx = 1", "TOML"), ("q\nATTRIBUTES: k", "x = 1", "TOML"), ("q", "{}", "JSON"), ("", "x", "JSON")]
    df = spark.createDataFrame(data, "query string, output string, output_type string")
    wide = df.select(
        "*",
        F.lit(None).cast(f"array<{schemas.MESSAGE}>").alias("messages"),
        F.lit(None).cast(schemas.METADATA).alias("metadata"),
        F.lit(None).cast("struct<grammar:struct<ok:boolean>,usable:boolean>").alias("evaluation"),
    )
    assert flows.offline_training_rows(wide, 3).count() == 2
    tasks = preparing.training_to_tasks(flows.offline_training_rows(wide))
    assert sorted(map(len, (r.raw_output_metric for r in tasks.collect()))) == [0, 0, 1]


def test_usable_rows(spark):
    df = spark.createDataFrame([("a", (True,)), ("b", (False,)), ("c", None), (" ", (True,))], "output string, meta struct<parse_ok:boolean>")
    assert [r.output for r in filtering.usable_rows(df).collect()] == ["a", "c"]


def test_rare_groups_and_missing_keys(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] + [("b",)] * 2, "task_key string")
    assert filtering.frequent_groups(df, 2).count() == 5
    assert filtering.frequent_groups(df, 1).count() == 6


# --- Judges and features --------------------------------------------------------------


def test_judges():
    def bad(task, text):
        raise RuntimeError("no")

    def good(task, text):
        return judging.Answer(0.5, True, {})

    assert judging.first_success([bad, good])({}, "x").score == 0.5
    with pytest.raises(judging.JudgeFailed):
        judging.first_success([bad])({}, "x")
    waits = []
    with pytest.raises(RuntimeError):
        judging.with_retries(bad, 3, 1.0, waits.append)({}, "x")
    assert waits == [1.0, 2.0]
    made = judging.make_judges({"providers": ["a", {"name": "b", "x": 2}, "none"], "x": 1}, {"a": lambda s: s["x"], "b": lambda s: s["x"]})
    assert made == [1, 2]
    assert judging.reply('{"score": 3, "passed": true}').score == 1.0


def test_judging_through_the_cache(spark):
    records = spark.createDataFrame([("t1", "g", "k1"), ("t2", "bad", "k2"), ("t3", "g", "k1")], "task_id string, generation string, cache_key string")

    def client():
        def ask(task, text):
            if text == "bad":
                raise RuntimeError("down")
            return judging.Answer(1.0, True, {"n": 1})

        return ask

    empty = spark.createDataFrame([], schemas.JUDGE_CACHE)
    missed = judging.misses(records, empty, "p", "m")
    assert missed.count() == 2
    cache = judging.upsert(empty, judging.asked(missed, client, "p", "m"))
    base = records.select("*", F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.lit("").alias("details"))
    found = {r.task_id: r for r in judging.refreshed(base, cache, "p", "m").collect()}
    assert found["t1"].score == found["t3"].score == 1.0 and found["t2"].score == 0.0 and "down" in found["t2"].details


def test_teacher_and_buckets(spark):
    prompts = spark.createDataFrame([("s", "ok"), ("s", "fail")], "system string, prompt string")

    def client():
        def make(system, prompt):
            if prompt == "fail":
                raise RuntimeError("x")
            return "{}"

        return make

    found = judging.generated(prompts, client).withColumn("bucket", reports.attempt_bucket(F.lit(True), F.col("generation"), F.col("error")))
    assert sorted(r.bucket for r in found.collect()) == ["errors", "ok"]


def test_labels_and_padding(spark):
    df = spark.createDataFrame([("USER:", "OK", 0), ("a", "b", 0)], "prompt string, target string, batch int")
    made = df.select("batch", *features.features(features.code_points("prompt"), features.code_points("target"), 100))
    found = features.padded(made, pad=9, batch="batch").orderBy(F.desc(F.col("input_ids")[1])).collect()
    first = found[0] if found[0].input_ids[0] == ord("U") else found[1]
    second = found[1] if first is found[0] else found[0]
    assert first.labels == [-100] * 5 + [ord("O"), ord("K")]
    assert second.labels == [-100, ord("b")] + [-100] * 5
    assert second.attention_mask == [1, 1, 0, 0, 0, 0, 0] and second.input_ids[2:] == [9] * 5
    ids_ = df.select(features.tokens(lambda text: [len(text)])(F.col("prompt")).alias("x")).collect()
    assert [r.x for r in ids_] == [[5], [1]]


def test_missing_generations_and_types(spark):
    tasks = spark.createDataFrame([("a", "JSON"), ("b", "yml"), ("c", "HTML")], "task_id string, output_type string")
    made = spark.createDataFrame([("a", "{}"), ("c", "x"), ("z", "x")], "task_id string, generation string")
    found = {r.task_id: (r.ok, r.error_kind) for r in joining.checked(tasks, made).collect()}
    assert found == {"a": (True, None), "b": (False, "MissingInference"), "c": (False, "UnsupportedType")}
    assert joining.orphans(made, tasks).count() == 1


def test_advantage_of_a_single_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "prompt string, reward double")
    found = {(r.prompt, r.reward): (round(r.advantage, 4), r.near_zero) for r in scoring.advantages(df).collect()}
    assert found == {("a", 1.0): (0.0, True), ("b", 1.0): (-0.7071, False), ("b", 3.0): (0.7071, False)}


def test_canonical_repairs_are_idempotent(spark):
    df = spark.createDataFrame([("b = 1\na = 2", "TOML")], "output string, output_type string")
    once = filtering.canonical_toml_rows(df)
    assert once.collect() == filtering.canonical_toml_rows(once).collect()


# --- Streams --------------------------------------------------------------------------


def test_scores_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [
        {"task_id": "a", "output_type": "JSON", "generation": "{\"x\": 1}", "raw_output_metric": ["x"], "ts": "2024-01-01T00:01:00"},
        {"task_id": "b", "output_type": "JSON", "generation": "{", "raw_output_metric": ["x"], "ts": "2024-01-01T00:02:00"},
    ]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = streaming.scores(streaming.first_of_each(streaming.generations(spark, str(folder))))
    run = stream.writeStream.format("memory").queryName("scores_out").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.final_eval_score for r in spark.table("scores_out").collect()) == [0.0, 1.0]
    rates = streaming.rates(streaming.scores(streaming.generations(spark, str(folder))))
    run = rates.writeStream.format("memory").queryName("rates_out").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.n, r.syntax_rate) for r in spark.table("rates_out").collect()] == [(2, 0.5)]
