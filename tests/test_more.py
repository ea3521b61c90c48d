"""Trainer callables, settings, teachers' rows, and zipped Arrow files."""

import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework import settings
from sievework.functions import scores
from sievework.operators import sampling, scoring, teaching
from sievework.sources import generators, readers, writers

SF = "/root/testdata/sf0.001"
CONFIG = {
    "w_parse_xml": 2.0,
    "w_match": 1.5,
    "w_match_soft": 0.5,
    "p_extraneous": -0.25,
    "p_extraneous_csv": -0.75,
    "p_only_json_fail": -2.0,
    "w_yaml_indent_canonical": 0.3,
    "p_yaml_block_style_fail": -0.4,
    "w_toml_canonical_soft": 0.2,
    "p_toml_canonical_soft_scale": -0.6,
    "p_toml_canonical_fail": -0.1,
    "w_no_extra_keys": 0.05,
}


def test_rewards_agree_natively_and_by_the_callable(spark):
    rows = generators.completions(spark.read.parquet(f"{SF}/part.parquet")).withColumn("reference_output", F.col("body"))
    for paths in (F.col("raw_output_metric"), F.lit(None).cast("array<string>")):
        found = scoring.rewarded(rows.withColumn("raw_output_metric", paths), CONFIG, "generation").collect()
        want = scores.reward_function(CONFIG)(
            [""] * len(found),
            [r.generation for r in found],
            raw_output_metric=[r.raw_output_metric for r in found],
            output_type=[r.output_type for r in found],
            batch={"reference_output": [r.reference_output for r in found]},
        )
        assert [r.reward for r in found] == pytest.approx(want)


def test_reward_columns_may_be_single_values():
    run = scores.reward_function({})
    assert run(["p"], ['{"a": 1}'], output_type="JSON") == [1.5]
    assert run(["p"], ["{"]) == [-3.0]
    assert run(["p"], ['{"a": 1}'], raw_output_metric=[["a", "b"]]) == [pytest.approx(0.6)]


def test_settings(tmp_path):
    path = str(tmp_path / "c.yaml")
    settings.save(path, {"a": {"b": 1}, "c": "é"})
    config = settings.load(path)
    assert settings.overridden(config, {"a.b": 2, "c.d.e": 3}) == {"a": {"b": 2}, "c": {"d": {"e": 3}}}
    assert config == {"a": {"b": 1}, "c": "é"}


def test_pseudo_rows(spark, tmp_path):
    attempts = spark.createDataFrame(
        [(" Q ", "json", "t", 0, ["a"], "P", 'x {"a": 1}', ""), ("Q", "toml", "t", 1, [], "P", "=", None)],
        "query string, output_type string, task_id string, variant int, raw_output_metric array<string>, prompt string, "
        "generation string, error string",
    )
    rows = teaching.pseudo_rows(attempts, "bench", "m", "stub")
    found = {r.meta.variant_id: r for r in rows.collect()}
    assert found[0].instruction == "Q" and json.loads(found[0].output) == {"a": 1}
    assert found[0].meta.parse_ok and not found[0].meta.syntax_strict_ok
    assert found[1].output == "" and found[1].meta.parse_error
    writers.valid_lines(rows, str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1


def test_first_rows_before_the_shuffle(spark):
    rows = spark.range(50).toDF("task_id")
    found = [r.task_id for r in sampling.first_then_shuffled(rows, 10, 3).collect()]
    assert sorted(found) == list(range(10)) and found != list(range(10))
    assert sampling.first_then_shuffled(rows, None, 3).count() == 50


def test_zipped_arrow(spark, tmp_path):
    table = pa.table({"x": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "d-train.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as archive:
        archive.write(tmp_path / "d-train.arrow", "inner/d-train.arrow")
    found = readers.zipped_arrow(spark, str(tmp_path / "d.zip"), "train", str(tmp_path / "out"))
    assert found.agg(F.sum("x")).first()[0] == 6
    with pytest.raises(FileNotFoundError):
        readers.zipped_arrow(spark, str(tmp_path / "d.zip"), "test", str(tmp_path / "none"))


def test_soft_matches_are_those_of_the_kernel(spark):
    from sievework.plans import queries as plans

    rows = generators.completions(spark.read.parquet(f"{SF}/part.parquet")).select("id", "generation", "output_type", "body").collect()
    found = {r.id: r for r in plans.queries()["reward_soft_matches"](spark, SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        want = scores.components(r.generation, r.output_type, r.body)
        assert (found[r.id].match, found[r.id].match_soft) == (want["match"], round(want["match_soft"], 6))


def test_places_follow_the_work_order(spark, monkeypatch):
    from sievework.operators import preparing

    monkeypatch.setattr(sampling, "SLICE_ROWS", 10)
    tasks = spark.createDataFrame([(k, ["csv", "json", "odd", None][k % 4]) for k in range(90)], "task_id long, output_type string")
    rows = preparing.variants_of(tasks, 3)
    placed = preparing.work_places(rows).orderBy("place").collect()
    ordered = rows.orderBy(*preparing.work_order(rows)).collect()
    assert [r.place for r in placed] == list(range(1, 271))
    known = [(r.task_id, r.variant) for r in placed if r.output_type]
    assert known == [(r.task_id, r.variant) for r in ordered if r.output_type]


def test_both_yaml_loaders_agree():
    import yaml

    from sievework.functions import formats

    texts = [
        "a: 1\nb: [x, 'y', 2.50, 0x1f, 1e3, yes, ~]", "a: b: c", "- 1\n-  - 2\n - 3", "\tx: 1", "x:\ty", "'it''s'", '"\\u00e9\\x41"', "a: |\n  b\n  c\n",
        "? k\n: v", "&a x: *a", "a: 2020-01-01", "{a: [1, 2}", "--- 1\n--- 2", "", "%YAML 1.2\n---\na", "a: !!python/object:x 1", "k: >\n folded\n text", "\u2028a: 1",
    ]
    for text in texts:
        plain, mixed = formats.attempt(yaml.safe_load, text), formats.attempt(formats.READERS["YAML"].read, text)
        assert plain == mixed, text


def test_strict_lines_name_the_bad_one(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n{"a": "x"}\n')
    assert [(r.line, r.text) for r in readers.bad_lines(spark, str(path), "a long").orderBy("line").collect()] == [(4, '{"a": '), (5, '{"a": "x"}')]
    with pytest.raises(ValueError, match="a.jsonl:4"):
        readers.checked_json_lines(spark, str(path), "a long")
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.checked_json_lines(spark, str(path), "a long").count() == 2
