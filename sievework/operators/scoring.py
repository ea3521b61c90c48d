"""Scores and rewards of generations, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import reward_type, safe_div, text
from ..functions.scores import EXTRA_KEY, WEIGHTS, weight


def scored(rows: DataFrame, generation: str = "generation", paths: str = "raw_output_metric", kind: str = "output_type") -> DataFrame:
    """Adds the five fields of the key score; each generation is parsed once."""
    return rows.withColumn("_score", udfs.key_score(F.col(generation), F.col(paths), F.col(kind))).select(
        *rows.columns, "_score.*"
    )


def share_found(found: Column) -> Column:
    """The share of true values, 0 of an empty array."""
    hits = F.aggregate(found, F.lit(0), lambda total, x: total + x.cast("int"))
    return safe_div(hits, F.size(found))


def with_components(
    rows: DataFrame,
    generation: str = "generation",
    kind: str = "output_type",
    reference: str | None = "reference_output",
    allowed: set[str] | None = None,
    schema: dict[str, Any] | None = None,
) -> DataFrame:
    """Adds the reward components of each completion, and those that carry its format's name."""
    gold = F.col(reference) if reference else F.lit(None).cast("string")
    made = udfs.reward_components(allowed, schema)(F.col(generation), F.col(kind), gold)
    staged = rows.withColumn("_parts", made).select(*rows.columns, "_parts.*")
    json = reward_type(kind) == "JSON"
    return staged.withColumns(
        {
            "parse_json": F.when(json, F.col("parse")).otherwise(0.0),
            "parse_json_best_effort": F.when(json, F.col("parse_best_effort")).otherwise(0.0),
            "json_only": F.when(json, F.col("only")).otherwise(0.0),
        }
    )


def diagnosed(rows: DataFrame, generation: str = "generation", kind: str = "output_type") -> DataFrame:
    """Key score and reward components side by side, under a struct for each."""
    made = udfs.diagnosis(F.col(generation), F.col(kind), F.col("raw_output_metric"))
    return rows.withColumn("_made", made).select(*rows.columns, "_made.*")


def combined(config: Mapping[str, float] | None = None, kind: Column | str = "output_type") -> Column:
    """The reward: components times weights, natively. Weights of a format go before
    general ones."""
    given = dict(config or {})
    name = reward_type(kind)
    formats = ("JSON", "YAML", "TOML", "XML", "CSV")

    def of(key: str) -> Column:
        found = F.lit(weight(given, key, "")) if key in WEIGHTS else F.lit(0.0)
        for own in formats:
            found = F.when(name == own, F.lit(weight(given, key, own))).otherwise(found)
        return found

    part = F.col
    missed = {x: part(x) < 1 for x in ("only", "yaml_indent_canonical", "yaml_block_style", "toml_canonical")}
    total = F.when(part("parse") < 1, of("p_parse_best_effort")).otherwise(0.0)
    for key, component in (
        ("w_parse", "parse"),
        ("w_only", "only"),
        ("w_match", "match"),
        ("w_match_soft", "match_soft"),
        ("w_schema_valid", "schema_valid"),
        ("w_exact_authors_len_2", "authors_len_is_2"),
    ):
        total = total + of(key) * part(component)
    total = total + F.when(part("extra_keys") == 0, of("w_no_extra_keys")).otherwise(0.0)
    total = total + EXTRA_KEY * part("extra_keys")
    total = total + F.when(missed["only"], of("p_only")).otherwise(0.0)
    yaml, toml = F.lit(0.0), F.lit(0.0)
    for what in ("yaml_indent_canonical", "yaml_block_style"):
        yaml = yaml + of(f"w_{what}") * part(what) + F.when(missed[what], of(f"p_{what}_fail")).otherwise(0.0)
    soft = part("toml_canonical_soft")
    toml = toml + of("w_toml_canonical") * part("toml_canonical") + of("w_toml_canonical_soft") * soft
    toml = toml + of("p_toml_canonical_soft_scale") * (1 - soft)
    toml = toml + F.when(missed["toml_canonical"], of("p_toml_canonical_fail")).otherwise(0.0)
    total = total + F.when(name == "YAML", yaml).when(name == "TOML", toml).otherwise(0.0)
    total = total + F.when(part("extraneous") >= 1, of("p_extraneous")).otherwise(0.0)
    nothing = (part("parse") < 1) & (part("parse_best_effort") < 1)
    return F.when(nothing, of("p_parse_fail")).otherwise(total)


def rewarded(rows: DataFrame, config: Mapping[str, float] | None = None, generation: str = "completion") -> DataFrame:
    """Adds ``reward``: with key paths the key score of the payload and its style, without
    them the combined components. What stands around a payload costs ``p_extraneous``."""
    given = dict(config or {})
    kind = F.upper(F.trim(F.coalesce(F.nullif("output_type", F.lit("")), F.lit("JSON"))))
    gold = F.col("reference_output") if "reference_output" in rows.columns else F.lit(None).cast("string")
    asked = F.coalesce(F.size("raw_output_metric"), F.lit(0)) > 0
    staged = rows.withColumn("_kind", kind)
    parts = udfs.reward_parts(F.col(generation), F.col("_kind"), F.col("raw_output_metric"), gold)
    staged = staged.withColumn("_parts", parts)
    # Columns of the input that are named like a part give way, inside this function only.
    flat = staged.select(F.struct(*(F.col(x) for x in rows.columns)).alias("_row"), "_kind", asked.alias("_asked"), "_parts.*")
    name = F.col("_kind")

    def of(key: str) -> Column:
        return F.lit(float(given.get(key, 0.0)))

    yaml = F.lit(0.0)
    for what in ("yaml_indent_canonical", "yaml_block_style"):
        yaml = yaml + F.when(F.col(what) < 1, of(f"p_{what}_fail")).otherwise(of(f"w_{what}"))
    soft = F.col("toml_canonical_soft")
    toml = of("w_toml_canonical_soft") * soft + of("p_toml_canonical_soft_scale") * (1 - soft)
    toml = toml + F.when(F.col("toml_canonical") < 1, of("p_toml_canonical_fail")).otherwise(of("w_toml_canonical"))
    outside = F.lit(weight(given, "p_extraneous", ""))
    for own in ("JSON", "YAML", "TOML", "XML", "CSV"):
        outside = F.when(name == own, F.lit(weight(given, "p_extraneous", own))).otherwise(outside)
    by_keys = (
        F.col("final_eval_score")
        + F.when(name == "YAML", yaml).when(name == "TOML", toml).otherwise(0.0)
        + F.when(F.col("extraneous") >= 1, outside).otherwise(0.0)
    )
    reward = F.when(F.col("_asked"), by_keys).otherwise(combined(given, "_kind"))
    return flat.select("_row.*", reward.alias("reward"))


def advantages(rows: DataFrame, prompt: str = "prompt", reward: str = "reward", near: float = 1e-6) -> DataFrame:
    """Reward less the prompt's mean, over its sample deviation (0 of a single row), and
    whether that deviation is nearly zero. Groups are the completions of one prompt."""
    own = Window.partitionBy(prompt)
    spread = F.coalesce(F.stddev_samp(reward).over(own), F.lit(0.0))
    staged = rows.withColumn("group_mean", F.avg(reward).over(own)).withColumn("group_std", spread)
    return staged.withColumn("advantage", (F.col(reward) - F.col("group_mean")) / (F.col("group_std") + 1e-8)).withColumn(
        "near_zero", F.col("group_std") < near
    )


def evaluated(rows: DataFrame, generation: str = "generation", kind: str = "output_type") -> DataFrame:
    """Adds what the evaluation counts: strict, only, article checks, and the key score."""
    name = F.upper(F.trim(F.coalesce(kind, F.lit("JSON"))))
    staged = rows.withColumn("_type", name)
    found = udfs.evaluation(text(generation), F.col("_type"), F.col("raw_output_metric"))
    return staged.withColumn("_found", found).select(*rows.columns, F.col("_type").alias("eval_type"), "_found.*")


def _rate(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def summary_by_type(rows: DataFrame) -> DataFrame:
    """Rows, parse and only rates of each type of evaluated rows."""
    return rows.groupBy("eval_type").agg(
        F.count("*").alias("n"),
        _rate(F.col("strict_ok")).alias("parse_rate"),
        _rate(F.col("only_ok")).alias("only_rate"),
        F.coalesce(F.avg("final_eval_score"), F.lit(0.0)).alias("avg_final"),
    )


def summary(rows: DataFrame, judge_score: Column | None = None) -> DataFrame:
    """One row over all evaluated rows; rates of JSON tasks over all rows and over JSON rows."""
    json = F.col("eval_type") == "JSON"
    n_json = F.sum(json.cast("long"))

    def both(flag: str, name: str) -> list[Column]:
        hits = F.sum((json & F.col(flag)).cast("long"))
        return [
            safe_div(hits, F.count("*")).alias(f"{name}_rate"),
            safe_div(hits, n_json).alias(f"{name}_rate_on_json_tasks"),
        ]

    judged = [F.avg(judge_score).alias("judge_score_avg")] if judge_score is not None else []
    return rows.agg(
        F.count("*").alias("total"),
        _rate(F.col("strict_ok")).alias("format_parse_rate"),
        _rate(F.col("only_ok")).alias("format_only_rate"),
        F.coalesce(n_json, F.lit(0)).alias("json_tasks_n"),
        *both("strict_ok", "json_parse"),
        *both("only_ok", "json_only"),
        safe_div(F.sum((json & F.col("authors_len_ok")).cast("long")), F.count("*")).alias("authors_len_2_rate"),
        F.coalesce(F.avg("final_eval_score"), F.lit(0.0)).alias("final_eval_score_avg"),
        *judged,
    )


def score_summary(rows: DataFrame) -> DataFrame:
    """Number of rows and mean final score, 0 of none."""
    return rows.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("final_eval_score"), F.lit(0.0)).alias("avg_final_eval_score")
    )
