"""The flows end to end: build training rows, build tasks, score, evaluate, analyse.

Each is one lazy chain; nothing is collected but the sizes that a split needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import filled, plain_type
from ..operators import filtering, preparing, reports, sampling, scoring
from ..operators.preparing import FAMILIES, Families


def imported(rows: DataFrame, families: Families = FAMILIES, supplement: bool = False) -> DataFrame:
    """Chat rows (``dataset``, ``messages``, ``metadata``) as training rows with ``keep``
    and ``reason``: prompt, type and task fields, reference output, JSON-in-TOML repair,
    the strict payload, the cleaning policy, and canonical TOML, in this order."""
    family = families.of(F.col("dataset"))
    in_metadata = family == families.metadata
    user = preparing.last_content("messages", "user")
    assistant = preparing.last_content("messages", "assistant")
    prompt = F.when(in_metadata, preparing.metadata_prompt()).otherwise(
        preparing.query_text(family, preparing.last_content("messages", "system"), user, families)
    )
    kind = preparing.declared_type(rows)
    staged = rows.select("*", prompt.alias("query"), kind.alias("_kind"), assistant.alias("_assistant"), user.alias("_user"))
    staged = staged.where(filled("query").isNotNull())
    staged = staged.select("*", *preparing.task_meta(staged, "_user", F.col("_kind"), families))
    if supplement:
        text = preparing.with_supplement("query", "_kind", "task_kind", "task_schema", "task_family", "task_key")
        staged = staged.withColumn("query", text)
    answer = F.when(in_metadata, preparing.metadata_answer()).otherwise(
        F.coalesce(preparing.metadata_answer(), filled("output") if "output" in rows.columns else F.lit(None), F.col("_assistant"))
    )
    gold = udfs.final_output(answer, F.col("_kind"))
    staged = staged.withColumn("output_type", F.col("_kind")).withColumn("output", gold)
    staged = staged.where(filled("output").isNotNull()).select(
        "query", "output", "output_type", "task_family", "task_kind", "task_schema", "task_key"
    )
    made = filtering.strict_payloads(filtering.repaired_toml(staged))
    return filtering.canonical_toml_rows(filtering.decided(made))


def training_rows(rows: DataFrame, how: sampling.Selection, families: Families = FAMILIES) -> DataFrame:
    """Imported rows that stay, with ids, selected."""
    kept = imported(rows, families).where("keep").drop("keep", "reason")
    named = kept.withColumn("task_id", preparing.task_id("hf_", "output_type", "query", "output"))
    return sampling.selected(named, how)


def offline_training_rows(rows: DataFrame, least_depth: int | None = None, families: Families = FAMILIES) -> DataFrame:
    return filtering.deep_toml(preparing.offline_rows(rows, families), least_depth)


def scored(tasks: DataFrame, seed: int | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Tasks with generations, cut before they are scored, and their summary."""
    rows = scoring.scored(sampling.limited(tasks, limit, seed))
    return rows, scoring.score_summary(rows)


@dataclass(frozen=True)
class Analysis:
    rows: DataFrame
    tasks: DataFrame
    escapes: DataFrame
    toml: DataFrame


def analysed(rows: DataFrame, families: Families = FAMILIES, yaml_style: bool = True) -> Analysis:
    """Records of chat rows (``dataset``, ``messages`` and family columns) with verdicts,
    task statistics, escape statistics and TOML structure."""
    found = preparing.records_of(rows, families).select(
        "dataset",
        "family",
        "task_key",
        F.col("output_format_found").alias("output_format"),
        F.col("task_kind_found").alias("task_kind"),
        F.col("task_schema_found").alias("task_schema"),
        "assistant_text",
    )
    verdict = udfs.validate_answer(F.col("assistant_text"), F.col("output_format"))
    judged = found.withColumn("_v", verdict).select("*", "_v.ok", "_v.reason").drop("_v")
    shaped = judged.select(
        "dataset", "family", F.col("output_format").alias("format"), F.col("ok").alias("usable"), F.col("assistant_text").alias("output")
    )
    body = udfs.answer_payload(F.col("output"), F.col("format"))
    toml = shaped.where("format = 'TOML'").withColumn("toml", udfs.toml_structure(body))
    return Analysis(
        judged,
        reports.task_stats(judged),
        reports.escape_stats(reports.escapes(shaped)),
        reports.toml_structure_stats(toml, families.metadata),
    )


def prepared_tasks(tasks: DataFrame, types: list[str]) -> DataFrame:
    """Benchmark tasks: filtered, projected, types in upper case."""
    return preparing.benchmark_tasks(filtering.usable_tasks(tasks, types)).withColumn("output_type", plain_type("output_type"))
