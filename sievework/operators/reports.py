"""Counts, rates, pivots and tops over prepared rows.

All of them are aggregations that add up before their shuffle; lists that could grow with
the data are cut to a stated number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import ESCAPES, INLINE_TYPES, answer_payload, escape_counts, family, rate_or_null, type_from_key


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy(type_from_key("output_type", "task_key").alias("output_type")).agg(F.count("*").alias("n"))


def by_family_and_type(rows: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(
        family("task_family", prefixes).alias("task_family"), type_from_key("output_type", "task_key").alias("output_type")
    ).agg(F.count("*").alias("n"))


def group_sizes(rows: DataFrame, key: str = "task_key") -> DataFrame:
    """One row: groups, rows, smallest and largest group."""
    return rows.groupBy(key).count().agg(
        F.count("*").alias("tasks"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.min("count").alias("min_per_task"),
        F.max("count").alias("max_per_task"),
    )


def decisions(rows: DataFrame, kind: str = "output_type") -> DataFrame:
    """Rows by type and reason of ``filtering.decided``."""
    return rows.groupBy(kind, "keep", "reason").agg(F.count("*").alias("n"))


def top_reasons(rows: DataFrame, n: int = 20) -> DataFrame:
    counts = rows.where("not keep").groupBy("reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(n)


def parse_rates(rows: DataFrame, ok: str = "ok", kind: str = "output_type", failures: int = 100) -> DataFrame:
    """Rows, successes, rate, failures, and the ids of the first ``failures`` of them by type.

    Only ids that come among the first of their type are gathered.
    """
    first = Window.partitionBy(kind).orderBy("task_id")
    failed = rows.where(~F.col(ok)).select(kind, "task_id")
    failed = failed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= failures)
    lists = failed.groupBy(kind).agg(F.sort_array(F.collect_list("task_id")).alias("failed_ids"))
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.col(ok).cast("long")).alias("parse_ok"))
    empty = F.array().cast(lists.schema["failed_ids"].dataType)
    return counts.join(lists, kind, "left").select(
        kind,
        "n",
        "parse_ok",
        (F.col("parse_ok") / F.col("n")).alias("parse_rate"),
        (F.col("n") - F.col("parse_ok")).alias("failures"),
        F.coalesce("failed_ids", empty).alias("failed_ids"),
    )


def failure_rates(rows: DataFrame, ok: Column, *groups: str) -> DataFrame:
    """Rows, failures and their rate for each combination of the groups."""
    failed = F.sum((~ok).cast("long"))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), failed.alias("failed"), (failed / F.count("*")).alias("fail_rate")
    )


def unknown_types(rows: DataFrame, known: Sequence[str], kind: str = "output_type") -> DataFrame:
    return rows.agg(F.count_if(~F.coalesce(F.col(kind).isin(*known), F.lit(False))).alias("unknown_types"))


def error_kinds(rows: DataFrame) -> DataFrame:
    """Failures by type and error kind, the most common first."""
    counts = rows.where("not ok").groupBy("output_type", "error_kind").agg(F.count("*").alias("n"))
    return counts.orderBy("output_type", F.desc("n"), "error_kind")


def task_stats(rows: DataFrame) -> DataFrame:
    """For each task key: totals, usable rate, data sets, and the most common error (of
    equally common ones the first in order). ``rows`` has ok, reason and the task fields."""
    keys = ["task_key", "family", "output_format", "task_kind", "task_schema"]
    reasons = rows.where("not ok").groupBy("task_key", "reason").agg(F.count("*").alias("n"))
    most = reasons.groupBy("task_key").agg(F.max("n").alias("most"))
    common = reasons.join(most, "task_key").where("n = most").groupBy("task_key").agg(F.min("reason").alias("top_error"))
    usable = F.sum(F.col("ok").cast("long"))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        (F.count("*") - usable).alias("errors"),
        usable.alias("usable"),
        (usable / F.count("*")).alias("usable_rate"),
        F.array_join(F.sort_array(F.collect_set("dataset")), ";").alias("datasets"),
    )
    return stats.join(common, "task_key", "left").withColumn("top_error", F.coalesce("top_error", F.lit("")))


# --- Escapes --------------------------------------------------------------------------


def escapes(rows: DataFrame, output: str = "output", kind: str = "format") -> DataFrame:
    """Long rows (dataset, format, usable, escape_type, n) with n of 0 left in, so that each
    checked type is reported. ``rows`` has dataset, format, usable and the output. Of the
    texts only those of TOML go to Python, so its memory does not depend on long ones."""
    body = answer_payload(output, kind)
    staged = rows.select("dataset", kind, "usable", body.alias("_body"))
    empty = F.array().cast("array<struct<escape_type:string,n:bigint>>")
    found = F.lit(None).cast("array<struct<escape_type:string,n:bigint>>")
    for name in ESCAPES:
        own = escape_counts("_body", name)
        found = F.when(F.col(kind) == name, own).otherwise(found)
    toml = F.col(kind) == "TOML"
    inline = F.when(toml, udfs.inline_tables(F.when(toml, F.col("_body"))))
    staged = staged.withColumn("_found", F.coalesce(found, empty)).withColumn("_inline", inline)
    more = F.array(
        *(F.struct(F.lit(name).alias("escape_type"), F.col(f"_inline.{name}").alias("n")) for name in INLINE_TYPES)
    )
    every = F.when(F.col("_inline").isNotNull(), F.concat("_found", more)).otherwise(F.col("_found"))
    # Without ``outer`` the optimizer filters by the size of the arrays, counting all anew.
    long = staged.select("dataset", F.col(kind).alias("format"), "usable", F.inline_outer(every))
    return long.where("escape_type IS NOT NULL")


def escape_stats(rows: DataFrame) -> DataFrame:
    """From long rows: per data set, format and type the examples and occurrences, in all
    and usable."""
    has, usable = F.col("n") > 0, F.col("usable")

    def number(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    return rows.groupBy("dataset", "format", "escape_type").agg(
        F.count("*").alias("examples_total"),
        number(usable).alias("examples_usable"),
        number(has).alias("examples_with_escape_total"),
        number(has & usable).alias("examples_with_escape_usable"),
        F.sum("n").alias("occurrences_total"),
        F.sum(F.when(usable, F.col("n")).otherwise(0)).alias("occurrences_usable"),
    )


def escape_rates(stats: DataFrame) -> DataFrame:
    """Rates over examples, null where there are none."""
    made = {}
    for which in ("total", "usable"):
        examples = F.col(f"examples_{which}")
        made[f"example_rate_{which}"] = rate_or_null(F.col(f"examples_with_escape_{which}"), examples)
        made[f"occ_per_example_{which}"] = rate_or_null(F.col(f"occurrences_{which}"), examples)
    return stats.withColumns(made)


COUNTERS = (
    "examples_total examples_usable examples_with_escape_total examples_with_escape_usable "
    "occurrences_total occurrences_usable"
).split()


def summed(stats: DataFrame, *grain: str) -> DataFrame:
    """The counters at a coarser grain."""
    return stats.groupBy(*grain).agg(*(F.sum(name).alias(name) for name in COUNTERS))


def pivoted(stats: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """One row per ``row`` and a column for each of the given values; what is missing is 0."""
    return stats.groupBy(row).pivot(column, list(values)).agg(F.first(value)).na.fill(0, list(values))


def toml_structure_stats(rows: DataFrame, family_with_stats: str) -> DataFrame:
    """Per data set: means and maxima of TOML structure; null for other families. ``rows``
    has dataset, format, family, usable and the struct ``toml``."""
    own = F.col("family") == family_with_stats
    names = ("array_table_headers", "array_table_headers_with_dot", "table_headers", "child_tables_under_array")
    json = F.col("toml.json_stringified_like")

    def shown(value: Column) -> Column:
        return F.when(own, value)

    return rows.groupBy("dataset", "format", "family").agg(
        F.count("*").alias("examples_total"),
        F.sum(F.col("usable").cast("long")).alias("examples_usable"),
        *(F.avg(shown(F.col(f"toml.{name}"))).alias(f"avg_{name}") for name in names),
        F.max(shown(F.col("toml.max_header_depth"))).alias("max_header_depth_max"),
        F.sum(shown(json)).alias("examples_with_json_stringified_like"),
        F.avg(shown(json)).alias("rate_json_stringified_like"),
    )


def crosstab(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of combinations, long, so that nothing limits the number of values."""
    return rows.groupBy(left, right).agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage").agg(
        F.count("*").alias("runs"), F.avg("avg_final_eval_score").alias("mean"), F.max("avg_final_eval_score").alias("best")
    )


# --- Generated variants ---------------------------------------------------------------


def attempt_bucket(ok: Column, generation: Column, error: Column) -> Column:
    """ok, invalid, empty or errors for one generation."""
    blank, failed = F.coalesce(generation, F.lit("")) == "", F.coalesce(error, F.lit("")) != ""
    return F.when(blank & failed, "errors").when(blank, "empty").when(ok, "ok").otherwise("invalid")


def task_buckets(attempts: DataFrame, variants: int) -> DataFrame:
    """Per task: the number of good variants and one bucket over all of them. ``attempts``
    has output_type, task_id and bucket."""
    counts = {name: F.count_if(F.col("bucket") == name) for name in ("ok", "invalid", "empty", "errors")}
    staged = attempts.groupBy("output_type", "task_id").agg(*(value.alias(name) for name, value in counts.items()))
    bucket = (
        F.when(F.col("ok") > 0, "ok")
        .when((F.col("errors") > 0) & (F.col("empty") + F.col("invalid") == 0), "errors")
        .when(F.col("empty") == variants, "empty")
        .otherwise("invalid")
    )
    return staged.select("output_type", "task_id", F.col("ok").alias("ok_variants"), bucket.alias("bucket"))


def attempt_stats(attempts: DataFrame, *groups: str) -> DataFrame:
    return attempts.groupBy(*groups).agg(
        *(F.count_if(F.col("bucket") == name).alias(name) for name in ("ok", "invalid", "empty", "errors"))
    )


def good_variant_histogram(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("output_type", "ok_variants").agg(F.count("*").alias("n"))


def progress(attempts: DataFrame, every: int, position: str = "position") -> DataFrame:
    """Buckets of attempts by windows of ``every`` positions (from 1)."""
    window = F.floor((F.col(position) - 1) / every).alias("window")
    return attempts.groupBy("output_type", window).agg(
        *(F.count_if(F.col("bucket") == name).alias(name) for name in ("ok", "invalid", "empty", "errors"))
    )


def best(trials: DataFrame, score: str, order: str) -> DataFrame:
    """The trial with the largest score, of equal ones the first; a two-field maximum
    rather than a sort of all."""
    key = F.struct(F.col(score), -F.col(order))
    return trials.agg(F.max_by(F.struct(*trials.columns), key).alias("trial")).select("trial.*")


def masked_rows(features: DataFrame, ignore: int = -100) -> DataFrame:
    """How many rows have no label to learn from."""
    masked = F.forall("labels", lambda x: x == ignore)
    return features.agg(F.count("*").alias("n"), F.coalesce(F.sum(masked.cast("long")), F.lit(0)).alias("fully_masked"))
