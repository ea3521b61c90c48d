"""Filters: which tasks, rows and groups are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import filled, plain_type, text, toml_is_deep, type_from_query


def usable_tasks(tasks: DataFrame, types: Sequence[str] | None = None, text_only: bool = True, no_rendering: bool = True) -> DataFrame:
    """Tasks of the allowed types, with text (or no stated) input, that are not rendered."""
    keep = F.lit(True)
    if types:
        keep = keep & plain_type("output_type").isin([name.strip().upper() for name in types if name.strip()])
    if text_only:
        keep = keep & (F.col("input_type").isNull() | F.col("input_type").isin("Text", "text"))
    if no_rendering:
        keep = keep & ~F.coalesce("rendering", F.lit(False))
    return tasks.where(keep)


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows with an output that was parsed, if anything is said about that."""
    known = [F.col(f"meta.{name}") for name in ("parse_ok", "json_parse_ok") if "meta" in rows.columns and name in rows.schema["meta"].dataType.fieldNames()]
    return rows.where(filled("output").isNotNull() & F.coalesce(*known, F.lit(True)))


def strict_payloads(rows: DataFrame, output: str = "output", kind: str = "output_type") -> DataFrame:
    """Rows whose payload can be read; what stands around it does not matter."""
    staged = rows.withColumn("_payload", udfs.payload(text(output), F.col(kind)))
    return staged.where(udfs.parse(F.col("_payload.payload"), F.col(kind))["ok"]).drop("_payload")


def decided(rows: DataFrame, prompt: str = "query", kind: str = "output_type", output: str = "output") -> DataFrame:
    """``keep`` and ``reason`` by the cleaning policy, evaluated once for each row."""
    return rows.withColumn("decision", udfs.keep(F.col(prompt), F.col(kind), F.col(output))).select(
        *rows.columns, "decision.keep", "decision.reason"
    )


def frequent_groups(rows: DataFrame, least: int, key: str = "task_key") -> DataFrame:
    """Rows of groups with ``least`` rows or more. Groups are counted first (added up
    before the shuffle) and the rare ones left out, so a large group is no single task."""
    if least <= 1:
        return rows
    rare = rows.groupBy(key).count().where(F.col("count") < least).select(key)
    return rows.join(rare, rows[key].eqNullSafe(rare[key]), "left_anti")


def task_key_or_default(key: Column | str = "task_key", kind: Column | str = "output_type") -> Column:
    """The task key, or one made of the type alone."""
    name = F.upper(F.coalesce(filled(kind), F.lit("UNKNOWN")))
    return F.coalesce(filled(key), F.concat(F.lit("unknown|"), name, F.lit("|unknown|unknown")))


def deep_toml(rows: DataFrame, least: int | None, output: str = "output") -> DataFrame:
    """All rows of other types, and TOML of the depth or more."""
    if least is None:
        return rows
    return rows.where((plain_type("output_type") != "TOML") | toml_is_deep(output, least))


def wanted_types(tasks: DataFrame, types: Sequence[str]) -> DataFrame:
    return tasks.where(type_from_query("output_type", "query").isin([name.lower() for name in types]))


def repaired_toml(rows: DataFrame, output: str = "output", kind: str = "output_type") -> DataFrame:
    """TOML rows that hold JSON are converted, if the JSON can be read."""
    staged = rows.withColumn("_made", F.when(F.col(kind) == "TOML", udfs.json_to_toml(F.col(output))))
    good = F.coalesce(F.col("_made.json_like") & F.col("_made.ok"), F.lit(False))
    return staged.withColumn(output, F.when(good, F.col("_made.toml")).otherwise(F.col(output))).drop("_made")


def canonical_toml_rows(rows: DataFrame, output: str = "output", kind: str = "output_type") -> DataFrame:
    """TOML outputs in canonical form where they can be read."""
    staged = rows.withColumn("_made", F.when(F.col(kind) == "TOML", udfs.canonical_toml(F.col(output))))
    good = F.coalesce(F.col("_made.ok"), F.lit(False))
    return staged.withColumn(output, F.when(good, F.col("_made.canonical")).otherwise(F.col(output))).drop("_made")


def distinct_rows(rows: DataFrame, key: Column, order: Sequence[Column | str]) -> DataFrame:
    """Of the rows of each fingerprint the first in the stated order; it is found by a
    minimum, which is taken before the shuffle."""
    staged = rows.select(F.struct(*(F.col(name) for name in rows.columns)).alias("_row"), F.struct(*order).alias("_order"), key.alias("fingerprint"))
    return staged.groupBy("fingerprint").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*", "fingerprint")


def first_rows(rows: DataFrame, partition: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    window = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")
