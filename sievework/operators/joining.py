"""Look-ups of tasks, generations, cached answers and settings, as joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import checked_type
from ..functions.formats import FORMATS


def checked(tasks: DataFrame, inference: DataFrame) -> DataFrame:
    """Each task with the verdict on its generation; a missing generation and an unknown
    type are failures of their own kinds."""
    joined = tasks.select("task_id", checked_type("output_type").alias("output_type")).join(
        inference.select("task_id", "generation", F.lit(True).alias("there")), "task_id", "left"
    )
    verdict = udfs.check_syntax(F.col("generation"), F.col("output_type"))
    joined = joined.withColumn("_verdict", verdict)
    known, there = F.col("output_type").isin(*FORMATS), F.col("there").isNotNull()
    kind = (
        F.when(~known, "UnsupportedType").when(~there, "MissingInference").otherwise(F.col("_verdict.error_kind"))
    )
    return joined.select(
        "task_id",
        "output_type",
        (known & there & F.col("_verdict.ok")).alias("ok"),
        kind.alias("error_kind"),
        F.when(known & there, F.col("_verdict.extracted_from")).alias("extracted_from"),
        F.when(known & there, F.col("_verdict.payload_preview")).alias("payload_preview"),
    )


def orphans(inference: DataFrame, tasks: DataFrame) -> DataFrame:
    """Generations of tasks that do not exist."""
    return inference.join(tasks.select("task_id"), "task_id", "left_anti")


def insert_absent(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``new`` whose key is not there yet."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def setting(value: Column, settings: Mapping[str, str], default: str | None = None) -> Column:
    """A setting by name, or the default's, or null; the mapping is a literal of the plan."""
    found = F.lit(settings.get(default) if default else None)
    for name, own in settings.items():
        found = F.when(value == name, F.lit(own)).otherwise(found)
    return found
