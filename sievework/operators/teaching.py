"""Pseudo training rows from generations of a teacher."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import strip, teacher_type, text


def pseudo_rows(attempts: DataFrame, source: str, model: str, backend: str) -> DataFrame:
    """Rows (instruction, output, meta) of attempts with query, output_type, task_id,
    variant, raw_output_metric, prompt, generation and error. JSON may be read leniently
    and is written anew; the other formats must be read whole, fence marks aside."""
    kind = teacher_type("output_type")
    parsed = attempts.withColumn("_kind", kind).withColumn("_p", udfs.pseudo_parse(text("generation"), F.col("_kind")))
    meta = F.struct(
        F.lit(source).alias("source"),
        F.col("task_id"),
        F.col("_kind").alias("output_type"),
        F.col("variant").alias("variant_id"),
        F.lit(model).alias("teacher_model"),
        F.lit(backend).alias("teacher_backend"),
        F.col("prompt").alias("teacher_prompt"),
        F.col("raw_output_metric"),
        text("generation").alias("raw_generation"),
        F.col("_p.used").alias("raw_used"),
        F.col("_p.ok").alias("parse_ok"),
        F.col("_p.strict").alias("syntax_strict_ok"),
        F.col("_p.only").alias("output_only_ok"),
        F.col("_p.error").alias("parse_error"),
        text("error").alias("error"),
    )
    return parsed.select(strip(text("query")).alias("instruction"), F.col("_p.output").alias("output"), meta.alias("meta"))
