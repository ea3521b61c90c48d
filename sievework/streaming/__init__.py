"""The row-level operators on streams.

They keep no state, so they work on a stream as they are. What needs the whole table
(balanced samples, splits, tops) does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.scoring import scored


def generations(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """A stream of JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema or f"{schemas.TASK}, generation string, ts timestamp").json(folder)


def scores(stream: DataFrame) -> DataFrame:
    return scored(stream)


def first_of_each(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each task once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id"])


def rates(scored_stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Syntax rate and mean score by window and type, late rows up to ``delay`` included."""
    return (
        scored_stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "output_type")
        .agg(F.count("*").alias("n"), F.avg("render_score").alias("syntax_rate"), F.avg("final_eval_score").alias("score"))
    )
