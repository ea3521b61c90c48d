"""Writers of JSON lines, arrays, CSV and partitioned folders, and run folders."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, safe_name


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", keep_nulls: bool = True) -> None:
    """UTF-8 JSON lines; text is written as it is, not as ASCII escapes."""
    rows.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows, path, mode="append")


def json_array(rows: DataFrame, path: str, most: int = 100_000, indent: int | None = None) -> int:
    """One array in one local file, for small results; more than ``most`` rows are an error."""
    found = [row.asDict(recursive=True) for row in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write JSON lines instead")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(found, file, ensure_ascii=False, indent=indent)
    return len(found)


def valid_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pseudo rows that could be parsed and are not empty."""
    json_lines(rows.where(F.coalesce("meta.parse_ok", F.lit(False)) & filled("output").isNotNull()), path, mode)


def by_column(rows: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """A folder for each value, as JSON lines."""
    rows.write.mode(mode).partitionBy(column).json(path)


def by_task(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each task key, its name made safe."""
    by_column(rows.withColumn("task_dir", safe_name("task_key")), path, "task_dir", mode)


def csv_with_header(rows: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """The columns in order; columns that are missing are empty."""
    there = [F.col(name) if name in rows.columns else F.lit("").alias(name) for name in columns]
    rows.select(*there).write.mode(mode).option("header", True).csv(path)


def scored(rows: DataFrame, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scored rows, and their summary in a folder beside."""
    json_lines(rows, path, mode)
    json_lines(summary.coalesce(1), f"{path}.summary", mode)


def failures(rows: DataFrame, failed: Column, path: str, mode: str = "errorifexists") -> None:
    json_lines(rows.where(failed), path, mode)


def run_folder(base: str, stage: str, revision: str, name: str | None = None, now: datetime | None = None) -> str:
    """Makes ``<time>_<stage>_<revision>[_<name>]``; it must not exist."""
    parts = [(now or datetime.now()).strftime("%Y%m%d_%H%M%S"), stage, revision, *([name] if name else [])]
    path = os.path.join(base, "_".join(parts))
    os.makedirs(path, exist_ok=False)
    return path


def shown(rows: DataFrame, n: int = 5) -> str:
    """A few rows with their line ends, for a terminal."""
    parts = []
    for k, row in enumerate(rows.limit(n).collect(), 1):
        parts.append("\n".join([f"--- {k}", *(f"{name}:\n{value}" for name, value in row.asDict(recursive=True).items())]))
    return "\n".join(parts)
