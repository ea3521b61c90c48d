"""Readers of JSON lines, JSON arrays, CSV summaries and run summaries."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, lenient: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped. A bad line fails the read, or is left
    out if ``lenient``."""
    mode = "DROPMALFORMED" if lenient else "FAILFAST"
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).json(paths, mode=mode)


#: Rows of which each is a small text's work in Python, for one task.
TASK_ROWS = 50_000


def dealt(rows: DataFrame) -> DataFrame:
    """A table's rows in even parts, for work that is heavy for each row: as many as there
    are cores, or one for every ``TASK_ROWS`` rows if these are more. A table of narrow rows
    lies in few row groups however many rows it has, and a row group is one task's."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // TASK_ROWS)))  # the count reads no column


def bad_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """``file, line, text`` of the lines that are no records, lines counted from 1.

    Lines of a split of a file come in order, so a line's number is its place in its split
    and the number of lines in the file's earlier splits; only counts are shuffled."""
    paths = [path] if isinstance(path, str) else list(path)
    fields = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    split = ["file", "start"]
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        (F.coalesce(fields["_bad"].isNotNull(), F.lit(True)) & (F.trim("value") != "")).alias("bad"),
    )
    sizes = lines.groupBy(*split).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    found = lines.where("bad").join(before, split)
    return found.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def checked_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """As ``json_lines``, but checked at once: the error names file and line of the first
    line that is no record."""
    first = bad_lines(spark, path, schema).orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first['file']}:{first['line']}: no record: {first['text'][:200]}")
    return json_lines(spark, path, schema)


def json_array(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """A file that is one array of objects. Elements that are no objects fail the read, or
    are left out if ``lenient``."""
    if not lenient:
        return spark.read.schema(schema).option("multiLine", True).json(path, mode="FAILFAST")
    # Dropping malformed records would drop the whole array, so elements are told apart here.
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    kinds = F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), F.schema_of_variant)
    element = whole.select(F.explode(F.arrays_zip(items.alias("text"), kinds.alias("kind"))).alias("x")).select("x.*")
    objects = element.where(F.startswith("kind", F.lit("OBJECT")))
    return objects.select(F.from_json("text", schema).alias("row")).where("row IS NOT NULL").select("row.*")


#: Names that configurations use for a file that is one array.
ARRAY_FORMATS = ("structeval_json", "structeval-t", "structeval_t")


def records(spark: SparkSession, path: str, file_format: str, schema: str) -> DataFrame:
    """By the name of the file format: ``jsonl``, or one of the names for arrays."""
    name = file_format.strip().lower()
    if name == "jsonl":
        return json_lines(spark, path, schema)
    if name in ARRAY_FORMATS:
        return json_array(spark, path, schema)
    raise ValueError(f"unknown file format: {file_format}")


def file_format_for(path: str | None, configured: str) -> str:
    """A path given from outside that ends in .json makes a configured jsonl an array."""
    override = path and path.endswith(".json") and configured.strip().lower() == "jsonl"
    return "structeval_json" if override else configured


def data_files(paths: Iterable[str], suffix: str) -> list[str]:
    """Files with the suffix, folders searched below and sorted, each file once."""
    found: list[str] = []
    for path in paths:
        if os.path.isdir(path):
            inside = (os.path.join(top, name) for top, _, names in os.walk(path) for name in names)
            found += sorted(name for name in inside if name.endswith(suffix))
        elif os.path.isfile(path) and path.endswith(suffix):
            found.append(path)
    once: dict[str, str] = {}
    for name in found:
        once.setdefault(os.path.realpath(name), name)
    return list(once.values())


def first_existing(candidates: Iterable[str | None]) -> str | None:
    return next((path for path in candidates if path and os.path.exists(path)), None)


def split_name(requested: str, available: Sequence[str]) -> str:
    """The split to load: ``train`` may stand for ``test`` where only that exists."""
    if requested in available:
        return requested
    if requested == "train" and "test" in available:
        return "test"
    raise ValueError(f"unknown split {requested!r}; there are {sorted(available)}")


def exported_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A data set exported as ``<folder>/<split>.parquet``, with the fallback for splits."""
    names = [name.removesuffix(".parquet") for name in os.listdir(folder) if name.endswith(".parquet")]
    return spark.read.parquet(os.path.join(folder, f"{split_name(split, names)}.parquet"))


def zipped_arrow(spark: SparkSession, path: str, split: str, target: str) -> DataFrame:
    """The ``*-<split>.arrow`` streams of a zip file, rewritten as Parquet at ``target``
    batch by batch (Spark has no reader of Arrow files), and read from there."""
    import zipfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    with zipfile.ZipFile(path) as archive:
        names = sorted(name for name in archive.namelist() if name.endswith(f"-{split}.arrow"))
        if not names:
            raise FileNotFoundError(f"no *-{split}.arrow inside {path}")
        os.makedirs(target)
        for k, name in enumerate(names):
            with archive.open(name) as file, pa.ipc.open_stream(file) as stream:
                with pq.ParquetWriter(os.path.join(target, f"{k:05d}.parquet"), stream.schema) as writer:
                    for batch in stream:
                        writer.write_batch(batch)
    return spark.read.parquet(target)


def csv_summaries(spark: SparkSession, path: str, schema: str = schemas.ESCAPE_STATS) -> DataFrame:
    """CSV files with a header, united, with ``source_file``. A missing column is an error."""
    wanted = [part.split()[0] for part in schema.split(",")]
    seen = spark.read.option("header", True).option("mergeSchema", True).csv(path)
    missing = sorted(set(wanted) - set(seen.columns))
    if missing:
        raise ValueError(f"{path}: missing columns: {missing}")
    kinds = dict(part.split() for part in schema.split(","))
    named = seen.select(*(F.col(name).cast(kinds[name]).alias(name) for name in wanted), F.col("_metadata.file_name").alias("source_file"))
    return named


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """``*.summary.json`` below a folder, with run and stage from the path; bad files go."""
    rows = (
        spark.read.schema(schemas.RUN_SUMMARY)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.summary.json")
        .option("multiLine", True)
        .json(folder, mode="DROPMALFORMED")
        # File paths are quoted like urls, in which a plus sign stands for itself.
        .withColumn("path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    )
    parts = F.split("path", "/")
    return rows.select(
        F.try_element_at(parts, F.lit(-2)).alias("run_id"),
        F.regexp_extract(F.try_element_at(parts, F.lit(-2)), r"^\d{8}_\d{6}_([A-Za-z0-9]+)", 1).alias("stage"),
        "n",
        "avg_final_eval_score",
        "path",
    )


def experiments(spark: SparkSession, path: str, names: dict[str, str], patches: Sequence[tuple[str, str, str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """An experiment CSV with columns renamed and cells patched (where column, equals,
    column, value), as rows of base models and others."""
    rows = spark.read.option("header", True).csv(path)
    for where, equals, column, value in patches:
        rows = rows.withColumn(column, F.when(F.col(where) == equals, value).otherwise(F.col(column)))
    rows = rows.withColumnsRenamed(names)
    base = F.contains(F.coalesce("method", F.lit("")), F.lit("base_model"))
    return rows.where(base), rows.where(~base)


def last_by_id(rows: DataFrame, order: str, key: str = "task_id", value: str | None = None) -> DataFrame:
    """The last row of each id (rows whose id is null go); a null ``value`` is empty."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    kept = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return kept.withColumn(value, F.coalesce(value, F.lit(""))) if value else kept
