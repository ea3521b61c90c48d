"""What the operators share: tables, shared storage, bounded samples, word rules."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the rule of the contracts: a run without space, tab, LF, VT, FF, CR.
#: ``bytes.split()`` without arguments splits at exactly these six bytes.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read only through Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """An input table of texts, for work that is heavy for each text: if its files have
    fewer parts with rows (row groups) than there are cores, rows are dealt over all cores.
    Large tables have more parts and are read as they are; results are the same."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    full = rows.groupBy(F.spark_partition_id()).count().limit(cores).count()  # reads no column
    return rows if full >= cores else rows.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    driver and executors are one process (tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievework-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage: a lost executor costs no more than the reading of a file, and
    expensive Python stages run once however often the result is used. Results are lazy
    and read these files later, so they stay; all files of an application lie in one
    folder, ``sievework-<application id>``, which may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievework-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small, bounded list as a DataFrame made by the JVM alone."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    one = spark.range(1).select(F.from_json(F.lit(text), f"array<struct<{_colons(schema)}>>").alias("rows"))
    return one.select(F.inline("rows"))


def _colons(schema: str) -> str:
    return ",".join(":".join(part.split()) for part in schema.split(","))


def batched(
    batches: Iterable[pa.RecordBatch], most_bytes: int = 8_000_000, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most_bytes`` at most, so that
    the memory of one step is bounded however long the texts are (a text stays whole)."""
    for batch in batches:
        sizes = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end


def byte_lengths(array: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def at_most(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Of stored ``rows`` about ``most``, by a hash of their place, and how many they were."""
    n = rows.count()
    if n <= most:
        return rows, n
    place = F.xxhash64(F.lit(19), F.monotonically_increasing_id()).bitwiseAND(F.lit(2**63 - 1))
    return rows.where(place <= F.lit(int(2**63 * (most / n)) - 1)), n


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words(text: str) -> list[bytes]:
    return text.encode().split()


@lru_cache(maxsize=4)
def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(column: Column, parts: int) -> Column:
    """A number below ``parts`` by hash; it splits hot groups into even pieces."""
    return F.pmod(F.xxhash64(F.lit(7), column), F.lit(parts)).cast("int")


#: Rows (of some 40 bytes) that are sent to all tasks at most; beyond, a shuffle join is used.
SENT = 1_000_000
#: The same where the rows of frequent keys alone are enough, and rows from which on a key is one.
FEW, HOT = 100_000, 1_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint to send it to all tasks, if its counted rows are few enough."""
    return F.broadcast(df) if rows <= SENT else df


def joined(
    left: DataFrame, right: DataFrame, on: list[str], name: str | None, weight: str, how: str = "inner"
) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key; ``weight`` is its
    column with the number of rows that the key has in ``left``, and is dropped.

    No key is one task's work: ``right`` is stored (under ``name``; None: it is already) and
    counted, and goes to all tasks if it has ``FEW`` rows at most. Beyond, its most frequent
    keys do, at most ``FEW`` (those of over ``HOT`` rows, or 10, 100 ... times as many), and
    the others meet in a shuffle. ``how`` is ``inner``, ``left`` or ``left_anti``.
    """
    right = stored(right, name) if name else right
    rest = right.drop(weight)
    if right.count() <= FEW:
        return left.join(F.broadcast(rest), on, how)
    least = HOT
    while (n_hot := right.where(F.col(weight) > least).count()) > FEW:
        least *= 10
    if not n_hot:
        return left.join(rest, on, how)
    hot = right.where(F.col(weight) > least)
    others = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    cold = others.join(right.where(F.col(weight) <= least).drop(weight), on, how)
    return cold if how == "left_anti" else cold.unionByName(left.join(F.broadcast(hot.drop(weight)), on))


#: Rows of a group for which ``gapless`` adds a part.
PART_ROWS = 100_000


def gapless(df: DataFrame, group: str, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Adds ``name``: a rank from 0 without gaps inside each ``group``.

    Two levels, so that a hot group is never one task: a row number inside (group, part),
    plus the counts of the group's earlier parts. A group has ``parts`` parts and one more
    for every ``PART_ROWS`` rows, so a part stays small however large the group is. The
    callers' groups are bounded in number; the table of counts has groups x ``parts`` rows,
    and one for every ``PART_ROWS`` rows of the input. It goes to all tasks if these are
    ``SENT`` at most, and is joined in a shuffle beyond.
    """
    from pyspark.sql import Window

    part = f"_{name}_part"
    sizes = df.groupBy(group).agg((F.floor(F.count("*") / PART_ROWS) + parts).cast("int").alias("_parts"))
    sizes = stored(sizes, f"{name}-parts")
    n_parts = sizes.agg(F.coalesce(F.sum("_parts"), F.lit(0))).first()[0]
    dealt = df.join(F.broadcast(sizes), group)
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(F.lit(7), *order), F.col("_parts")).cast("int")).drop("_parts")
    counts = dealt.groupBy(group, part).count()
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(group), F.col(part), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, part).orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside))
    placed = ranked.join(sized(counts, n_parts), [group, part])
    return placed.withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop(
        part, "_before", "_inside"
    )
