"""Reproducible sampling, splitting and ordering.

A shuffle is an order by a hash of seed and id, so members depend on the data alone and not
on partitions. Ranks inside groups are built in two levels (``ranked``): a row number inside
(group, slice) plus the counts of earlier slices, so that a group of any size is spread over
many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import family, type_from_key

#: Slices of a group's order: so many, and one more for every ``SLICE_ROWS`` rows of all.
SLICES, SLICE_ROWS = 64, 100_000


def shuffled(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def ranked(rows: DataFrame, groups: Sequence[str], seed: int, key: str, name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... inside each group in the seeded order, and ``size``, the
    number of the group's rows. Slices are ranges of the hash, so the order is global."""
    order = shuffled(seed, key)
    # Counted inside the plan, so that slices stay small however many rows there are.
    slices = rows.agg((F.floor(F.count("*") / SLICE_ROWS) + SLICES).alias("_slices")).scalar()
    place = F.floor((order / F.lit(2.0**64) + 0.5) * slices).cast("int")
    staged = rows.withColumn("_order", order).withColumn("_slice", F.least(place, (slices - 1).cast("int")))
    counts = staged.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *groups,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(own).alias("size"),
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy("_order", key)
    staged = staged.withColumn("_inside", F.row_number().over(inside))
    counts = counts.select(*(F.col(x).alias(f"_g_{x}") for x in (*groups, "_slice")), "_before", "size")
    same = F.lit(True)
    for x in (*groups, "_slice"):
        same = same & F.col(x).eqNullSafe(F.col(f"_g_{x}"))
    joined = staged.join(counts, same)
    rank = (F.col("_before") + F.col("_inside")).cast("long").alias(name)
    return joined.select(*rows.columns, rank, F.col("size").cast("long"))


def repeated(ranked_rows: DataFrame, wanted: Column) -> DataFrame:
    """The first ``wanted`` rows of each group; where there are fewer, all of them again
    and again in turn. Adds ``copy`` from 0. A null ``wanted`` takes all once."""
    need = F.coalesce(wanted, F.col("size"))
    copies = F.when(F.col("rank") > need, 0).otherwise(F.floor((need - F.col("rank")) / F.col("size")) + 1)
    staged = ranked_rows.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return staged.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def balanced(rows: DataFrame, key: str = "task_key", strategy: str = "min", fixed: int | None = None, seed: int = 42, by: str = "task_id") -> DataFrame:
    """As many rows of each group as the smallest (``min``) or largest (``max``) group has,
    or ``fixed``. Small groups repeat cyclically."""
    sizes = rows.groupBy(key).count()
    if strategy in ("min", "max"):
        need = sizes.agg((F.min if strategy == "min" else F.max)("count").alias("need")).scalar()
        return repeated(ranked(rows, [key], seed, by).withColumn("_need", need), F.col("_need")).drop("_need", "size")
    if not strategy.startswith("fixed"):
        raise ValueError(f"unknown strategy: {strategy}")
    if not fixed or fixed <= 0:
        raise ValueError("the strategy fixed needs a number above 0")
    return repeated(ranked(rows, [key], seed, by), F.lit(fixed)).drop("size")


def target(value: Any) -> int | None:
    """A number of rows, or None for all: null, all, ``*``, -1, any truth value, negatives."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, str):
        word = value.strip().lower()
        if word in ("all", "*", "-1"):
            return None
        if not word.isdigit():
            raise ValueError(f"no target: {value!r}")
        return int(word)
    if not isinstance(value, (int, float)):
        raise ValueError(f"no target: {value!r}")
    return int(value) if int(value) >= 0 else None


def _wanted(kind: Column, targets: Mapping[str, Any], default: Any) -> Column:
    def number(value: Any) -> Column:
        n = target(value)
        return F.lit(None).cast("int") if n is None else F.lit(n)

    found = number(default)
    for name, value in targets.items():
        found = F.when(kind == name, number(default if value is None else value)).otherwise(found)
    return found


def _taken(staged: DataFrame, wanted: Column, oversample: bool) -> DataFrame:
    if oversample:
        return repeated(staged, wanted).drop("size")
    return staged.where(wanted.isNull() | (F.col("rank") <= wanted)).withColumn("copy", F.lit(0)).drop("size")


def per_type(rows: DataFrame, targets: Mapping[str, Any], default: Any = None, seed: int = 42, oversample: bool = False, by: str = "task_id") -> DataFrame:
    """Rows of each output type up to its target; larger targets repeat if asked to."""
    staged = rows.withColumn("_type", type_from_key("output_type", "task_key"))
    wanted = _wanted(F.col("_type"), {str(k).strip().upper(): v for k, v in targets.items()}, default)
    return _taken(ranked(staged, ["_type"], seed, by), wanted, oversample).drop("_type")


def per_family(
    rows: DataFrame,
    families: Mapping[str, Mapping[str, Any]],
    targets: Mapping[str, Any],
    default: Any = None,
    default_family: str = "other",
    seed: int = 42,
    oversample: bool = False,
    by: str = "task_id",
    prefixes: Sequence[str] = (),
) -> DataFrame:
    """Rows of each family and type: family target, general target, family default,
    general default, all. A family that is not configured uses the default family's."""

    def plain(name: str) -> str:
        name = "".join(sign for sign in name.lower() if sign.isalnum()) or "other"
        return next((prefix for prefix in prefixes if name.startswith(prefix)), name)

    own = {plain(name): setting for name, setting in families.items()}
    staged = rows.withColumn("_type", type_from_key("output_type", "task_key")).withColumn("_family", family("task_family", prefixes))
    general = {str(k).strip().upper(): v for k, v in targets.items()}

    def wanted(setting: Mapping[str, Any]) -> Column:
        named = general | {str(k).strip().upper(): v for k, v in (setting.get("targets") or {}).items()}
        return _wanted(F.col("_type"), named, setting.get("default_target", default))

    chosen = wanted(own.get(plain(default_family), {}))
    for name, setting in own.items():
        chosen = F.when(F.col("_family") == name, wanted(setting)).otherwise(chosen)
    return _taken(ranked(staged, ["_family", "_type"], seed, by), chosen, oversample).drop("_type", "_family")


@dataclass(frozen=True)
class Selection:
    """How rows are selected: ``none``, ``balance_by_task`` or ``per_output_type``."""

    mode: str = "none"
    strategy: str = "min"
    fixed: int | None = None
    least: int = 1
    targets: Mapping[str, Any] | None = None
    default: Any = None
    families: Mapping[str, Any] | None = None
    oversample: bool = False
    seed: int = 42

    def with_environment(self, env: Mapping[str, str], prefix: str = "BALANCE_") -> "Selection":
        """Overrides from variables ``<prefix>STRATEGY``, ``FIXED_N``, ``MIN_COUNT``, ``SEED``."""
        from dataclasses import replace

        given = {
            "strategy": env.get(f"{prefix}STRATEGY"),
            "fixed": env.get(f"{prefix}FIXED_N"),
            "least": env.get(f"{prefix}MIN_COUNT"),
            "seed": env.get(f"{prefix}SEED"),
        }
        numbers = {"fixed", "least", "seed"}
        return replace(self, **{k: int(v) if k in numbers else v for k, v in given.items() if v})


def selected(rows: DataFrame, how: Selection, by: str = "task_id") -> DataFrame:
    from .filtering import frequent_groups, task_key_or_default

    if how.mode == "none":
        return rows
    if how.mode == "balance_by_task":
        keyed = rows.withColumn("task_key", task_key_or_default())
        return balanced(frequent_groups(keyed, how.least), "task_key", how.strategy, how.fixed, how.seed, by).drop("rank", "copy")
    if how.mode == "per_output_type":
        if how.families:
            made = per_family(rows, how.families, how.targets or {}, how.default, seed=how.seed, oversample=how.oversample, by=by)
        else:
            made = per_type(rows, how.targets or {}, how.default, how.seed, how.oversample, by)
        return made.drop("rank", "copy")
    raise ValueError(f"unknown mode: {how.mode}")


def source_block(config: Mapping[str, Any], forced: str = "auto") -> str:
    """Which block of the data configuration holds: online, offline or legacy."""
    if forced.strip().lower() in ("online", "offline"):
        return forced.strip().lower()
    for name in ("online", "offline"):
        block = config.get(f"{name}_dataset")
        if isinstance(block, Mapping) and block.get("use"):
            return name
    return "legacy"


def _split(rows: DataFrame, size: Callable[[int], int], seed: int, by: str) -> tuple[DataFrame, DataFrame]:
    n = rows.count()
    held_out = n if n <= 1 else size(n)
    staged = ranked(rows, [], seed, by).drop("size")
    return staged.where(F.col("rank") > held_out).drop("rank"), staged.where(F.col("rank") <= held_out).drop("rank")


def training_split(rows: DataFrame, share: float, seed: int = 42, by: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of the usable ones; at least one to validate, halves
    rounded to even; a single row is for validation."""
    from .filtering import usable_rows

    return _split(usable_rows(rows), lambda n: max(1, round(n * share)), seed, by)


def task_split(rows: DataFrame, share: float, seed: int = 42, by: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """As ``training_split`` for all rows, with the number cut off to an integer."""
    return _split(rows, lambda n: max(1, int(n * share)), seed, by)


def limited(rows: DataFrame, n: int, seed: int | None = None, by: str = "task_id") -> DataFrame:
    """The first ``n`` rows in a seeded order, or in the order of ``by``; 0 is all."""
    if not n:
        return rows
    return rows.orderBy(*([shuffled(seed, by)] if seed is not None else []), by).limit(n)


def first_then_shuffled(rows: DataFrame, most: int | None, seed: int, by: str = "task_id") -> DataFrame:
    """The first ``most`` rows in the order of ``by``, and only then shuffled."""
    first = rows.orderBy(by).limit(most) if most else rows
    return first.orderBy(shuffled(seed, by), by)


def limited_per_type(rows: DataFrame, n: int, types: Sequence[str], seed: int | None = None, by: str = "task_id") -> DataFrame:
    """Up to ``n`` rows of each type, seeded or in the order of ``by``, in ``place`` of the types."""
    kind = F.upper(F.trim(F.coalesce("output_type", F.lit("JSON"))))
    place = F.array_position(F.array(*map(F.lit, types)), kind)
    order = [shuffled(seed, by)] if seed is not None else []
    window = Window.partitionBy("place").orderBy(*order, by)
    staged = rows.withColumn("place", place).where("place > 0")
    # Only the first rows of each type are wanted, which Spark cuts inside every task.
    return staged.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_groups(rows: DataFrame, group: str, metric: str, n: int) -> DataFrame:
    """The rows of the ``n`` groups with the largest value of the metric, with ``place``."""
    best = rows.groupBy(group).agg(F.max(metric).alias("_best"))
    first = best.orderBy(F.desc("_best"), group).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("_best"), group)).alias("place")
    return rows.join(F.broadcast(first.select(group, place)), group)


def steps(examples: int, batch: int, accumulate: int, epochs: float | None = None) -> dict[str, int]:
    """Optimiser steps for so many examples."""
    effective = max(1, batch * max(1, accumulate))
    made = {"effective_batch": effective, "steps_per_epoch": math.ceil(examples / effective)}
    if epochs is not None:
        made["total_steps"] = math.ceil(made["steps_per_epoch"] * epochs)
    return made


def drawn(space: Mapping[str, Mapping[str, Any]], seed: int) -> dict[str, Any]:
    """A random draw of hyper-parameters: choice, uniform, log_uniform or int."""
    import random

    source, found = random.Random(seed), {}
    for name, rule in space.items():
        kind = rule.get("type", "choice")
        if kind == "choice":
            found[name] = source.choice(rule["values"])
        elif kind == "int":
            found[name] = source.randint(int(rule["low"]), int(rule["high"]))
        elif kind == "uniform":
            found[name] = source.uniform(rule["low"], rule["high"])
        elif kind == "log_uniform":
            found[name] = math.exp(source.uniform(math.log(rule["low"]), math.log(rule["high"])))
        else:
            raise ValueError(f"unknown kind of parameter: {kind}")
    return found
