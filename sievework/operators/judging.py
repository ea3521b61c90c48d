"""Judges: cache, look-up, refresh, and calls through any client."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.scores import judge_key_text

CACHE_KEY = ("provider", "model", "key")


def cache_key(provider: str, model: str, content: Mapping[str, Any]) -> str:
    """SHA-256 of provider, model and content; the content in sorted JSON as Python writes it."""
    return hashlib.sha256(judge_key_text(provider, model, content).encode()).hexdigest()


def cache_key_of(provider: str, model: str, content: Column) -> Column:
    """The same for a struct column, handed over as JSON text; numbers and nested values have
    to look as Python writes them, so the text is made anew there."""
    return udfs.arrow(lambda text: cache_key(provider, model, json.loads(text)), "string")(F.to_json(content))


def _ids(row: Column) -> Column:
    """Task ids of a cache row, its own first."""
    empty = F.array().cast("array<string>")
    one = F.when(row["task_id"].isNotNull(), F.array(row["task_id"]))
    return F.concat(F.coalesce(one, empty), F.coalesce(row["task_ids"], empty))


def upsert(cache: DataFrame, new: DataFrame, order: Column | str = "task_id") -> DataFrame:
    """The cache with new answers, one row for each key: an answer replaces older ones, and
    task ids are united, those of newer answers first and each once. Of several new answers
    for one key the last in the ``order`` (a column of ``new``) wins, as if they had been
    written one after the other; answers of equal order are taken by their values."""
    fields = [*CACHE_KEY, "score", "passed", "details", "task_id", "task_ids"]
    old = cache.select(*fields, F.lit(False).alias("_new"), F.lit(None).cast(new.select(order).dtypes[0][1]).alias("_at"))
    both = old.unionByName(new.select(*fields, F.lit(True).alias("_new"), (F.col(order) if isinstance(order, str) else order).alias("_at")))
    row = F.struct("_new", "_at", *fields[3:])
    gathered = both.groupBy(*CACHE_KEY).agg(F.sort_array(F.collect_set(row), asc=False).alias("_rows"))
    last = F.col("_rows")[0]
    ids = F.array_distinct(F.flatten(F.transform("_rows", _ids)))
    return gathered.select(
        *CACHE_KEY,
        *(last[name].alias(name) for name in ("score", "passed", "details")),
        F.try_element_at(ids, F.lit(1)).alias("task_id"),
        ids.alias("task_ids"),
    )


def refreshed(records: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Records (with ``cache_key``) with score, verdict and details of the cache where it
    has the key; ``cache_hit`` says so."""
    own = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select(
        F.col("key").alias("cache_key"),
        F.col("score").alias("_score"),
        F.col("passed").alias("_passed"),
        F.col("details").alias("_details"),
        F.lit(True).alias("cache_hit"),
    )
    joined = records.join(own, "cache_key", "left")
    rest = [name for name in records.columns if name not in ("score", "passed", "details", "cache_hit")]
    return joined.select(
        *rest,
        F.coalesce("_score", "score").alias("score"),
        F.coalesce("_passed", "passed").alias("passed"),
        F.coalesce("_details", "details").alias("details"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
    )


def misses(records: DataFrame, cache: DataFrame, provider: str, model: str, order: str = "task_id") -> DataFrame:
    """Records that have to be asked for: each key once, by its first record in the order."""
    own = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select(F.col("key").alias("cache_key"))
    missed = records.join(own, "cache_key", "left_anti")
    row = F.struct(*(F.col(name) for name in missed.columns))
    return missed.groupBy(F.col("cache_key").alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


@dataclass
class Answer:
    score: float
    passed: bool
    details: dict[str, Any]


class Judge(Protocol):
    def __call__(self, task: Mapping[str, Any], generation: str) -> Answer: ...


class JudgeFailed(RuntimeError):
    pass


def first_success(judges: Sequence[Judge]) -> Judge:
    """The answer of the first judge that gives one."""

    def ask(task: Mapping[str, Any], generation: str) -> Answer:
        problems = []
        for judge in judges:
            try:
                return judge(task, generation)
            except Exception as problem:
                problems.append(repr(problem))
        raise JudgeFailed("; ".join(problems) or "there is no judge")

    return ask


def make_judges(config: Mapping[str, Any], makers: Mapping[str, Callable[[Mapping[str, Any]], Judge]]) -> list[Judge]:
    """Judges by the list of providers, each with the general settings and its own; those
    that cannot be made are left out."""
    made = []
    for entry in config.get("providers", ()):
        own = {"name": entry} if isinstance(entry, str) else dict(entry)
        settings = {k: v for k, v in config.items() if k != "providers"} | own
        try:
            made.append(makers[own["name"]](settings))
        except Exception:
            continue
    return made


def with_retries(call: Callable[..., Any], tries: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """The call, repeated after waits that double."""

    def run(*args: Any, **named: Any) -> Any:
        for k in range(tries):
            try:
                return call(*args, **named)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(first_wait * 2**k)

    return run


def reply(text: str) -> Answer:
    """A judge's JSON reply; a score outside 0 to 1 is cut to it."""
    found = json.loads(text)
    score = min(1.0, max(0.0, float(found.get("score", 0.0))))
    return Answer(score, bool(found.get("passed", False)), found)


def asked(records: DataFrame, judge: Callable[[], Judge], provider: str, model: str) -> DataFrame:
    """Calls the judge for each record (task fields, ``generation``, ``cache_key``), a
    client for each task; rows are ready for ``upsert``. A failing call is an answer of 0
    with its error, which is stored as such."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = judge()
        for batch in batches:
            rows = []
            for task in batch.to_dict("records"):
                try:
                    answer = client(task, task.get("generation") or "")
                except Exception as problem:
                    answer = Answer(0.0, False, {"error": str(problem)})
                rows.append(
                    (provider, model, task["cache_key"], answer.score, answer.passed, task.get("task_id"),
                     [task["task_id"]] if task.get("task_id") else [], json.dumps(answer.details, ensure_ascii=False))
                )
            yield pd.DataFrame(rows, columns=["provider", "model", "key", "score", "passed", "task_id", "task_ids", "details"])

    from ..schemas import JUDGE_CACHE

    return records.mapInPandas(run, JUDGE_CACHE)


def generated(prompts: DataFrame, teacher: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """Adds ``generation`` and ``error``: what a teacher makes of system and prompt texts,
    a client for each task."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*prompts.schema.fields, StructField("generation", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = teacher()
        for batch in batches:
            made, errors = [], []
            for system, prompt in zip(batch["system"], batch["prompt"]):
                try:
                    made.append(client(system, prompt))
                    errors.append("")
                except Exception as problem:
                    made.append("")
                    errors.append(str(problem))
            yield batch.assign(generation=made, error=errors)

    return prompts.mapInPandas(run, schema)
