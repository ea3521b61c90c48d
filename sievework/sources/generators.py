"""Made-up tasks, training rows, and completions whose verdicts are known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import FORMATS

#: Key paths that the made-up tasks ask for.
ARTICLE_PATHS = (
    "title",
    "authors[0].name",
    "authors[0].affiliation",
    "authors[1].name",
    "authors[1].affiliation",
    "publication.year",
    "keywords[0]",
)
PATHS = {
    "JSON": ARTICLE_PATHS,
    "YAML": ARTICLE_PATHS,
    "TOML": ARTICLE_PATHS,
    "XML": ("article.title", "article.publication.year"),
    "CSV": ("rows[0].title", "rows[0].year"),
}
SUBJECTS = ("parsing", "grammars", "tables", "markup", "records", "schemas")
PLACES = ("Northern Institute", "Harbour College", "Valley University")


def _one_of(words: Sequence[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(F.rand(seed) * len(words)) + 1).cast("int"))


def tasks(spark: SparkSession, n: int, formats: Sequence[str] = ("JSON",), first: int = 500) -> DataFrame:
    """Tasks in turn for each format, ids from ``first`` on, six digits wide."""
    names = [name.strip().upper() for name in formats if name.strip()] or ["JSON"]
    turn = (F.col("id") % len(names)).cast("int") + 1
    paths = F.create_map(*(x for name in names for x in (F.lit(name), F.array(*map(F.lit, PATHS.get(name, ARTICLE_PATHS))))))
    kind = F.element_at(F.array(*map(F.lit, names)), turn)
    return spark.range(n).select(
        F.format_string("%06d", F.col("id") + first).alias("task_id"),
        F.concat(F.lit("Please output "), kind, F.lit(" code.\n\nTask:\nDescribe a made-up article.\n")).alias("query"),
        F.lit("").alias("feature_requirements"),
        F.concat(F.lit("Text to "), kind, F.lit(" (mock)")).alias("task_name"),
        F.lit("Text").alias("input_type"),
        kind.alias("output_type"),
        F.lit("").alias("query_example"),
        F.array().cast("array<string>").alias("VQA"),
        F.element_at(paths, kind).alias("raw_output_metric"),
        F.lit(False).alias("rendering"),
    )


def training_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Rows with compact JSON articles as outputs; one seed gives one result."""

    def author(k: int) -> Column:
        return F.struct(
            F.concat(F.lit("Author "), (F.floor(F.rand(seed + k) * 1000)).cast("string")).alias("name"),
            _one_of(PLACES, seed + 10 + k).alias("affiliation"),
        )

    article = F.struct(
        F.concat(F.lit("On "), _one_of(SUBJECTS, seed + 20)).alias("title"),
        F.array(author(1), author(2)).alias("authors"),
        F.struct((F.floor(F.rand(seed + 30) * 12) + 2015).cast("int").alias("year")).alias("publication"),
        F.slice(F.array(*map(F.lit, SUBJECTS)), 1, (F.floor(F.rand(seed + 40) * 4) + 3).cast("int")).alias("keywords"),
    )
    return spark.range(n).select(
        F.lit("Please output JSON code.\n\nTask:\nDescribe a made-up article.\n").alias("instruction"),
        F.array(F.lit("The output is one JSON object and nothing else.")).alias("requirements"),
        F.to_json(article).alias("output"),
    )


#: Seed rows of nested TOML: id, schema, query, output.
NESTED_TOML = (
    ("nested_toml_0001", "deep_profile", "Write the user's profile as TOML.", '[user.profile]\nname = "Ada"\n\n[user.profile.contact]\nemail = "ada@example.com"\n'),
    ("nested_toml_0002", "deep_orders", "Write the order as TOML with a list of items.", '[orders]\nid = "A-1"\n\n[[orders.items]]\nsku = "X"\nqty = 2\n'),
    ("nested_toml_0003", "deep_keys", "Write the settings as dotted TOML keys.", 'server.http.port = 80\nserver.http.host = "localhost"\n'),
    ("nested_toml_0004", "deep_plant", "Write the plant's lines as TOML.", '[plant.line.one]\nspeed = 3\n\n[plant.line.two]\nspeed = 4\n'),
)


def with_nested_toml(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``task_id``) and the seed rows that are not there yet."""
    spark = rows.sparkSession
    seeds = spark.createDataFrame(
        [(i, query, output, "TOML", "extra", "extract", schema, f"extra|TOML|extract|{schema}") for i, schema, query, output in NESTED_TOML],
        "task_id string, query string, output string, output_type string, task_family string, task_kind string, "
        "task_schema string, task_key string",
    )
    fresh = seeds.join(rows.select("task_id"), "task_id", "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


# --- Completions with known verdicts --------------------------------------------------

VARIANTS = 7
#: What is done to a clean body, by variant; the others are clean.
FENCED, CHATTY, BROKEN = 1, 2, 3


def completions(part: DataFrame) -> DataFrame:
    """A completion for each row of ``part`` (p_partkey, p_name, p_size): the format by
    key modulo 5, the corruption by key modulo 7. Only strings and integers are joined, so
    any engine builds the same texts."""
    title, year = F.col("p_name"), F.col("p_size").cast("string")
    tick = F.lit("```")

    def put(*pieces: str | Column) -> Column:
        return F.concat(*(F.lit(piece) if isinstance(piece, str) else piece for piece in pieces))

    bodies = {
        "JSON": put('{"title": "', title, '", "publication": {"year": ', year, "}}"),
        "YAML": put("title: ", title, "\npublication:\n  year: ", year),
        "TOML": put('title = "', title, '"\n\n[publication]\nyear = ', year),
        "XML": put("<article><title>", title, "</title><publication><year>", year, "</year></publication></article>"),
        "CSV": put("title,year\n", title, ",", year),
    }
    body = F.col("body")
    broken = {
        "JSON": F.substring(body, F.lit(1), F.length(body) - 1),
        "YAML": put("a: b: ", body),
        "TOML": put("x: 1\n", body),
        "XML": put(body, "<tail>"),
        "CSV": F.lit("just some text"),
    }
    paths = {
        "JSON": ("title", "publication.year"),
        "YAML": ("title", "publication.year"),
        "TOML": ("title", "publication.year"),
        "XML": ("article.title", "article.publication.year"),
        "CSV": ("rows[0].title", "rows[0].year"),
    }
    kind = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("p_partkey") % 5).cast("int") + 1)

    def pick(options: dict[str, Column]) -> Column:
        chosen = F.lit(None)
        for name, option in options.items():
            chosen = F.when(F.col("output_type") == name, option).otherwise(chosen)
        return chosen

    rows = part.select(
        F.col("p_partkey").alias("id"),
        kind.alias("output_type"),
        (F.col("p_partkey") % VARIANTS).cast("int").alias("variant"),
        "p_name",
        "p_size",
    ).withColumn("body", pick(bodies))
    variant = F.col("variant")
    text = (
        F.when(variant == FENCED, F.concat(tick, F.lower("output_type"), F.lit("\n"), body, F.lit("\n"), tick))
        .when(variant == CHATTY, F.concat(F.lit("Sure! Here is the answer\n"), body))
        .when(variant == BROKEN, pick(broken))
        .otherwise(body)
    )
    return rows.withColumn("generation", text).withColumn(
        "raw_output_metric", pick({name: F.array(*map(F.lit, own)) for name, own in paths.items()})
    )
