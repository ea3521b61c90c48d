"""Queries that write files and read them again, and queries of operators on records, prompts,
settings, judges and teachers. The SQL computes from the tables what should come out."""

from __future__ import annotations

import json
import os
import zipfile
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions import formats, trees, udfs
from ..operators import filtering, judging, preparing, sampling, scoring, teaching
from ..sources import readers, writers
from ..sources.scratch import scratch
from .relational import _ESCAPES_SQL, COMPLETIONS, _completions, _escape_stats, query, read, role_pivot, ROLES_SQL


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema)


def folder(spark: SparkSession, name: str) -> str:
    """A new local or shared folder that exists, for small files the driver writes."""
    path = scratch(spark, name)
    os.makedirs(path)
    return path


# --- Files ----------------------------------------------------------------------------


@query("SELECT * FROM documents")
def json_lines_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, appended to, and read strictly."""
    docs, path = read(spark, sf_dir, "documents"), scratch(spark, "lines")
    writers.json_lines(docs.where("doc_id % 2 = 0"), path)
    writers.append_lines(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), path)
    return readers.json_lines(spark, path, ddl(docs))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def bad_lines_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line lacks its last bracket."""
    line, path = F.to_json(F.struct("doc_id", "lang")), scratch(spark, "bad-lines")
    broken = F.when(F.col("doc_id") % 3 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    read(spark, sf_dir, "documents").select(broken.alias("value")).write.text(path)
    return readers.json_lines(spark, path, "doc_id long, lang string", lenient=True)


@query("SELECT * FROM nation")
def json_array_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one array; the path makes the configured format an array."""
    rows, path = read(spark, sf_dir, "nation"), f"{folder(spark, 'array')}/nation.json"
    writers.json_array(rows, path, indent=2)
    return readers.records(spark, path, readers.file_format_for(path, "jsonl"), ddl(rows))


@query("SELECT n_nationkey FROM nation")
def objects_of_an_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array in which text and numbers stand among the objects."""
    found = [{"n_nationkey": row["n_nationkey"]} for row in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    path = f"{folder(spark, 'mixed-array')}/mixed.json"
    with open(path, "w", encoding="utf-8") as file:
        json.dump([x for k, one in enumerate(found) for x in ([one, k, "text"] if k % 2 else [one])], file)
    return readers.json_array(spark, path, "n_nationkey int", lenient=True)


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY source")
def files_below_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each language, of which the files are found again, each once."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), scratch(spark, "by-language")
    writers.by_column(docs, path, "lang")
    top = readers.first_existing([None, f"{path}-missing", path])
    files = readers.data_files([top, top], ".json")
    rows = readers.json_lines(spark, files, "doc_id long, source string")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT regexp_replace(p_brand || '|' || p_type, '[^A-Za-z0-9_|.-]+', '_', 'g') AS task_dir, count(*) AS n FROM part GROUP BY 1")
def task_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("task_key"))
    path = scratch(spark, "by-task")
    writers.by_task(rows, path)
    return spark.read.json(path).groupBy("task_dir").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents")
def split_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a test split was exported, and the training split is asked for."""
    path = scratch(spark, "exported")
    read(spark, sf_dir, "documents").select("doc_id", "lang").write.parquet(f"{path}/test.parquet")
    return readers.exported_split(spark, path, "train")


@query("SELECT n_nationkey, n_name FROM nation")
def zipped_arrow_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Arrow streams of a split inside a zip file."""
    import pyarrow as pa

    table, path = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow(), folder(spark, "zip")
    with zipfile.ZipFile(f"{path}/nation.zip", "w") as archive:
        for k, part in enumerate((table.slice(0, 10), table.slice(10))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_table(part)
            archive.writestr(f"set/nation-{k}-train.arrow", sink.getvalue().to_pybytes())
    return readers.zipped_arrow(spark, f"{path}/nation.zip", "train", f"{path}/parquet")


@query(f"{_ESCAPES_SQL} SELECT * FROM stats")
def csv_summaries_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _escape_stats(spark, sf_dir), scratch(spark, "csv")
    writers.csv_with_header(rows, path, rows.columns)
    return readers.csv_summaries(spark, path).drop("source_file")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 THEN 'base_model ' || p_brand ELSE p_brand END AS method,
    CASE WHEN p_type = 'SMALL' THEN '96' ELSE CAST(p_size AS VARCHAR) END AS score, p_size % 2 = 0 AS base FROM part"""
)
def experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a cell patched and a column renamed, taken apart into base models and others."""
    how = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("base_model "), "p_brand")).otherwise(F.col("p_brand"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), how.alias("how"), F.col("p_size").alias("score"), "p_type")
    path = scratch(spark, "experiments")
    writers.csv_with_header(rows, path, ["id", "how", "score", "p_type"])
    base, others = readers.experiments(spark, path, {"how": "method"}, [("p_type", "SMALL", "score", "96")])
    both = base.withColumn("base", F.lit(True)).unionByName(others.withColumn("base", F.lit(False)))
    return both.select("id", "method", "score", "base")


@query(
    "SELECT '20260102_03040' || r_regionkey || '_stage' || r_regionkey || '_abc_' || r_name AS run_id, 'stage' || r_regionkey AS stage, "
    "CAST(r_regionkey * 10 AS BIGINT) AS n, r_regionkey / 4e0 AS avg_final_eval_score FROM region"
)
def run_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run folder for each region with a summary, and one whose summary cannot be read."""
    base = folder(spark, "runs")
    for key, name in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        run = writers.run_folder(base, f"stage{key}", "abc", name, datetime(2026, 1, 2, 3, 4, key))
        with open(f"{run}/scored.summary.json", "w", encoding="utf-8") as file:
            json.dump({"n": key * 10, "avg_final_eval_score": key / 4}, file)
    with open(f"{writers.run_folder(base, 'bad', 'abc', now=datetime(2026, 1, 2))}/x.summary.json", "w", encoding="utf-8") as file:
        file.write("{")
    return readers.run_summaries(spark, base).select("run_id", "stage", "n", "avg_final_eval_score")


@query(
    f"{COMPLETIONS} SELECT id, round(final, 6) AS final_eval_score, (SELECT count(*) FROM scored) AS n, "
    "(SELECT round(avg(final), 6) FROM scored) AS average FROM scored"
)
def scored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows and the summary that is written beside them."""
    rows, path = scoring.scored(_completions(spark, sf_dir)).select("id", "final_eval_score"), scratch(spark, "scored")
    writers.scored(rows, scoring.score_summary(rows), path)
    summary = spark.read.schema("n long, avg_final_eval_score double").json(f"{path}.summary").first()
    again = readers.json_lines(spark, path, "id long, final_eval_score double")
    return again.select(
        "id", F.round("final_eval_score", 6).alias("final_eval_score"),
        F.lit(summary["n"]).alias("n"), F.round(F.lit(summary["avg_final_eval_score"]), 6).alias("average"),
    )


@query(f"{COMPLETIONS} SELECT id, output_type FROM verdict WHERE render_score < 1")
def failure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = scoring.scored(_completions(spark, sf_dir)), scratch(spark, "failures")
    writers.failures(rows.select("id", "output_type", "render_score"), F.col("render_score") < 1, path)
    return readers.json_lines(spark, path, "id long, output_type string")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 7 NOT IN (3, 6)")
def valid_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo rows of which some could not be parsed and some are blank."""
    key, path = F.col("p_partkey"), scratch(spark, "valid")
    output = F.when(key % 7 == 6, " \n").otherwise(F.col("p_name"))
    ok = F.when(key % 7 == 3, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    writers.valid_lines(read(spark, sf_dir, "part").select(key.alias("id"), output.alias("output"), F.struct(ok.alias("parse_ok")).alias("meta")), path)
    return readers.json_lines(spark, path, "id long")


@query(
    "SELECT string_agg('--- ' || (r_regionkey + 1) || chr(10) || 'key:' || chr(10) || r_regionkey || chr(10) || 'name:' || chr(10) || r_name || chr(10) || 'x', "
    "chr(10) ORDER BY r_regionkey) AS preview FROM region WHERE r_regionkey < 3"
)
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a terminal shows of the first three rows, line ends and all."""
    name = F.concat("r_name", F.lit("\nx")).alias("name")
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("key"), name)
    return spark.range(1).select(F.lit(writers.shown(rows, 3)).alias("preview"))


# --- Records --------------------------------------------------------------------------

_CHATS = f"""WITH turns_ AS ({ROLES_SQL}), chats AS (SELECT *, (['json', ' YAML', 'c_toml', 'yml'])[conv_id % 4 + 1] AS fmt,
  CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS family FROM turns_)"""


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows: messages, and metadata of which some is missing, for every conversation."""
    key = F.col("conv_id")
    even = key % 2 == 0

    def said(role: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(f"{role}_text").alias("content"))

    metadata = F.struct(
        F.element_at(F.array(*map(F.lit, ("json", " YAML", "c_toml", "yml"))), (key % 4 + 1).cast("int")).alias("format"),
        F.when(key % 3 != 0, " Extract ").alias("type"),
        F.when(key % 5 != 0, "s1").alias("schema"),
        F.when(even, F.concat(F.lit(" prompt "), key.cast("string"))).alias("prompt"),
        F.lit(None).cast("string").alias("output"),
        F.when(key % 3 == 1, " ").alias("final_output"),
        F.lit(None).cast("string").alias("answer"),
        F.when(key % 3 == 1, F.concat(F.lit('{"gold": '), key.cast("string"), F.lit("}"))).alias("gold"),
        F.lit(None).cast("string").alias("target"),
    )
    return role_pivot(spark, sf_dir).select(
        "conv_id",
        F.when(even, "chat-a/x").otherwise("chat-b/y").alias("dataset"),
        F.array(said("system"), said("user"), said("assistant")).alias("messages"),
        metadata.alias("metadata"),
        F.when(key % 6 == 2, '{"column": 1}').alias("output"),
        F.when(key % 3 != 0, "Convert").alias("task"),
        F.lit("sub_to_csv").alias("subcategory"),
        "user_text",
        "assistant_text",
    )


@query(
    f"""{_CHATS} SELECT conv_id, 'a' AS family, (['JSON', 'YAML', 'TOML', 'YAML'])[conv_id % 4 + 1] AS kind, coalesce(assistant_text, '') AS answer,
    'a|' || (['JSON', 'YAML', 'TOML', 'YAML'])[conv_id % 4 + 1] || '|' || CASE WHEN conv_id % 3 <> 0 THEN 'Extract' ELSE 'unknown' END || '|' ||
    CASE WHEN conv_id % 5 <> 0 THEN 's1' ELSE 'unknown' END AS task_key FROM chats"""
)
def analysis_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preparing.records_of(_chats(spark, sf_dir).drop("assistant_text"))
    return found.select("conv_id", "family", F.col("output_format_found").alias("kind"), F.col("assistant_text").alias("answer"), "task_key")


@query(
    f"""{_CHATS} SELECT conv_id, 'b' AS family, 'CSV' AS kind, 'b|CSV|' || CASE WHEN conv_id % 3 <> 0 THEN 'Convert' ELSE 'unknown' END || '|sub_to_csv' AS task_key FROM chats"""
)
def category_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chats(spark, sf_dir).drop("metadata", "assistant_text").withColumn("category", F.lit("C_JSON"))
    return preparing.records_of(rows).select("conv_id", "family", F.col("output_format_found").alias("kind"), "task_key")


@query(
    f"""{_CHATS} SELECT conv_id, family AS task_family, (['JSON', 'YAML', 'TOML', 'YAML'])[conv_id % 4 + 1] AS kind,
    family || '|' || (['JSON', 'YAML', 'TOML', 'YAML'])[conv_id % 4 + 1] || '|' || CASE WHEN conv_id % 3 = 0 THEN 'unknown' WHEN family = 'a' THEN 'extract' ELSE 'convert' END
    || '|' || CASE WHEN family = 'b' THEN 'sub_to_csv' WHEN conv_id % 5 <> 0 THEN 's1' ELSE 'unknown' END AS task_key FROM chats"""
)
def task_meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chats(spark, sf_dir)
    rows = rows.withColumn("kind", preparing.declared_type(rows)).withColumn("said", F.lit("hello"))
    return rows.select("conv_id", "kind", *preparing.task_meta(rows, "said", F.col("kind"))).select("conv_id", "task_family", "kind", "task_key")


@query(
    f"""{_CHATS} SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'prompt ' || conv_id END AS prompt,
    CASE WHEN conv_id % 3 = 1 THEN '{{"gold": ' || conv_id || '}}' END AS answer,
    CASE WHEN conv_id % 3 = 1 THEN '{{"gold": ' || conv_id || '}}' WHEN conv_id % 6 = 2 THEN '{{"column": 1}}' ELSE '{{"said": 1}}' END AS reference FROM chats"""
)
def metadata_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit('Output:\n```json\n{"said": 1}\n```')
    reference = preparing.reference_output("output", said, F.lit("JSON"))
    return _chats(spark, sf_dir).select(
        "conv_id", preparing.metadata_prompt().alias("prompt"), preparing.metadata_answer().alias("answer"), reference.alias("reference")
    )


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id % 4 = 0")
def conversations_that_say(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which a user says just ``stop``."""
    said = F.struct("role", F.when(F.col("conv_id") % 4 == 0, "stop").otherwise(F.col("text")).alias("content"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.array(said).alias("messages"))
    return turns.where(preparing.says("messages", "user", "stop")).select("conv_id").distinct()


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 NOT IN (1, 2)")
def usable_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an output of which nothing says that it could not be parsed."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 4 == 1, " ").otherwise(F.col("p_name")).alias("output"),
        F.struct(F.when(key % 4 == 2, F.lit(False)).when(key % 4 == 3, F.lit(True)).alias("parse_ok")).alias("meta"),
    )
    return filtering.usable_rows(rows).select("id")


@query(f"{COMPLETIONS} SELECT id, output_type FROM verdict WHERE parse = 1")
def rows_with_strict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).withColumn("output", F.col("generation"))
    return filtering.strict_payloads(rows).select("id", "output_type")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (0, 1)")
def tasks_of_wanted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are stated, or told from the query."""
    key = F.col("p_partkey") % 4
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(key == 0, "TOML").when(key == 3, "xml").alias("output_type"),
        F.when(key == 1, "Write it as YAML, please").when(key == 2, "a table (CSV)").otherwise("json").alias("query"),
    )
    return filtering.wanted_types(rows, ["toml", "YAML"]).select("id")


# --- Trees, sets and settings ---------------------------------------------------------


def _xml_json(convert):
    import xml.etree.ElementTree as ET

    return udfs.arrow(lambda text: json.dumps(convert(ET.fromstring(text))), "string")


@query(
    f"""{COMPLETIONS} SELECT id, CASE output_type
      WHEN 'XML' THEN '{{"title": "' || p_name || '", "publication": {{"year": "' || p_size || '"}}}}'
      ELSE '{{"rows": [{{"title": "' || p_name || '", "year": "' || p_size || '"}}]}}' END AS tree,
      CASE output_type WHEN 'XML' THEN '{{"article": {{"title": {{"title": "' || p_name || '"}}, "publication": {{"publication": {{"year": {{"year": "' || p_size || '"}}}}}}}}}}' END AS wrapped
      FROM comp JOIN part ON id = p_partkey WHERE output_type IN ('XML', 'CSV')"""
)
def xml_and_csv_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).where("output_type IN ('XML', 'CSV')")
    table = udfs.arrow(lambda text: json.dumps(trees.rows_tree(formats.table_rows(text))), "string")
    xml = F.col("output_type") == "XML"
    own = F.when(xml, F.col("body")).otherwise("<x/>")
    return rows.select(
        "id",
        F.when(xml, _xml_json(trees.element_tree)(own)).otherwise(table("body")).alias("tree"),
        F.when(xml, _xml_json(trees.wrapped_element)(own)).alias("wrapped"),
    )


@query(
    "SELECT p_partkey AS id, '{\"a\": {\"b\": ' || p_size || ', \"z\": 0}, \"c\": {\"d\": \"' || p_name || '\"}}' AS config FROM part"
)
def overridden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(size: int, name: str) -> str:
        return json.dumps(settings.overridden({"a": {"b": 1, "z": 0}, "c": 5}, {"a.b": size, "c.d": name}))

    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), udfs.arrow(made, "string")("p_size", "p_name").alias("config"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END AS common, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS only_left,
    CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END AS together FROM part"""
)
def leaf_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of the leaves of two trees."""
    left = F.concat(F.lit('{"a": "x", "b": '), (F.col("p_partkey") % 3).cast("string"), F.lit("}"))
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), udfs.leaves(left, F.lit("JSON")).alias("l"), udfs.leaves(F.lit('{"a": "x", "b": 1}'), F.lit("JSON")).alias("r")
    )
    return rows.select(
        "id", F.size(F.array_intersect("l", "r")).alias("common"), F.size(F.array_except("l", "r")).alias("only_left"), F.size(F.array_union("l", "r")).alias("together")
    )


@query(
    f"{_ESCAPES_SQL} SELECT escape_type FROM found WHERE n > 0 AND usable UNION SELECT escape_type FROM found WHERE n > 0 AND NOT usable"
)
def escape_types_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that occur in usable pages or in others, each once."""
    stats = _escape_stats(spark, sf_dir)
    usable = stats.where("occurrences_usable > 0").select("escape_type")
    return usable.union(stats.where("occurrences_total > occurrences_usable").select("escape_type")).distinct()


# --- Selections, blocks, steps, draws -------------------------------------------------


@query(
    """SELECT 'balance' AS mode, p_brand AS name, CAST(7 AS BIGINT) AS n FROM part GROUP BY p_brand HAVING count(*) >= 3
    UNION ALL SELECT 'types', p_type, least(count(*), CASE WHEN p_type = 'SMALL' THEN 4 ELSE 6 END) FROM part GROUP BY p_type
    UNION ALL SELECT 'none', 'all', count(*) FROM part"""
)
def selection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes of selection, one of them with settings from the environment."""
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"), F.col("p_type").alias("output_type"), F.col("p_brand").alias("task_key")
    )
    given = {"BALANCE_STRATEGY": "fixed", "BALANCE_FIXED_N": "7", "BALANCE_MIN_COUNT": "3"}
    balance = sampling.Selection("balance_by_task").with_environment(given)
    types = sampling.Selection("per_output_type", targets={"small": 4}, default=6)
    made = []
    for mode, how, name in (("balance", balance, "task_key"), ("types", types, "output_type"), ("none", sampling.Selection(), None)):
        found = sampling.selected(rows, how).select((F.col(name) if name else F.lit("all")).alias("name"))
        made.append(found.groupBy(F.lit(mode).alias("mode"), "name").agg(F.count("*").alias("n")))
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN 'online' WHEN p_partkey % 5 IN (1, 3) THEN 'online' WHEN p_partkey % 5 = 2 THEN 'offline' ELSE 'legacy' END AS block,
    CAST(8 * greatest(1, p_partkey % 4) AS BIGINT) AS effective_batch, CAST(ceil(p_size * 37 / (8e0 * greatest(1, p_partkey % 4))) AS BIGINT) AS steps_per_epoch,
    CAST(ceil(ceil(p_size * 37 / (8e0 * greatest(1, p_partkey % 4))) * 1.5e0) AS BIGINT) AS total_steps, true AS drawn_inside FROM part"""
)
def blocks_steps_and_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which data block holds, how many steps there are, and draws of parameters."""

    def block(key: int) -> str:
        config = {"online_dataset": {"use": key % 2 == 1}, "offline_dataset": {"use": key >= 2}}
        return sampling.source_block(config, "Online " if key == 4 else "auto")

    def steps(size: int, key: int) -> dict:
        return sampling.steps(size * 37, 8, key % 4, 1.5)

    space = {
        "a": {"values": [1, 2, 3]}, "b": {"type": "int", "low": 2, "high": 4},
        "c": {"type": "uniform", "low": 0.5, "high": 0.7}, "d": {"type": "log_uniform", "low": 1e-5, "high": 1e-3},
    }

    def inside(key: int) -> bool:
        x = sampling.drawn(space, key)
        bounds = x["a"] in (1, 2, 3) and 2 <= x["b"] <= 4 and 0.5 <= x["c"] <= 0.7 and 1e-5 <= x["d"] <= 1e-3
        return bounds and x == sampling.drawn(space, key)

    key = F.col("p_partkey")
    counted = udfs.arrow(steps, "effective_batch long, steps_per_epoch long, total_steps long")("p_size", "p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("id"), udfs.arrow(block, "string")(key % 5).alias("block"), counted.alias("s"), udfs.arrow(inside, "boolean")(key).alias("drawn_inside")
    ).select("id", "block", "s.*", "drawn_inside")


# --- Judges and teachers --------------------------------------------------------------


def _client():
    """A judge that cannot be made, one that always fails, and one that fails at every
    first try; what it replies is the length of the generation, as JSON."""
    tries: dict[str, int] = {}

    def failing(task, generation):
        raise RuntimeError("no answer")

    def flaky(task, generation):
        tries[task["cache_key"]] = tries.get(task["cache_key"], 0) + 1
        if tries[task["cache_key"]] == 1:
            raise TimeoutError("again")
        return judging.reply(json.dumps({"score": len(generation) / 16, "passed": len(generation) % 2 == 0}))

    makers = {"failing": lambda own: failing, "flaky": lambda own: judging.with_retries(flaky, own["tries"], sleep=lambda wait: None)}
    return judging.first_success(judging.make_judges({"providers": ["absent", "failing", {"name": "flaky"}], "tries": 2}, makers))


@query(
    "SELECT 'k' || p_partkey AS key, least(1e0, length(p_name) / 16e0) AS score, length(p_name) % 2 = 0 AS passed, 't' || p_partkey AS task_id FROM part"
)
def judged_by_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    records = read(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), key).alias("cache_key"), F.concat(F.lit("t"), key).alias("task_id"), F.col("p_name").alias("generation")
    )
    return judging.asked(records, _client, "p", "m").select("key", "score", "passed", "task_id")


def _teacher():
    def teach(system: str, prompt: str) -> str:
        if prompt.startswith("5"):
            raise RuntimeError("no model")
        return f'{{"n": {len(prompt)}}}' + (" and more" if prompt.startswith("6") else "")

    return teach


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 5 THEN '' ELSE '{"n": ' || (length(p_name) + 2) || '}' END AS output,
    p_partkey % 8 <> 5 AS parse_ok, p_partkey % 8 NOT IN (5, 6) AS strict_ok, CASE WHEN p_partkey % 8 = 5 THEN 'no model' ELSE '' END AS error FROM part"""
)
def taught_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a teacher makes of prompts, and the pseudo rows made of that."""
    key = F.col("p_partkey")
    prompts = read(spark, sf_dir, "part").select(
        key.cast("string").alias("task_id"),
        F.concat((key % 8).cast("string"), F.lit(" "), "p_name").alias("prompt"),
        preparing.teacher_system(F.lit("json")).alias("system"),
        F.col("p_name").alias("query"),
        F.lit("json").alias("output_type"),
        F.lit(0).alias("variant"),
        F.array(F.lit("n")).alias("raw_output_metric"),
    )
    found = teaching.pseudo_rows(judging.generated(prompts, _teacher), "part", "stub", "none")
    return found.select(
        F.col("meta.task_id").cast("long").alias("id"), "output", F.col("meta.parse_ok").alias("parse_ok"),
        F.col("meta.syntax_strict_ok").alias("strict_ok"), F.col("meta.error").alias("error"),
    )
