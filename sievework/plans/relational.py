"""Queries over the tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..operators import features, filtering, joining, judging, preparing, reports, sampling, scoring
from ..sources import generators, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return named


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(value: F.Column) -> F.Column:
    return F.round(value, 6)


# --- Conversations --------------------------------------------------------------------

ROLES_SQL = """
SELECT conv_id,
  arg_max(text, turn) FILTER (WHERE lower(trim(role)) = 'system' AND text IS NOT NULL) AS system_text,
  arg_max(text, turn) FILTER (WHERE lower(trim(role)) = 'user' AND text IS NOT NULL) AS user_text,
  arg_max(text, turn) FILTER (WHERE lower(trim(role)) = 'assistant' AND text IS NOT NULL) AS assistant_text
FROM conversations GROUP BY conv_id"""


@query(ROLES_SQL)
def role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.roles(read(spark, sf_dir, "conversations"))


def _dataset() -> F.Column:
    return F.when(F.col("conv_id") % 2 == 0, "chat-a/x").otherwise("chat-b/y")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = role_pivot(spark, sf_dir)
    family = preparing.FAMILIES.of(_dataset())
    return pivot.withColumn("family", family).withColumn("query", preparing.query_text(F.col("family"), "system_text", "user_text"))


QUERY_CTE = f"""
WITH turns_ AS ({ROLES_SQL}), q AS (
  SELECT conv_id, assistant_text, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS family,
    CASE WHEN conv_id % 2 = 0 AND trim(coalesce(system_text, ''), ' ' || chr(10)) <> ''
      THEN trim(trim(system_text, ' ' || chr(10)) || chr(10) || chr(10) || trim(coalesce(user_text, ''), ' ' || chr(10)), ' ' || chr(10))
      ELSE trim(coalesce(user_text, ''), ' ' || chr(10)) END AS query FROM turns_)"""


@query(f"{QUERY_CTE} SELECT conv_id, family, query FROM q")
def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("conv_id", "family", "query")


@query(
    f"{QUERY_CTE} SELECT conv_id, 'hf_' || md5('JSON' || chr(10) || query || chr(10) || coalesce(assistant_text, '')) AS task_id, "
    "md5('JSON' || chr(10) || query || chr(10) || coalesce(assistant_text, '')) AS fingerprint FROM q"
)
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select(
        "conv_id",
        preparing.task_id("hf_", F.lit("JSON"), "query", "assistant_text").alias("task_id"),
        preparing.fingerprint(F.lit("JSON"), "query", "assistant_text").alias("fingerprint"),
    )


@query(
    f"""{QUERY_CTE} SELECT conv_id, CASE WHEN query = '' THEN query ELSE query || chr(10) || chr(10) || '---' || chr(10) ||
    'Supplementary metadata (for disambiguation only; do NOT include this block in your output):' || chr(10) || 'FORMAT: JSON' || chr(10) ||
    'TASK_KIND: chat' || chr(10) || 'TASK_FAMILY: ' || family || chr(10) || 'TASK_KEY: ' || family || '|JSON|chat|unknown' END AS query FROM q"""
)
def supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("family", F.lit("|JSON|chat|unknown"))
    made = preparing.with_supplement("query", F.lit("JSON"), F.lit("chat"), F.lit(" "), "family", key)
    return _queries(spark, sf_dir).select("conv_id", made.alias("query"))


@query(
    "SELECT conv_id, turn, '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt "
    "FROM conversations WHERE role = 'user'"
)
def framed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    rows = read(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", preparing.framed(message).alias("prompt"))


@query("SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY conv_id, turn")
def unbundled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of the turns of a conversation, taken apart again."""
    turns = read(spark, sf_dir, "conversations")
    message = F.array(F.struct("role", F.col("text").alias("content")))
    meta = F.struct(F.col("turn").cast("string").alias("format"))
    bundles = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m"), meta.alias("d")))).alias("b"))
    bundles = bundles.select("conv_id", F.transform("b", lambda x: x["m"]).alias("messages"), F.transform("b", lambda x: x["d"]).alias("metadata"))
    apart = preparing.unbundled(bundles)
    return apart.groupBy("conv_id", F.col("metadata.format").cast("long").alias("turn")).agg(F.count("*").alias("n"))


# --- Rows, joins and sets -------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, md5(chr(10) || lang || chr(10) || text) AS fingerprint FROM documents GROUP BY 2")
def exact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = preparing.fingerprint(F.lit(""), "lang", "text")
    return filtering.distinct_rows(read(spark, sf_dir, "documents"), key, ["doc_id"]).select("doc_id", "fingerprint")


@query(
    "SELECT o_custkey AS k, 'order' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer "
    "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin"))
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return joining.insert_absent(rows, new, "k")


@query(
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MissingInference' ELSE 'found' END AS verdict "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def tasks_left_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there"))
    verdict = F.when(F.col("there").isNull(), "MissingInference").otherwise("found").alias("verdict")
    return read(spark, sf_dir, "documents").join(found, "doc_id", "left").select("doc_id", verdict)


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphan_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("task_id"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"))
    return joining.orphans(labels, tasks).select(F.col("task_id").alias("doc_id"))


@query(
    "SELECT user_id, event_id, coalesce(event_type, '') AS event_type FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) t WHERE n = 1"
)
def last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return readers.last_by_id(events, "event_id", "user_id", "event_type")


@query(
    "SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'fine' WHEN p_type = 'ECONOMY' THEN 'cheap' ELSE 'plain' END AS rule FROM part"
)
def settings_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = joining.setting(F.col("p_type"), {"SMALL": "fine", "ECONOMY": "cheap", "other": "plain"}, "other")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rule.alias("rule"))


@query(
    """WITH kinds AS (SELECT (['json','yaml','toml','xml','csv','html'])[p_partkey % 6 + 1] AS output_type, count(*) AS n FROM part GROUP BY 1),
    work AS (SELECT output_type, variant, n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['json','yaml','toml','xml','csv'],
    output_type), 0), 6), output_type, variant) AS pos FROM kinds CROSS JOIN (VALUES (0), (1), (2)) v(variant))
    SELECT output_type, variant, n, n AS places, CAST(sum(n) OVER (ORDER BY pos) - n + 1 AS BIGINT) AS first_place,
    CAST(sum(n) OVER (ORDER BY pos) AS BIGINT) AS last_place FROM work"""
)
def variants_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all tasks' variants; inside a type and variant a hash decides, so they are
    compared by type and variant."""
    kinds = F.array(*map(F.lit, ("json", "yaml", "toml", "xml", "csv", "html")))
    tasks = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("output_type")
    )
    placed = preparing.work_places(preparing.variants_of(tasks, 3), key="id")
    return placed.groupBy("output_type", "variant").agg(
        F.count("*").alias("n"),
        F.countDistinct("place").alias("places"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
    )


# --- JSON in events -------------------------------------------------------------------

_PROPS = "CASE event_id % 4 WHEN 1 THEN props || ' x' WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN replace(props, '\"', '''') ELSE props END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.expr(_PROPS.replace("''''", "\"'\"")).alias("doc"))


@query(f"SELECT event_id, json_valid({_PROPS}) AS ok FROM events")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", udfs.parse(F.col("doc"), F.lit("JSON"))["ok"].alias("ok"))


@query(
    "SELECT event_id, event_id % 4 IN (0, 1) AS has_k, false AS has_z, CASE event_id % 4 WHEN 0 THEN 6e-1 WHEN 1 THEN 4e-1 ELSE 0e0 END AS final FROM events"
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("raw_output_metric", F.array(F.lit("k"), F.lit("z"))).withColumn("output_type", F.lit("JSON"))
    found = scoring.scored(rows, "doc")
    return found.select(
        "event_id",
        F.col("raw_output_eval")[0].alias("has_k"),
        F.col("raw_output_eval")[1].alias("has_z"),
        six(F.col("final_eval_score")).alias("final"),
    )


# --- Completions with known verdicts --------------------------------------------------

COMPLETIONS = """
WITH base AS (SELECT p_partkey AS id, (['JSON', 'YAML', 'TOML', 'XML', 'CSV'])[p_partkey % 5 + 1] AS output_type, p_partkey % 7 AS variant,
  CASE p_partkey % 5
    WHEN 0 THEN '{"title": "' || p_name || '", "publication": {"year": ' || p_size || '}}'
    WHEN 1 THEN 'title: ' || p_name || chr(10) || 'publication:' || chr(10) || '  year: ' || p_size
    WHEN 2 THEN 'title = "' || p_name || '"' || chr(10) || chr(10) || '[publication]' || chr(10) || 'year = ' || p_size
    WHEN 3 THEN '<article><title>' || p_name || '</title><publication><year>' || p_size || '</year></publication></article>'
    ELSE 'title,year' || chr(10) || p_name || ',' || p_size END AS body FROM part),
comp AS (SELECT *, CASE variant
    WHEN 1 THEN '```' || lower(output_type) || chr(10) || body || chr(10) || '```'
    WHEN 2 THEN 'Sure! Here is the answer' || chr(10) || body
    WHEN 3 THEN CASE output_type WHEN 'JSON' THEN substr(body, 1, length(body) - 1) WHEN 'YAML' THEN 'a: b: ' || body
      WHEN 'TOML' THEN 'x: 1' || chr(10) || body WHEN 'XML' THEN body || '<tail>' ELSE 'just some text' END
    ELSE body END AS generation,
  variant IN (0, 4, 5, 6) AS clean FROM base),
verdict AS (SELECT *,
  CASE WHEN clean OR (variant = 2 AND output_type = 'CSV') THEN 1.0e0 ELSE 0.0e0 END AS render_score,
  CASE WHEN clean OR (variant IN (1, 2) AND output_type = 'JSON') THEN 1.0e0 ELSE 0.0e0 END AS key_score,
  CASE WHEN clean OR variant IN (1, 2) OR (variant = 3 AND output_type IN ('TOML', 'CSV')) THEN 1.0e0 ELSE 0.0e0 END AS parse,
  CASE WHEN clean OR variant IN (1, 2) OR (variant = 3 AND output_type = 'TOML') THEN 1.0e0 ELSE 0.0e0 END AS parse_best_effort,
  CASE WHEN clean OR (variant = 2 AND output_type = 'CSV') THEN 1.0e0 ELSE 0.0e0 END AS only_,
  CASE WHEN variant IN (1, 2) OR (variant = 3 AND output_type = 'TOML') THEN 1.0e0 ELSE 0.0e0 END AS extraneous FROM comp),
scored AS (SELECT *, 0.2e0 * render_score + 0.8e0 * key_score AS final FROM verdict)
"""


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.completions(readers.dealt(read(spark, sf_dir, "part")))


@query(f"{COMPLETIONS} SELECT id, output_type, generation FROM comp")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completions(spark, sf_dir).select("id", "output_type", "generation")


@query(
    f"{COMPLETIONS} SELECT id, output_type, render_score, key_score AS key_validation_score, round(final, 6) AS final_eval_score FROM scored"
)
def key_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.scored(_completions(spark, sf_dir))
    return found.select("id", "output_type", "render_score", "key_validation_score", six(F.col("final_eval_score")).alias("final_eval_score"))


@query(f"{COMPLETIONS} SELECT count(*) AS n, round(avg(final), 6) AS avg_final_eval_score FROM scored")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.score_summary(scoring.scored(_completions(spark, sf_dir)))
    return found.select("n", six(F.col("avg_final_eval_score")).alias("avg_final_eval_score"))


_STRICT = "(clean OR (output_type = 'CSV' AND variant IN (2, 3)))"


@query(
    f"{COMPLETIONS} SELECT output_type AS eval_type, count(*) AS n, round(avg(CASE WHEN {_STRICT} THEN 1e0 ELSE 0e0 END), 6) AS parse_rate, "
    "round(avg(only_), 6) AS only_rate, round(avg(final), 6) AS avg_final FROM scored GROUP BY output_type"
)
def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.summary_by_type(scoring.evaluated(_completions(spark, sf_dir)))
    return rows.select("eval_type", "n", *(six(F.col(name)).alias(name) for name in ("parse_rate", "only_rate", "avg_final")))


@query(
    f"""{COMPLETIONS} SELECT count(*) AS total, round(avg(CASE WHEN {_STRICT} THEN 1e0 ELSE 0e0 END), 6) AS format_parse_rate,
    round(avg(only_), 6) AS format_only_rate, count(*) FILTER (WHERE output_type = 'JSON') AS json_tasks_n,
    round(1e0 * count(*) FILTER (WHERE output_type = 'JSON' AND clean) / count(*), 6) AS json_parse_rate,
    round(1e0 * count(*) FILTER (WHERE output_type = 'JSON' AND clean) / count(*) FILTER (WHERE output_type = 'JSON'), 6) AS json_parse_rate_on_json_tasks,
    round(1e0 * count(*) FILTER (WHERE output_type = 'JSON' AND clean) / count(*), 6) AS json_only_rate,
    round(1e0 * count(*) FILTER (WHERE output_type = 'JSON' AND clean) / count(*) FILTER (WHERE output_type = 'JSON'), 6) AS json_only_rate_on_json_tasks,
    CAST(0.0 AS DOUBLE) AS authors_len_2_rate, round(avg(final), 6) AS final_eval_score_avg FROM scored"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.summary(scoring.evaluated(_completions(spark, sf_dir)))
    return found.select(*(six(F.col(name)).alias(name) if kind == "double" else F.col(name) for name, kind in found.dtypes))


@query(f"{COMPLETIONS} SELECT id, parse, parse_best_effort, only_ AS only_ok, extraneous, CAST(0.0 AS DOUBLE) AS extra_keys FROM verdict")
def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.with_components(_completions(spark, sf_dir), reference=None)
    return found.select("id", "parse", "parse_best_effort", F.col("only").alias("only_ok"), "extraneous", "extra_keys")


@query(
    f"""{COMPLETIONS} SELECT id, round(CASE WHEN parse < 1 AND parse_best_effort < 1 THEN -3e0
      ELSE parse + 5e-1 * only_ + CASE WHEN only_ < 1 THEN -1e0 ELSE 0e0 END + CASE WHEN extraneous >= 1 THEN CASE output_type WHEN 'XML' THEN -5e-1 ELSE -25e-2 END ELSE 0e0 END
      END, 6) AS reward FROM verdict"""
)
def reward_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.with_components(_completions(spark, sf_dir), reference=None)
    reward = scoring.combined({"p_extraneous": -0.25, "p_extraneous_xml": -0.5})
    return found.select("id", six(reward).alias("reward"))


@query(
    f"""{COMPLETIONS} SELECT id, round(CASE
      WHEN clean OR variant IN (1, 2) OR (variant = 3 AND output_type = 'TOML') THEN 1e0 ELSE 0e0 END
      + CASE WHEN extraneous >= 1 THEN -25e-2 ELSE 0e0 END, 6) AS reward FROM verdict"""
)
def reward_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.rewarded(_completions(spark, sf_dir), {"p_extraneous": -0.25}, "generation")
    return rows.select("id", six(F.col("reward")).alias("reward"))


@query(
    f"{COMPLETIONS} SELECT id, CASE WHEN output_type <> 'XML' AND parse = 1 AND NOT (output_type = 'CSV' AND variant = 3) THEN 1e0 ELSE 0e0 END AS match FROM verdict"
)
def reward_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.with_components(_completions(spark, sf_dir), reference="body")
    return found.select("id", "match")


@query()
def reward_soft_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness to the reference; what is left of a broken text is no matter for SQL, so it
    is held against the kernel in the tests."""
    found = scoring.with_components(_completions(spark, sf_dir), reference="body")
    return found.select("id", "match", six(F.col("match_soft")).alias("match_soft"))


@query(
    f"""{COMPLETIONS} SELECT output_type, count(*) AS n, count(*) FILTER (WHERE ok) AS parse_ok,
      round(1e0 * count(*) FILTER (WHERE ok) / count(*), 6) AS parse_rate,
      count(*) FILTER (WHERE NOT ok) AS failures FROM (SELECT *, {_STRICT} AS ok FROM comp) t GROUP BY output_type"""
)
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).withColumn("ok", udfs.parse("generation", "output_type")["ok"]).withColumn("task_id", F.col("id"))
    found = reports.parse_rates(rows)
    return found.select("output_type", "n", "parse_ok", six(F.col("parse_rate")).alias("parse_rate"), "failures")


@query(
    f"""{COMPLETIONS} SELECT output_type, CASE WHEN id % 11 = 0 THEN 'MissingInference' WHEN output_type = 'JSON' THEN 'JSONDecodeError'
      WHEN output_type = 'YAML' THEN 'YAMLScannerError' WHEN output_type = 'TOML' THEN 'TOMLDecodeError' WHEN output_type = 'XML' THEN 'XMLParseError'
      ELSE 'ValueError' END AS error_kind, count(*) AS n FROM comp
      WHERE id % 11 = 0 OR (variant = 3 AND output_type <> 'CSV') OR (variant = 2 AND output_type <> 'XML')
      GROUP BY 1, 2"""
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).withColumn("task_id", F.col("id").cast("string"))
    inference = rows.where("id % 11 <> 0").select("task_id", "generation")
    return reports.error_kinds(joining.checked(rows, inference))


_USABLE = "(clean OR variant = 1 OR (variant = 2 AND output_type IN ('JSON', 'XML')) OR (variant = 3 AND output_type = 'CSV'))"


@query(
    f"""{COMPLETIONS} SELECT 'f|' || output_type || '|k|s' AS task_key, 'f' AS family, output_type AS output_format, 'k' AS task_kind, 's' AS task_schema,
      count(*) AS total, count(*) FILTER (WHERE NOT {_USABLE}) AS errors, count(*) FILTER (WHERE {_USABLE}) AS usable,
      round(1e0 * count(*) FILTER (WHERE {_USABLE}) / count(*), 6) AS usable_rate, 'd0;d1' AS datasets FROM comp GROUP BY output_type"""
)
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).withColumn("_v", udfs.validate_answer("generation", "output_type"))
    rows = rows.select(
        F.concat(F.lit("f|"), "output_type", F.lit("|k|s")).alias("task_key"),
        F.lit("f").alias("family"),
        F.col("output_type").alias("output_format"),
        F.lit("k").alias("task_kind"),
        F.lit("s").alias("task_schema"),
        F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("dataset"),
        "_v.ok",
        "_v.reason",
    )
    return reports.task_stats(rows).withColumn("usable_rate", six(F.col("usable_rate"))).drop("top_error")


@query(
    f"""{COMPLETIONS} SELECT output_type, count(*) AS n, count(*) FILTER (WHERE render_score < 1) AS failed,
      round(1e0 * count(*) FILTER (WHERE render_score < 1) / count(*), 6) AS fail_rate FROM verdict GROUP BY output_type"""
)
def lint_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored(_completions(spark, sf_dir))
    found = reports.failure_rates(rows, F.col("render_score") >= 1, "output_type")
    return found.withColumn("fail_rate", six(F.col("fail_rate")))


@query(
    f"""{COMPLETIONS} SELECT output_type, keep, reason, count(*) AS n FROM (SELECT output_type, CASE WHEN NOT {_STRICT} THEN false ELSE true END AS keep,
      CASE WHEN NOT {_STRICT} THEN 'lint_fail' ELSE 'keep' END AS reason FROM comp) t GROUP BY 1, 2, 3"""
)
def cleaning_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir).withColumn("query", F.concat(F.lit("Output "), "output_type"))
    return reports.decisions(filtering.decided(rows, output="generation"))


_BUCKET = f"CASE WHEN variant = 6 THEN 'empty' WHEN {_STRICT} THEN 'ok' ELSE 'invalid' END"


@query(
    f"""{COMPLETIONS} SELECT output_type, ok_variants, count(*) AS n FROM (SELECT output_type, id // 35 AS task,
      count(*) FILTER (WHERE {_BUCKET} = 'ok') AS ok_variants FROM comp GROUP BY 1, 2) t GROUP BY 1, 2"""
)
def good_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir)
    return reports.good_variant_histogram(reports.task_buckets(rows, 7))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir)
    made = F.when(F.col("variant") == 6, "").otherwise(F.col("generation"))
    ok = udfs.parse(made, F.col("output_type"))["ok"]
    return rows.select(
        "output_type",
        F.floor(F.col("id") / 35).alias("task_id"),
        (F.col("id") + 1).alias("position"),
        reports.attempt_bucket(ok, made, F.lit("")).alias("bucket"),
    )


@query(
    f"""{COMPLETIONS} SELECT output_type, id // 100 AS "window", count(*) FILTER (WHERE b = 'ok') AS ok, count(*) FILTER (WHERE b = 'invalid') AS invalid,
      count(*) FILTER (WHERE b = 'empty') AS empty, count(*) FILTER (WHERE b = 'errors') AS errors FROM (SELECT *, {_BUCKET} AS b FROM comp) t GROUP BY 1, 2"""
)
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.progress(_attempts(spark, sf_dir), 100)


# --- Rewards and sampling over numbers ------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (coalesce(stddev_samp(l_quantity) OVER w, 0.0) + 1e-8), 4) AS advantage,
    coalesce(stddev_samp(l_quantity) OVER w, 0.0) < 1e-6 AS near_zero FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)"""
)
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("reward"))
    found = scoring.advantages(rows, "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", F.round("advantage", 4).alias("advantage"), "near_zero")


@query("SELECT p_partkey, p_type FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 10)")
def frequent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.frequent_groups(read(spark, sf_dir, "part"), 10, "p_brand").select("p_partkey", "p_type")


def _balanced(strategy: str, fixed: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sampling.balanced(read(spark, sf_dir, "part"), "p_brand", strategy, fixed, by="p_partkey")
        return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("members"))

    return run


for _name, _strategy, _fixed, _each in (
    ("balanced_min", "min", None, "(SELECT min(c) FROM sizes)"),
    ("balanced_max", "max", None, "(SELECT max(c) FROM sizes)"),
    ("balanced_fixed", "fixed", 25, "25"),
):
    QUERIES[_name] = _balanced(_strategy, _fixed)
    SQL[_name] = (
        "WITH sizes AS (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand) "
        f"SELECT p_brand, CAST({_each} AS BIGINT) AS n, CAST(least(c, {_each}) AS BIGINT) AS members FROM sizes"
    )


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.upper("lang").alias("output_type"), F.col("source").alias("task_family"), F.lit(None).cast("string").alias("task_key"))


@query(
    """SELECT upper(lang) AS output_type, CASE upper(lang) WHEN 'EN' THEN least(count(*), 50) WHEN 'FR' THEN 400 WHEN 'DE' THEN count(*)
    ELSE least(count(*), 20) END AS n FROM documents GROUP BY lang"""
)
def per_type_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(read(spark, sf_dir, "documents"))
    capped = sampling.per_type(rows.where("output_type <> 'FR'"), {"en": 50, "DE": "all"}, 20, by="doc_id")
    more = sampling.per_type(rows.where("output_type = 'FR'"), {"FR": 400.9}, 20, oversample=True, by="doc_id")
    return capped.unionByName(more).groupBy("output_type").agg(F.count("*").alias("n"))


@query(
    """SELECT source AS task_family, upper(lang) AS output_type, CASE WHEN source = 'src0' AND lang = 'en' THEN least(count(*), 7) WHEN lang = 'fr' THEN least(count(*), 3)
    WHEN source = 'src0' THEN least(count(*), 5) ELSE least(count(*), 2) END AS n FROM documents GROUP BY source, lang"""
)
def per_family_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(read(spark, sf_dir, "documents"))
    families = {"src-0": {"targets": {"en": 7}, "default_target": 5}}
    found = sampling.per_family(rows, families, {"FR": 3}, 2, by="doc_id")
    return found.groupBy("task_family", "output_type").agg(F.count("*").alias("n"))


@query("SELECT upper(lang) AS output_type, count(*) AS n FROM documents GROUP BY lang")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_type(_typed(read(spark, sf_dir, "documents")))


@query("SELECT source AS task_family, upper(lang) AS output_type, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_family_and_type(_typed(read(spark, sf_dir, "documents")))


@query(
    "SELECT count(*) AS tasks, CAST(sum(c) AS BIGINT) AS total, min(c) AS min_per_task, max(c) AS max_per_task FROM (SELECT count(*) AS c FROM part GROUP BY p_brand) t"
)
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_sizes(read(spark, sf_dir, "part"), "p_brand")


@query(
    """SELECT 'sft' AS kind, greatest(1, CAST(round_even(count(*) * 0.05, 0) AS BIGINT)) AS held_out, count(*) - greatest(1, CAST(round_even(count(*) * 0.05, 0) AS BIGINT)) AS training, CAST(0 AS BIGINT) AS shared
    FROM documents WHERE text IS NOT NULL AND trim(text) <> '' UNION ALL
    SELECT 'task', greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)), count(*) - greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)), CAST(0 AS BIGINT) FROM documents"""
)
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output"))
    made = []
    for kind, (training, held_out) in (
        ("sft", sampling.training_split(rows, 0.05, by="doc_id")),
        ("task", sampling.task_split(rows, 0.1, by="doc_id")),
    ):
        a, b = training.select("doc_id", F.lit(0).alias("held")), held_out.select("doc_id", F.lit(1).alias("held"))
        both = a.unionByName(b).groupBy("doc_id").agg(F.sum("held").alias("held"), F.count("*").alias("n"))
        made.append(
            both.agg(
                F.lit(kind).alias("kind"),
                F.sum("held").alias("held_out"),
                (F.sum("n") - F.sum("held")).alias("training"),
                F.count_if(F.col("n") > 1).alias("shared"),
            )
        )
    return made[0].unionByName(made[1])


@query(
    """SELECT doc_id, list_position(['EN', 'DE', 'XX'], upper(lang)) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n
    FROM documents) t WHERE n <= 15 AND lang IN ('en', 'de')"""
)
def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(read(spark, sf_dir, "documents"))
    found = sampling.limited_per_type(rows, 15, ["EN", "DE", "XX"], by="doc_id")
    return found.select("doc_id", F.col("place").cast("int"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40")
def plain_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.limited(read(spark, sf_dir, "documents"), 40, by="doc_id").select("doc_id", "lang")


# --- Reports --------------------------------------------------------------------------


@query(
    """WITH best AS (SELECT p_brand, max(p_retailprice) AS b FROM part GROUP BY p_brand), top AS (SELECT p_brand, row_number() OVER (ORDER BY b DESC, p_brand) AS place FROM best)
    SELECT p_partkey, p.p_brand, CAST(place AS INTEGER) AS place FROM part p JOIN top t ON p.p_brand = t.p_brand WHERE place <= 5"""
)
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return sampling.top_groups(rows, "p_brand", "p_retailprice", 5).select("p_partkey", "p_brand", "place")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) t WHERE n = 1"""
)
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return filtering.first_rows(rows, ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber"])


@query("SELECT lang AS \"left\", source AS \"right\", count(*) AS n FROM documents GROUP BY lang, source")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("left"), F.col("source").alias("right"))
    return reports.crosstab(rows, "left", "right")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(read(spark, sf_dir, "events"), "event_type")


_XML = {
    "xml_amp": "&amp;",
    "xml_apos": "&apos;",
    "xml_gt": "&gt;",
    "xml_lt": "&lt;",
    "xml_quot": "&quot;",
    "xml_cdata": "<![CDATA[",
}
_HTML = "substr(html, position('<' IN html))"


def _occurrences(part: str) -> str:
    return f"((length(h) - length(replace(h, '{part}', ''))) // {len(part)})"


_DEC, _HEX = (f"len(regexp_extract_all(h, '{pattern}'))" for pattern in (r"&#\d+;", r"&#x[0-9A-Fa-f]+;"))
_KNOWN = " + ".join(_occurrences(_XML[name]) for name in ("xml_amp", "xml_apos", "xml_gt", "xml_lt", "xml_quot"))
_ESCAPE_ROWS = " UNION ALL ".join(
    [f"SELECT page_id, usable, '{name}' AS escape_type, {_occurrences(part)} AS n FROM pages_" for name, part in _XML.items()]
    + [
        f"SELECT page_id, usable, 'xml_num_dec', {_DEC} FROM pages_",
        f"SELECT page_id, usable, 'xml_num_hex', {_HEX} FROM pages_",
        f"SELECT page_id, usable, 'xml_bare_amp', {_occurrences('&')} - ({_KNOWN}) - {_DEC} - {_HEX} FROM pages_",
    ]
)
_ESCAPES_SQL = (
    f"WITH pages_ AS (SELECT page_id, page_id % 3 <> 0 AS usable, {_HTML} AS h FROM pages WHERE html LIKE '%<%'), found AS ({_ESCAPE_ROWS}), "
    "stats AS (SELECT 'd' AS dataset, 'XML' AS format, escape_type, count(*) AS examples_total, count(*) FILTER (WHERE usable) AS examples_usable, "
    "count(*) FILTER (WHERE n > 0) AS examples_with_escape_total, count(*) FILTER (WHERE n > 0 AND usable) AS examples_with_escape_usable, "
    "CAST(sum(n) AS BIGINT) AS occurrences_total, CAST(coalesce(sum(n) FILTER (WHERE usable), 0) AS BIGINT) AS occurrences_usable FROM found GROUP BY escape_type)"
)


def _escape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").where(F.contains("html", F.lit("<"))).select(
        F.lit("d").alias("dataset"), F.lit("XML").alias("format"), (F.col("page_id") % 3 != 0).alias("usable"), F.col("html").alias("output")
    )
    return reports.escape_stats(reports.escapes(rows))


@query(f"{_ESCAPES_SQL} SELECT * FROM stats")
def escape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escape_stats(spark, sf_dir)


@query(
    f"{_ESCAPES_SQL} SELECT escape_type, round(1e0 * examples_with_escape_total / examples_total, 6) AS example_rate_total, "
    "round(1e0 * occurrences_usable / examples_usable, 6) AS occ_per_example_usable FROM stats"
)
def escape_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.escape_rates(_escape_stats(spark, sf_dir))
    return found.select("escape_type", *(six(F.col(name)).alias(name) for name in ("example_rate_total", "occ_per_example_usable")))


@query(
    f"{_ESCAPES_SQL} SELECT dataset, CAST(sum(CASE WHEN escape_type = 'xml_amp' THEN occurrences_total ELSE 0 END) AS BIGINT) AS xml_amp, "
    "CAST(sum(CASE WHEN escape_type = 'xml_lt' THEN occurrences_total ELSE 0 END) AS BIGINT) AS xml_lt FROM stats GROUP BY dataset"
)
def escape_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivoted(_escape_stats(spark, sf_dir), "dataset", "escape_type", ["xml_amp", "xml_lt"], "occurrences_total")


@query(f"{_ESCAPES_SQL} SELECT format, CAST(sum(occurrences_total) AS BIGINT) AS occurrences_total FROM stats GROUP BY format")
def escape_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summed(_escape_stats(spark, sf_dir), "format").select("format", "occurrences_total")


# --- Judges, features, generated rows -------------------------------------------------

def _cache(spark: SparkSession, sf_dir: str, rows: str, shift: int, details: str = "") -> DataFrame:
    """Answers for the parts of which ``rows`` holds, scores and task ids moved by ``shift``."""
    key = F.col("p_partkey").cast("string")
    task = F.concat(F.lit("t"), (F.col("p_partkey") + shift).cast("string"))
    return read(spark, sf_dir, "part").where(rows).select(
        F.lit("p").alias("provider"),
        F.lit("m").alias("model"),
        F.concat(F.lit("k"), key).alias("key"),
        (F.col("p_size") + shift).cast("double").alias("score"),
        F.lit(shift == 0).alias("passed"),
        task.alias("task_id"),
        F.array(task).alias("task_ids"),
        F.lit(details).alias("details"),
    )


#: Parts whose answers are in the old cache, and those with new ones; both hold for some.
_OLD, _NEW = "p_size <= 30", "p_size >= 20"


@query(
    f"""SELECT 'k' || p_partkey AS key, CASE WHEN {_NEW} THEN CAST(p_size + 3000000 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS score,
    NOT {_NEW} AS passed, CASE WHEN {_NEW} THEN 'later' ELSE '' END AS details,
    concat_ws(',', CASE WHEN {_NEW} THEN 't' || (p_partkey + 3000000) || ',t' || (p_partkey + 2000000) END, CASE WHEN {_OLD} THEN 't' || p_partkey END) AS ids
    FROM part WHERE {_OLD} OR {_NEW}"""
)
def judge_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new answers for each key: the later one wins, the ids of both stay."""
    earlier = _cache(spark, sf_dir, _NEW, 2_000_000, "earlier").withColumn("at", F.lit(1))
    later = _cache(spark, sf_dir, _NEW, 3_000_000, "later").withColumn("at", F.lit(2))
    made = judging.upsert(_cache(spark, sf_dir, _OLD, 0), later.unionByName(earlier), "at")
    return made.select("key", "score", "passed", "details", F.array_join("task_ids", ",").alias("ids"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each part that share its key."""
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), key.alias("cache_key"), F.lit(0.0).alias("score"), F.lit(False).alias("passed"),
        F.lit("").alias("details"), F.explode(F.array(F.lit(1), F.lit(0))).alias("copy"),
    ).withColumn("id", F.col("part") * 2 + F.col("copy"))


@query(
    f"SELECT p_partkey * 2 + copy AS id, CASE WHEN {_OLD} THEN CAST(p_size AS DOUBLE) ELSE 0e0 END AS score, {_OLD} AS passed, {_OLD} AS cache_hit "
    "FROM part CROSS JOIN (VALUES (0), (1)) c(copy)"
)
def judge_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judging.refreshed(_records(spark, sf_dir), _cache(spark, sf_dir, _OLD, 0), "p", "m")
    return found.select("id", "score", "passed", "cache_hit")


@query(f"SELECT p_partkey * 2 AS id FROM part WHERE NOT {_OLD}")
def judge_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two records of a key the one of the least id is asked for."""
    return judging.misses(_records(spark, sf_dir), _cache(spark, sf_dir, _OLD, 0), "p", "m", "id").select("id")


@query(
    "SELECT p_partkey AS id, sha256('p' || chr(0) || 'm' || chr(0) || '{\"id\": ' || p_partkey || ', \"name\": \"' || p_name || '\"}') AS key FROM part"
)
def judge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.struct(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), judging.cache_key_of("p", "m", content).alias("key"))


@query(
    """SELECT p_partkey AS id, CAST(least(length(p_type) + length(p_name), 12) AS INTEGER) AS n_ids, CAST(least(length(p_type), 12) AS INTEGER) AS n_ignored,
    CAST(16 - least(length(p_type) + length(p_name), 12) AS INTEGER) AS n_pads, CAST(16 AS INTEGER) AS n_labels, CAST(ascii(p_type) AS INTEGER) AS first_id FROM part"""
)
def mask_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), *features.features(features.code_points("p_type"), features.code_points("p_name"), 12)
    )
    padded = features.padded(made, pad=0, length=16)
    return padded.select(
        "id",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_ids"),
        (F.size(F.filter("labels", lambda x: x == features.IGNORE)) - F.size(F.filter("attention_mask", lambda x: x == 0))).alias("n_ignored"),
        F.size(F.filter("attention_mask", lambda x: x == 0)).alias("n_pads"),
        F.size("labels").alias("n_labels"),
        F.col("input_ids")[0].alias("first_id"),
    )


@query("SELECT count(*) AS n, count(*) FILTER (WHERE length(p_type) >= 6) AS fully_masked FROM part")
def masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "part").select(*features.features(features.code_points("p_type"), features.code_points("p_name"), 6))
    return reports.masked_rows(made)


@query(
    "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS score FROM part WHERE p_size = (SELECT max(p_size) FROM part) ORDER BY p_partkey LIMIT 1"
)
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("score"))
    return reports.best(trials, "score", "id")


@query(
    """SELECT doc_id, substr(text, 1, 20) || CASE WHEN length(text) > 20 THEN '...' ELSE '' END AS short,
    replace(substr(text, 1, 30), chr(10), '\\n') AS flat FROM documents WHERE text IS NOT NULL"""
)
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", C.preview("text", 20, ellipsis=True).alias("short"), C.preview("text", 30, flat=True).alias("flat"))


@query(
    "SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, round(CASE WHEN p_size = 0 THEN 0e0 ELSE p_partkey * 1e0 / p_size END, 6) AS ratio FROM part"
)
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), C.safe_name("p_name").alias("name"), six(C.safe_div(F.col("p_partkey"), F.col("p_size"))).alias("ratio")
    )


@query(
    """SELECT printf('%06d', 500 + n) AS task_id, (['JSON', 'YAML', 'CSV'])[n % 3 + 1] AS output_type,
    CASE WHEN n % 3 = 2 THEN 2 ELSE 7 END AS n_paths FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM part) - 1)) AS n) t"""
)
def mock_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many made-up tasks as there are parts."""
    made = generators.tasks(spark, read(spark, sf_dir, "part").count(), ["json", "yaml", "csv"])
    return made.select("task_id", "output_type", F.size("raw_output_metric").alias("n_paths"))


@query(
    "SELECT CASE WHEN p_partkey = 2 THEN 'nested_toml_0003' ELSE 'row' || p_partkey END AS task_id FROM part UNION ALL SELECT 'nested_toml_0001' "
    "UNION ALL SELECT 'nested_toml_0002' UNION ALL SELECT 'nested_toml_0004' UNION ALL SELECT 'nested_toml_0003' WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = 2)"
)
def nested_toml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the seed rows is there already."""
    key = F.col("p_partkey")
    name = F.when(key == 2, "nested_toml_0003").otherwise(F.concat(F.lit("row"), key.cast("string")))
    return generators.with_nested_toml(read(spark, sf_dir, "part").select(name.alias("task_id"))).select("task_id")


@query("SELECT p_partkey AS task_id, upper(kind) AS output_type FROM (SELECT p_partkey, (['json', 'YAML', 'html'])[p_partkey % 3 + 1] AS kind FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) t WHERE kind <> 'html'")
def usable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("json", "YAML", "html")))
    tasks = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"),
        F.element_at(kinds, (F.col("p_partkey") % 3 + 1).cast("int")).alias("output_type"),
        F.when(F.col("p_partkey") % 5 == 0, "Image").otherwise("Text").alias("input_type"),
        (F.col("p_partkey") % 7 == 0).alias("rendering"),
    )
    from .flows import prepared_tasks

    return prepared_tasks(tasks, ["JSON", "yaml"]).select("task_id", "output_type")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming rates."""
    events = read(spark, sf_dir, "events")
    hour = F.window("ts", "1 hour")["start"].cast("timestamp").cast("long")
    return events.groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"))
