"""Queries of text operators over the texts of whole tables; their SQL computes the same
results from the same tables, by its own string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..operators import preparing
from ..sources import readers
from ..sources.scratch import scratch
from .relational import query, read

_TYPES = "(['yml ', 'C_' || p_type, ' tsv', 'Toml', p_type, 'c_xml', 'json', '', ' ', NULL])[p_partkey % 10 + 1]"
_PLAIN = "upper(trim(coalesce(x, '')))"


@query(
    f"""WITH names AS (SELECT p_partkey AS id, {_TYPES} AS x FROM part) SELECT id,
    CASE WHEN {_PLAIN} = 'YML' THEN 'YAML' ELSE regexp_replace({_PLAIN}, '^C_', '') END AS p_import,
    CASE WHEN coalesce(x, '') = '' THEN 'JSON' WHEN {_PLAIN} = 'YML' THEN 'YAML' WHEN {_PLAIN} = 'TSV' THEN 'CSV' ELSE {_PLAIN} END AS p_reward,
    CASE WHEN {_PLAIN} = 'YML' THEN 'YAML' WHEN {_PLAIN} = 'TSV' THEN 'CSV' ELSE regexp_replace({_PLAIN}, '^C_', '') END AS p_analysis,
    CASE WHEN {_PLAIN} = '' THEN 'UNKNOWN' ELSE {_PLAIN} END AS p_selection,
    CASE WHEN {_PLAIN} IN ('JSON', 'YAML', 'TOML', 'XML', 'CSV') THEN lower({_PLAIN}) WHEN {_PLAIN} = 'YML' THEN 'yaml' ELSE 'json' END AS p_teacher,
    {_PLAIN} AS p_plain, CASE WHEN {_PLAIN} = 'YML' THEN 'YAML' ELSE {_PLAIN} END AS p_checked FROM names"""
)
def types_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(
        "element_at(array('yml ', 'C_' || p_type, ' tsv', 'Toml', p_type, 'c_xml', 'json', '', ' ', null), int(p_partkey % 10) + 1)"
    )
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return rows.select("id", *(profile("name").alias(f"p_{name}") for name, profile in C.TYPE_PROFILES.items()))


@query(
    """SELECT doc_id, CASE WHEN x = '' THEN 'other' WHEN starts_with(x, 'src1') THEN 'src1' ELSE x END AS family FROM
    (SELECT doc_id, regexp_replace(lower(coalesce(source || '-' || lang, '')), '[^a-z0-9]', '', 'g') AS x FROM documents) t"""
)
def families_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("-"), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", C.family(name, ["src1"]).alias("family"))


_WORDED = "text || (['', ' as YAML', ' to a CSV file or xml', ' (TOML)', ' yml!'])[turn % 5 + 1]"


@query(
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'xml' WHEN contains(x, 'yaml') OR contains(x, 'yml') THEN 'yaml' WHEN contains(x, 'toml') THEN 'toml'
    WHEN contains(x, 'xml') THEN 'xml' WHEN contains(x, 'csv') THEN 'csv' ELSE 'json' END AS by_query,
    CASE WHEN turn % 3 = 1 THEN 'XML' WHEN turn % 2 = 0 THEN upper(role) ELSE 'UNKNOWN' END AS by_key
    FROM (SELECT conv_id, turn, role, lower(coalesce({_WORDED}, '')) AS x FROM conversations) t"""
)
def types_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that are stated, or told from the text or the second part of a key."""
    endings = F.array(*map(F.lit, ("", " as YAML", " to a CSV file or xml", " (TOML)", " yml!")))
    said = F.concat("text", F.element_at(endings, (F.col("turn") % 5 + 1).cast("int")))
    stated = F.when(F.col("turn") % 3 == 1, " xml ")
    key = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("f| "), "role", F.lit(" |k")))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", C.type_from_query(stated, said).alias("by_query"), C.type_from_key(stated, key).alias("by_key")
    )


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN 'YAML' ELSE regexp_replace(upper(trim(p_brand)), '^C_', '') END AS kind
    FROM part"""
)
def types_of_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 3
    below = F.when(key == 0, F.concat(F.lit("json_to_"), "p_type")).when(key == 1, "csv_to_yml ").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.type_of_chat("p_brand", below).alias("kind"))


_CONVERT = """(CASE p_partkey % 4 WHEN 0 THEN 'Please convert this ' || p_type || ' data into YML format: ' || p_name
  WHEN 1 THEN 'Transform this C_csv data to ' || p_type || '.' WHEN 2 THEN p_name || ' data to JSON' END)"""


@query(
    f"""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || '_to_yaml' WHEN 1 THEN 'csv_to_' || lower(p_type)
    ELSE coalesce(nullif(trim(p_brand), ''), 'unknown') END AS schema FROM part"""
)
def schemas_of_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_CONVERT).alias("prompt"), "p_brand")
    return rows.select("id", C.conversion_schema("prompt", "p_brand").alias("schema"))


@query(
    """SELECT doc_id, doc_id % 3 <> 0 AS fenced, CASE WHEN doc_id % 3 <> 0 THEN x END AS inside, doc_id % 3 = 2 AS only_block
    FROM (SELECT doc_id, substr(regexp_replace(lower(text), '[^a-z]+', '_', 'g'), 1, 40) || 'z' AS x FROM documents WHERE text IS NOT NULL) t"""
)
def fences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, bare, after a line and in a fence, and in a fence alone."""
    words = F.concat(F.substring(F.regexp_replace(F.lower("text"), "[^a-z]+", "_"), 1, 40), F.lit("z"))
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", words.alias("x"))
    key = F.col("doc_id") % 3
    made = F.when(key == 0, F.col("x")).when(key == 1, F.concat(F.lit("Here:\n```json\n"), "x", F.lit("\n```\nBye"))).otherwise(
        F.concat(F.lit("```\n"), "x", F.lit("\n```"))
    )
    rows = rows.select("doc_id", made.alias("txt"))
    return rows.select("doc_id", C.has_fence("txt").alias("fenced"), C.first_block("txt").alias("inside"), C.only_a_block("txt").alias("only_block"))


@query(
    """SELECT event_id, json_valid(props) AS ok, json_valid(props) AND json_type(props) IN ('OBJECT', 'ARRAY') AS tree,
    json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events"""
)
def json_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict reading, whether there is a tree to score, and a key path, of every event."""
    found = udfs.syntax("props", F.lit("JSON"))
    rows = read(spark, sf_dir, "events").select("event_id", "props", udfs.parse("props", F.lit("JSON"))["ok"].alias("ok"), found.alias("s"))
    has = udfs.paths_exist("props", F.array(F.lit("k")), F.lit("JSON"))[0]
    return rows.select("event_id", "ok", F.col("s.there").alias("tree"), has.alias("has_k"))


@query(
    """SELECT l_orderkey, l_linenumber, 4 - l_linenumber % 3 AS depth, 4 - l_linenumber % 3 >= 3 AS deep, true AS dotted FROM lineitem"""
)
def toml_depths_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOML texts whose headers and dotted keys nest two to four levels deep."""
    key = F.col("l_linenumber") % 3
    quantity = F.col("l_quantity").cast("string")
    doc = F.when(key == 0, F.concat(F.lit("[a.b.c.d]\nx = "), quantity)).when(
        key == 1, F.concat(F.lit("y = 1 # [p.q.r.s]\n[[a.b]]\nk.l.m = "), quantity)
    ).otherwise(F.concat(F.lit('["u.v.w.x".y]\n[ a.b ]\nz = '), quantity))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", doc.alias("doc"))
    return rows.select(
        "l_orderkey", "l_linenumber", C.toml_depth("doc").alias("depth"), C.toml_is_deep("doc", 3).alias("deep"), C.has_deep_toml("doc").alias("dotted")
    )


@query(
    """SELECT conv_id, turn, 'TASK PROMPT:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'FEATURE REQUIREMENTS (if provided):' || chr(10) || role || chr(10) || chr(10) ||
    'EXPECTED KEY PATHS (raw_output_metric, if provided):' || chr(10) || '[''a'', ''' || role || ''']' || chr(10) || chr(10) || 'CANDIDATE OUTPUT (model generation):' || chr(10) ||
    coalesce(text, '') || chr(10) AS judged FROM conversations"""
)
def judge_texts_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = preparing.judge_text("text", "role", F.array(F.lit("a"), F.col("role")), "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("judged"))


@query(
    """SELECT line, doc_id FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS line, doc_id FROM documents) t WHERE doc_id % 7 = 3"""
)
def places_of_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of the lines of a file that cannot be read."""
    line, path = F.to_json(F.struct("doc_id", "lang")), scratch(spark, "one-file")
    broken: Column = F.when(F.col("doc_id") % 7 == 3, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    rows = read(spark, sf_dir, "documents").repartition(1).sortWithinPartitions("doc_id")
    rows.select(broken.alias("value")).write.text(path)
    bad = readers.bad_lines(spark, path, "doc_id long, lang string")
    return bad.select("line", F.regexp_extract("text", '"doc_id":([0-9]+)', 1).cast("long").alias("doc_id"))
