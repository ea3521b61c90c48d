"""Queries over texts whose verdicts are known by construction.

A list of cases (inputs, expected results) is dealt over the rows of ``part`` by key. The
operator sees only the inputs; the SQL states only what is expected, as fixed values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..operators import filtering, preparing

Query = Callable[[SparkSession, str], DataFrame]


class Case(NamedTuple):
    given: tuple[Any, ...]
    expected: tuple[Any, ...]


class Constructed(NamedTuple):
    """Names and types of inputs and results, the operator, and the cases."""

    inputs: str
    results: str
    operator: Callable[[DataFrame], DataFrame]
    cases: Sequence[Case]

    def query(self) -> Query:
        n = len(self.cases)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = [(k, *case.given) for k, case in enumerate(self.cases)]
            given = spark.createDataFrame(rows, f"case_id int, {self.inputs}")
            part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
                F.col("p_partkey").alias("id"), (F.col("p_partkey") % n).cast("int").alias("case_id")
            )
            names = [piece.split()[0] for piece in self.results.split(",")]
            return self.operator(part.join(F.broadcast(given), "case_id")).select("id", *names)

        return run

    def sql(self) -> str:
        kinds = [piece.split() for piece in self.results.split(",")]
        rows = ",\n".join(
            "(" + ", ".join([str(k), *(f"CAST({_sql(x)} AS {_KINDS[kind[1]]})" for x, kind in zip(case.expected, kinds))]) + ")"
            for k, case in enumerate(self.cases)
        )
        names = ", ".join(kind[0] for kind in kinds)
        return (
            f"SELECT p.p_partkey AS id, {', '.join('c.' + kind[0] for kind in kinds)} FROM part p JOIN "
            f"(VALUES {rows}) AS c(case_id, {names}) ON p.p_partkey % {len(self.cases)} = c.case_id"
        )


_KINDS = {"string": "VARCHAR", "boolean": "BOOLEAN", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def _sql(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def add(**made: Callable) -> Callable[[DataFrame], DataFrame]:
    """An operator that adds columns."""
    return lambda rows: rows.withColumns({name: column() for name, column in made.items()})


def struct(column: Callable, *fields: str) -> Callable[[DataFrame], DataFrame]:
    """An operator that adds the fields of a struct, evaluated once."""
    return lambda rows: rows.withColumn("_s", column()).select("*", *(f"_s.{field}" for field in fields))


T = "```"

#: name -> query
QUERIES: dict[str, Constructed] = {
    "fences": Constructed(
        "txt string",
        "fenced boolean, inside string, bare string, only_block boolean",
        add(
            fenced=lambda: C.has_fence("txt"),
            inside=lambda: C.first_block("txt"),
            bare=lambda: C.without_fences("txt"),
            only_block=lambda: C.only_a_block("txt"),
        ),
        [
            Case(('{"a": 1}',), (False, None, '{"a": 1}', False)),
            Case((f'{T}json\n{{"a": 1}}\n{T}',), (True, '{"a": 1}', '{"a": 1}', True)),
            Case((f"Here:\n{T}yaml\na: 1\n{T}\nBye",), (True, "a: 1", "Here:\na: 1\nBye", False)),
            Case((f"{T}\none\n{T}\n{T}\ntwo\n{T}",), (True, "one", "one\ntwo", False)),
            Case((None,), (False, None, "", False)),
        ],
    ),
    "strict_and_lenient": Constructed(
        "txt string, kind string",
        "ok boolean, ok_lenient boolean, used string, only_ok boolean",
        lambda rows: struct(lambda: udfs.parse(C.text("txt"), F.col("kind")), "ok", "ok_lenient", "used", "only")(rows).withColumnRenamed("only", "only_ok"),
        [
            Case(('{"a": 1}', "JSON"), (True, True, '{"a": 1}', True)),
            Case(('Sure: {"a": "}"} bye', "JSON"), (False, True, '{"a": "}"}', False)),
            Case(('{"a": 1', "JSON"), (False, False, None, False)),
            Case((f'{T}json\n[1]\n{T}', "JSON"), (False, True, "[1]", False)),
            Case(("a: 1\nb: 2", "YAML"), (True, True, "a: 1\nb: 2", True)),
            Case(("just prose", "YAML"), (True, False, None, False)),
            Case(("a: 1\n]", "YAML"), (False, True, "a: 1", False)),
            Case(("a = 1\n!", "TOML"), (False, True, "a = 1", False)),
            Case(("<r><a>1</a></r>", "XML"), (True, True, "<r><a>1</a></r>", True)),
            Case(("see <r/>\ntail", "XML"), (False, True, "<r/>", False)),
            Case(("a,b\n1,2", "CSV"), (True, True, "a,b\n1,2", True)),
            Case(("one cell", "CSV"), (True, False, None, False)),
        ],
    ),
    "scored_syntax": Constructed(
        "txt string, kind string",
        "there boolean, syntax boolean",
        struct(lambda: udfs.syntax("txt", "kind"), "there", "syntax"),
        [
            Case(("a: 1", "YAML"), (True, True)),
            Case(("This is prose.", "YAML"), (False, False)),
            Case((f"{T}yaml\na: 1\n{T}", "YAML"), (False, False)),
            Case(("one\ntwo", "CSV"), (False, False)),
            Case(("a,b\n1,2\n\n", "CSV"), (True, True)),
            Case(("a,b\n1,2,3", "CSV"), (False, False)),
            Case(("Sure!\na,b\n1,2", "CSV"), (True, True)),
            Case(('x {"a": 1}', "JSON"), (True, False)),
        ],
    ),
    "payloads": Constructed(
        "txt string, kind string",
        "payload string, extraneous boolean",
        struct(lambda: udfs.payload("txt", "kind"), "payload", "extraneous"),
        [
            Case(('{"a": 1}', "JSON"), ('{"a": 1}', False)),
            Case(('Sure! {"a": 1}', "JSON"), ('{"a": 1}', True)),
            Case(("no json", "JSON"), ("no json", False)),
            Case((f"{T}toml\na = 1\n{T}", "TOML"), ("a = 1", True)),
            Case(("Well\ntitle = 1", "TOML"), ("title = 1", True)),
            Case(("Well\nkey: 1", "YAML"), ("key: 1", True)),
            Case(("so <a/>", "XML"), ("<a/>", True)),
            Case(("Intro\na,b\n1,2", "CSV"), ("a,b\n1,2", True)),
            Case(("a,b\n1,2", "CSV"), ("a,b\n1,2", False)),
        ],
    ),
    "final_outputs": Constructed(
        "txt string, kind string",
        "answer string",
        add(answer=lambda: udfs.final_output("txt", "kind")),
        [
            Case(('Steps.\nOutput:\n{"a": [1, {"b": "]"}]} done', "JSON"), ('{"a": [1, {"b": "]"}]}',)),
            Case((f"x\n{T}xml\n<a/>\n{T}\ny\n{T}xml\n<b/>\n{T}", "XML"), ("<b/>",)),
            Case(("Here it is\nname: x\nage: 1", "YAML"), ("name: x\nage: 1",)),
            Case(("Hello\n[t]\na = 1", "TOML"), ("[t]\na = 1",)),
            Case(("Rows\na,b\n1,2", "CSV"), ("a,b\n1,2",)),
            Case(('{"a": ]', "JSON"), ('{"a": ]',)),
        ],
    ),
    "key_paths": Constructed(
        "txt string, paths array<string>",
        "found string",
        add(found=lambda: F.array_join(F.transform(udfs.paths_exist("txt", "paths", F.lit("JSON")), lambda x: x.cast("string")), ",")),
        [
            Case(('{"a": {"b": [{"c": 1}, {"d": null}]}}', ["a.b[0].c", "a.b[*].d", "a.*", "a.b[2]", "x"]), ("true,true,true,false,false",)),
            Case(('{"@id": 1, "k v": 2}', ["@id", '["@id"]', "['k v']", "k v"]), ("false,true,true,false",)),
            Case(('[1, 2]', ["[1]", "[*]", "", "[2]"]), ("true,true,false,false",)),
        ],
    ),
    "leaf_containment": Constructed(
        "a string, b string",
        "f1 double",
        add(f1=lambda: F.round(udfs.leaf_f1(udfs.leaves("a", F.lit("JSON")), udfs.leaves("b", F.lit("JSON"))), 6)),
        [
            Case(('{"a": 1, "b": 2}', '{"b": 2.0, "a": 1}'), (1.0,)),
            Case(('{"a": 1, "b": 2}', '{"a": 1}'), (0.666667,)),
            Case(('{"a": 1}', '{"a": 2}'), (0.0,)),
            Case(("{}", "{}"), (1.0,)),
            Case(("{}", '{"a": 1}'), (0.0,)),
        ],
    ),
    "canonical_toml": Constructed(
        "txt string",
        "ok boolean, already boolean, canonical string",
        struct(lambda: udfs.canonical_toml("txt"), "ok", "already", "canonical"),
        [
            Case(("a = 1",), (True, True, "a = 1\n")),
            Case(("b = 1\na = 2",), (True, False, "a = 2\nb = 1\n")),
            Case(("[t]\nx = 1\n\n[[u]]\ny = 2\n\n[[u]]\ny = 3",), (True, True, "[t]\nx = 1\n\n[[u]]\ny = 2\n\n[[u]]\ny = 3\n")),
            Case(('p = {q = 1.5, r = true}\ns = ["a", "b"]',), (True, False, 's = ["a", "b"]\n\n[p]\nq = 1.5\nr = true\n')),
            Case(("not toml",), (False, False, "")),
        ],
    ),
    "json_to_toml": Constructed(
        "txt string",
        "json_like boolean, ok boolean, toml string",
        struct(lambda: udfs.json_to_toml("txt"), "json_like", "ok", "toml"),
        [
            Case(('{"a": null, "b": [1, 2]}',), (True, True, 'a = ""\nb = [1, 2]\n')),
            Case(('[{"x": 1}, {"x": 2}]',), (True, True, "[[root]]\nx = 1\n\n[[root]]\nx = 2\n")),
            Case(("[public]\na = 1",), (False, False, "")),
            Case(("[[items]]",), (False, False, "")),
            Case(("{ k = 1 }",), (False, False, "")),
        ],
    ),
    "toml_depths": Constructed(
        "txt string",
        "depth int, deep boolean, nested boolean",
        add(depth=lambda: C.toml_depth("txt"), deep=lambda: C.toml_is_deep("txt", 3), nested=lambda: C.has_deep_toml("txt")),
        [
            Case(("a = 1",), (0, False, False)),
            Case(("[a.b.c]\nx = 1",), (3, True, True)),
            Case(("[[a . b]]\nx = 1",), (2, False, False)),
            Case(("a.b = 1 # [x.y.z]",), (2, False, True)),
            Case(('["q.r"]\nx = 1',), (0, False, False)),
        ],
    ),
    "toml_structures": Constructed(
        "txt string",
        "array_table_headers long, array_table_headers_with_dot long, table_headers long, max_header_depth long, "
        "child_tables_under_array long, json_stringified_like long, toml_inline_table long, "
        "toml_inline_table_after_eq long, toml_inline_table_in_array long",
        lambda rows: rows.withColumn("_a", udfs.toml_structure("txt"))
        .withColumn("_b", udfs.inline_tables("txt"))
        .select("*", "_a.*", "_b.*"),
        [
            Case(("[[a]]\nx = 1\n[a.b]\ny = 2",), (1, 0, 1, 2, 1, 0, 0, 0, 0)),
            Case(("[[a.c]]\n[t]\ns = \"{\\\"k\\\": 1}\"",), (1, 1, 1, 2, 0, 1, 0, 0, 0)),
            Case(("p = {a = 1}\nq = [{b = 2}, {c = 3}]",), (0, 0, 0, 0, 0, 0, 3, 1, 2)),
            Case(("s = \"{a = 1}\"",), (0, 0, 0, 0, 0, 0, 0, 0, 0)),
        ],
    ),
    "target_formats": Constructed(
        "prompt string",
        "source string, target string, payload boolean, class string",
        add(
            source=lambda: C.source_format("prompt"),
            target=lambda: C.target_format("prompt"),
            payload=lambda: C.has_payload("prompt"),
            **{"class": lambda: C.task_class("prompt")},
        ),
        [
            Case(('Convert from JSON to YAML: {"a": 1}',), ("json", "yaml", True, "clean_strict")),
            Case(("Transform CSV to TOML please",), ("csv", "toml", False, "generation_like")),
            Case(("Turn it into XML and return it",), (None, "xml", False, "generation_like")),
            Case(("Respond as yml",), (None, "yaml", False, "generation_like")),
            Case(("Produce it in csv format",), (None, "csv", False, "generation_like")),
            Case(("output a JSON",), (None, "json", False, "generation_like")),
            Case(("Tell me about TOML",), (None, "toml", False, "generation_like")),
            Case(("JSON and XML are formats",), (None, None, False, "clean_relaxed")),
            Case((None,), (None, None, False, "clean_relaxed")),
        ],
    ),
    "attribute_lists": Constructed(
        "prompt string",
        "attrs string",
        add(attrs=lambda: F.array_join(udfs.attributes("prompt"), ";")),
        [
            Case(("Extract.\nATTRIBUTES:\na.b, c,\na.b, d[0]\n\nTEXT: x",), ("a.b;c;d[0]",)),
            Case(("attributes: x, y\nTEXT: z",), ("x;y",)),
            Case(("nothing",), ("",)),
        ],
    ),
    "conversions": Constructed(
        "prompt string, kind string, answer string",
        "result string, keep boolean, reason string",
        lambda rows: rows.withColumn("_e", udfs.equivalence("prompt", "kind", "answer"))
        .withColumn("_k", udfs.keep("prompt", F.upper("kind"), "answer"))
        .select("*", "_e.result", "_k.keep", "_k.reason"),
        [
            Case(('Convert from JSON to YAML:\n{"a": 1, "b": [true]}', "yaml", "b: [true]\na: 1.0"), ("PASS", True, "keep")),
            Case(('Convert from JSON to YAML:\n{"a": 1}', "yaml", "a: 2"), ("FAIL", False, "equiv_fail:semantic_mismatch")),
            Case(('Convert from JSON to YAML:\n{"a": 1}', "json", '{"a": 1}'), ("PASS", False, "format_mismatch")),
            Case(('Convert from JSON to YAML:\n{"a": 1}', "yaml", "a: b: c"), ("FAIL", False, "lint_fail")),
            Case(("Convert from CSV to JSON:\na,b\n1,2", "json", '[{"a": "1", "b": "2"}]'), ("FAIL", False, "equiv_fail:semantic_mismatch")),
            Case(("Convert from XML to JSON:\n<r><a>1</a></r>", "json", '{"r": {"a": "1"}}'), ("UNKNOWN", True, "keep")),
        ],
    ),
    "yaml_style": Constructed(
        "txt string",
        "flow boolean, indent boolean",
        add(flow=lambda: C.is_flow_style("txt"), indent=lambda: udfs.yaml_indent_ok("txt")),
        [
            Case(("a:\n  b: 1",), (False, True)),
            Case(("a:\n    b: 1",), (False, False)),
            Case(("a:\n\tb: 1",), (False, False)),
            Case(("a: {b: 1}",), (True, True)),
            Case(("- a\n- b:\n   c",), (False, False)),
            Case(("# note\n",), (False, False)),
        ],
    ),
    "article_constraints": Constructed(
        "txt string",
        "title_is_string boolean, authors_len_is_2 boolean, authors_items_ok boolean, publication_year_is_int boolean, keywords_is_list_str boolean, extra long",
        lambda rows: rows.withColumn("_a", udfs.article_checks("txt"))
        .withColumn("extra", udfs.extra_keys({"title", "authors", "publication", "keywords"})("txt"))
        .select("*", "_a.*"),
        [
            Case(('{"title": "t", "authors": [{"name": "a", "affiliation": "b"}, {"name": "c", "affiliation": "d"}], "publication": {"year": 2020}, "keywords": ["k"]}',), (True, True, True, True, True, 0)),
            Case(('{"title": 1, "authors": [{"name": "a"}], "publication": {"year": "2020"}, "keywords": [1], "z": 0}',), (False, False, False, False, False, 1)),
            Case(('{"authors": [], "publication": {"year": true}}',), (False, False, True, True, False, 0)),
            Case(("[1]",), (False, False, False, False, False, 0)),
        ],
    ),
    "schema_checks": Constructed(
        "txt string",
        "ok boolean, n_errors int",
        lambda rows: rows.withColumn(
            "_s",
            udfs.schema_check(
                {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}
            )("txt"),
        ).select("*", "_s.ok", F.size("_s.errors").alias("n_errors")),
        [
            Case(('{"a": 1}',), (True, 0)),
            Case(('{"a": "x", "b": 1}',), (False, 2)),
            Case(("{}",), (False, 1)),
            Case(("[]",), (False, 1)),
        ],
    ),
    "type_names": Constructed(
        "name string",
        "p_import string, p_reward string, p_analysis string, p_selection string, p_teacher string, p_plain string, p_checked string, p_format string",
        add(
            **{f"p_{name}": (lambda f=f: f("name")) for name, f in C.TYPE_PROFILES.items()},
            p_format=lambda: C.format_name("name"),
        ),
        [
            Case((" yml ",), ("YAML", "YAML", "YAML", "YML", "yaml", "YML", "YAML", "yaml")),
            Case(("C_JSON",), ("JSON", "C_JSON", "JSON", "C_JSON", "json", "C_JSON", "C_JSON", None)),
            Case(("tsv",), ("TSV", "CSV", "CSV", "TSV", "json", "TSV", "TSV", None)),
            Case((None,), ("", "JSON", "", "UNKNOWN", "json", "", "", None)),
            Case(("toml",), ("TOML", "TOML", "TOML", "TOML", "toml", "TOML", "TOML", "toml")),
        ],
    ),
    "families": Constructed(
        "name string",
        "task_family string",
        add(task_family=lambda: C.family("name", ["groupa"])),
        [
            Case(("Group-A/set",), ("groupa",)),
            Case(("h_f",), ("hf",)),
            Case((" ",), ("other",)),
            Case((None,), ("other",)),
            Case(("My Set 1",), ("myset1",)),
        ],
    ),
    "query_types": Constructed(
        "kind string, query string, key string",
        "by_query string, by_key string",
        add(by_query=lambda: C.type_from_query("kind", "query"), by_key=lambda: C.type_from_key("kind", "key")),
        [
            Case((None, "write yaml from json", "f| toml |k|s"), ("yaml", "TOML")),
            Case(("XML", "write yaml", "f|TOML|k|s"), ("xml", "XML")),
            Case(("weird", "write yaml", None), ("json", "WEIRD")),
            Case(("", "hello", "nokey"), ("json", "UNKNOWN")),
        ],
    ),
    "chat_types": Constructed(
        "category string, subcategory string",
        "output_type string",
        add(output_type=lambda: C.type_of_chat("category", "subcategory")),
        [
            Case(("C_XML", "xml_to_yaml"), ("YAML",)),
            Case(("C_TOML", "other"), ("TOML",)),
            Case((None, None), ("",)),
        ],
    ),
    "conversion_schemas": Constructed(
        "prompt string, fallback string",
        "schema string",
        add(schema=lambda: C.conversion_schema("prompt", "fallback")),
        [
            Case(("Convert this CSV data into TOML format", "x"), ("csv_to_toml",)),
            Case(("please transform this yml data to JSON now", "x"), ("yaml_to_json",)),
            Case(("Write a report", " order "), ("order",)),
            Case((None, None), ("unknown",)),
        ],
    ),
    "task_names": Constructed(
        "name string, query string",
        "src string, dst string, kind string, subtype string",
        lambda rows: rows.withColumns(dict(zip(("src", "dst"), C.task_name_formats("name"))))
        .withColumn("kind", C.task_kind("query", F.col("src"), F.col("dst")))
        .withColumn("subtype", C.task_subtype("query", F.col("kind"), F.col("dst"))),
        [
            Case(("Text to JSON", "Summarize this"), ("text", "json", "generation", "structured_summarization")),
            Case(("csv TO yaml", "go"), ("csv", "yaml", "conversion", "yaml_conversion")),
            Case(("Text to XML", "Extract the following attributes"), ("text", "xml", "extraction", "xml_extraction")),
            Case(("Text to TOML", "Please convert it"), ("text", "toml", "conversion", "toml_conversion")),
            Case(("HTML to JSON", "x"), (None, None, "other", "")),
        ],
    ),
    "syntax_checks": Constructed(
        "txt string, kind string",
        "ok boolean, error_kind string, extracted_from string",
        struct(lambda: udfs.check_syntax("txt", "kind"), "ok", "error_kind", "extracted_from"),
        [
            Case((f"{T}python\nx\n{T}\n{T}json\n[1]\n{T}", "JSON"), (True, None, "fence:json")),
            Case(("{", "JSON"), (False, "JSONDecodeError", "raw")),
            Case(("a: b: c", "YAML"), (False, "YAMLScannerError", "raw")),
            Case(("a: [1", "YAML"), (False, "YAMLParserError", "raw")),
            Case(("a =", "TOML"), (False, "TOMLDecodeError", "raw")),
            Case(('x <?xml version="1.0"?><a/>', "XML"), (True, None, "raw:from_xml_decl")),
            Case(("<a>", "XML"), (False, "XMLParseError", "raw:from_first_tag")),
            Case(("a,b\n1", "CSV"), (False, "ValueError", "raw")),
            Case(("x", "HTML"), (False, "UnsupportedType", "raw")),
        ],
    ),
    "answer_checks": Constructed(
        "txt string, kind string",
        "ok boolean, reason string",
        struct(lambda: udfs.validate_answer("txt", "kind"), "ok", "reason"),
        [
            Case(('Text.\nAnswer:\n{"a": 1}', "JSON"), (True, "ok")),
            Case(("a:\n    b: 1", "YAML"), (False, "yaml_indent_fail")),
            Case(("a,b\n1,2,3", "CSV"), (False, "parse_fail: row 2 width mismatch: 3 != 2")),
            Case(("", "CSV"), (False, "parse_fail: empty")),
            Case(("x", "HTML"), (False, "unknown_format: HTML")),
        ],
    ),
    "chat_prompts": Constructed(
        "said string, wanted array<string>, kind string",
        "system string, user string, contest string",
        lambda rows: rows.withColumn(
            "_m",
            preparing.chat(
                "said", preparing.numbered("wanted"), "kind", preparing.Prompting(system="Be exact.", schema_prefix="NEEDS:\n", rules={"JSON": "Rules for JSON."})
            ),
        )
        .withColumn("_c", preparing.chat("said", F.lit(""), "kind", preparing.Prompting(mode="contest")))
        .select(
            "*",
            F.col("_m")[0]["content"].alias("system"),
            F.col("_m")[1]["content"].alias("user"),
            F.col("_c")[0]["content"].alias("contest"),
        ),
        [
            Case((" Do it ", ["a", "b"], "json"), ("Be exact.\n\nRules for JSON.", "Do it\n\nNEEDS:\n1. a\n2. b", "Do it")),
            Case(("Do it", [], "CSV"), ("Be exact.", "Do it", "Do it")),
        ],
    ),
    "teacher_prompts": Constructed(
        "said string, kind string, variant int",
        "system string, prompt string",
        add(system=lambda: preparing.teacher_system("kind"), prompt=lambda: preparing.teacher_prompt("said", "kind", "variant", 1)),
        [
            Case(("Do it ", "yml", 0), ("Return ONLY valid YAML. Do not include code fences or commentary.", "Do it\n\nIMPORTANT: Output ONLY valid YAML. Do not include code fences, markdown, or any extra text.")),
            Case(("x", "csv", 1), ("Return ONLY valid CSV text. Do not include code fences or commentary.", "x\n\nIMPORTANT: Output ONLY valid CSV. Do not include code fences, markdown, or any extra text.")),
        ],
    ),
    "judge_texts": Constructed(
        "q string, r string, paths array<string>, g string",
        "txt string",
        add(txt=lambda: preparing.judge_text("q", "r", "paths", "g")),
        [
            Case(
                ("Q", None, ["a.b", "c"], "G"),
                (
                    "TASK PROMPT:\nQ\n\nFEATURE REQUIREMENTS (if provided):\n\n\nEXPECTED KEY PATHS (raw_output_metric, if provided):\n"
                    "['a.b', 'c']\n\nCANDIDATE OUTPUT (model generation):\nG\n",
                ),
            ),
            Case(
                ("", "R", [], None),
                (
                    "TASK PROMPT:\n\n\nFEATURE REQUIREMENTS (if provided):\nR\n\nEXPECTED KEY PATHS (raw_output_metric, if provided):\n"
                    "[]\n\nCANDIDATE OUTPUT (model generation):\n\n",
                ),
            ),
        ],
    ),
    "pseudo_parses": Constructed(
        "txt string, kind string",
        "ok boolean, strict boolean, output string, only_ok boolean",
        lambda rows: struct(lambda: udfs.pseudo_parse("txt", "kind"), "ok", "strict", "output", "only")(rows).withColumnRenamed("only", "only_ok"),
        [
            Case((' {"a":1} ', "json"), (True, True, '{"a": 1}', True)),
            Case(('Sure {"a":1}', "json"), (True, False, '{"a": 1}', True)),
            Case((f"{T}yaml\na: 1\n{T}", "yaml"), (True, True, "a: 1", True)),
            Case(("prose", "yaml"), (True, True, "prose", False)),
            Case(("a = ", "toml"), (False, False, "", False)),
            Case(("", "csv"), (False, False, "", False)),
        ],
    ),
    "numbers": Constructed(
        "txt string",
        "pct double",
        add(pct=lambda: F.round(C.percent("txt", F.lit(50)), 6)),
        [Case((" 12 ",), (24.0,)), Case(("x",), (None,)), Case(("1e1",), (20.0,)), Case((None,), (None,))],
    ),
    "toml_repairs": Constructed(
        "output string, output_type string",
        "output string",
        lambda rows: filtering.canonical_toml_rows(filtering.repaired_toml(rows)),
        [
            Case(('{"b": 1, "a": {"c": null}}', "TOML"), ('b = 1\n\n[a]\nc = ""\n',)),
            Case(("b = 1\na = 2", "TOML"), ("a = 2\nb = 1\n",)),
            Case(('{"b": 1}', "JSON"), ('{"b": 1}',)),
        ],
    ),
    "offline_normalised": Constructed(
        "dataset string, query string, output string, output_type string, output_format string, task_kind string, task_name string, "
        "messages array<struct<role:string,content:string>>, metadata struct<format:string,type:string,schema:string,prompt:string,output:string,final_output:string,answer:string,gold:string,target:string>, "
        "evaluation struct<grammar:struct<ok:boolean>,usable:boolean>",
        "query string, output string, output_type string, task_key string, parse_ok boolean",
        lambda rows: _offline(rows),
        [
            Case(("d", " Q ", " O ", "json", None, None, None, None, None, None), ("Q", "O", "JSON", "hf|JSON|unknown|unknown", None)),
            Case(
                ("chat-a/x", None, None, None, "toml", None, None, [], ("TOML", "Generation", "order", "P", "Output:\na = 1", None, None, None, None), ((True,), True)),
                ("P", "a = 1", "TOML", "a|TOML|generation|order", True),
            ),
            Case(
                ("chat-b/y", None, None, None, "XML", "Transform", "json_to_xml", [("system", "S"), ("user", "U"), ("assistant", "Here <a/> it is")], None, ((False,), None)),
                ("U", "<a/>", "XML", "b|XML|transform|json_to_xml", False),
            ),
        ],
    ),
}


def _offline(rows: DataFrame) -> DataFrame:
    """``offline_rows`` returns training rows without ids, so each case is normalised by
    itself and joined back."""
    cases, made = rows.drop("id").dropDuplicates(["case_id"]), []
    for k in range(3):
        made.append(preparing.offline_rows(cases.where(F.col("case_id") == k)).withColumn("case_id", F.lit(k)))
    united = made[0].unionByName(made[1]).unionByName(made[2]).withColumn("parse_ok", F.col("meta.parse_ok"))
    return rows.select("id", "case_id").join(F.broadcast(united), "case_id")
