"""From chat rows to queries, reference outputs, task keys and prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import (
    analysis_type,
    col,
    content_id,
    conversion_schema,
    filled,
    first_filled,
    import_type,
    plain_type,
    strip,
    teacher_type,
    text,
)

ANSWER_FIELDS = ("output", "final_output", "answer", "gold", "target")


@dataclass(frozen=True)
class Families:
    """Which data sets keep prompt and answer in ``metadata``, and which are described by
    category and subcategory: name prefixes of data sets, and the family names."""

    metadata_prefix: str = "chat-a/"
    category_prefix: str = "chat-b/"
    metadata: str = "a"
    category: str = "b"
    other: str = "hf"

    def of(self, dataset: Column) -> Column:
        return (
            F.when(F.startswith(dataset, F.lit(self.metadata_prefix)), self.metadata)
            .when(F.startswith(dataset, F.lit(self.category_prefix)), self.category)
            .otherwise(self.other)
        )


FAMILIES = Families()

# --- Messages -------------------------------------------------------------------------


def last_content(messages: Column | str, role: str, exact: bool = False) -> Column:
    """The last text of a role; roles are compared in lower case unless ``exact``."""

    def own(message: Column) -> Column:
        name = message["role"] if exact else F.lower(strip(message["role"]))
        return (name == role) & (F.lit(True) if exact else message["content"].isNotNull())

    found = F.filter(col(messages), own)
    return F.try_element_at(F.transform(found, lambda message: message["content"]), F.lit(-1))


def last_assistant(messages: Column | str) -> Column:
    """The last assistant message by exact role; empty if there is none."""
    return text(last_content(messages, "assistant", exact=True))


def says(messages: Column | str, role: str, content: str) -> Column:
    return F.coalesce(
        F.exists(col(messages), lambda message: (message["role"] == role) & (message["content"] == content)), F.lit(False)
    )


def roles(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation with the last system, user and assistant text, from one
    row per turn: one aggregation, added up before its shuffle."""
    own = F.when(F.col("text").isNotNull(), F.lower(strip("role")))
    return turns.groupBy(conversation).agg(
        *(
            F.max_by(F.when(own == role, F.col("text")), F.when(own == role, F.col(turn))).alias(f"{role}_text")
            for role in ("system", "user", "assistant")
        )
    )


def query_text(family: Column, system: Column | str, user: Column | str, families: Families = FAMILIES) -> Column:
    """System and user text where the family keeps rules in the system message."""
    said, rules = strip(text(user)), strip(text(system))
    joined = strip(F.concat(rules, F.lit("\n\n"), said))
    return F.when((family == families.metadata) & (rules != ""), joined).otherwise(said)


def metadata_prompt(metadata: str = "metadata") -> Column:
    return filled(F.col(f"{metadata}.prompt"))


def metadata_answer(metadata: str = "metadata") -> Column:
    return first_filled(*(F.col(f"{metadata}.{name}") for name in ANSWER_FIELDS))


def reference_output(output: Column | str, assistant: Column | str, kind: Column, metadata: str = "metadata") -> Column:
    """The structured part of the first of: metadata answer, output column, assistant text."""
    source = F.coalesce(metadata_answer(metadata), filled(output), col(assistant), F.lit(""))
    return udfs.final_output(source, kind)


def declared_type(rows: DataFrame) -> Column:
    """Of metadata.format, category, format, output_type the first that is present at all."""
    present = []
    for name in ("metadata.format", "category", "format", "output_type"):
        top = name.split(".")[0]
        if top in rows.columns:
            present.append(F.col(name))
    return import_type(F.coalesce(*present, F.lit("")))


def unbundled(rows: DataFrame) -> DataFrame:
    """One row for each conversation of a bundle, up to the shorter of the two lists, with
    its position in ``part``."""
    n = F.least(F.size("messages"), F.size("metadata"))
    pairs = F.arrays_zip(F.slice("messages", F.lit(1), n), F.slice("metadata", F.lit(1), n))
    rest = [name for name in rows.columns if name not in ("messages", "metadata")]
    pairs = F.transform(pairs, lambda pair: F.struct(pair["0"].alias("messages"), pair["1"].alias("metadata")))
    return rows.select(*rest, F.posexplode(pairs).alias("part", "pair")).select(
        *rest, "part", F.col("pair.messages").alias("messages"), F.col("pair.metadata").alias("metadata")
    )


# --- Tasks ----------------------------------------------------------------------------


def task_fields(family: Column, kind: Column, schema: Column, output_type: Column) -> list[Column]:
    """Family, kind, schema and the key made of them."""
    kind, schema = F.coalesce(F.lower(strip(kind)), F.lit("unknown")), F.coalesce(filled(schema), F.lit("unknown"))
    name = F.coalesce(F.nullif(output_type, F.lit("")), F.lit("UNKNOWN"))
    return [
        family.alias("task_family"),
        kind.alias("task_kind"),
        schema.alias("task_schema"),
        F.concat_ws("|", family, name, kind, schema).alias("task_key"),
    ]


def task_meta(rows: DataFrame, user: str, output_type: Column, families: Families = FAMILIES) -> list[Column]:
    """Task fields of chat rows with ``dataset``; kind and schema come from metadata (and
    the prompt), or from task and subcategory."""
    family = families.of(F.col("dataset"))
    has = set(rows.columns)
    meta_kind, meta_schema = (
        (F.col("metadata.type"), F.col("metadata.schema")) if "metadata" in has else (F.lit(None), F.lit(None))
    )
    chat_kind, chat_schema = (F.col(name) if name in has else F.lit(None) for name in ("task", "subcategory"))
    kind = F.when(family == families.metadata, meta_kind.cast("string")).when(
        family == families.category, chat_kind.cast("string")
    )
    schema = F.when(family == families.metadata, conversion_schema(user, meta_schema.cast("string"))).when(
        family == families.category, chat_schema.cast("string")
    )
    return task_fields(family, kind, schema, output_type)


# Fixed value.
SUPPLEMENT = "Supplementary metadata (for disambiguation only; do NOT include this block in your output):"


def with_supplement(
    query: Column | str,
    output_type: Column | str,
    kind: Column | str,
    schema: Column | str,
    family: Column | str,
    key: Column | str,
    complexity: Column | str | None = None,
) -> Column:
    """The query and a block of what is known about its task; nothing known, nothing added."""
    known = [("FORMAT", output_type), ("TASK_KIND", kind), ("SCHEMA", schema)]
    known += [("COMPLEXITY", complexity)] if complexity is not None else []
    known += [("TASK_FAMILY", family), ("TASK_KEY", key)]
    lines = [F.concat(F.lit(f"{label}: "), filled(value)) for label, value in known]
    block = F.concat_ws("\n", *lines)
    made = F.concat(strip(text(query)), F.lit(f"\n\n---\n{SUPPLEMENT}\n"), block)
    return F.when(filled(query).isNull(), col(query)).when(block == "", strip(query)).otherwise(made)


def task_id(prefix: str, output_type: Column | str, query: Column | str, reference: Column | str) -> Column:
    return content_id(prefix, output_type, query, reference)


def fingerprint(output_type: Column | str, query: Column | str, output: Column | str) -> Column:
    return content_id("", output_type, query, output)


def offline_rows(rows: DataFrame, families: Families = FAMILIES) -> DataFrame:
    """Rows of either offline shape as training rows; rows without query or output go.

    A row that has ``query`` and ``output`` is taken as it is; another is read from its
    metadata or its messages, as its family demands.
    """
    def column(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    for name, kind in (("metadata", None), ("messages", None), ("evaluation", None)):
        if name not in rows.columns:
            raise ValueError(f"offline rows need a column {name}")
    dataset = F.coalesce(column("dataset"), F.lit("offline"))
    family = families.of(dataset)
    ready = column("query").isNotNull() & column("output").isNotNull()
    kind = F.coalesce(
        F.nullif(plain_type(column("output_type")), F.lit("")),
        F.nullif(plain_type(column("output_format")), F.lit("")),
        F.nullif(import_type(F.col("metadata.format")), F.lit("")),
        F.lit(""),
    )
    in_metadata = family == families.metadata
    user, assistant = last_content("messages", "user"), last_content("messages", "assistant")
    prompt = F.when(in_metadata, metadata_prompt()).otherwise(
        query_text(family, last_content("messages", "system"), user, families)
    )
    answer = F.when(in_metadata, metadata_answer()).otherwise(assistant)
    staged = rows.select(
        "*",
        dataset.alias("_dataset"),
        kind.alias("_type"),
        family.alias("_family"),
        strip(text(F.when(ready, column("query")).otherwise(prompt))).alias("_query"),
        ready.alias("_ready"),
        F.when(ready, strip(column("output"))).otherwise(answer).alias("_answer"),
    )
    staged = staged.where((F.col("_query") != "") & filled("_answer").isNotNull())
    output = F.when(F.col("_ready"), F.col("_answer")).otherwise(strip(udfs.final_output("_answer", "_type")))
    staged = staged.withColumn("_output", output).where("_output <> ''")
    kind_of = F.when(F.col("_family") == families.metadata, F.col("metadata.type")).when(
        F.col("_family") == families.category, column("task_kind")
    )
    schema_of = F.when(F.col("_family") == families.metadata, conversion_schema("_query", F.col("metadata.schema"))).when(
        F.col("_family") == families.category, column("task_name")
    )
    return staged.select(
        F.col("_query").alias("query"),
        F.col("_output").alias("output"),
        F.nullif("_type", F.lit("")).alias("output_type"),
        *task_fields(F.col("_family"), kind_of, schema_of, F.col("_type")),
        F.struct(
            F.col("evaluation.grammar.ok").alias("parse_ok"), F.col("evaluation.usable").alias("usable")
        ).alias("meta"),
    )


def training_to_tasks(rows: DataFrame, prefix: str = "offline_") -> DataFrame:
    """Training rows as tasks with ids, key paths from the prompt, and reference outputs."""
    kind = F.coalesce(F.nullif(plain_type("output_type"), F.lit("")), F.lit("JSON"))
    return rows.select(
        task_id(prefix, kind, "query", "output").alias("task_id"),
        "query",
        kind.alias("output_type"),
        F.col("output").alias("reference_output"),
        udfs.attributes("query").alias("raw_output_metric"),
        *(F.col(name) for name in ("task_key", "task_family", "task_kind", "task_schema") if name in rows.columns),
    )


def benchmark_tasks(rows: DataFrame) -> DataFrame:
    """The ten fields of a benchmark task, with defaults (fixed values) for what is missing."""
    defaults = {
        "task_id": F.lit(""),
        "task_name": F.lit("StructEval"),
        "query": F.lit(""),
        "feature_requirements": F.lit(""),
        "input_type": F.lit("Text"),
        "output_type": F.lit("JSON"),
        "query_example": F.lit(""),
        "VQA": F.array().cast("array<string>"),
        "raw_output_metric": F.array().cast("array<string>"),
        "rendering": F.lit(False),
    }
    return rows.select(
        *(
            (F.coalesce(F.col(name), default) if name in rows.columns else default).alias(name)
            for name, default in defaults.items()
        )
    )


# --- Prompts --------------------------------------------------------------------------


@dataclass(frozen=True)
class Prompting:
    mode: str = "default"
    system: str = ""
    user_prefix: str = ""
    schema_prefix: str = ""
    output_prefix: str = ""
    rules: Mapping[str, str] | None = None


def numbered(requirements: Column | str) -> Column:
    """``1. a`` and so on, a line each."""
    lines = F.transform(col(requirements), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x))
    return F.array_join(lines, "\n")


def chat(instruction: Column | str, requirements: Column | str, output_type: Column | str, style: Prompting) -> Column:
    """Messages of one example: the user's alone in contest mode, or a system message with
    the format's rules and a user message with the requirements."""
    said = strip(text(instruction))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if style.mode.strip().lower() == "contest":
        return F.array(message("user", said))
    system: Column = F.lit(style.system.strip())
    if style.rules:
        rules = F.create_map(*(F.lit(x) for pair in style.rules.items() for x in pair))
        own = F.try_element_at(rules, plain_type(output_type))
        system = F.when(own.isNotNull(), strip(F.concat(system, F.lit("\n\n"), own))).otherwise(system)
    wanted = strip(text(requirements))
    middle = F.when(wanted == "", "").otherwise(F.concat(F.lit(style.schema_prefix), wanted, F.lit("\n\n")))
    user = F.concat(F.lit(style.user_prefix), said, F.lit("\n\n"), middle, F.lit(style.output_prefix))
    both = F.array(message("system", system), message("user", strip(user)))
    return F.when(system == "", F.slice(both, 2, 1)).otherwise(both)


def framed(messages: Column | str) -> Column:
    """Messages between plain start and end marks, open for the assistant."""
    parts = F.transform(
        col(messages),
        lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), text(m["content"]), F.lit("<|im_end|>")),
    )
    return F.concat_ws("\n", F.array_join(parts, "\n"), F.lit("<|im_start|>assistant\n"))


# The wording of the prompts below.


def teacher_system(output_type: Column | str) -> Column:
    kind = teacher_type(output_type)
    name = F.when(kind == "csv", "CSV text").otherwise(F.upper(kind))
    return F.concat(F.lit("Return ONLY valid "), name, F.lit(". Do not include code fences or commentary."))


def teacher_prompt(query: Column | str, output_type: Column | str, variant: Column | str, variants: int) -> Column:
    """The query, the demand for the format alone, and which variation it is."""
    kind = F.upper(teacher_type(output_type))
    parts: list[Column] = [
        strip(text(query)),
        F.lit("\n\nIMPORTANT: Output ONLY valid "),
        kind,
        F.lit(". Do not include code fences, markdown, or any extra text."),
    ]
    if variants > 1:
        parts += [
            F.lit(
                "\n\n[Variation] Produce a different fictional instance than previous attempts "
                "(different names/values), while still satisfying all Feature Requirements. Return "
            ),
            kind,
            F.lit(" only.\n[Variation ID] "),
            (col(variant) + 1).cast("string"),
            F.lit(f" / {variants}"),
        ]
    return F.concat(*parts)


def variants_of(tasks: DataFrame, n: int) -> DataFrame:
    """Each task ``n`` times, with ``variant`` from 0."""
    return tasks.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))


TYPE_ORDER = ("json", "yaml", "toml", "xml", "csv")


def work_order(rows: DataFrame, order: Sequence[str] = TYPE_ORDER, seed: int = 0, key: str = "task_id") -> list[Column]:
    """Sort columns: types in the given order and unknown ones after, then variants, then
    a seeded shuffle of the tasks."""
    return [_type_place(order), F.col("output_type"), F.col("variant"), F.xxhash64(F.lit(seed), key), F.col(key)]


def _type_place(order: Sequence[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), F.col("output_type"))
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order) + 1).otherwise(at)


def work_places(
    rows: DataFrame, order: Sequence[str] = TYPE_ORDER, seed: int = 0, key: str = "task_id", name: str = "place"
) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the ``work_order`` of all rows. Ranks inside a type and
    variant come from ``sampling.ranked``, and only the counts of types and variants are put
    in order, so no task gets more than a slice of the rows."""
    from .sampling import ranked

    groups = ["output_type", "variant"]
    counts = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(_type_place(order), *groups).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *(F.col(x).alias(f"_g_{x}") for x in groups), "_earlier"
    )
    same = [F.col(x).eqNullSafe(F.col(f"_g_{x}")) for x in groups]
    placed = ranked(rows, groups, seed, key, "_rank").join(counts, same[0] & same[1])
    return placed.select(*rows.columns, (F.col("_earlier") + F.col("_rank")).alias(name))


# The wording of what a judge reads.


def judge_text(query: Column | str, requirements: Column | str, paths: Column | str, generation: Column | str) -> Column:
    """What a judge reads. Paths are written the way Python prints a list of strings."""
    listed = udfs.arrow(lambda paths: str(list(paths if paths is not None else ())), "string")(col(paths))
    return F.concat(
        F.lit("TASK PROMPT:\n"),
        text(query),
        F.lit("\n\nFEATURE REQUIREMENTS (if provided):\n"),
        text(requirements),
        F.lit("\n\nEXPECTED KEY PATHS (raw_output_metric, if provided):\n"),
        listed,
        F.lit("\n\nCANDIDATE OUTPUT (model generation):\n"),
        text(generation),
        F.lit("\n"),
    )


def records_of(rows: DataFrame, families: Families = FAMILIES) -> DataFrame:
    """Analysis fields of chat rows of either family: type, kind, schema, key and answer.

    The family is known by the columns: metadata and messages, or category, subcategory
    and messages."""
    has = set(rows.columns)
    if {"metadata", "messages"} <= has:
        family, kind = F.lit(families.metadata), analysis_type(F.col("metadata.format"))
        task, schema = filled(F.col("metadata.type")), filled(F.col("metadata.schema"))
    elif {"category", "subcategory", "messages"} <= has:
        from ..functions.columns import type_of_chat

        family, kind = F.lit(families.category), type_of_chat("category", "subcategory")
        task, schema = filled(F.col("task")) if "task" in has else F.lit(None), filled(F.col("subcategory"))
    else:
        family, kind, task, schema = F.lit("unknown"), F.lit(""), F.lit(None), F.lit(None)
    task, schema = F.coalesce(task, F.lit("unknown")), F.coalesce(schema, F.lit("unknown"))
    return rows.select(
        "*",
        family.alias("family"),
        kind.alias("output_format_found"),
        task.alias("task_kind_found"),
        schema.alias("task_schema_found"),
        F.concat_ws("|", family, kind, task, schema).alias("task_key"),
        last_assistant("messages").alias("assistant_text"),
    )
