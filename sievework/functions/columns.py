"""Native column expressions: normalisers, prompt rules, TOML depth, escape counters.

Everything here stays inside whole-stage code generation. Patterns ask for Unicode classes
where Python's own would, and for plain line ends where multi-line mode matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import ANSWER_LINE, BLOCK_ANY, FENCE_ENDS, FENCE_LINES, MARK
from .prompts import FORMAT_NAMES, TARGET_RULES, WORD
from .trees import TOML_DOTTED

#: What Python strips: Unicode white space and the four separators.
_BLANK = r"(?U)[\s\x1c-\x1f]"
#: The same characters one by one; U+3000 is the last of them.
BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """The text, a null being empty."""
    return F.coalesce(col(value), F.lit(""))


def strip(value: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(value), rf"\A{_BLANK}+", ""), rf"{_BLANK}+\z", "")


def trimmed(value: Column | str) -> Column:
    """As ``strip``, in one pass whatever blanks stand inside a long text."""
    return F.btrim(col(value), F.lit(BLANKS))


def filled(value: Column | str) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def first_filled(*values: Column | str) -> Column:
    return F.coalesce(*(filled(value) for value in values))


# --- Format names ---------------------------------------------------------------------


def _renamed(value: Column, names: Mapping[str, str]) -> Column:
    for old, new in names.items():
        value = F.when(value == old, new).otherwise(value)
    return value


def import_type(value: Column | str) -> Column:
    """Upper-case; YML is YAML; ``C_`` goes; null is empty."""
    upper = F.upper(strip(text(value)))
    return F.when(upper == "YML", "YAML").otherwise(F.regexp_replace(upper, "^C_", ""))


def reward_type(value: Column | str) -> Column:
    """Upper-case; YML is YAML, TSV is CSV; null or empty is JSON."""
    given = F.when(text(value) == "", "JSON").otherwise(col(value))
    return _renamed(F.upper(strip(given)), {"YML": "YAML", "TSV": "CSV"})


def analysis_type(value: Column | str) -> Column:
    """Upper-case; YML is YAML, TSV is CSV; then ``C_`` goes."""
    return F.regexp_replace(_renamed(F.upper(strip(text(value))), {"YML": "YAML", "TSV": "CSV"}), "^C_", "")


def selection_type(value: Column | str) -> Column:
    """Upper-case; null or blank is UNKNOWN."""
    return F.coalesce(F.upper(filled(value)), F.lit("UNKNOWN"))


def teacher_type(value: Column | str) -> Column:
    """Lower-case; unknown names are json."""
    return F.coalesce(format_name(value), F.lit("json"))


def plain_type(value: Column | str) -> Column:
    """Upper-case, stripped; null is empty."""
    return F.upper(strip(text(value)))


def checked_type(value: Column | str) -> Column:
    """Upper-case; YML is YAML."""
    return _renamed(plain_type(value), {"YML": "YAML"})


def format_name(value: Column | str) -> Column:
    """The lower-case name of a format or its alias; null if there is none."""
    names = F.create_map(*(F.lit(x) for pair in FORMAT_NAMES.items() for x in pair))
    return F.try_element_at(names, F.lower(strip(text(value))))


TYPE_PROFILES = {
    "import": import_type,
    "reward": reward_type,
    "analysis": analysis_type,
    "selection": selection_type,
    "teacher": teacher_type,
    "plain": plain_type,
    "checked": checked_type,
}


def type_from_key(output_type: Column | str, task_key: Column | str) -> Column:
    """The selection type, or else the second part of a task key."""
    part = F.try_element_at(F.split(col(task_key), r"\|"), F.lit(2))
    own = selection_type(output_type)
    return F.when(own == "UNKNOWN", selection_type(part)).otherwise(own)


def type_from_query(output_type: Column | str, query: Column | str) -> Column:
    """The given type, or the first of yaml, yml, toml, xml, csv, json inside the query."""
    lower = F.lower(text(query))
    guess = F.lit("json")
    for word in reversed(("yaml", "yml", "toml", "xml", "csv", "json")):
        guess = F.when(F.contains(lower, F.lit(word)), FORMAT_NAMES[word]).otherwise(guess)
    return F.when(filled(output_type).isNotNull(), teacher_type(output_type)).otherwise(guess)


def type_of_chat(category: Column | str, subcategory: Column | str) -> Column:
    """By the suffix ``_to_<format>`` of the subcategory, or else the category."""
    suffix = F.regexp_extract(strip(text(subcategory)), r"_to_([A-Za-z0-9]+)\s*$", 1)
    return analysis_type(F.when(suffix != "", suffix).otherwise(text(category)))


def family(value: Column | str, prefixes: Sequence[str] = ()) -> Column:
    """Lower-case letters and digits of a family name; one that begins with a known prefix
    is that prefix; nothing is ``other``."""
    compact = F.regexp_replace(F.lower(text(value)), r"(?U)[^\p{Alpha}\p{Digit}]", "")
    found = F.when(compact == "", "other").otherwise(compact)
    for prefix in prefixes:
        found = F.when(F.startswith(compact, F.lit(prefix)), prefix).otherwise(found)
    return found


# --- Fences ---------------------------------------------------------------------------


def has_fence(value: Column | str) -> Column:
    return F.contains(text(value), F.lit(MARK))


def without_fences(value: Column | str) -> Column:
    return strip(F.regexp_replace(text(value), f"(?md){FENCE_ENDS}", ""))


def first_block(value: Column | str) -> Column:
    """Inside of the first fenced block, or null."""
    found = F.regexp_extract(text(value), f"(?s){BLOCK_ANY}", 0)
    return F.when(found != "", F.regexp_extract(text(value), f"(?s){BLOCK_ANY}", 1))


def around_block(value: Column | str) -> Column:
    """The text without its first fenced block."""
    block = F.regexp_extract(text(value), f"(?s){BLOCK_ANY}", 0)
    at = F.position(block, text(value))
    rest = F.concat(F.substring(text(value), F.lit(1), at - 1), F.substr(text(value), at + F.length(block)))
    return F.when(block == "", text(value)).otherwise(rest)


def only_a_block(value: Column | str) -> Column:
    return first_block(value).isNotNull() & filled(around_block(value)).isNull()


def _spaced(pattern: str, flags: str) -> str:
    """The pattern of Python's in which white space is what Python takes for it."""
    return f"(?U{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def answer_payload(value: Column | str, name: Column | str) -> Column:
    """As ``formats.answer_payload``: the last block, or what follows a marker line, or what
    begins with the format's first sign, or the text without lines of fences."""
    given = trimmed(text(value))
    fenced, marker = has_fence(given), _spaced(ANSWER_LINE, "imds")
    block = F.when(fenced, F.try_element_at(F.regexp_extract_all(given, F.lit(_spaced(BLOCK_ANY, "s")), F.lit(1)), F.lit(-1)))
    after = F.when(F.rlike(given, F.lit(marker)), F.regexp_extract(given, f"{marker}(.*)", 1))
    begun = F.lit(None).cast("string")
    for own, sign in (("JSON", r"[{\[]"), ("XML", "<")):
        begun = F.when(col(name) == own, F.coalesce(F.nullif(F.regexp_extract(given, f"(?s){sign}.*", 0), F.lit("")), given)).otherwise(begun)
    bare = F.when(fenced, F.regexp_replace(given, _spaced(FENCE_LINES, "md"), "")).otherwise(given)
    return F.coalesce(trimmed(block), trimmed(after), begun, trimmed(bare))


def is_flow_style(value: Column | str) -> Column:
    return F.rlike(text(value), F.lit(r"[{}\[\]]"))


# --- Prompts --------------------------------------------------------------------------


def _rule(prompt: Column, pattern: str, group: int, words: Sequence[str]) -> Column:
    hit = F.regexp_extract(prompt, f"(?U){pattern}", group)
    good = hit != ""
    if words:
        good = good & F.rlike(prompt, F.lit("|".join(words)))
    return F.when(good, hit)


def target_format(prompt: Column | str) -> Column:
    """The format that a prompt asks for: the first rule that fits, or the only format word."""
    lower = F.lower(text(prompt))
    words = F.regexp_extract_all(lower, F.lit(rf"(?U)\b{WORD}\b"), F.lit(1))
    alone = F.when(F.size(words) == 1, F.try_element_at(words, F.lit(1)))
    return format_name(F.coalesce(*(_rule(lower, *rule) for rule in TARGET_RULES), alone))


def source_format(prompt: Column | str) -> Column:
    """The format that a conversion prompt names as its source, or null."""
    lower = F.lower(text(prompt))
    pairs = [(pattern, 1, words) for pattern, _, words in TARGET_RULES[:2]]
    return format_name(F.coalesce(*(_rule(lower, *rule) for rule in pairs)))


def _payload_like(value: Column) -> Column:
    def count(sign: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(sign), F.lit("")))

    return (
        F.rlike(value, F.lit(r"\A[{\[<]"))
        | (F.contains(value, F.lit("\n")) & (count(",") >= 2))
        | (count("=") >= 2)
        | (count(":") >= 3)
    )


def has_payload(prompt: Column | str) -> Column:
    """Whether the prompt seems to hold data (fence, tail after the first colon, XML)."""
    value = text(prompt)
    parts = F.split(value, F.lit(MARK))
    inside = F.filter(parts, lambda part, k: k % 2 == 1)
    fenced = F.exists(
        inside, lambda part: _payload_like(F.regexp_replace(strip(part), r"\A[a-zA-Z0-9_+\-]+\n", ""))
    )
    tail = F.when(
        F.contains(value, F.lit(":")), strip(F.substr(value, F.position(F.lit(":"), value) + 1))
    ).otherwise("")
    return fenced | _payload_like(tail) | F.contains(F.lower(value), F.lit("<?xml"))


def task_class(prompt: Column | str) -> Column:
    """clean_strict, generation_like or clean_relaxed."""
    asked = target_format(prompt).isNotNull()
    return (
        F.when(asked & has_payload(prompt), "clean_strict").when(asked, "generation_like").otherwise("clean_relaxed")
    )


def conversion_schema(prompt: Column | str, fallback: Column | str) -> Column:
    """``a_to_b`` of a prompt that names both formats, or else the given schema."""
    sign = r"([A-Za-z0-9_\-]+)"
    start = rf"(?iU)\b(?:Transform|Convert)\s+this\s+{sign}\s+data\s+"
    patterns = [rf"{start}into\s+{sign}\s+format\b", rf"{start}to\s+{sign}\b"]
    value, found = strip(text(prompt)), []
    for pattern in patterns:
        pair = [F.lower(import_type(F.regexp_extract(value, pattern, group))) for group in (1, 2)]
        found.append(F.when((pair[0] != "") & (pair[1] != ""), F.concat(pair[0], F.lit("_to_"), pair[1])))
    return F.coalesce(*found, filled(fallback), F.lit("unknown"))


def task_name_formats(name: Column | str) -> tuple[Column, Column]:
    """Source and target of a name like ``CSV to JSON``, in lower case, or nulls."""
    pattern = r"(?iU)\A\s*(Text|CSV|JSON|YAML|XML|TOML)\s+to\s+(CSV|JSON|YAML|XML|TOML)\s*\z"
    return tuple(F.nullif(F.lower(F.regexp_extract(text(name), pattern, k)), F.lit("")) for k in (1, 2))


def task_kind(query: Column | str, source: Column, target: Column) -> Column:
    """conversion, extraction, generation or other, by phrases first."""
    lower = F.lower(text(query))

    def says(*phrases: str) -> Column:
        return F.rlike(lower, F.lit("|".join(phrases)))

    structured = sorted(set(FORMAT_NAMES.values()))
    asked, given = F.coalesce(target.isin(structured), F.lit(False)), F.coalesce(source.isin(structured), F.lit(False))
    return (
        F.when(says("convert the following", "transform this", "please convert"), "conversion")
        .when(says("extract the following") & says("attributes"), "extraction")
        .when((F.coalesce(source, F.lit("")) == "text") & asked, "generation")
        .when(given & asked, "conversion")
        .otherwise("other")
    )


def task_subtype(query: Column | str, kind: Column, target: Column) -> Column:
    summary = F.contains(F.lower(text(query)), F.lit("summarize"))
    return (
        F.when((kind == "generation") & summary, "structured_summarization")
        .when(kind == "generation", "structured_generation")
        .when(kind == "conversion", F.concat(target, F.lit("_conversion")))
        .when(kind == "extraction", F.concat(target, F.lit("_extraction")))
        .otherwise("")
    )


# --- TOML depth -----------------------------------------------------------------------

_TOML_HEADER = r"^\s*(?:\[\[|\[)\s*([^\[\]]+?)\s*(?:\]\]|\])\s*$"


def toml_depth(value: Column | str) -> Column:
    """The largest number of parts of an unquoted header or dotted key, comments aside."""
    body = F.regexp_replace(text(value), r"(?md)(^|[^\\])#.*$", "$1")
    headers = F.regexp_extract_all(body, F.lit(f"(?md){_TOML_HEADER}"), F.lit(1))
    headers = F.filter(headers, lambda path: ~F.rlike(path, F.lit("[\"']")))
    dotted = F.regexp_extract_all(body, F.lit(f"(?md){TOML_DOTTED}"), F.lit(1))
    depths = F.transform(
        F.concat(headers, dotted),
        lambda path: F.size(F.filter(F.split(path, r"\."), lambda part: F.trim(part) != "")),
    )
    return F.coalesce(F.array_max(depths), F.lit(0))


def toml_is_deep(value: Column | str, least: int) -> Column:
    if least < 2:
        raise ValueError("a depth of 2 or more is asked for")
    return toml_depth(value) >= least


# TOML nested deeper than one level.
DEEP_HEADER = r"^\s*\[\[?\s*[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\s*\]\]?\s*$"
DEEP_KEY = r"^\s*[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\s*="


def has_deep_toml(value: Column | str) -> Column:
    """A dotted header or a dotted key at the start of a line."""
    return F.rlike(text(value), F.lit(f"(?md){DEEP_HEADER}|{DEEP_KEY}"))


# --- Escapes --------------------------------------------------------------------------

# The names and patterns of escapes, by format.
ESCAPES: dict[str, dict[str, str]] = {
    "XML": {
        "xml_amp": r"&amp;",
        "xml_lt": r"&lt;",
        "xml_gt": r"&gt;",
        "xml_quot": r"&quot;",
        "xml_apos": r"&apos;",
        "xml_num_dec": r"&#\d+;",
        "xml_num_hex": r"&#x[0-9A-Fa-f]+;",
        "xml_cdata": r"<!\[CDATA\[",
        "xml_bare_amp": r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9A-Fa-f]+;)",
    },
    "JSON": {
        "json_escaped_quote": r'\\"',
        "json_escaped_backslash": r"\\\\",
        "json_escaped_slash": r"\\/",
        "json_escape_b": r"\\b",
        "json_escape_f": r"\\f",
        "json_escape_n": r"\\n",
        "json_escape_r": r"\\r",
        "json_escape_t": r"\\t",
        "json_escape_u": r"\\u[0-9A-Fa-f]{4}",
        "json_raw_control_char": r"[\x00-\x1F]",
    },
    "TOML": {
        "toml_escaped_quote": r'\\"',
        "toml_escaped_backslash": r"\\\\",
        "toml_escape_b": r"\\b",
        "toml_escape_t": r"\\t",
        "toml_escape_n": r"\\n",
        "toml_escape_f": r"\\f",
        "toml_escape_r": r"\\r",
        "toml_escape_u": r"\\u[0-9A-Fa-f]{4}",
        "toml_escape_U": r"\\U[0-9A-Fa-f]{8}",
    },
    "YAML": {
        "yaml_escaped_quote": r'\\"',
        "yaml_escaped_backslash": r"\\\\",
        "yaml_escape_n": r"\\n",
        "yaml_escape_t": r"\\t",
        "yaml_escape_r": r"\\r",
        "yaml_escape_u": r"\\u[0-9A-Fa-f]{4}",
        "yaml_escape_U": r"\\U[0-9A-Fa-f]{8}",
        "yaml_escape_x": r"\\x[0-9A-Fa-f]{2}",
        "yaml_single_quote_doubled": r"''",
    },
    "CSV": {
        "csv_quote_doubled": r'""',
        "csv_quoted_newline": r'"[^"]*\n[^"]*"',
    },
}
#: Further types that a format is checked for, counted by ``trees.inline_tables``.
INLINE_TYPES = ("toml_inline_table", "toml_inline_table_after_eq", "toml_inline_table_in_array")


def escape_counts(value: Column | str, name: str) -> Column:
    """Array of (escape_type, n) of one format."""
    pairs = [
        F.struct(F.lit(label).alias("escape_type"), F.regexp_count(text(value), F.lit(pattern)).cast("long").alias("n"))
        for label, pattern in ESCAPES[name].items()
    ]
    return F.array(*pairs)


# --- Small things ---------------------------------------------------------------------


def safe_div(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.coalesce(top / bottom, F.lit(0.0)))


def rate_or_null(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def number(value: Column | str) -> Column:
    """A number, or null where the text is none."""
    return strip(col(value).cast("string")).try_cast("double")


def percent(value: Column | str, total: Column | float) -> Column:
    return number(value) / total * 100


def preview(value: Column | str, most: int, ellipsis: bool = False, flat: bool = False) -> Column:
    """The first ``most`` characters; ``flat`` writes line ends as two characters."""
    short = F.substring(text(value), 1, most)
    if ellipsis:
        short = F.when(F.length(text(value)) > most, F.concat(short, F.lit("..."))).otherwise(text(value))
    return F.replace(short, F.lit("\n"), F.lit("\\n")) if flat else short


def safe_name(value: Column | str) -> Column:
    """A directory name: a slash, or a run of unusual characters, is ``_``."""
    return F.regexp_replace(F.replace(text(value), F.lit("/"), F.lit("_")), r"[^A-Za-z0-9_\-|.]+", "_")


def content_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and the md5 of the parts, a line each."""
    lines: list[Column] = []
    for part in parts:
        lines += [F.lit("\n"), text(part)]
    return F.concat(F.lit(prefix), F.md5(F.concat(*lines[1:])))


