"""The kernels as Arrow functions, one struct for each concern.

Each text is parsed once for all fields of its struct. The functions are marked as not
deterministic, which they are not in fact: otherwise a filter on one of the fields would
make the optimizer evaluate the function twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats, prompts, scores, trees


def arrow(kernel: Callable[..., Any], returns: str) -> Callable[..., Column]:
    def apply(*columns: Column | str) -> Column:  # made when used: types need a session
        return F.udf(kernel, returns, useArrow=True).asNondeterministic()(*columns)

    return apply


def _parse(text: str | None, name: str | None) -> dict[str, Any]:
    text = text or ""
    found, loose = formats.strict(text, name), formats.lenient(text, name)
    return {
        "ok": found.ok,
        "error": found.error,
        "canon": trees.canonical_text(found.value, name) if found.ok else None,
        "ok_lenient": loose.ok,
        "used": loose.used,
        "only": formats.nothing_else(text, name),
    }


parse = arrow(_parse, "ok boolean, error string, canon string, ok_lenient boolean, used string, only boolean")


def _syntax(text: str | None, name: str | None) -> dict[str, Any]:
    there, _, good = trees.scored_tree(text or "", name)
    return {"there": there, "syntax": good}


syntax = arrow(_syntax, "there boolean, syntax boolean")


def _payload(text: str | None, name: str | None) -> dict[str, Any]:
    body, extraneous = formats.payload(text, name)
    return {"payload": body, "extraneous": extraneous}


payload = arrow(_payload, "payload string, extraneous boolean")
final_output = arrow(formats.final_output, "string")
last_block = arrow(formats.last_block, "string")


def _checked(text: str | None, name: str | None) -> dict[str, Any]:
    fields = ("ok", "error_kind", "error_message", "extracted_from", "payload_preview")
    return dict(zip(fields, formats.check_syntax(text, name or "")))


check_syntax = arrow(
    _checked, "ok boolean, error_kind string, error_message string, extracted_from string, payload_preview string"
)


def _validated(text: str | None, name: str | None) -> dict[str, Any]:
    return dict(zip(("ok", "reason"), formats.validate_answer(text, name or "")))


validate_answer = arrow(_validated, "ok boolean, reason string")
answer_payload = arrow(lambda text, name: formats.answer_payload(text, name or ""), "string")
yaml_indent_ok = arrow(formats.yaml_indent_is_canonical, "boolean")


def _toml(text: str | None) -> dict[str, Any]:
    return dict(zip(("ok", "already", "canonical", "error"), trees.canonical_toml(text)))


canonical_toml = arrow(_toml, "ok boolean, already boolean, canonical string, error string")
toml_likeness = arrow(trees.toml_likeness, "double")


def _converted(text: str | None) -> dict[str, Any]:
    return {"json_like": trees.looks_like_json(text)} | dict(zip(("ok", "toml", "error"), trees.json_to_toml(text)))


json_to_toml = arrow(_converted, "json_like boolean, ok boolean, toml string, error string")
inline_tables = arrow(
    trees.inline_tables,
    "toml_inline_table long, toml_inline_table_after_eq long, toml_inline_table_in_array long",
)
toml_structure = arrow(
    trees.toml_structure,
    "array_table_headers long, array_table_headers_with_dot long, table_headers long, "
    "max_header_depth long, child_tables_under_array long, json_stringified_like long",
)


def _tree(text: str | None, name: str | None) -> Any:
    found = formats.strict(text or "", name)
    return found.value if found.ok else None


def _leaves(text: str | None, name: str | None) -> list[dict[str, str]]:
    value = trees.canonical(_tree(text, name))
    return [{"path": path, "value": leaf} for path, leaf in trees.leaves(value)]


leaves = arrow(_leaves, "array<struct<path:string,value:string>>")


def leaf_f1(left: Column, right: Column) -> Column:
    """F1 of two arrays of leaves, natively."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    common = F.size(F.array_intersect(a, b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).otherwise(
        F.coalesce(F.try_divide(F.lit(2.0) * common, F.size(a) + F.size(b)), F.lit(0.0))
    )


def _paths(text: str | None, paths: Any, name: str | None) -> list[bool]:
    there, tree, _ = trees.scored_tree(text or "", name)
    return [there and trees.path_exists(tree, path) for path in (paths if paths is not None else ())]


paths_exist = arrow(_paths, "array<boolean>")


def _score(text: str | None, paths: Any, name: str | None) -> dict[str, Any]:
    return scores.key_score(text, None if paths is None else list(paths), name)


key_score = arrow(
    _score,
    "render_score double, key_validation_score double, raw_output_eval array<boolean>, "
    "raw_output_score double, final_eval_score double",
)


def _reward_parts(text: str | None, name: str | None, paths: Any, reference: str | None) -> dict[str, Any]:
    return scores.reward_parts(text, name, None if paths is None else list(paths), reference)


reward_parts = arrow(_reward_parts, ", ".join(f"{name} double" for name in (*scores.COMPONENTS, "final_eval_score")))


def _diagnosis(text: str | None, name: str | None, paths: Any) -> dict[str, Any]:
    return {"key_score": _score(text, paths, name), "components": scores.components(text, name)}


diagnosis = arrow(
    _diagnosis,
    "key_score struct<render_score:double,key_validation_score:double,raw_output_eval:array<boolean>,"
    "raw_output_score:double,final_eval_score:double>, "
    f"components struct<{','.join(f'{name}:double' for name in scores.COMPONENTS)}>",
)


def _evaluation(text: str | None, name: str | None, paths: Any) -> dict[str, Any]:
    text = text or ""
    found = formats.strict(text, name)
    authors = trees.article_checks(found.value)["authors_len_is_2"] if name == "JSON" and found.ok else False
    return {
        "strict_ok": found.ok,
        "only_ok": formats.nothing_else(text, name),
        "authors_len_ok": authors,
        "final_eval_score": _score(text, paths, name)["final_eval_score"],
    }


evaluation = arrow(_evaluation, "strict_ok boolean, only_ok boolean, authors_len_ok boolean, final_eval_score double")


def reward_components(
    allowed: set[str] | None = None, schema: dict[str, Any] | None = None
) -> Callable[[Column, Column, Column], Column]:
    def run(text: str | None, name: str | None, reference: str | None) -> dict[str, float]:
        return scores.components(text, name, reference, allowed, schema)

    return arrow(run, ", ".join(f"{name} double" for name in scores.COMPONENTS))


def _article(text: str | None) -> dict[str, Any]:
    loose = formats.lenient(text or "", "JSON")
    return trees.article_checks(loose.value if loose.ok else None)


article_checks = arrow(
    _article,
    "title_is_string boolean, authors_is_list boolean, authors_len_is_2 boolean, authors_items_ok boolean, "
    "publication_year_is_int boolean, keywords_is_list_str boolean",
)


def extra_keys(allowed: set[str]) -> Callable[[Column], Column]:
    def run(text: str | None) -> int:
        return trees.extra_keys(_tree(text, "JSON"), allowed)

    return arrow(run, "long")


def schema_check(schema: dict[str, Any]) -> Callable[[Column], Column]:
    def run(text: str | None) -> dict[str, Any]:
        found = formats.strict(text or "", "JSON")
        errors = trees.schema_errors(found.value, schema) if found.ok else ["unreadable"]
        return {"ok": not errors, "errors": errors}

    return arrow(run, "ok boolean, errors array<string>")


attributes = arrow(prompts.attributes, "array<string>")
inline_payload = arrow(prompts.inline_payload, "string")


def _equivalence(prompt: str | None, name: str | None, output: str | None) -> dict[str, Any]:
    return prompts.equivalence(prompt, (name or "").lower(), output or "")._asdict()


equivalence = arrow(_equivalence, "result string, score double, reason string")


def _pseudo(text: str | None, name: str | None) -> dict[str, Any]:
    """A teacher's generation: JSON leniently and written anew, others whole."""
    text, name = (text or "").strip(), (name or "").upper()
    body = formats.without_fences(text)
    found = formats.strict(text if name == "JSON" else body, name)
    loose = formats.lenient(text, name) if name == "JSON" and not found.ok else found
    used = (loose.used or body).strip()
    value = json.dumps(loose.value, ensure_ascii=False) if name == "JSON" and loose.ok and loose.value is not None else used
    return {
        "ok": loose.ok,
        "strict": found.ok,
        "used": used if name == "JSON" else body,
        "output": value if loose.ok else "",
        "only": loose.ok and formats.nothing_else(used if name == "JSON" else body, name),
        "error": loose.error or "",
    }


pseudo_parse = arrow(_pseudo, "ok boolean, strict boolean, used string, output string, only boolean, error string")


def _keep(prompt: str | None, name: str | None, output: str | None) -> dict[str, Any]:
    return dict(zip(("keep", "reason"), prompts.keep(prompt, name, output or "")))


keep = arrow(_keep, "keep boolean, reason string")
