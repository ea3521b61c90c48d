"""Scores of generations: required keys, reward components, and their combination."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from . import trees
from .formats import kind, lenient, nothing_else, payload, strict, yaml_indent_is_canonical, yaml_is_flow

SYNTAX_SHARE, KEYS_SHARE = 0.2, 0.8
#: Components of the reward, in order.
COMPONENTS = (
    "parse parse_best_effort only extraneous yaml_indent_canonical yaml_block_style toml_canonical "
    "toml_canonical_soft schema_valid title_is_string authors_len_is_2 authors_items_ok publication_year_is_int "
    "keywords_is_list_str extra_keys match match_soft"
).split()
_ARTICLE = ("title_is_string", "authors_len_is_2", "authors_items_ok", "publication_year_is_int", "keywords_is_list_str")


def key_score(text: str | None, paths: Sequence[str] | None, name: str | None) -> dict[str, Any]:
    """Syntax and required keys of a generation. Without paths the key score is 0."""
    there, tree, syntax = trees.scored_tree(text or "", name)
    found = [there and trees.path_exists(tree, path) for path in paths or ()]
    share = sum(found) / len(found) if found else 0.0
    return {
        "render_score": float(syntax),
        "key_validation_score": share,
        "raw_output_eval": found,
        "raw_output_score": share,
        "final_eval_score": SYNTAX_SHARE * syntax + KEYS_SHARE * share,
    }


def reward_name(name: str | None) -> str:
    """Upper-case, YML as YAML, TSV as CSV; nothing stands for JSON."""
    name = kind(name)
    return {"YML": "YAML", "TSV": "CSV"}.get(name, name)


def components(
    text: str | None,
    name: str | None,
    reference: str | None = None,
    allowed: set[str] | None = None,
    schema: dict[str, Any] | None = None,
) -> dict[str, float]:
    """The reward components of one completion.

    Two separately read XML trees are never equal, so ``match`` of XML is 0.
    """
    name = reward_name(name)
    body, extraneous = payload(text, name)
    whole = strict(body, name)
    loose = whole if name == "TOML" else lenient(body, name)
    found = dict.fromkeys(COMPONENTS, 0.0)
    found |= {
        "parse": float(whole.ok),
        "parse_best_effort": float(loose.ok),
        "only": float(nothing_else(text or "", name)),
        "extraneous": float(extraneous),
    }
    found |= style(body, name)
    # A cut-off start of a strict format must not stand in for the whole.
    value = whole.value if whole.ok else None if name in ("TOML", "XML", "CSV") or not loose.ok else loose.value
    if name == "JSON":
        if whole.ok and schema is not None:
            found["schema_valid"] = float(not trees.schema_errors(whole.value, schema))
        if value is not None:
            checks = trees.article_checks(value)
            found |= {key: float(checks[key]) for key in _ARTICLE}
            if allowed is not None:
                found["extra_keys"] = float(trees.extra_keys(value, allowed))
    if reference is not None and reference.strip():
        gold = strict(payload(reference, name)[0], name)
        if whole.ok and gold.ok and whole.value is not None and gold.value is not None:
            found["match"] = float(whole.value == gold.value)
        if value is not None and gold.value is not None:
            found["match_soft"] = trees.likeness(
                trees.canonical_text(value, name), trees.canonical_text(gold.value, name)
            )
    return found


def style(body: str, name: str) -> dict[str, float]:
    """The components of YAML's and TOML's style."""
    if name == "YAML":
        return {
            "yaml_indent_canonical": float(yaml_indent_is_canonical(body)),
            "yaml_block_style": float(not yaml_is_flow(body)),
        }
    if name == "TOML":
        return {"toml_canonical": float(trees.canonical_toml(body)[1]), "toml_canonical_soft": trees.toml_likeness(body)}
    return {}


def reward_parts(
    text: str | None, name: str | None, paths: Sequence[str] | None, reference: str | None
) -> dict[str, float]:
    """What a reward is made of: with key paths the key score of the payload, its style and
    whether anything stands around it, without them all components."""
    if not paths:
        return components(text, name, reference) | {"final_eval_score": 0.0}
    body, extraneous = payload(text, name)
    found = dict.fromkeys(COMPONENTS, 0.0) | style(body, reward_name(name)) | {"extraneous": float(extraneous)}
    return found | {"final_eval_score": key_score(body, paths, name)["final_eval_score"]}


#: Weights that hold where a configuration is silent.
WEIGHTS = {
    "p_parse_fail": -3.0,
    "p_parse_best_effort": -1.5,
    "w_parse": 1.0,
    "w_only": 0.5,
    "w_match": 0.0,
    "w_match_soft": 0.0,
    "w_schema_valid": 2.0,
    "w_exact_authors_len_2": 1.0,
    "w_no_extra_keys": 0.0,
    "p_only": -1.0,
    "w_yaml_indent_canonical": 0.0,
    "w_yaml_block_style": 0.0,
    "p_yaml_indent_canonical_fail": 0.0,
    "p_yaml_block_style_fail": 0.0,
    "w_toml_canonical": 0.0,
    "w_toml_canonical_soft": 0.0,
    "p_toml_canonical_soft_scale": 0.0,
    "p_toml_canonical_fail": 0.0,
    "p_extraneous": 0.0,
}
EXTRA_KEY = -0.1
_BY_FORMAT = {"w_parse", "w_only", "w_match", "w_match_soft", "p_only", "p_extraneous"}


def weight(given: Mapping[str, float], key: str, name: str) -> float:
    """A weight: the format's own, the general one, or the default."""
    own = [f"{key}_{name.lower()}"] if key in _BY_FORMAT else []
    if key == "p_only":
        own.insert(0, f"p_only_{name.lower()}_fail")
    return float(next((given[x] for x in (*own, key) if x in given), WEIGHTS[key]))


def combine(found: Mapping[str, float], config: Mapping[str, float], name: str | None) -> float:
    """The reward of one completion; ``operators.scoring.combined`` is the same natively."""
    name = reward_name(name)

    def of(key: str) -> float:
        return weight(config, key, name)

    if found["parse"] < 1 and found["parse_best_effort"] < 1:
        return of("p_parse_fail")
    pairs = {
        "w_parse": "parse",
        "w_only": "only",
        "w_match": "match",
        "w_match_soft": "match_soft",
        "w_schema_valid": "schema_valid",
        "w_exact_authors_len_2": "authors_len_is_2",
    }
    total = 0.0 if found["parse"] >= 1 else of("p_parse_best_effort")
    total += sum(of(key) * found[part] for key, part in pairs.items())
    total += EXTRA_KEY * found["extra_keys"] + (of("w_no_extra_keys") if not found["extra_keys"] else 0.0)
    total += of("p_only") if found["only"] < 1 else 0.0
    total += style_reward(found, config, name)
    return total + (of("p_extraneous") if found["extraneous"] >= 1 else 0.0)


def style_reward(found: Mapping[str, float], config: Mapping[str, float], name: str) -> float:
    """What the style of YAML and TOML adds."""
    flags = {"YAML": ("yaml_indent_canonical", "yaml_block_style"), "TOML": ("toml_canonical",)}.get(name, ())
    total = 0.0
    for flag in flags:
        total += weight(config, f"w_{flag}", name) * found[flag]
        total += weight(config, f"p_{flag}_fail", name) if found[flag] < 1 else 0.0
    if name == "TOML":
        soft = found["toml_canonical_soft"]
        total += weight(config, "w_toml_canonical_soft", name) * soft
        total += weight(config, "p_toml_canonical_soft_scale", name) * (1 - soft)
    return total


def reward_function(config: Mapping[str, float], **options: Any):
    """A reward callable for a trainer: ``(prompts, completions, **columns) -> rewards``.

    Columns, each a list or one value for all: raw_output_metric, output_type,
    reference_output; they may also come inside ``batch``.
    """

    def run(prompts: Sequence[str], completions: Sequence[str], **columns: Any) -> list[float]:
        given = {**(columns.get("batch") or {}), **columns}

        def of(name: str, k: int) -> Any:
            value = given.get(name)
            return value[k] if isinstance(value, (list, tuple)) and k < len(value) else value

        return [
            one_reward(text, of("raw_output_metric", k), of("output_type", k), of("reference_output", k), config, **options)
            for k, text in enumerate(completions)
        ]

    return run


def one_reward(
    text: str, paths: Any, name: str | None, reference: str | None, config: Mapping[str, float], **options: Any
) -> float:
    """With key paths the key score of the payload and its style, else the components."""
    name = kind(name)
    listed = [str(path) for path in paths] if isinstance(paths, (list, tuple)) else []
    if not listed:
        return combine(components(text, name, reference, **options), config, name)
    body, extraneous = payload(text, name)
    found = dict.fromkeys(COMPONENTS, 0.0) | style(body, reward_name(name))
    silent = {key: 0.0 for key in WEIGHTS} | dict(config)
    total = key_score(body, listed, name)["final_eval_score"] + style_reward(found, silent, name)
    return total + (weight(silent, "p_extraneous", name) if extraneous else 0.0)


def judge_key_text(provider: str, model: str, content: Mapping[str, Any]) -> str:
    """What a judge's answer is filed under, before hashing."""
    return f"{provider}\0{model}\0{json.dumps(content, sort_keys=True, ensure_ascii=False)}"
