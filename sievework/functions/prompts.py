"""What prompts say: target and source formats, inline payloads, attribute lists, the
conversion check, and the policy that keeps or drops an example."""

from __future__ import annotations

import json
import re
from typing import Any, NamedTuple

import yaml

from . import formats
from .formats import BLOCK_TIGHT, MARK, Parsed, attempt
from .trees import canonical, leaf_f1

# Format words and their names.
FORMAT_NAMES = {"json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "csv": "csv"}
WORD = "(" + "|".join(FORMAT_NAMES) + ")"
CONVERT = ("convert", "transform", "reformat")
MAKE = ("output", "produce", "generate", "create", "return", "respond")
#: Rules in order: pattern, the group with the target, words of which one must be there.
TARGET_RULES = (
    (rf"\bfrom\s+{WORD}\s+to\s+{WORD}\b", 2, ()),
    (rf"\b{WORD}\s+to\s+{WORD}\b", 2, CONVERT),
    (rf"\binto\s+{WORD}\b", 1, CONVERT + MAKE),
    (rf"\bas\s+{WORD}\b", 1, MAKE),
    (rf"\bin\s+{WORD}\s+format\b", 1, MAKE + ("transform", "convert")),
    (rf"\b({'|'.join(MAKE)})\s+(?:a\s+)?{WORD}\b", 2, ()),
)
_RULES = [(re.compile(pattern), group, words) for pattern, group, words in TARGET_RULES]
_ALONE = re.compile(rf"\b{WORD}\b")
_BLOCK = re.compile(BLOCK_TIGHT, re.S)


def _first_rule(prompt: str, rules) -> tuple[re.Match[str], int] | None:
    for pattern, group, words in rules:
        found = pattern.search(prompt)
        if found and (not words or any(word in prompt for word in words)):
            return found, group
    return None


def target_format(prompt: str | None) -> str | None:
    prompt = (prompt or "").lower()
    hit = _first_rule(prompt, _RULES)
    if hit:
        return FORMAT_NAMES[hit[0][hit[1]]]
    alone = _ALONE.findall(prompt)
    return FORMAT_NAMES[alone[0]] if len(alone) == 1 else None


def source_and_target(prompt: str | None) -> tuple[str | None, str | None]:
    hit = _first_rule((prompt or "").lower(), _RULES[:2])
    if hit:
        return FORMAT_NAMES[hit[0][1]], FORMAT_NAMES[hit[0][2]]
    return None, target_format(prompt)


def _payload_like(text: str) -> bool:
    return (
        text.startswith(("{", "[", "<"))
        or ("\n" in text and text.count(",") >= 2)
        or text.count("=") >= 2
        or text.count(":") >= 3
    )


def has_payload(text: str | None) -> bool:
    """Whether a prompt seems to hold data: in a fence, after its first colon, or as XML."""
    text = text or ""
    fenced = (re.sub(r"^[a-zA-Z0-9_+\-]+\n", "", part.strip()) for part in text.split(MARK)[1::2])
    _, _, tail = text.partition(":")
    return any(map(_payload_like, fenced)) or _payload_like(tail.strip()) or "<?xml" in text.lower()


def classify(text: str | None) -> tuple[str, str | None, str | None, bool]:
    """Kind of task, source, target, and whether there is a payload."""
    payload, (source, target) = has_payload(text), source_and_target(text)
    kind = "clean_relaxed" if target is None else "clean_strict" if payload else "generation_like"
    return kind, source, target, payload


def _balanced(text: str, opening: str, closing: str) -> str:
    begin, depth = text.find(opening), 0
    for token in re.finditer(f"[{re.escape(opening + closing)}]", text[begin:] if begin >= 0 else ""):
        depth += 1 if token[0] == opening else -1
        if depth == 0:
            return text[begin : begin + token.end()]
    return ""


def inline_payload(prompt: str | None) -> str:
    """The data inside a prompt: first fence, what follows a line ending in a colon, the
    larger of the first balanced object and array, or else the second half of the lines."""
    prompt = prompt or ""
    block = _BLOCK.search(prompt)
    if block and block[1].strip():
        return block[1].strip()
    lines = prompt.splitlines()
    for k, line in enumerate(lines[:10]):
        tail = "\n".join(lines[k + 1 :]).strip() if line.strip().endswith(":") else ""
        if tail:
            return tail
    found = [_balanced(prompt.strip(), *pair) for pair in ("[]", "{}")]
    largest = max(found, key=len) if len(found[0]) != len(found[1]) else found[1]
    return largest.strip() or "\n".join(lines[len(lines) // 2 :]).strip()


# Section names that end a list of attributes.
_ATTRIBUTES = re.compile(r"\bATTRIBUTES\s*:\s*(.*)", re.IGNORECASE)
_SECTION = re.compile(r"^(TEXT|JSON|XML|YAML|TOML|CSV)\s*:\s*", re.IGNORECASE)


def attributes(prompt: str | None) -> list[str]:
    """Key paths of the first ATTRIBUTES block, each once, in order."""
    lines = (prompt or "").splitlines()
    for k, line in enumerate(lines):
        found = _ATTRIBUTES.search(line)
        if not found:
            continue
        parts = [found[1].strip()]
        for below in map(str.strip, lines[k + 1 :]):
            if not below or _SECTION.match(below):
                break
            parts.append(below)
        return list(dict.fromkeys(filter(None, map(str.strip, " ".join(parts).split(",")))))
    return []


class Verdict(NamedTuple):
    result: str  # PASS, FAIL or UNKNOWN
    score: float | None
    reason: str


def _guessed_source(text: str) -> str | None:
    text = text.lstrip()
    guesses = {
        "json": text.startswith(("{", "[")),
        "xml": text.startswith("<"),
        "csv": "\n" in text and text.count(",") >= 2,
        "toml": text.count("=") >= 2,
        "yaml": text.count(":") >= 3,
    }
    return next((name for name, fits in guesses.items() if fits), None)


def _read(name: str | None, text: str) -> Parsed:
    readers = {
        "json": json.loads,
        "yaml": yaml.safe_load,
        "xml": lambda body: formats.READERS["XML"].read(body.strip()),
        "csv": formats.table_rows,
    }
    if name == "toml":
        return formats.strict(text, "TOML")
    if name not in readers:
        return Parsed(False, None, f"unknown format: {name}")
    return attempt(readers[name], text)


def equivalence(prompt: str | None, name: str, output: str) -> Verdict:
    """Whether an output says what the prompt's payload says."""
    data = inline_payload(prompt)
    source = source_and_target(prompt)[0] or _guessed_source(data)
    given, made = _read(source, data), _read(name, output)
    if not made.ok:
        return Verdict("FAIL", 0.0, f"output_parse_failed: {made.error}")
    if not given.ok:
        return Verdict("UNKNOWN", None, f"input_parse_failed_or_unknown: {given.error}")
    left, right = canonical(given.value), canonical(made.value)
    if left == right:
        return Verdict("PASS", 1.0, "")
    if "xml" in (source, name):
        f1 = leaf_f1(left, right)
        return Verdict("UNKNOWN", f1, f"containment_f1:{f1:.4f}")
    return Verdict("FAIL", 0.0, "semantic_mismatch")


def import_name(name: Any) -> str:
    """Upper-case, YML as YAML, without a leading ``C_``."""
    name = ("" if name is None else str(name)).strip().upper()
    return "YAML" if name == "YML" else name.removeprefix("C_")


def keep(prompt: str | None, output_type: str | None, output: str, least_f1: float = 0.97) -> tuple[bool, str]:
    """Whether an example stays, and why: syntax first, then the asked format, then, for
    conversions whose source is named, what the output says."""
    name = import_name(output_type)
    if not formats.strict(output, name).ok:
        return False, "lint_fail"
    kind, source, target, _ = classify(prompt)
    if target is not None and target.upper() != name:
        return False, "format_mismatch"
    if kind != "clean_strict" or source is None:
        return True, "keep"
    found = equivalence(prompt, name.lower(), output)
    if found.result == "FAIL":
        return False, f"equiv_fail:{found.reason}"
    if found.result == "UNKNOWN" and name == "XML" and found.score is not None and found.score >= least_f1:
        return True, f"keep_xml_soft:{found.reason}"
    return True, "keep"
