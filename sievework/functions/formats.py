"""Format names, fences, and the strict and lenient readers of the five formats.

Kernels here are plain functions of strings: what they do is defined by Python's own
parsers, which Spark's and other engines' parsers do not agree with in detail. ``udfs``
wraps them for Arrow batches.
"""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

import yaml

FORMATS = ("JSON", "YAML", "TOML", "XML", "CSV")
MARK = "```"

# Patterns that decide results.
FENCE_ENDS = r"^\s*```[a-zA-Z0-9_\-]*\s*|\s*```\s*$"  # multi-line
BLOCK_ANY = r"```[a-zA-Z0-9_\-]*\s*\n(.*?)\n```"  # dot matches all
BLOCK_TIGHT = r"```(?:[a-zA-Z0-9_+\-]+)?\n(.*?)\n```"  # dot matches all
BLOCK_NAMED = r"```(?P<lang>[a-zA-Z0-9_\-+]*)\s*\n(?P<body>.*?)(?:\n```)"  # dot matches all
FENCE_LINES = r"^\s*```[a-zA-Z0-9_\-]*\s*$|^\s*```\s*$"  # multi-line

_ENDS = re.compile(FENCE_ENDS, re.M)
_ANY = re.compile(BLOCK_ANY, re.S)
_TIGHT = re.compile(BLOCK_TIGHT, re.S)
_NAMED = re.compile(BLOCK_NAMED, re.S)
_LINES = re.compile(FENCE_LINES, re.M)

#: Lines that a lenient reader looks at.
LENIENT_LINES = {"YAML": 400, "TOML": 400, "XML": 600, "CSV": 600}


class Parsed(NamedTuple):
    """Whether a text was read, the object, the error, and the part that was read."""

    ok: bool
    value: Any = None
    error: str | None = None
    used: str | None = None


def kind(name: str | None) -> str:
    """The upper-case format name; nothing stands for JSON."""
    return (name or "JSON").strip().upper()


def without_fences(text: str) -> str:
    return _ENDS.sub("", text).strip()


def first_block(text: str) -> tuple[str | None, str]:
    """The first fenced block and the text around it."""
    found = _ANY.search(text)
    return (found[1], text[: found.start()] + text[found.end() :]) if found else (None, text)


def only_a_block(text: str) -> bool:
    inside, around = first_block(text)
    return inside is not None and not around.strip()


def table_rows(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text)))


def _filled_rows(text: str) -> list[list[str]]:
    rows = table_rows(text)
    if not rows:
        raise ValueError("empty csv")
    return rows


def _is_tree(value: Any) -> bool:
    return isinstance(value, (dict, list))


def _is_wide(rows: Any) -> bool:
    return max(map(len, rows), default=0) >= 2


def _anything(value: Any) -> bool:
    return True


@dataclass(frozen=True)
class Format:
    """How a format is read, and which values count as structured."""

    read: Callable[[str], Any]
    structured: Callable[[Any], bool] = _anything


#: Texts on which the compiled YAML loader and the plain one were found to agree (150,000
#: made-up texts): no tabs, tags, comments, anchors, directives and unusual characters.
_PLAIN_YAML = re.compile(r"[\n\x20\x22\x24\x27-\x29\x2B-\x7E\xA0-\u2027\u2030-\uD7FF]*")


def _yaml(text: str) -> Any:
    """As ``yaml.safe_load``; the compiled loader reads plain texts if it can, and the plain
    one has the last word (and its own messages) on all others."""
    if _PLAIN_YAML.fullmatch(text) and hasattr(yaml, "CSafeLoader"):
        try:
            return yaml.load(text, yaml.CSafeLoader)
        except Exception:
            pass
    return yaml.safe_load(text)


READERS = {
    "JSON": Format(json.loads),
    "YAML": Format(_yaml, _is_tree),
    "TOML": Format(tomllib.loads),
    "XML": Format(ET.fromstring),
    "CSV": Format(_filled_rows, _is_wide),
}


def attempt(read: Callable[[str], Any], text: str) -> Parsed:
    try:
        return Parsed(True, read(text), None, text)
    except Exception as problem:  # parsers raise many types; all mean "cannot be read"
        return Parsed(False, None, str(problem))


def strict(text: str, name: str | None = "JSON") -> Parsed:
    """The whole text in the format; fences are an error. Unknown formats are JSON."""
    if MARK in text:
        return Parsed(False, None, "markdown_fence")
    return attempt(READERS.get(kind(name), READERS["JSON"]).read, text.strip())


def span_of_brackets(text: str) -> tuple[int, int] | None:
    """From the first ``{`` or ``[`` to where that bracket type is balanced, outside strings."""
    begin = min((at for at in map(text.find, "{[") if at >= 0), default=-1)
    if begin < 0:
        return None
    opening = text[begin]
    closing = {"{": "}", "[": "]"}[opening]
    depth = 0
    quoted = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]', re.S)
    for token in quoted.finditer(text, begin):
        depth += (token[0] == opening) - (token[0] == closing)
        if token[0] == closing and depth == 0:
            return begin, token.end()
    return None


def lenient(text: str, name: str | None = "JSON") -> Parsed:
    """The best readable part: the first balanced JSON value, or the longest run of first
    lines that is structured in the other formats."""
    name = kind(name)
    if name not in LENIENT_LINES:
        whole = without_fences(text)
        first = strict(whole)
        if first.ok:
            return first._replace(used=whole)
        span = span_of_brackets(whole)
        if span is None:
            return first
        part = whole[slice(*span)]
        return attempt(json.loads, part)._replace(used=part)
    block, _ = first_block(text)
    whole = without_fences(text if block is None else block)
    if name == "XML" and "<" in whole:
        whole = whole[whole.index("<") :]
    structured = READERS[name].structured
    first = strict(whole, name)
    if first.ok and structured(first.value):
        return first._replace(used=whole)
    lines = whole.splitlines()
    for n in range(min(len(lines), LENIENT_LINES[name]), 0, -1):
        part = "\n".join(lines[:n]).strip()
        found = strict(part, name) if part else Parsed(False)
        if found.ok and structured(found.value):
            return found._replace(used=part)
    return Parsed(False, None, first.error)


def nothing_else(text: str, name: str | None = "JSON") -> bool:
    """Whether the text is the format and nothing else."""
    name = kind(name)
    if first_block(text)[0] is not None:
        return False
    found = strict(text, name)
    return found.ok and READERS.get(name, READERS["JSON"]).structured(found.value)


# How a payload's first line looks.
STARTS = {
    "YAML": r"^\s*(---\s*$|\-|\?|\{|\[|[A-Za-z0-9_\-\.]+\s*:)",
    "TOML": r"^\s*(\[.*\]|[A-Za-z0-9_\-\.]+\s*=)",
    "CSV": r",",
}
_STARTS = {name: re.compile(pattern) for name, pattern in STARTS.items()}


def payload(text: str | None, name: str | None) -> tuple[str, bool]:
    """The structured part of a text, and whether other text stands before it (for JSON:
    around it; a fence counts as other text)."""
    text, name = text or "", kind(name)
    block, _ = first_block(text)
    if block is not None:
        return without_fences(block).strip(), True
    text = without_fences(text)
    if name == "JSON":
        found = lenient(text)
        return (found.used.strip(), text != found.used.strip()) if found.ok and found.used is not None else (text, False)
    begin = 0
    if name == "XML":
        begin = max(0, text.find("<"))
    elif name in _STARTS:
        for line in text.splitlines(keepends=True):
            if _STARTS[name].search(line):
                break
            begin += len(line)
        else:
            begin = 0
    return text[begin:].strip(), bool(text[:begin].strip())


def last_block(text: str | None) -> str:
    """The last tight fenced block, or the stripped text."""
    text = (text or "").strip()
    blocks = _TIGHT.findall(text)
    return blocks[-1].strip() if blocks else text


# Fixed value: the marker before a final answer.
OUTPUT_MARK = r"\bOutput\s*:\s*\n"  # any case
_OUTPUT = re.compile(OUTPUT_MARK, re.IGNORECASE)


def _nested_json(text: str) -> str:
    """The first balanced JSON text, both bracket types being matched."""
    begin = min((at for at in map(text.find, "{[") if at >= 0), default=-1)
    if begin < 0:
        return ""
    open_: list[str] = []
    for token in re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]', re.S).finditer(text, begin):
        sign = token[0]
        if sign in "{[":
            open_.append("}" if sign == "{" else "]")
        elif sign in "}]":
            if open_.pop() != sign:
                return ""
            if not open_:
                return text[begin : token.end()].strip()
    return ""


def _yaml_line(line: str) -> bool:
    return (":" in line and not line.startswith("#")) or line.startswith("- ")


def _toml_line(line: str) -> bool:
    return (line.startswith("[") and line.endswith("]")) or ("=" in line and not line.startswith("#"))


def _csv_line(line: str) -> bool:
    return "," in line or "\t" in line


_LINE_TESTS = {"YAML": _yaml_line, "TOML": _toml_line, "CSV": _csv_line}


def final_output(text: str | None, name: str | None) -> str:
    """The answer inside an assistant message: after the last ``Output:`` line, the last
    fenced block, then the format's own first blob or line. ``name`` is normalised."""
    text = (text or "").strip()
    marks = list(_OUTPUT.finditer(text))
    if marks:
        text = text[marks[-1].end() :].strip()
    text = last_block(text)
    if name == "JSON":
        return _nested_json(text) or text
    if name == "XML":
        begin, end = text.find("<"), text.rfind(">")
        return text[begin : end + 1].strip() if 0 <= begin < end else text
    if name in _LINE_TESTS:
        lines = [line.rstrip() for line in text.splitlines()]
        starts = (k for k, line in enumerate(lines) if line.strip() and _LINE_TESTS[name](line.strip()))
        return "\n".join(lines[next(starts, 0) :]).strip()
    return text


def yaml_is_flow(text: str | None) -> bool:
    return any(sign in (text or "") for sign in "{[}]")


def yaml_indent_is_canonical(text: str | None, step: int = 2) -> bool:
    """No tabs in indents, multiples of ``step``, and exactly one step below a line that
    opens a block or is a list item."""
    lines = [line for line in (text or "").splitlines()]
    if any("\t" in line[: len(line) - len(line.lstrip(" \t"))] for line in lines):
        return False
    real = [(len(line) - len(line.lstrip(" ")), line.strip()) for line in lines if line.strip() and not line.lstrip().startswith("#")]
    if not real or any(indent % step for indent, _ in real):
        return False
    for (indent, line), (below, _) in zip(real, real[1:]):
        if (line.startswith("-") or line.endswith(":")) and below > indent and below - indent != step:
            return False
    return True


# The named block of another reader, which prefers fences labelled with the format.
# Labels that stand for a format.
FENCE_LABELS = {
    "json": {"json"},
    "yaml": {"yaml", "yml"},
    "toml": {"toml"},
    "xml": {"xml", "html"},
    "csv": {"csv", "tsv"},
}


def labelled_payload(text: str | None, name: str) -> tuple[str, str]:
    """A generation's payload and where it was found."""
    text, name = (text or "").strip(), name.strip().lower()
    blocks = [(found["lang"].strip().lower(), found["body"].strip()) for found in _NAMED.finditer(text)]
    if blocks:
        fitting = [block for block in blocks if block[0] in FENCE_LABELS.get(name, ())]
        label, body = (fitting or blocks)[0]
        return body, f"fence:{label or 'unknown'}"
    if name == "xml":
        for sign, where in (("<?xml", "raw:from_xml_decl"), ("<", "raw:from_first_tag")):
            if sign in text:
                return text[text.index(sign) :].strip(), where
    return text, "raw"


# The messages below and the names of error kinds reach output columns.


def _even_rows(text: str) -> list[list[str]]:
    rows = list(csv.reader(text.splitlines()))
    if not rows:
        raise ValueError("CSVEmpty: no rows")
    if rows == [[]]:
        raise ValueError("CSVEmpty: single empty row")
    widths = [len(row) for row in rows]
    if len(set(widths)) > 1:
        raise ValueError(f"CSVInconsistentColumns: widths={widths[:10]}{'...' if len(widths) > 10 else ''}")
    return rows


def _error_kind(problem: Exception, name: str) -> str:
    made = type(problem).__name__
    if name == "YAML":
        return next((f"YAML{part}" for part in ("ScannerError", "ParserError", "ReaderError") if part in made), made)
    return "XMLParseError" if name == "XML" and isinstance(problem, ET.ParseError) else made


def check_syntax(text: str | None, name: str) -> tuple[bool, str | None, str | None, str, str]:
    """Ok, error kind, message, where the payload was found, and a preview of it."""
    body, where = labelled_payload(text, name)
    preview = body[:160].replace("\n", "\\n")
    if name not in READERS:
        return False, "UnsupportedType", f"Unsupported output_type={name}", where, preview
    read = _even_rows if name == "CSV" else READERS[name].read
    try:
        read(body)
    except Exception as problem:
        return False, _error_kind(problem, name), str(problem), where, preview
    return True, None, None, where, preview


# Fixed value: the line before an answer.
ANSWER_LINE = r"^\s*(?:output|answer|final)\s*:\s*$"  # any case, multi-line
_ANSWER = re.compile(ANSWER_LINE, re.I | re.M)


def answer_payload(text: str | None, name: str) -> str:
    """The payload by the rules of dataset analysis: last block, marker line, first sign."""
    text = (text or "").strip()
    blocks = _ANY.findall(text)
    if blocks:
        return blocks[-1].strip()
    mark = _ANSWER.search(text)
    if mark:
        return text[mark.end() :].strip()
    if name in ("JSON", "XML"):
        begin = min((at for at in map(text.find, "{[" if name == "JSON" else "<") if at >= 0), default=0)
        return text[begin:].strip()
    return _LINES.sub("", text).strip()


def _matching_rows(text: str) -> list[list[str]]:
    rows = table_rows(text)
    if not rows:
        raise ValueError("empty")
    if not rows[0]:
        raise ValueError("no header")
    for k, row in enumerate(rows[1:], start=2):
        if len(row) != len(rows[0]):
            raise ValueError(f"row {k} width mismatch: {len(row)} != {len(rows[0])}")
    return rows


def validate_answer(text: str | None, name: str, yaml_style: bool = True) -> tuple[bool, str]:
    """Whether an answer is usable, and ``ok`` or the reason against it."""
    if name not in READERS:
        return False, f"unknown_format: {name}"
    body = answer_payload(text, name)
    found = attempt(_matching_rows if name == "CSV" else READERS[name].read, body)
    if not found.ok:
        return False, f"parse_fail: {found.error}"
    if name == "YAML" and yaml_style and not yaml_indent_is_canonical(body):
        return False, "yaml_indent_fail"
    return True, "ok"
