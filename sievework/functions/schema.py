"""A subset of JSON Schema (Draft 2020-12), used where ``jsonschema`` is not installed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or (isinstance(x, float) and x.is_integer())),
}


def errors(value: Any, schema: Any) -> Iterator[str]:
    """Messages for: type, enum, const, required, properties, additionalProperties, items,
    the bounds of sizes and numbers, pattern, anyOf, allOf, oneOf, not."""
    if isinstance(schema, bool):
        if not schema:
            yield f"{value!r} is not allowed"
        return
    wanted = schema.get("type")
    names = [wanted] if isinstance(wanted, str) else wanted or []
    if names and not any(_TYPES[name](value) for name in names):
        yield f"{value!r} is not of type {', '.join(map(repr, names))}"
    if "enum" in schema and value not in schema["enum"]:
        yield f"{value!r} is not one of {schema['enum']!r}"
    if "const" in schema and value != schema["const"]:
        yield f"{schema['const']!r} was expected"
    if isinstance(value, dict):
        yield from _object_errors(value, schema)
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield f"{value!r} is too short"
        if len(value) > schema.get("maxItems", len(value)):
            yield f"{value!r} is too long"
        for item in value if "items" in schema else ():
            yield from errors(item, schema["items"])
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield f"{value!r} is too short"
        if len(value) > schema.get("maxLength", len(value)):
            yield f"{value!r} is too long"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{value!r} does not match {schema['pattern']!r}"
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            yield f"{value!r} is less than the minimum of {schema['minimum']!r}"
        if value > schema.get("maximum", value):
            yield f"{value!r} is greater than the maximum of {schema['maximum']!r}"
    for part in schema.get("allOf", ()):
        yield from errors(value, part)
    for word, good in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if word in schema and not good(sum(not list(errors(value, part)) for part in schema[word])):
            yield f"{value!r} is not valid under {word}"
    if "not" in schema and not list(errors(value, schema["not"])):
        yield f"{value!r} should not be valid under {schema['not']!r}"


def _object_errors(value: dict[str, Any], schema: dict[str, Any]) -> Iterator[str]:
    known = schema.get("properties", {})
    for name in schema.get("required", ()):
        if name not in value:
            yield f"{name!r} is a required property"
    for name, item in value.items():
        if name in known:
            yield from errors(item, known[name])
        elif schema.get("additionalProperties", True) is False:
            yield f"additional property {name!r} is not allowed"
        elif isinstance(schema.get("additionalProperties"), dict):
            yield from errors(item, schema["additionalProperties"])
