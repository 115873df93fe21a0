"""Checks of a rule against a schema file of its collection: the keywords of JSON Schema that such schemas use."""

from __future__ import annotations

import re
from collections.abc import Iterator

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def _is(value: object, kind: str) -> bool:
    return isinstance(value, KINDS[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))


def schema_problems(value: object, schema: dict, at: str = "") -> Iterator[str]:
    """What is wrong with a value, each with its place, such as `detect.regex: pattern is missing`."""
    here = f"{at}: " if at else ""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        yield f"{here}is no {' or '.join(kinds)}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{here}{value!r} isn't allowed"
    if "oneOf" in schema:
        fits = sum(not any(schema_problems(value, s)) for s in schema["oneOf"])
        if fits != 1:
            yield f"{here}fits {fits} of {len(schema['oneOf'])} forms, not one"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield f"{here}has {len(value)} characters"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{here}{value!r} doesn't match {schema['pattern']}"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield f"{here}has {len(value)} items"
        for i, item in enumerate(value):
            yield from schema_problems(item, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                yield f"{here}{k} is missing"
        if schema.get("additionalProperties") is False:
            yield from (f"{here}{k} isn't known" for k in value if k not in known)
        for k, v in value.items():
            if k in known:
                yield from schema_problems(v, known[k], f"{at}.{k}" if at else k)
    elif isinstance(value, (int, float)) and value < schema.get("minimum", value):
        yield f"{here}{value} is below {schema['minimum']}"
