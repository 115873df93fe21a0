"""Repair of XML that isn't well-formed: a stream of tokens with a stack of open elements, and a note of all that was mended.

Only broken files come here. What follows the fault is kept: an end that fits an outer element closes those in between, one
that fits none is dropped, open elements are closed at the end, stray marks are escaped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_À-�][\w.\-:·]*"
_TOKEN = re.compile(
    rf"<!--(?P<comment>.*?)(?P<c>-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?P<d>\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<name>{_NAME})(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+)(?P<close>>|(?=<)|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(rf"({_NAME})(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'/]+)))?")
_LOOSE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)")
#: Characters that XML can't hold.
_BAD = re.compile("[^\t\n\r\\x20-퟿-�\U00010000-\U0010FFFF]")


def repair(text: str) -> tuple[str | None, list[str]]:
    """(well-formed XML, what was mended); None in place of the XML where there is no element at all. Each kind of fault is
    told once with its number, in the order of the first. Takes time that grows with the text."""
    notes: Counter[str] = Counter()
    out: list[str] = []
    stack: list[str] = []
    open_: Counter[str] = Counter()
    root = False

    def note(what: str, n: int = 1) -> None:
        if n:
            notes[what] += n

    def escaped(said: str) -> str:
        said, n = _LOOSE.subn("&amp;", said)
        note("escaped &", n)
        return said

    def close(to: int, why: str) -> None:
        while len(stack) > to:
            name = stack.pop()
            open_[name] -= 1
            out.append(f"</{name}>")
            if len(stack) > to or why == "closed at the end":
                note(why)

    text, n = _BAD.subn("", text.removeprefix("﻿"))
    note("removed characters", n)
    for m in _TOKEN.finditer(text):
        if m["name"]:
            name, attrs = m["name"], m["attrs"]
            if m["end"]:
                if not open_[name]:
                    note("dropped ends")
                    continue
                close(len(stack) - 1 - stack[::-1].index(name), "closed elements")
                continue
            if not stack and root:
                note("dropped after the root")
                continue
            if not m["close"]:
                note("closed tags")
            alone = attrs.rstrip().endswith("/")
            seen: dict[str, str] = {}
            for a in _ATTR.finditer(attrs.rstrip().removesuffix("/")):
                value = next((v for v in a.groups()[1:] if v is not None), None)
                if value is None or a[4] is not None:
                    note("quoted attributes")
                if a[1] in seen:
                    note("dropped attributes")
                else:
                    seen[a[1]] = escaped(value or "").replace('"', "&quot;").replace("<", "&lt;")
            out.append(f"<{name}{''.join(f' {k}="{v}"' for k, v in seen.items())}{'/' if alone else ''}>")
            root = True
            if not alone:
                stack.append(name)
                open_[name] += 1
        elif m["cdata"] is not None:
            if not m["d"]:
                note("closed sections")
            if stack:
                out.append(m["cdata"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif m["comment"] is not None:
            if not m["c"]:
                note("dropped comments")
        elif m["text"] is not None:
            if not stack:
                note("dropped outside the root", bool(m["text"].strip()))
            elif m["text"] == "<":
                note("escaped <")
                out.append("&lt;")
            else:
                out.append(escaped(m["text"]).replace("]]>", "]]&gt;"))
    close(0, "closed at the end")
    return ("".join(out) if root else None), [f"{k}: {v}" for k, v in notes.items()]


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("xml")
        made = [repair(x) if x is not None else (None, ["empty"]) for x in batch.column(i).to_pylist()]
        columns = [c if k != i else pa.array([x for x, _ in made], pa.string()) for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r for _, r in made], pa.list_(pa.string()))], names=[*batch.schema.names, "repairs"])


def repaired(objects: DataFrame) -> DataFrame:
    """`objects` (xml, well_formed, ...) with the broken ones mended, and `repairs` array<string>: what was mended, null for
    files that were well-formed. `well_formed` then says whether there is anything to read."""
    good = objects.where("well_formed").withColumn("repairs", F.lit(None).cast("array<string>"))
    bad = objects.where("not well_formed or well_formed is null")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields)
    mended = bad.mapInArrow(_repairs, f"{spec}, repairs array<string>").withColumn("well_formed", F.col("xml").isNotNull())
    return good.unionByName(mended)
