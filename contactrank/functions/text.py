"""Text functions with the semantics of the browser that wrote the exports (X1-X4), as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's trim and \\s have it.
_JS_WS_POINTS = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
#: For Python's str.strip, and as the body of a character class.
JS_WS_CHARS = JS_WS = "".join(map(chr, _JS_WS_POINTS))


def js_trim(c: Column) -> Column:
    """Strips JS_WS from both ends."""
    return F.regexp_replace(c, f"^[{JS_WS}]+|[{JS_WS}]+\\z", "")


def normalize_key(c: Column) -> Column:
    """Lower case, only a-z and 0-9 kept."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def tokenize_query(c: Column) -> Column:
    """Lower-cased tokens between white space, commas and semicolons; order and duplicates are kept."""
    return F.filter(F.split(F.lower(c), f"[{JS_WS},;]+"), lambda t: t != "")


def tokens_of(query: str) -> list[str]:
    """X3 for one query on the driver."""
    out = query.lower()
    for ch in JS_WS_CHARS + ",;":
        out = out.replace(ch, " ")
    return [t for t in out.split(" ") if t]


def array_to_text(c: Column) -> Column:
    """X1 for array<string>: elements joined by one space, null as nothing."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), " ")


def object_to_text(c: Column) -> Column:
    """X1 for a struct or map: compact JSON."""
    return F.to_json(c, {"ignoreNullFields": "false"})
