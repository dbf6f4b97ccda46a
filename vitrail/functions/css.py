"""CSS text: blocks of keyframes, variables, declarations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYFRAME = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("css_text", T.StringType()), T.StructField("prefixed", T.BooleanType())])
)

_HEAD = re.compile(r"@(-(?:webkit|moz|o|ms)-)?keyframes\s+([A-Za-z_][\w-]*|\"[^\"]*\"|'[^']*')\s*\{")
#: Inside a block: a comment (to the end if it isn't closed), a string, or a brace.
_MARK = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|[{}]", re.S)


def keyframes_of(sheet: str | None) -> list[tuple[str, str, bool]]:
    """(name, text, prefixed) of the keyframe rules of a stylesheet, prefixes taken off.

    Braces in comments and strings do not count; a rule that is not closed is skipped.
    """
    out, at, sheet = [], 0, sheet or ""
    while head := _HEAD.search(sheet, at):
        name, depth, end = head[2].strip("\"'"), 1, None
        for mark in _MARK.finditer(sheet, head.end()):
            depth += {"{": 1, "}": -1}.get(mark[0], 0)
            if not depth:
                end = mark.start()
                break
        if name and end is not None:
            out.append((name, f"@keyframes {name} {{{sheet[head.end():end]}}}", bool(head[1])))
        at = head.end() if end is None else end + 1
    return out


@F.pandas_udf(KEYFRAME)
def parse_keyframes(sheets: pd.Series) -> pd.Series:
    """Keyframe rules of each stylesheet; nesting makes this a matter for Python, in Arrow batches."""
    return sheets.map(lambda s: [dict(zip(("name", "css_text", "prefixed"), r)) for r in keyframes_of(s)])


def variable_names(css: Column) -> Column:
    """Distinct custom property names in a stylesheet."""
    return F.array_distinct(F.regexp_extract_all(css, F.lit("--[a-zA-Z0-9_-]+"), 0))


def font_faces(css: Column) -> Column:
    """The ``@font-face`` rules of a stylesheet."""
    return F.regexp_extract_all(css, F.lit(r"(?i)@font-face\s*\{[^}]*\}"), 0)


def unprefixed(header: Column) -> Column:
    """A keyframe rule without its vendor prefix."""
    return F.regexp_replace(header, "^@-(?:webkit|moz|o|ms)-keyframes", "@keyframes")


def block(selectors: Column, declarations: Column) -> Column:
    """One rule from structs (name, value, important, disabled); disabled declarations are left out."""
    lines = F.transform(
        F.filter(declarations, lambda d: ~F.coalesce(d["disabled"], F.lit(False)) & (d["name"] != "")),
        lambda d: F.concat(F.lit("  "), d["name"], F.lit(": "), d["value"], F.when(d["important"], " !important").otherwise(""), F.lit(";")),
    )
    return F.when((F.size(selectors) > 0) & (F.size(lines) > 0), F.concat(F.array_join(selectors, ", "), F.lit(" {\n"), F.array_join(lines, "\n"), F.lit("\n}")))
