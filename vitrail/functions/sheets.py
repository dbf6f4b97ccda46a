"""Style sheets as rules and declarations, by one scan over their tokens.

Comments are skipped; braces and semicolons in strings and parentheses (``url(data:a;b)``) are text; a
sheet that ends inside a rule closes it, a null one has no lines.  At-rules are the context of the rules inside them.  Rules
nested in style rules are read with the outer selector as part of their context.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .arrays import let, scan

TOKEN = r"""(?s)/\*.*?(?:\*/|\z)|"(?:[^"\\]|\\.)*(?:"|\z)|'(?:[^'\\]|\\.)*(?:'|\z)|[{};()]|[^{};()"'/]+|/"""
_LINE = "struct<rule:int,context:array<string>,text:string>"
_NAME = r"^(?:--[^\s:]+|-?[A-Za-z][A-Za-z0-9-]*)$"


def lines(css: Column) -> Column:
    """Structs (rule, context, text) of what stands between braces and semicolons, in order.

    ``context`` are the preludes around it, outermost first; ``rule`` numbers the innermost by its
    opening brace and is null at top level, where statements such as ``@import`` stand.
    """
    near = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<rule:int,prelude:string>>").alias("open"), F.lit(0).alias("n"), F.lit(0).alias("parens"))
    state = lambda s, **new: F.struct(*[new.get(c, s[c]).alias(c) for c in ("text", "open", "n", "parens")])

    def line(s: Column) -> Column:
        text = X.trim(s["text"])
        return F.when(text != "", F.struct(F.try_element_at(s["open"], F.lit(-1))["rule"].alias("rule"), F.transform(s["open"], lambda x: x["prelude"]).alias("context"), text.alias("text")))

    def step(_: Column, s: Column, t: Column) -> Column:
        nothing = F.lit(None).cast(_LINE)
        out = lambda state, line=nothing: F.struct(state.alias("s"), line.alias("o"))
        depth = F.when(t == "(", s["parens"] + 1).when(t == ")", F.greatest(s["parens"] - 1, F.lit(0))).otherwise(s["parens"])
        opened = F.concat(s["open"], F.array(F.struct(s["n"].alias("rule"), X.trim(s["text"]).alias("prelude"))))
        outer = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return (
            F.when(t.startswith("/*"), out(s))
            .when(t.isin("}", ";") & (s["parens"] == 0), out(state(s, text=F.lit(""), open=F.when(t == "}", outer).otherwise(s["open"])), line(s)))
            .when((t == "{") & (s["parens"] == 0), out(state(s, text=F.lit(""), open=opened, n=s["n"] + 1)))
            .otherwise(out(state(s, text=F.concat(s["text"], t), parens=depth)))
        )

    def finish(_: Column, s: Column, found: Column) -> Column:
        return F.array_compact(F.concat(found, F.array(line(s))))

    return scan(F.regexp_extract_all(css, F.lit(TOKEN), 0), near, step, _LINE, finish=finish)


def declaration(text: Column) -> Column:
    """(name, value, important) of a declaration; null if it is none.  Names are lower case but for ``--x``."""

    def read(name: Column, rest: Column) -> Column:
        important = F.contains(rest, F.lit("!")) & rest.rlike(r"(?i)!\s*important$")
        value = F.when(important, X.trim(F.regexp_replace(rest, r"(?i)!\s*important$", ""))).otherwise(rest)
        own = F.struct(F.when(name.startswith("--"), name).otherwise(F.lower(name)).alias("name"), value.alias("value"), important.alias("important"))
        return let(own, lambda d: F.when(name.rlike(_NAME) & (d["value"] != ""), d))

    rest = X.trim(F.substring(text, F.locate(":", text) + 1, F.length(text)))
    return F.when(F.contains(text, F.lit(":")), let(X.trim(F.substring_index(text, ":", 1)), lambda name: let(rest, lambda r: read(name, r))))


def rules(css: Column) -> Column:
    """Structs (rule, selector, context, declarations) of the style rules of a sheet, in order.

    ``context`` are the at-rules around it; rules in keyframes and font faces are no style rules.  Rules
    without a valid declaration are left out.
    """

    def read(found: Column) -> Column:
        own = F.transform(found, lambda x: F.struct(x["rule"].alias("rule"), x["context"].alias("context"), declaration(x["text"]).alias("d")))
        plain = lambda x: F.element_at(x["context"], -1).startswith("@") | F.exists(x["context"], lambda c: c.rlike(r"(?i)^@(?:-[a-z]+-)?keyframes\b"))
        kept = F.filter(own, lambda x: x["rule"].isNotNull() & x["d"].isNotNull() & ~plain(x))
        return let(kept, by_rule)

    def by_rule(kept: Column) -> Column:
        first = F.filter(F.transform(kept, lambda x, i: F.when((i == 0) | (F.get(kept, i - 1)["rule"] != x["rule"]), i)), lambda i: i.isNotNull())
        last = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(kept))

        def one(f: Column, b: Column, j: Column) -> Column:
            x = F.get(kept, b)
            depth = F.size(x["context"])
            return F.struct(
                x["rule"].alias("rule"), F.element_at(x["context"], -1).alias("selector"), F.slice(x["context"], F.lit(1), depth - 1).alias("context"),
                F.transform(F.slice(kept, b + 1, last(f, j) - b), lambda y: y["d"]).alias("declarations"),
            )

        return let(first, lambda f: F.transform(f, lambda b, j: one(f, b, j)))

    return let(lines(css), read)


def statements(css: Column) -> Column:
    """Top-level statements of a sheet, such as ``@import``."""
    return F.transform(F.filter(lines(css), lambda x: x["rule"].isNull()), lambda x: x["text"])


def declarations(css: Column) -> Column:
    """Declarations of a ``style`` attribute."""
    return F.array_compact(F.transform(F.filter(lines(css), lambda x: x["rule"].isNull()), lambda x: declaration(x["text"])))
