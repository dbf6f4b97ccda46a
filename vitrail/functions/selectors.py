"""Selectors compiled into steps, and elements matched against them.

A compiled selector is read from the right: its right-most compound says by which key (id, class, tag or
``*``) elements can come at all; the rest runs over the elements around a candidate as a set of places,
each combinator moving the set and each compound thinning it, so a match is found in one pass whatever
the selector repeats.

Understood: types, ``*``, ids, classes, attributes with all operators and the i flag, the four
combinators, ``:not :is :where`` over lists of compounds, the structural and form pseudo-classes below.
States (hover, focus ...) and pseudo-elements are valid and match nothing.  Everything else is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .arrays import let

_IDENT = r"(?:--|-?(?:[A-Za-z_]|[^\x00-\x7F]|\\.))(?:[\w-]|[^\x00-\x7F]|\\.)*"
_STRING = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_ATTRIBUTE = rf"\[\s*({_IDENT})\s*(?:([~|^$*]?=)\s*({_STRING}|{_IDENT}|[\w.-]+)\s*([iIsS])?\s*)?\]"
_ARGUMENT = rf"\((?:[^()\"']|{_STRING}|\((?:[^()\"']|{_STRING})*\))*\)"
_PART = rf"#(?:[\w-]|[^\x00-\x7F]|\\.)+|\.{_IDENT}|{_ATTRIBUTE}|::?{_IDENT}(?:{_ARGUMENT})?"
_PLAIN = rf"(?:#(?:[\w-]|[^\x00-\x7F]|\\.)+|\.{_IDENT}|{_ATTRIBUTE.replace('(' + _IDENT + ')', _IDENT)})"
_COMPOUND = rf"(?:\*|{_IDENT})?(?:{_PART})*"
_COMMA = rf"(?:[^,(\[\"']|{_STRING}|\[(?:[^\]\"']|{_STRING})*\]|{_ARGUMENT})+"
_TOKEN = rf"\s*[>+~]\s*|\s+|(?:[^\s>+~\[\"'(\\]|\\.|{_STRING}|\[(?:[^\]\"']|{_STRING})*\]|{_ARGUMENT})+"

#: FIXED VALUES: pseudo-classes that hang on the user or the document's history, and pseudo-elements in old notation.
STATES = ("hover", "focus", "focus-visible", "focus-within", "active", "visited", "target")
OLD_ELEMENTS = ("before", "after", "first-line", "first-letter")
PLACES = ("first-child", "last-child", "only-child", "root", "empty")
FORMS = ("checked", "disabled", "enabled", "required", "optional", "link", "any-link")
COUNTS, LISTS = ("nth-child", "nth-last-child"), ("not", "is", "where")
CONTROLS = ("button", "input", "select", "textarea", "option", "optgroup", "fieldset")
_KNOWN = "|".join((*STATES, *OLD_ELEMENTS, *PLACES, *FORMS))


def split(text: Column) -> Column:
    """The selectors of a list; commas in parentheses, brackets and strings don't count."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_COMMA), 0), X.trim), lambda x: x != "")


def _plain(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(.)", "$1")


def _parts(c: Column) -> Column:
    """What follows the type of a compound."""
    return F.regexp_extract_all(F.regexp_replace(c, rf"^(?:\*|{_IDENT})", ""), F.lit(_PART), 0)


def _simple(c: Column) -> Column:
    """Type, ids, classes and attributes of a compound without its pseudo parts."""
    return let(_parts(c), lambda parts: _simple_of(c, parts))


def _simple_of(c: Column, parts: Column) -> Column:
    own = lambda sign: F.transform(F.filter(parts, lambda p: p.startswith(sign)), lambda p: _plain(F.substring(p, F.lit(2), F.length(p))))
    value = lambda p: F.regexp_extract(p, _ATTRIBUTE, 3)
    attrs = F.transform(
        F.filter(parts, lambda p: p.startswith("[")),
        lambda p: F.struct(
            F.regexp_extract(p, _ATTRIBUTE, 1).alias("name"), F.regexp_extract(p, _ATTRIBUTE, 2).alias("op"), _plain(X.unquote(value(p))).alias("value"), F.lower(F.regexp_extract(p, _ATTRIBUTE, 4)).alias("flag"),
        ),
    )
    return F.struct(F.lower(_plain(F.regexp_extract(c, rf"^(?:\*|({_IDENT}))?", 1))).alias("tag"), own("#").alias("ids"), own(".").alias("classes"), attrs.alias("attrs"))


def _pseudos(parts: Column) -> Column:
    def one(p: Column) -> Column:
        named = lambda arg: let(F.lower(F.regexp_extract(p, rf"^::?({_IDENT})", 1)), lambda name: read(p, name, arg))
        return let(X.trim(F.regexp_extract(p, r"(?s)^[^(]*\((.*)\)$", 1)), named)

    def read(p: Column, name: Column, arg: Column) -> Column:
        nth = F.lower(F.regexp_replace(arg, r"\s+", ""))
        a = F.when(nth == "odd", 2).when(nth == "even", 2).when(F.contains(nth, F.lit("n")), F.regexp_replace(F.regexp_replace(F.substring_index(nth, "n", 1), r"^\+?$", "1"), r"^-$", "-1").try_cast("int")).otherwise(0)
        b = F.when(nth == "odd", 1).when(nth == "even", 0).when(F.contains(nth, F.lit("n")), F.regexp_replace(F.substring_index(nth, "n", -1), r"^$", "0").try_cast("int")).otherwise(nth.try_cast("int"))
        items = F.when(name.isin(*LISTS), split(arg)).otherwise(F.array().cast("array<string>"))
        valid = (
            p.startswith("::") | name.rlike(rf"^(?:{_KNOWN})$") & ~F.contains(p, F.lit("("))
            | name.isin(*COUNTS) & a.isNotNull() & b.isNotNull()
            | name.isin(*LISTS) & (F.size(items) > 0) & F.forall(items, lambda i: i.rlike(rf"^(?:\*|{_IDENT})?{_PLAIN}*$"))
        )
        return F.struct(
            F.when(p.startswith("::"), F.lit("::")).otherwise(name).alias("name"), F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(b, F.lit(0)).alias("b"), F.transform(items, _simple).alias("items"),
            F.coalesce(valid, F.lit(False)).alias("valid"),
        )

    return F.transform(F.filter(parts, lambda p: p.startswith(":")), one)


def _weight(c: Column) -> Column:
    """Specificity of a simple compound: ids, then classes and attributes, then the type."""
    return F.size(c["ids"]) * 1_000_000 + (F.size(c["classes"]) + F.size(c["attrs"])) * 1_000 + F.when(c["tag"] != "", 1).otherwise(0)


def _pseudo_weight(p: Column) -> Column:
    most = F.coalesce(F.array_max(F.transform(p["items"], _weight)), F.lit(0))
    return F.when((p["name"] == "::") | p["name"].isin(*OLD_ELEMENTS), 1).when(p["name"] == "where", 0).when(p["name"].isin(*LISTS), most).otherwise(1_000)


def compile(selector: Column) -> Column:
    """(steps, key, specificity, valid) of one selector; steps from the right, each with the combinator on
    its right side ('' for the first)."""
    tokens = F.regexp_extract_all(X.trim(selector), F.lit(_TOKEN), 0)

    def read(t: Column) -> Column:
        n = F.size(t)
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(2))
        shaped = (n > 0) & (n % 2 == 1) & F.forall(t, lambda x: F.lit(True)) & (F.array_join(t, "") == X.trim(selector))
        texts = F.transform(at, lambda i: F.coalesce(F.get(t, n - 1 - i), F.lit("")))
        formed = F.forall(texts, lambda c: (c != "") & c.rlike(rf"^{_COMPOUND}$"))
        combs = F.forall(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda i: F.get(t, i + 1).rlike(r"^\s*[>+~]\s*$|^\s+$"))
        step = lambda c, i: let(_parts(c), lambda parts: of_parts(c, i, parts))
        of_parts = lambda c, i, parts: F.struct(
            F.when(i == 0, F.lit("")).otherwise(F.coalesce(F.nullif(F.trim(F.regexp_replace(F.get(t, n - i * 2), r"\s+", " ")), F.lit("")), F.lit(" "))).alias("comb"), _simple_of(c, parts).alias("own"), _pseudos(parts).alias("pseudos")
        )
        return let(F.transform(texts, step), lambda s: described(s, shaped & formed & combs))

    def described(s: Column, formed: Column) -> Column:
        first = F.get(s, F.lit(0))["own"]
        key = (
            F.when(F.size(first["ids"]) > 0, F.concat(F.lit("#"), F.get(first["ids"], F.lit(0)))).when(F.size(first["classes"]) > 0, F.concat(F.lit("."), F.get(first["classes"], F.lit(0))))
            .when(first["tag"] != "", first["tag"]).otherwise(F.lit("*"))
        )
        weight = F.aggregate(s, F.lit(0), lambda a, x: a + _weight(x["own"]) + F.aggregate(x["pseudos"], F.lit(0), lambda b, p: b + _pseudo_weight(p)))
        valid = formed & F.forall(s, lambda x: F.forall(x["pseudos"], lambda p: p["valid"]))
        return F.struct(s.alias("steps"), key.alias("key"), weight.alias("specificity"), F.coalesce(valid, F.lit(False)).alias("valid"))

    return let(tokens, read)


def keys(e: Column) -> Column:
    """The keys under which selectors can reach an element."""
    named = F.concat(F.transform(e["classes"], lambda c: F.concat(F.lit("."), c)), F.array(e["tag"], F.lit("*")))
    return F.array_distinct(F.when(e["id"] != "", F.concat(F.array(F.concat(F.lit("#"), e["id"])), named)).otherwise(named))


def _fits(e: Column, c: Column) -> Column:
    """Whether an element has a simple compound's type, ids, classes and attributes."""

    def has(a: Column) -> Column:
        found = F.coalesce(F.try_element_at(e["attrs"], a["name"]), F.try_element_at(e["attrs"], F.lower(a["name"])))
        fold = lambda x: F.when(a["flag"] == "i", F.lower(x)).otherwise(x)
        v, w, op = fold(found), fold(a["value"]), a["op"]
        some = w != ""
        test = (
            F.when(op == "", True).when(op == "=", v == w).when(op == "~=", F.array_contains(X.class_tokens(v), w)).when(op == "|=", (v == w) | v.startswith(F.concat(w, F.lit("-"))))
            .when(op == "^=", some & v.startswith(w)).when(op == "$=", some & v.endswith(w)).otherwise(some & F.contains(v, w))
        )
        return found.isNotNull() & F.coalesce(test, F.lit(False))

    tag = (c["tag"] == "") | (c["tag"] == e["tag"])
    return tag & F.forall(c["ids"], lambda i: i == e["id"]) & (F.size(F.array_except(c["classes"], e["classes"])) == 0) & F.forall(c["attrs"], has)


def _holds(e: Column, p: Column) -> Column:
    name, has = p["name"], lambda k: F.map_contains_key(e["attrs"], F.lit(k))
    counted = lambda place: let(place - p["b"], lambda d: F.when(p["a"] == 0, d == 0).otherwise((d % F.nullif(p["a"], F.lit(0)) == 0) & (d * F.signum(p["a"]) >= 0)))
    link = e["tag"].isin("a", "area") & has("href")
    some = F.exists(p["items"], lambda c: _fits(e, c))
    return F.coalesce(
        F.when(name == "first-child", e["place"] == 1).when(name == "last-child", e["place"] == e["of"]).when(name == "only-child", e["of"] == 1).when(name == "root", e["up"].isNull())
        .when(name == "empty", e["empty"]).when(name == "nth-child", counted(e["place"])).when(name == "nth-last-child", counted(e["of"] - e["place"] + 1))
        .when(name == "not", ~some).when(name.isin("is", "where"), some).when(name.isin("link", "any-link"), link).when(name == "checked", has("checked") | has("selected"))
        .when(name == "disabled", e["tag"].isin(*CONTROLS) & has("disabled")).when(name == "enabled", e["tag"].isin(*CONTROLS) & ~has("disabled"))
        .when(name == "required", has("required")).when(name == "optional", e["tag"].isin("input", "select", "textarea") & ~has("required")).otherwise(False),
        F.lit(False),
    )


def matches(els: Column, children: Column, i: Column, steps: Column) -> Column:
    """Whether the element at ``i`` of ``els`` matches compiled steps.

    ``els`` are structs (up, tag, id, classes, attrs, place, of, before, empty, path) by node number, null
    for texts; ``children`` maps a node number (-1 for the top) to its elements.
    """
    at = lambda j: F.get(els, j)
    thin = lambda places, s: F.filter(places, lambda j: _fits(at(j), s["own"]) & F.forall(s["pseudos"], lambda p: _holds(at(j), p)))

    def moved(places: Column, comb: Column) -> Column:
        up = lambda j: F.filter(F.array(at(j)["up"]), lambda x: x.isNotNull())
        before = lambda j: F.filter(F.array(at(j)["before"]), lambda x: x.isNotNull())
        earlier = lambda j: F.filter(F.try_element_at(children, F.coalesce(at(j)["up"], F.lit(-1))), lambda x: x < j)
        to = F.when(comb == " ", F.transform(places, lambda j: at(j)["path"])).when(comb == ">", F.transform(places, up)).when(comb == "+", F.transform(places, before)).otherwise(F.transform(places, earlier))
        return F.array_distinct(F.flatten(to))

    own = thin(F.array(i), F.get(steps, F.lit(0)))
    return F.size(F.aggregate(F.slice(steps, 2, F.size(steps)), own, lambda places, s: F.when(F.size(places) == 0, places).otherwise(thin(moved(places, s["comb"]), s)))) > 0
