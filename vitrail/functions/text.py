"""String functions over captured text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of page text: ASCII white space, no-break space and byte-order mark.
SPACES = r"[\s\u00a0\ufeff]+"
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
#: White space that is not one plain space already: what collapsing has to change.
UNEVEN = r"[\s\u00a0\ufeff]{2,}|[\t\n\x0b\f\r\u00a0\ufeff]"
SQL_SPACES = r"[\s\x{00A0}\x{FEFF}]+"


def collapse(x: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(x, UNEVEN, " ")


def trim(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def compact(x: Column) -> Column:
    """Collapsed, without white space at either end."""
    return F.trim(collapse(x))


def preview(x: Column, n: int) -> Column:
    return F.substring(compact(x), 1, n)


def present(x: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(trim(x), F.lit(""))


def class_tokens(x: Column) -> Column:
    """The classes of a class attribute."""
    return F.filter(F.split(collapse(F.coalesce(x, F.lit(""))), " "), lambda t: t != "")


def unquote(x: Column) -> Column:
    """One quote off the start and one off the end."""
    return F.regexp_replace(x, "^['\"]|['\"]$", "")


def escape_text(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_attribute(x: Column, single: bool = False) -> Column:
    x = F.replace(escape_text(x), F.lit('"'), F.lit("&quot;"))
    return F.replace(x, F.lit("'"), F.lit("&#39;")) if single else x


def decode_entities(x: Column) -> Column:
    """The five entities that serialised subtrees contain; ``&amp;`` last."""
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def path_segment(x: Column) -> Column:
    """A name for a file or folder: lower case, other characters as single dashes."""
    s = F.regexp_replace(F.lower(trim(F.coalesce(x, F.lit("")))), "[^a-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("artifact"))


def file_tag(x: Column, n: int = 60) -> Column:
    return F.regexp_replace(F.substring(x, 1, n), "[^a-zA-Z0-9_-]", "_")


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the size of the larger set; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    size = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def tokens(x: Column) -> Column:
    """Lower-cased tokens of a text."""
    return F.filter(F.split(F.lower(compact(x)), " "), lambda t: t != "")


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x)


def selector_list(x: Column) -> Column:
    """Selectors of a list, compact and distinct (commas inside ``:is()`` split too)."""
    return F.array_distinct(F.filter(F.transform(F.split(x, ","), compact), lambda s: s != ""))


def first_compound(x: Column) -> Column:
    """The first compound of a selector, pseudo classes taken off."""
    return F.regexp_replace(F.split(trim(x), r"[\s>+~]+")[0], ":{1,2}[a-zA-Z-]+(?:\\([^)]*\\))?", "")


def selector_parts(x: Column) -> Column:
    """Tag, id and classes of the first compound of a selector."""
    c = first_compound(x)
    return F.struct(
        F.lower(F.regexp_extract(c, "^([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"),
        F.regexp_extract(c, "#([a-zA-Z0-9_-]+)", 1).alias("id"),
        F.regexp_extract_all(c, F.lit("\\.([a-zA-Z0-9_-]+)"), 1).alias("classes"),
    )


def without_states(x: Column) -> Column:
    """A selector without the pseudo classes of interaction states."""
    return trim(F.regexp_replace(x, ":(?:hover|focus-within|focus-visible|focus|active)", ""))


def css_escape(x: Column) -> Column:
    return F.regexp_replace(x, "([^a-zA-Z0-9_-])", "\\\\$1")


def data_url(x: Column, mime: str) -> Column:
    """Text as a base64 data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(F.encode(x, "UTF-8")))


def data_url_bytes(x: Column) -> Column:
    """Bytes of a data URL, base64 or percent-encoded (a plus sign stays one)."""
    head = F.substring_index(x, ",", 1)
    body = F.substring(x, F.lit(1) + F.length(head) + 1, F.length(x))
    plain = F.encode(F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), "UTF-8")
    return F.when(~x.startswith("data:"), F.raise_error(F.lit("not a data URL")).cast("binary")).when(head.endswith(";base64"), F.unbase64(body)).otherwise(plain)
