"""A target's subtree: walked within limits, written as allow-listed HTML, flattened through shadow roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import once
from ..sources import fixtures as S
from . import htmltree as H

#: FIXED VALUES: attributes that a written subtree keeps, and prefixes of more.
ATTRIBUTES = (
    "id", "class", "role", "style", "type", "name", "value", "placeholder", "href", "src", "alt", "title", "tabindex", "for", "viewbox", "viewBox",
    "d", "cx", "cy", "r", "x1", "y1", "x2", "y2", "points", "transform", "xmlns", "version", "preserveaspectratio", "preserveAspectRatio", "xlink:href",
)
PREFIXES = ("aria-", "data-")
#: Limits of the walk that collects styles.
WALK_NODES, WALK_DEPTH = 300, 8


def allowed(name: Column) -> Column:
    keep = name.isin(*ATTRIBUTES)
    for p in PREFIXES:
        keep = keep | name.startswith(p)
    return keep


def allowed_attributes(attrs: Column) -> Column:
    """Attributes that a written subtree keeps."""
    return F.map_filter(attrs, lambda k, _: allowed(k))


def _parsed(pages: DataFrame, tag: str) -> DataFrame:
    """Each capture's nodes, with the first element ``tag`` as root and the nodes from it down."""
    d = H.parsed(pages)
    d = d.withColumn("root", F.get(F.filter("nodes", lambda n: n["tag"] == tag), F.lit(0))).where("root is not null")
    below = F.slice("nodes", F.col("root.node_idx") + 1, F.col("root.end_idx") - F.col("root.node_idx") + 1)
    return d.select("capture_id", "nodes", "root", below.alias("below"))


def walk(pages: DataFrame, tag: str = "body", max_nodes: int = WALK_NODES, max_depth: int = WALK_DEPTH) -> DataFrame:
    """Elements below a root in document order, without it, up to the limits; and whether there were more."""
    d = _parsed(pages, tag)
    near = F.filter("below", lambda n: n["tag"].isNotNull() & (n["depth"] > F.col("root.depth")) & (n["depth"] - F.col("root.depth") <= max_depth))
    d = d.select("capture_id", near.alias("near"))
    each = F.posexplode(F.transform(F.slice("near", 1, max_nodes), lambda n: n["node_idx"])).alias("place", "node_idx")
    return d.select("capture_id", (F.size("near") > max_nodes).alias("truncated"), each)


def written(pages: DataFrame, tag: str = "body", max_nodes: int = H.MAX_NODES, max_depth: int = H.MAX_DEPTH) -> DataFrame:
    """The subtree of a root as HTML of allow-listed attributes, with its counts and what was cut.

    The root has depth 0.  Nodes deeper than the limit count for nothing, the first ``max_nodes`` others
    are written.  All inside the row: nodes never become rows.
    """
    d = _parsed(pages, tag)
    rel = lambda n: n["depth"] - F.col("root.depth")
    near = F.filter("below", lambda n: rel(n) <= max_depth)
    d = d.select("capture_id", "root", "below", near.alias("near"), F.slice(near, 1, max_nodes).alias("kept"))

    def attributes(raw: Column) -> Column:
        names, values = (F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(H.ATTRIBUTE), i) for i in (1, 2))
        pairs = F.zip_with(names, values, lambda n, v: F.when(allowed(n), F.concat(F.lit(" "), n, F.lit('="'), X.escape_attribute(X.decode_entities(v), single=True), F.lit('"'))))
        return F.array_join(F.array_compact(pairs), "")

    ends = lambda tags: F.array_join(F.transform(F.reverse(tags), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")

    def write(a: Column, n: Column) -> Column:
        depth = rel(n)
        left = F.slice(a["open"], F.lit(1), depth)
        closed = ends(F.slice(a["open"], depth + 1, F.greatest(F.size(a["open"]) - depth, F.lit(0))))
        start = F.concat(F.lit("<"), n["tag"], attributes(n["attrs"]), F.lit(">"))
        return F.struct(
            F.concat(a["out"], closed, F.when(n["tag"].isNull(), X.escape_text(X.compact(n["text"]))).otherwise(start)).alias("out"),
            F.when(n["tag"].isNull(), left).otherwise(F.concat(left, F.array(n["tag"]))).alias("open"),
        )

    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("open"))
    html = F.aggregate("kept", start, write, lambda a: F.concat(a["out"], ends(a["open"])))
    texts = F.filter("kept", lambda n: n["tag"].isNull())
    return d.select(
        "capture_id", html.alias("html"), F.size("kept").alias("nodes"), (F.size("kept") - F.size(texts)).alias("elements"), F.size(texts).alias("texts"),
        F.aggregate(texts, F.lit(0), lambda a, n: a + F.length(X.compact(n["text"]))).alias("text_length"),
        F.array_max(F.transform("kept", rel)).alias("max_depth"), (F.size("near") > max_nodes).alias("cut_nodes"), F.exists("below", lambda n: rel(n) > max_depth).alias("cut_depth"),
    )


def flattened(pages: DataFrame, in_shadow) -> DataFrame:
    """(capture_id, node_idx, position): document order once shadow roots are flattened.

    ``in_shadow`` says of a node whether it hangs in its parent's shadow root; such children come
    before the others.
    """
    return ordered(H.parsed(pages, paths=True), in_shadow).select("capture_id", F.posexplode("order").alias("position", "node_idx"))


def ordered(d: DataFrame, in_shadow) -> DataFrame:
    """``d`` (nodes with their paths, ...) with ``order``, the numbers of all nodes in that order."""
    d = once(d, _light=F.transform("nodes", lambda n: F.when(in_shadow(n), 0).otherwise(1)))
    step = lambda i: F.struct(F.get(F.col("_light"), i).alias("light"), i.alias("i"))
    keyed = F.transform("nodes", lambda n: F.struct(F.transform(F.concat(n["path"], F.array(n["node_idx"])), step).alias("key"), n["node_idx"].alias("i")))
    return once(d, order=F.transform(F.array_sort(keyed), lambda k: k["i"])).drop("_light")


def _shadow_items(n: Column) -> Column:
    return (n["tag"] == "li") & (n["node_idx"] % 2 == 0)


def _pages(s, d):
    return H.spread(S.varied_pages(s, d))


QUERIES = {
    "allowed_attributes": lambda s, d: H.nodes(_pages(s, d), paths=False).select("capture_id", "node_idx", F.explode(allowed_attributes(F.col("attrs"))).alias("name", "value")),
    "descendant_walk": lambda s, d: walk(_pages(s, d), "body", 12, 3),
    "target_subtree_html": lambda s, d: written(_pages(s, d), "body", 25, 4),
    "shadow_flatten": lambda s, d: flattened(_pages(s, d), _shadow_items),
}

_NAMES = "(" + ", ".join(f"'{a}'" for a in ATTRIBUTES) + ")"
_KEEP = f"(k IN {_NAMES} OR starts_with(k, 'aria-') OR starts_with(k, 'data-'))"
_PAIRS = r"""regexp_extract_all(raw, '([:@a-zA-Z0-9_-]+)(?:\s*=\s*"([^"]*)")?', {})"""
_DECODED = "replace(replace(replace(replace(replace(v, '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_ESCAPED = f"replace(replace(replace(replace(replace({_DECODED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_TREE = f"""WITH RECURSIVE {S.VARIED_SQL}, {H.sql_over('vpages')},
a AS (SELECT capture_id, node_idx, unnest({_PAIRS.format(1)}) AS k, unnest({_PAIRS.format(2)}) AS v, generate_subscripts({_PAIRS.format(1)}, 1) AS i FROM nodes WHERE raw IS NOT NULL),
root AS (SELECT capture_id, min(node_idx) AS r, arg_min(depth, node_idx) AS rd FROM nodes WHERE tag = 'body' GROUP BY ALL),
sub AS (SELECT n.*, (depth - rd)::INT AS rel, rd FROM nodes n JOIN root USING (capture_id) WHERE n.node_idx = r OR list_contains(n.path, r))"""
ORACLE = {
    "allowed_attributes": _TREE + f" SELECT capture_id, node_idx, k AS name, arg_max({_DECODED}, i) AS value FROM a WHERE {_KEEP} GROUP BY capture_id, node_idx, k",
    "descendant_walk": _TREE + """, e AS (SELECT capture_id, node_idx, row_number() OVER (PARTITION BY capture_id ORDER BY node_idx) - 1 AS place, count(*) OVER (PARTITION BY capture_id) AS n FROM sub WHERE tag IS NOT NULL AND rel BETWEEN 1 AND 3)
      SELECT capture_id, n > 12 AS truncated, place::INT AS place, node_idx FROM e WHERE place < 12""",
    "target_subtree_html": _TREE + f""", near AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY node_idx) AS k, count(*) OVER (PARTITION BY capture_id) AS n FROM sub WHERE rel <= 4),
      attr AS (SELECT capture_id, node_idx, string_agg(' ' || k || '="' || {_ESCAPED} || '"', '' ORDER BY i) AS attrs FROM a WHERE {_KEEP} GROUP BY ALL),
      kept AS (SELECT near.*, coalesce(attrs, '') AS attrs, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, coalesce(lead(rel) OVER (PARTITION BY capture_id ORDER BY node_idx), 0) AS next_rel,
        list_concat(path_tags[rd:depth - 1], CASE WHEN tag IS NULL THEN [] ELSE [tag] END) AS open FROM near LEFT JOIN attr USING (capture_id, node_idx) WHERE k <= 25),
      part AS (SELECT *, CASE WHEN tag IS NULL THEN replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ELSE '<' || tag || attrs || '>' END || array_to_string(list_transform(list_reverse(open[next_rel + 1:]), lambda x: '</' || x || '>'), '') AS s FROM kept),
      deep AS (SELECT capture_id, bool_or(rel > 4) AS cut_depth FROM sub GROUP BY ALL)
      SELECT capture_id, string_agg(s, '' ORDER BY node_idx) AS html, count(*)::INT AS nodes, count(tag)::INT AS elements, (count(*) - count(tag))::INT AS texts, coalesce(sum(length(t)) FILTER (tag IS NULL), 0)::INT AS text_length, max(rel) AS max_depth, any_value(n > 25) AS cut_nodes, any_value(cut_depth) AS cut_depth
      FROM part JOIN deep USING (capture_id) GROUP BY capture_id""",
    "shadow_flatten": _TREE + """, sh AS (SELECT capture_id, list(node_idx) AS items FROM nodes WHERE tag = 'li' AND node_idx % 2 = 0 GROUP BY ALL)
      SELECT capture_id, node_idx, (row_number() OVER (PARTITION BY capture_id ORDER BY list_transform(list_append(path, node_idx), lambda i: CASE WHEN list_contains(coalesce(items, []), i) THEN i ELSE 1000000 + i END)) - 1)::INT AS position FROM nodes LEFT JOIN sh USING (capture_id)""",
}
