"""The fallback export assembled: HTML positions, scoped styles, states, symbols, keyframes, statistics.

Elements are numbered by their position in the flattened tree, which both names them in the style
sheet and pairs them with their copies.  Every part is a relation of (capture_id, position, ...), so
captures of any size are joined and put in order by shuffles, and only the text of one capture's sheet
comes together in one row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.arrays import once
from ..sources import fixtures as X
from . import cascade as K
from . import fallback as B
from . import fidelity as Q
from . import htmltree as H
from . import subtrees as S

#: Stand-ins that every sheet begins with.
RESET = "*,*::before,*::after{box-sizing:border-box;}"
#: Attribute that carries an element's number.
NUMBER = "data-part"
_RULES = "array<struct<selector:string,place:bigint,declarations:array<struct<name:string,value:string>>>>"


def placed(elements: DataFrame, order: DataFrame) -> DataFrame:
    """Elements with the position of their copy: ranks of both in document order are the same."""
    w = W.partitionBy("capture_id").orderBy("position")
    return elements.join(order, ["capture_id", "node_idx"]).withColumn("place", F.row_number().over(w) - 1).drop("position")


def exported(d: DataFrame, in_shadow) -> DataFrame:
    """``d`` (nodes with their paths, ...) with ``elements``, structs (place, node_idx, parent_idx, tag, raw) in the
    order of their copies.  A page's order is found in its row, where its nodes are."""
    d = once(S.ordered(d, in_shadow), _shown=F.filter("order", lambda i: F.get(F.col("nodes"), i)["tag"].isNotNull()))
    at = lambda i: F.get(F.col("nodes"), i)
    each = F.transform("_shown", lambda i, k: F.struct(k.alias("place"), i.alias("node_idx"), at(i)["parent_idx"].alias("parent_idx"), at(i)["tag"].alias("tag"), at(i)["attrs"].alias("raw")))
    return once(d, elements=each).drop("order", "_shown")


def element_rows(d: DataFrame) -> DataFrame:
    """(capture_id, place, node_idx, parent_idx, tag, attrs) of ``elements``."""
    return d.select("capture_id", F.inline("elements")).withColumn("attrs", H.attributes(F.coalesce("raw", F.lit("")))).drop("raw")


def elements_and_states(pages: DataFrame, rules: DataFrame, in_shadow) -> tuple[DataFrame, DataFrame]:
    """Rows of the elements, and (capture_id, place, state, name, value) of the given rules' states.

    Both come from one parse.  The parts of an export read them many times (each asset's tokens alone five
    times), so what the parse gives is kept on the executors' disks while anything refers to it.
    """
    d = K.trees(K.given_rules(pages, rules), read=F.coalesce("given", F.array().cast(_RULES)))
    d = exported(K.with_state_hits(d).select("capture_id", "nodes", "by_state"), in_shadow)
    # Places by node number: elements have one, texts none.
    pair = lambda i, place: F.struct(i.alias("i"), place.cast("int").alias("place"))
    texts = F.transform(F.filter("nodes", lambda n: n["tag"].isNull()), lambda n: pair(n["node_idx"], F.lit(None)))
    d = once(d, _places=F.array_sort(F.concat(F.transform("elements", lambda e: pair(e["node_idx"], e["place"])), texts)))
    states = F.transform("by_state", lambda x: F.struct(F.get(F.col("_places"), x["node_idx"])["place"].alias("place"), x["state"].alias("state"), x["name"].alias("name"), x["value"].alias("value")))
    whole = d.select("capture_id", "elements", states.alias("states")).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    return element_rows(whole), whole.select("capture_id", F.inline("states"))


def referenced_ids(attrs: Column) -> Column:
    """Ids that attribute values refer to: in a url token, or as the whole value."""
    return F.array_distinct(F.transform(F.flatten(F.transform(F.map_values(attrs), U.fragments)), lambda r: F.substring(r, F.lit(2), F.length(r))))


def symbols(elements: DataFrame) -> DataFrame:
    """(capture_id, id, node_idx): the first element of each id that something refers to."""
    asked = elements.select("capture_id", F.explode(referenced_ids(F.col("attrs"))).alias("id")).distinct()
    owners = elements.select("capture_id", F.try_element_at("attrs", F.lit("id")).alias("id"), "node_idx").where("id is not null")
    return asked.join(owners.groupBy("capture_id", "id").agg(F.min("node_idx").alias("node_idx")), ["capture_id", "id"])


def animations(names: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All keyframes of each name that an element names (capture_id, place, names), repeats too."""
    one = names.select("capture_id", "place", F.posexplode(F.transform(F.split("names", ","), T.trim)).alias("n", "name")).where("name <> 'none'")
    return one.join(keyframes, ["capture_id", "name"])


def block(selector: Column, lines: Column) -> Column:
    return F.concat(selector, F.lit(" {\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x["name"], F.lit(": "), x["value"], F.lit(";\n"))), ""), F.lit("}\n"))


def _ordered(rows: DataFrame, keys: list[str], selector: Column, rank: int) -> DataFrame:
    """One block of declarations a group of ``keys``, with its rank among the parts of a sheet."""
    lines = F.array_sort(F.collect_list(F.struct("name", "value")))
    g = rows.groupBy("capture_id", *keys).agg(lines.alias("lines"))
    return g.select("capture_id", "place", F.lit(rank).alias("rank"), F.col("state").alias("sub") if "state" in keys else F.lit("").alias("sub"), block(selector, F.col("lines")).alias("text"))


def sheet(styles: DataFrame, states: DataFrame, frames: DataFrame) -> DataFrame:
    """The style sheet of each capture: its blocks by element, each followed by its states and keyframes.

    ``styles`` and ``states`` are (capture_id, place, name, value) and so with state, their assets
    already inlined; ``frames`` is (capture_id, place, n, name, ordinal, css_text).
    """
    scope = F.concat(F.lit(f'[{NUMBER}="'), F.col("place").cast("string"), F.lit('"]'))
    parts = _ordered(styles, ["place"], scope, 0)
    parts = parts.unionByName(_ordered(states, ["place", "state"], F.concat(scope, F.lit(":"), F.col("state")), 1))
    each = F.format_string("%06d.%06d", F.col("n"), F.col("ordinal").cast("int"))
    parts = parts.unionByName(frames.select("capture_id", "place", F.lit(2).alias("rank"), each.alias("sub"), F.concat("css_text", F.lit("\n")).alias("text")))
    lines = F.array_sort(F.collect_list(F.struct("place", "rank", "sub", "text")))
    return parts.groupBy("capture_id").agg(F.concat(F.lit(RESET + "\n"), F.array_join(F.transform(lines, lambda x: x["text"]), "")).alias("css"))


def inlined(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """``rows`` with assets in their values; how many were asked for and not there."""
    return B.inline_assets(rows, assets)


def statistics(elements: DataFrame, shadow_hosts: DataFrame, found: DataFrame, states: DataFrame, frames: DataFrame, values: DataFrame) -> DataFrame:
    """Counters of one export: elements, shadow hosts, attributes removed, symbols, state rules,
    keyframes, assets asked for and missed; and what they make of its confidence."""
    removed = F.size("attrs") - F.size(B.exported_attributes(F.col("attrs")))
    one = lambda df, name: df.select("capture_id", F.lit(1).alias(name))
    # All counters as rows of one table, so that they meet in one aggregate.
    rows = elements.select("capture_id", F.lit(1).alias("nodes"), removed.alias("removed_attributes"))
    for more in (
        one(shadow_hosts, "shadow_hosts"), one(found, "symbols"), one(states.select("capture_id", "place", "state").distinct(), "pseudo_rules"),
        one(frames, "keyframe_rules"), values.select("capture_id", F.col("requested").alias("asset_requests"), F.col("failed").alias("asset_failures")),
    ):
        rows = rows.unionByName(more, allowMissingColumns=True)
    names = [c for c in rows.columns if c != "capture_id"]
    d = rows.groupBy("capture_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names)).where("nodes > 0")
    return Q.fallback_confidence(d)


def _elements(s, d):
    return element_rows(exported(H.parsed(S._pages(s, d), paths=True), S._shadow_items))


def _computed(e):
    i = F.col("node_idx")
    color = F.when(F.col("tag") == "a", F.concat(F.lit("c"), (i % 3).cast("string"))).otherwise("c0")
    props = F.array(
        F.struct(F.lit("color").alias("name"), color.alias("value")), F.struct(F.lit("float").alias("name"), F.when(i % 4 == 0, "left").otherwise("none").alias("value")),
        F.struct(F.lit("mask").alias("name"), F.when(F.col("tag") == "div", F.concat(F.lit("url(/i/"), F.col("capture_id").cast("string"), F.lit(".png)"))).alias("value")),
    )
    return e.select("capture_id", "place", "tag", F.inline(props)).where("value is not null")


def _defaults(s):
    return s.range(1).select(F.explode(F.array(F.lit("a"), F.lit("li"), F.lit("p"))).alias("tag"), F.lit("float").alias("name"), F.lit("none").alias("value"))


def _rules(s, d):
    k = F.col("k")
    return X._series(s, d, 2).select(
        F.col("p").alias("capture_id"), F.when(k == 0, "a:hover, #stage1:focus").when(k == 1, "div.board:focus-within, nav li:active").otherwise("b.overlay:hover, a:hover, li:foo:hover").alias("selector_text"),
        k.alias("ordinal"), F.lit("color").alias("name"), F.concat(F.lit("s"), k.cast("string")).alias("value"),
    )


def _parts(s, d):
    e, states = elements_and_states(S._pages(s, d), _rules(s, d), S._shadow_items)
    styles = inlined(B.differing_styles(_computed(e), _defaults(s)).select("capture_id", "place", "name", "value"), B._assets(s, d))
    named = e.where("tag = 'li'").select("capture_id", "place", F.concat(F.lit("kf"), (F.col("place") % 3).cast("string"), F.lit(", none")).alias("names"))
    return e, styles, states, animations(named, X.keyframes(s, d))


def _css(s, d):
    _, styles, states, frames = _parts(s, d)
    return sheet(styles, states, frames)


def _stats(s, d):
    e, styles, states, frames = _parts(s, d)
    hosts = e.join(e.where("tag = 'li' and node_idx % 2 = 0").select("capture_id", F.col("parent_idx").alias("node_idx")).distinct(), ["capture_id", "node_idx"], "left_semi")
    return statistics(e, hosts, symbols(e), states, frames, styles).select(
        "capture_id", "nodes", "removed_attributes", "shadow_hosts", "symbols", "pseudo_rules", "keyframe_rules", "asset_requests", "asset_failures", "export_confidence"
    )


QUERIES = {
    "symbol_references": lambda s, d: symbols(_elements(s, d)),
    "fallback_positions": lambda s, d: _elements(s, d).select("capture_id", "node_idx", "place"),
    "fallback_css": _css,
    "fallback_statistics": _stats,
}

_EXPORTED = "(" + ", ".join(f"'{a}'" for a in B.EXPORTED) + ")"
_BASE = S._TREE + f""", sh AS (SELECT capture_id, list(node_idx) AS items FROM nodes WHERE tag = 'li' AND node_idx % 2 = 0 GROUP BY ALL),
e AS (SELECT capture_id, node_idx, path[-1] AS parent_idx, path_tags, tag, raw, (row_number() OVER (PARTITION BY capture_id ORDER BY list_transform(list_append(path, node_idx), lambda i: CASE WHEN list_contains(coalesce(items, []), i) THEN i ELSE 1000000 + i END)) - 1)::INT AS place FROM nodes LEFT JOIN sh USING (capture_id) WHERE tag IS NOT NULL),
atr AS (SELECT capture_id, node_idx, k, arg_max({S._DECODED}, i) AS v FROM a GROUP BY ALL),
ids AS (SELECT capture_id, min(node_idx) AS node_idx, v AS id FROM atr WHERE k = 'id' GROUP BY capture_id, v),
syms AS (SELECT DISTINCT r.capture_id, ids.id, ids.node_idx FROM (SELECT capture_id, coalesce(nullif(regexp_extract(v, 'url\\(#([^)]+)\\)', 1), ''), nullif(regexp_extract(v, '^#(.+)$', 1), '')) AS id FROM atr) r JOIN ids ON ids.capture_id = r.capture_id AND ids.id = r.id),
st AS (SELECT capture_id, place, 'color' AS name, CASE WHEN tag = 'a' THEN 'c' || node_idx % 3 ELSE 'c0' END AS value, 0 AS asked, 0 AS lost FROM e
  UNION ALL SELECT capture_id, place, 'float', CASE WHEN node_idx % 4 = 0 THEN 'left' ELSE 'none' END, 0, 0 FROM e WHERE node_idx % 4 = 0 OR tag NOT IN ('a', 'li', 'p')
  UNION ALL SELECT capture_id, place, 'mask', CASE WHEN capture_id % 2 = 0 THEN 'url("data:image/png;base64,' || base64(encode(capture_id::VARCHAR)) || '")' ELSE 'url("/i/' || capture_id || '.png")' END, 1, capture_id % 2 FROM e WHERE tag = 'div'),
cl AS (SELECT e.*, string_split_regex(coalesce(c.v, ''), '\\s+') AS classes, i.v AS id FROM e LEFT JOIN atr c ON c.capture_id = e.capture_id AND c.node_idx = e.node_idx AND c.k = 'class' LEFT JOIN atr i ON i.capture_id = e.capture_id AND i.node_idx = e.node_idx AND i.k = 'id'),
ps AS (SELECT capture_id, place, 'hover' AS state, 's2' AS value FROM cl WHERE tag = 'a' OR (tag = 'b' AND list_contains(classes, 'overlay'))
  UNION ALL SELECT capture_id, place, 'focus', CASE WHEN tag = 'div' AND list_contains(classes, 'board') THEN 's1' ELSE 's0' END FROM cl WHERE id = 'stage1' OR (tag = 'div' AND list_contains(classes, 'board'))
  UNION ALL SELECT capture_id, place, 'active', 's1' FROM cl WHERE tag = 'li' AND list_contains(path_tags, 'nav')),
kf AS (SELECT e.capture_id, e.place, k.ordinal, k.css_text FROM e JOIN (WITH {X.KEYFRAMES_SQL} SELECT * FROM fx_keyframes) k ON k.capture_id = e.capture_id AND k.name = 'kf' || e.place % 3 WHERE e.tag = 'li')"""
_PEN = "least(0.92::DOUBLE, greatest(0::DOUBLE, ((((((0.32::DOUBLE + least(0.2::DOUBLE, shadow_hosts::DOUBLE * 0.04::DOUBLE)) + least(0.1::DOUBLE, removed_attributes::DOUBLE * 0.002::DOUBLE)) + least(0.2::DOUBLE, asset_failures::DOUBLE * 0.03::DOUBLE)) + CASE WHEN pseudo_rules = 0 THEN 0.02::DOUBLE ELSE 0::DOUBLE END) + CASE WHEN keyframe_rules = 0 THEN 0.02::DOUBLE ELSE 0::DOUBLE END) + CASE WHEN nodes > 160 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)))"
ORACLE = {
    "symbol_references": _BASE + " SELECT capture_id, id, node_idx FROM syms",
    "fallback_positions": _BASE + " SELECT capture_id, node_idx, place FROM e",
    "fallback_css": _BASE + f""", b AS (SELECT capture_id, place, 0 AS rank, '' AS sub, '[{NUMBER}="' || place || '"] {{' || chr(10) || string_agg('  ' || name || ': ' || value || ';' || chr(10), '' ORDER BY name) || '}}' || chr(10) AS text FROM st GROUP BY capture_id, place
      UNION ALL SELECT capture_id, place, 1, state, '[{NUMBER}="' || place || '"]:' || state || ' {{' || chr(10) || '  color: ' || value || ';' || chr(10) || '}}' || chr(10) FROM ps UNION ALL SELECT capture_id, place, 2, lpad(ordinal::VARCHAR, 6, '0'), css_text || chr(10) FROM kf)
      SELECT capture_id, '{RESET}' || chr(10) || string_agg(text, '' ORDER BY place, rank, sub) AS css FROM b GROUP BY capture_id""",
    "fallback_statistics": _BASE + f""", n AS (SELECT e.capture_id, count(*) AS nodes FROM e GROUP BY ALL), rm AS (SELECT capture_id, count(*) FILTER (lower(k) NOT IN {_EXPORTED} AND NOT starts_with(lower(k), 'aria-')) AS removed FROM atr GROUP BY ALL),
      sy AS (SELECT capture_id, count(*) AS c FROM syms GROUP BY ALL), p AS (SELECT capture_id, count(*) AS c FROM ps GROUP BY ALL), f AS (SELECT capture_id, count(*) AS c FROM kf GROUP BY ALL), q AS (SELECT capture_id, sum(asked) AS a, sum(lost) AS l FROM st GROUP BY ALL),
      ho AS (SELECT capture_id, count(DISTINCT parent_idx) AS c FROM e WHERE tag = 'li' AND node_idx % 2 = 0 AND parent_idx IS NOT NULL GROUP BY ALL),
      t AS (SELECT capture_id, nodes, coalesce(removed, 0)::BIGINT AS removed_attributes, coalesce(ho.c, 0) AS shadow_hosts, coalesce(sy.c, 0) AS symbols, coalesce(p.c, 0) AS pseudo_rules, coalesce(f.c, 0) AS keyframe_rules, coalesce(a, 0)::BIGINT AS asset_requests, coalesce(l, 0)::BIGINT AS asset_failures
        FROM n LEFT JOIN rm USING (capture_id) LEFT JOIN sy USING (capture_id) LEFT JOIN p USING (capture_id) LEFT JOIN f USING (capture_id) LEFT JOIN q USING (capture_id) LEFT JOIN ho USING (capture_id))
      SELECT *, floor(least(1::DOUBLE, greatest(0.08::DOUBLE, 1::DOUBLE - {_PEN})) * 1000 + 0.5) / 1000 AS export_confidence FROM t""",
}
