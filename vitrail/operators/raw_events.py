"""Raw events of a page, JSON of any shape, as action and mutation rows.

An event is read as VARIANT, so one of an unknown shape costs its own row and not the job: what cannot be
read is dropped, a field of another type is absent (where a text is asked for: its JSON), fields that no
rule names are kept in ``extra``.

An element is ``{nodeType: 1, tag, attrs, svg}``; a text, another node, or a drawing stands for its
``parent``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.arrays import let
from . import matching as M

#: FIXED VALUES: kinds of events, attributes whose changes count (and prefixes of more), limits of previews.
ACTIONS = ("click", "hover", "input", "focus", "keyboard")
MUTATIONS = ("attributes", "characterData", "childList")
TRACED = ("class", "style", "value", "checked", "selected", "disabled", "hidden", "open", "role", "aria-expanded", "aria-selected", "aria-checked", "aria-hidden", "aria-busy", "data-state")
TRACED_PREFIXES = ("aria-", "data-state")
TAGS, PREVIEW = 8, 140
KNOWN = ("type", "at", "target", "text", "key", "code", "value", "attributeName", "added", "removed")

_ELEMENT = "struct<nodeType:int,tag:string,svg:boolean,attrs:map<string,string>,text:string>"
_NODE = "struct<nodeType:int,tag:string>"


def traced(name: Column) -> Column:
    """Whether a change of an attribute counts."""
    more = F.lit(False)
    for p in TRACED_PREFIXES:
        more = more | name.startswith(p)
    return F.coalesce(name.isin(*TRACED) | more, F.lit(False))


def tag_names(nodes: Column) -> Column:
    """Names of the first nodes of a list; null if there are none."""
    name = lambda n: F.when(F.coalesce(n["nodeType"] == 1, F.lit(False)) & n["tag"].isNotNull(), F.lower(n["tag"])).when(n["nodeType"] == 3, "#text").otherwise("#node")
    return F.when(F.size(nodes) > 0, F.transform(F.slice(nodes, 1, TAGS), name))


def normalised(events: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows (capture_id, seq, kind, type, at_ms, selector, tag_name, ...) of events (capture_id, seq, raw).

    Mutations of elements whose id is in ``ignored``, of attributes that don't count, without a text or
    without nodes are left out.
    """
    v = lambda path, kind: F.try_variant_get("_v", path, kind)
    d = events.select("capture_id", "seq", F.try_parse_json("raw").alias("_v"))
    own, parent = v("$.target", _ELEMENT), v("$.target.parent", _ELEMENT)
    d = d.select(
        "*", v("$.type", "string").alias("type"), own.alias("_own"), parent.alias("_parent"), F.coalesce(v("$.added", f"array<{_NODE}>"), F.array().cast(f"array<{_NODE}>")).alias("_added"),
        F.coalesce(v("$.removed", f"array<{_NODE}>"), F.array().cast(f"array<{_NODE}>")).alias("_removed"), F.lower(v("$.attributeName", "string")).alias("_name"),
    )
    whole = F.coalesce((F.col("_own.nodeType") == 1) & F.col("_own.tag").isNotNull() & ~F.coalesce(F.col("_own.svg"), F.lit(False)), F.lit(False))
    up = F.coalesce((F.col("_parent.nodeType") == 1) & F.col("_parent.tag").isNotNull(), F.lit(False))
    d = d.withColumn("_el", F.when(whole, F.col("_own")).when(up, F.col("_parent")))
    mutation, action = F.col("type").isin(*MUTATIONS), F.col("type").isin(*ACTIONS)
    el = F.col("_el")
    tag, attrs = F.lower(el["tag"]), F.coalesce(el["attrs"], F.create_map().cast("map<string,string>"))
    kind = F.when(action, "action-trace").when(mutation, "mutation")
    preview = lambda x: F.substring(T.compact(x), 1, PREVIEW)
    value = F.when(F.col("type") == "attributes", preview(F.try_element_at(attrs, F.col("_name")))).when(F.col("type") == "characterData", F.nullif(preview(F.col("_own.text")), F.lit("")))
    some = (
        F.when(F.col("type") == "attributes", traced(F.col("_name"))).when(F.col("type") == "characterData", value.isNotNull())
        .otherwise(F.size("_added") + F.size("_removed") > 0)
    )
    mine = F.coalesce(F.try_element_at(attrs, F.lit("id")).isin(*ignored), F.lit(False)) if ignored else F.lit(False)
    kept = action | (mutation & el.isNotNull() & ~mine & F.coalesce(some, F.lit(False)))
    child, typed = F.col("type") == "childList", lambda k: F.when(action, F.nullif(v(f"$.{k}", "string"), F.lit("")))
    extra = let(v("$", "map<string,variant>"), lambda m: F.transform_values(F.map_filter(m, lambda k, _: ~k.isin(*KNOWN)), lambda _, x: F.to_json(x)))
    return d.where(F.coalesce(kept, F.lit(False))).select(
        "capture_id", "seq", kind.alias("kind"), "type", F.greatest(F.lit(0).cast("long"), N.whole_ms(F.coalesce(v("$.at", "double"), F.lit(0.0)))).alias("at_ms"),
        F.when(el.isNotNull(), M.stable_selector(tag, attrs)).alias("selector"), tag.alias("tag_name"), typed("text").alias("text"), typed("key").alias("key"), typed("code").alias("code"),
        F.when(action, v("$.value", "string")).alias("value"), F.when(F.col("type") == "attributes", F.col("_name")).alias("attribute_name"), value.alias("value_preview"),
        F.when(child, F.size("_added")).alias("added_nodes"), F.when(child, F.size("_removed")).alias("removed_nodes"),
        F.when(child, tag_names(F.col("_added"))).alias("added_tag_names"), F.when(child, tag_names(F.col("_removed"))).alias("removed_tag_names"), extra.alias("extra"),
    )


def _raw(s, d) -> DataFrame:
    """Events as JSON, one shape an event type; every 17th is broken."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("seq"), "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))
    k = F.col("k")
    n, quote = k.cast("string"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    el = quote('{"nodeType":1,"tag":"LI","attrs":{"id":"n', n, '","value":" v  ', n, ' ","Class":"x"}}')
    node = F.transform(F.sequence(F.lit(0), k % 11), lambda i: F.when(i % 3 == 0, '{"nodeType":1,"tag":"LI"}').when(i % 3 == 1, '{"nodeType":3,"tag":"x"}').otherwise('{"nodeType":8}'))
    added = F.slice(node, F.lit(1), k % 11)
    raw = (
        F.when(k % 17 == 0, quote('{"type":"click",', n)).when(F.col("event_type") == "click", quote('{"type":"click","at":', n, '.6,"target":', el, ',"text":"t', n, '","deep":{"a":[', n, ']}}'))
        .when(F.col("event_type") == "view", quote('{"type":"hover","at":-5,"target":', n, ',"text":""}'))
        .when(F.col("event_type") == "signup", quote('{"type":"input","at":"x","target":{"nodeType":3,"parent":', el, '},"value":"", "key":"K', n, '"}'))
        .when(F.col("event_type") == "purchase", quote('{"type":"childList","at":', n, ',"target":', el, ',"added":[', F.array_join(added, ","), '],"removed":', F.when(k % 2 == 0, '"none"').otherwise('[{"nodeType":3}]'), "}"))
        .when(k % 3 == 0, quote('{"type":"attributes","at":1,"target":', el, ',"attributeName":"', F.when(k % 2 == 0, "VALUE").otherwise("foo"), '"}'))
        .when(k % 3 == 1, quote('{"type":"attributes","at":1,"target":{"nodeType":1,"tag":"path","svg":true,"parent":', el, '},"attributeName":"data-state-x"}'))
        .otherwise(quote('{"type":"characterData","at":2,"target":{"nodeType":3,"text":"', F.when(k % 2 == 0, quote(" a ", n)).otherwise(" "), '","parent":', el, "}}"))
    )
    return e.select("capture_id", "seq", raw.alias("raw"))


def _rows(s, d) -> DataFrame:
    r = normalised(_raw(s, d), ("n4",))
    extra = F.array_join(F.transform(F.map_entries("extra"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select(*[c for c in r.columns if c not in ("added_tag_names", "removed_tag_names", "extra")], joined("added_tag_names"), joined("removed_tag_names"), extra.alias("extra"))


QUERIES = {"raw_event_rows": _rows}

ORACLE = {
    "raw_event_rows": """WITH e AS (SELECT user_id AS capture_id, event_id AS seq, event_type AS t, coalesce((json_extract_string(props, '$.k'))::INT, 0) AS k FROM events),
      r AS (SELECT *, CASE t WHEN 'click' THEN 'click' WHEN 'view' THEN 'hover' WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'childList' ELSE CASE WHEN k % 3 = 2 THEN 'characterData' ELSE 'attributes' END END AS type FROM e
        WHERE k % 17 <> 0 AND (t IN ('click', 'view', 'signup') OR (k <> 4 AND (t <> 'purchase' OR k % 11 > 0 OR k % 2 = 1) AND (t <> 'error' OR k % 3 = 1 OR k % 2 = 0))))
      SELECT capture_id, seq, CASE WHEN t IN ('click', 'view', 'signup') THEN 'action-trace' ELSE 'mutation' END AS kind, type,
        (CASE WHEN t = 'click' THEN k + 1 WHEN t IN ('view', 'signup') THEN 0 WHEN t = 'purchase' THEN k WHEN k % 3 = 2 THEN 2 ELSE 1 END)::BIGINT AS at_ms,
        CASE WHEN t <> 'view' THEN '#n' || k END AS selector, CASE WHEN t <> 'view' THEN 'li' END AS tag_name, CASE WHEN t = 'click' THEN 't' || k END AS text, CASE WHEN t = 'signup' THEN 'K' || k END AS key, NULL::VARCHAR AS code,
        CASE WHEN t = 'signup' THEN '' END AS value, CASE WHEN type = 'attributes' THEN CASE WHEN k % 3 = 1 THEN 'data-state-x' ELSE 'value' END END AS attribute_name,
        CASE WHEN type = 'characterData' THEN 'a ' || k WHEN type = 'attributes' AND k % 3 = 0 THEN 'v ' || k END AS value_preview,
        CASE WHEN t = 'purchase' THEN k % 11 END AS added_nodes, CASE WHEN t = 'purchase' THEN k % 2 END AS removed_nodes,
        CASE WHEN t = 'purchase' AND k % 11 > 0 THEN array_to_string(list_transform(range(least(8, k % 11)), lambda i: CASE i % 3 WHEN 0 THEN 'li' WHEN 1 THEN '#text' ELSE '#node' END), ',') END AS added_tag_names,
        CASE WHEN t = 'purchase' AND k % 2 = 1 THEN '#text' END AS removed_tag_names, CASE WHEN t = 'click' THEN 'deep={"a":[' || k || ']}' ELSE '' END AS extra FROM r""",
}
