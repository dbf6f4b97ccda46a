"""The fallback export: styles of elements from rules, defaults, variables and inlined assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..sources import fixtures as X
from . import htmltree as H

#: FIXED VALUES: attributes an export keeps, properties always written, and families never dropped.
EXPORTED = (
    "id", "class", "href", "src", "srcset", "alt", "title", "type", "name", "value", "placeholder", "role", "for", "style", "width", "height",
    "viewbox", "d", "points", "fill", "stroke", "cx", "cy", "r", "rx", "ry", "x", "y", "x1", "y1", "x2", "y2", "transform", "xmlns",
)
CRITICAL = ("display", "position", "width", "height", "color", "background-color", "font-size", "font-family", "font-weight", "line-height")
FAMILIES = ("flex", "grid", "animation", "transition", "transform")
NO_CONTENT = ("none", "", '""', "''", "normal")
HINTS = ("data-testid", "data-test", "role", "name", "type", "aria-label", "placeholder", "title", "alt", "href", "src", "for")
HINT_COUNT, HINT_CHARS = 12, 160


def exported_attributes(attrs: Column) -> Column:
    """Attributes an export keeps: listed ones, and all of ARIA."""
    return F.map_filter(attrs, lambda k, v: F.lower(k).isin(*EXPORTED) | F.lower(k).startswith("aria-"))


def attribute_hints(attrs: Column) -> Column:
    """The first listed attributes with a value, as hints for finding an element again."""
    found = F.filter(
        F.array(*[F.struct(F.lit(k).alias("name"), F.substring(T.compact(F.try_element_at(attrs, F.lit(k))), 1, HINT_CHARS).alias("value")) for k in HINTS]),
        lambda h: F.coalesce(h["value"], F.lit("")) != "",
    )
    return F.slice(found, 1, HINT_COUNT)


def differing_styles(computed: DataFrame, defaults: DataFrame) -> DataFrame:
    """Computed properties worth writing: critical ones, families, and those unlike the tag's default.

    Defaults are a dimension table (a tag's properties); its size does not follow the captures', and
    Spark broadcasts it while it is small.
    """
    j = computed.join(defaults.withColumnRenamed("value", "default"), ["tag", "name"], "left")
    family = F.lit(False)
    for f in FAMILIES:
        family = family | F.col("name").startswith(f)
    return j.where(F.col("name").isin(*CRITICAL) | family | ~F.col("value").eqNullSafe(F.col("default"))).drop("default")


def nearest_values(declared: DataFrame, paths: DataFrame) -> DataFrame:
    """Value of each custom property at each target: that of the nearest element on its path."""
    up = paths.select("capture_id", "node_idx", F.posexplode(F.concat("path", F.array("node_idx"))).alias("depth", "at"))
    j = up.join(declared.withColumnRenamed("node_idx", "at"), ["capture_id", "at"])
    return j.groupBy("capture_id", "node_idx", "name").agg(F.max_by("value", "depth").alias("value"))


#: FIXED VALUE: a token whose target is inlined, with its target.
TOKEN = r"""url\(['"]?([^'")]*)['"]?\)"""
#: An address that has this share of all tokens is hot; there are as many such addresses at most.
HOT = 1_000


def inline_assets(values: DataFrame, assets: DataFrame, base: Column | None = None) -> DataFrame:
    """``values`` with each ``url(...)`` token rewritten at its place to the fetched data, quoted; a miss gets
    its own address, quoted.  ``requested`` and ``failed`` count tokens.

    ``assets`` are (url, data), one row an address; addresses are resolved against ``base`` if given.  Data
    URLs are there already, fragments and empty targets never are.  All columns but ``value`` together tell
    rows apart.  Each address is looked up once; what a hot address has is spread over as many groups as
    it has shares, so no task gets all its tokens.
    """
    key = [c for c in values.columns if c != "value"]
    target = F.regexp_extract_all("value", F.lit(TOKEN), 1)
    if base is not None:
        plain = lambda u: (u == "") | F.exists(F.array(*map(F.lit, ("data:", "http", "//", "#"))), lambda x: u.startswith(x))
        target = F.transform(target, lambda u: F.when(plain(u), u).otherwise(F.coalesce(U.resolve(u, base), u)))
    rows = values.select(F.struct(*key).alias("_key"), "value", target.alias("_targets"))
    tokens = rows.select("_key", F.posexplode("_targets").alias("place", "url"))
    asked = ~F.col("url").startswith("data:") & ~F.col("url").startswith("#") & (F.col("url") != "")
    n = tokens.where(asked).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.greatest(F.lit(1.0), F.sum("n") / HOT).alias("share"))  # one row
    hot = n.join(F.broadcast(total), F.col("n") > F.col("share")).select("url", F.ceil(F.col("n") / F.col("share")).alias("parts"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    found = n.join(assets, "url", "left").join(F.broadcast(hot), "url", "left")
    found = found.select("url", "data", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
    salted = tokens.join(F.broadcast(hot), "url", "left").withColumn("salt", F.when(asked, F.pmod(F.xxhash64("_key", "place"), parts)))
    text = F.concat(F.lit('url("'), F.coalesce("data", "url"), F.lit('")'))
    part = F.struct("place", text.alias("text"), (~F.col("url").startswith("data:") & F.col("data").isNull()).alias("missed"))
    done = salted.join(found, ["url", "salt"], "left").groupBy("_key").agg(F.array_sort(F.collect_list(part)).alias("p"))
    some = F.size("_targets") > 0
    written = F.array_join(F.transform(F.split("value", TOKEN, -1), lambda b, i: F.concat(b, F.coalesce(F.get("p", i)["text"], F.lit("")))), "")
    changed = rows.where(some).join(done, "_key").select("_key.*", written.alias("value"), F.size("p").alias("requested"), F.size(F.filter("p", lambda x: x["missed"])).alias("failed"))
    return changed.unionByName(rows.where(~F.coalesce(some, F.lit(False))).select("_key.*", "value", F.lit(0).alias("requested"), F.lit(0).alias("failed")))


def written_pseudo(content: Column) -> Column:
    """Whether a pseudo element is written at all."""
    return ~F.coalesce(F.trim(content), F.lit("")).isin(*NO_CONTENT)


def _links(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ordinal", "href"))


def _values(s, d):
    """Tokens over the pages' links: repeated, quoted, inside one another, beside plain words, fragments, data."""
    h, word = F.col("href"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    k = F.col("ordinal") % 4
    value = (
        F.when(k == 0, word("url(", h, ")")).when(k == 1, word('url("', h, '") ', h, " url(/x", h, ")"))
        .when(k == 2, word("url(", h, "), url(", h, ") url('#", F.substring(h, 2, 20), "')")).otherwise(word("url(data:image/gif;base64,AA) url() url('/logo.png') none ", h))
    )
    return _links(s, d).select("capture_id", "ordinal", value.alias("value"))


def _fetched(s, d):
    """The links with an even number of characters were fetched, and the logo."""
    data = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("url").cast("binary")))
    links = _links(s, d).where("length(href) % 2 = 0").select(F.col("href").alias("url")).union(s.range(1).select(F.lit("/logo.png"))).distinct()
    return links.select("url", data.alias("data"))


def _assets(s, d):
    p = F.col("page_id")
    return s.read.parquet(f"{d}/pages.parquet").where(p % 2 == 0).select(F.concat(F.lit("/i/"), p.cast("string"), F.lit(".png")).alias("url"), F.concat(F.lit("data:image/png;base64,"), F.base64(p.cast("string").cast("binary"))).alias("data"))


def _nearest(s, d):
    nodes = H.nodes(H._read(s, d)).where("kind = 'element'")
    declared = nodes.where("node_idx % 3 = 0").select("capture_id", "node_idx", F.concat(F.lit("--v"), (F.col("node_idx") % 2).cast("string")).alias("name"), F.col("node_idx").cast("string").alias("value"))
    return nearest_values(declared, nodes.where("tag = 'a'").select("capture_id", "node_idx", "path"))


QUERIES = {
    "asset_inlining": lambda s, d: inline_assets(_values(s, d), _fetched(s, d)),
    "nearest_variables": _nearest,
}

ORACLE = {
    "asset_inlining": """WITH l AS (SELECT page_id AS capture_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS ordinal FROM pages),
      t AS (SELECT *, length(h) % 2 = 0 AS got, 'url("' || CASE WHEN length(h) % 2 = 0 THEN 'data:image/png;base64,' || base64(encode(h)) ELSE h END || '")' AS d, '/x' || h AS x FROM l),
      u AS (SELECT *, 'url("' || CASE WHEN x IN (SELECT h FROM t WHERE got) THEN 'data:image/png;base64,' || base64(encode(x)) ELSE x END || '")' AS dx, x NOT IN (SELECT h FROM t WHERE got) AS lost FROM t)
      SELECT capture_id, ordinal::INT AS ordinal, CASE ordinal % 4 WHEN 0 THEN d WHEN 1 THEN d || ' ' || h || ' ' || dx WHEN 2 THEN d || ', ' || d || ' url("#' || h[2:21] || '")'
          ELSE 'url("data:image/gif;base64,AA") url("") url("data:image/png;base64,' || base64(encode('/logo.png')) || '") none ' || h END AS value,
        CASE ordinal % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS requested, (CASE ordinal % 4 WHEN 0 THEN (NOT got)::INT WHEN 1 THEN (NOT got)::INT + lost::INT WHEN 2 THEN 2 * (NOT got)::INT + 1 ELSE 1 END)::INT AS failed FROM u""",
    "nearest_variables": f"""WITH RECURSIVE {H.SQL}, e AS (SELECT * FROM nodes WHERE tag IS NOT NULL), dec AS (SELECT capture_id, node_idx, '--v' || node_idx % 2 AS name, node_idx::VARCHAR AS value FROM e WHERE node_idx % 3 = 0),
      up AS (SELECT capture_id, node_idx, unnest(list_append(path, node_idx)) AS at_idx, generate_subscripts(list_append(path, node_idx), 1) AS depth FROM e WHERE tag = 'a')
      SELECT u.capture_id, u.node_idx, d.name, arg_max(d.value, u.depth) AS value FROM up u JOIN dec d ON d.capture_id = u.capture_id AND d.node_idx = u.at_idx GROUP BY ALL""",
}
