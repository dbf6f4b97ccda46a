"""Deterministic capture inputs derived from ``pages``, as Spark expressions and as SQL.

``pages`` have no styles, shadow roots or recorded captures, so the operators over those read rows
that are pure functions of page_id (p) and a small series index (k).  Both engines make the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _series(spark: SparkSession, sf_dir: str, last: int | Column) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("p"), "url")
    end = last if isinstance(last, Column) else F.lit(last).cast("long")
    return pages.select("p", "url", F.explode(F.sequence(F.lit(0).cast("long"), end)).alias("k"))


def _pick(i: Column, *values) -> Column:
    """The i-th of a few values (from 0)."""
    out = F.lit(None)
    for n, v in enumerate(values):
        out = F.when(i == n, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _s(x: str) -> Column:
    return F.col(x).cast("string")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-table entries of a page's snapshot."""
    d = _series(spark, sf_dir, 5)
    value = _pick(
        (F.col("p") + F.col("k")) % 6,
        F.concat(F.lit("https://cdn.example.com/a"), _s("p"), F.lit(".js")),
        F.concat(F.lit("/img/"), _s("p"), F.lit(".png?v="), _s("k")),
        F.concat(F.lit("url(#g"), _s("k"), F.lit(")")),
        F.concat(F.lit("../f/"), _s("p"), F.lit(".woff2")),
        "data:image/png;base64,AA",
        F.concat(F.lit("plain text "), _s("k")),
    )
    return d.select(F.col("p").alias("capture_id"), F.col("url").alias("page_url"), F.col("k").alias("seq"), value.alias("value"))


STRINGS_SQL = """fx_strings AS (SELECT page_id AS capture_id, url AS page_url, k AS seq, CASE (page_id + k) % 6 WHEN 0 THEN 'https://cdn.example.com/a' || page_id || '.js'
  WHEN 1 THEN '/img/' || page_id || '.png?v=' || k WHEN 2 THEN 'url(#g' || k || ')' WHEN 3 THEN '../f/' || page_id || '.woff2' WHEN 4 THEN 'data:image/png;base64,AA' ELSE 'plain text ' || k END AS value
  FROM pages, range(6) AS r(k))"""


def css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _series(spark, sf_dir, 4)
    return d.select(
        F.col("p").alias("capture_id"), F.col("url").alias("page_url"), F.col("k").alias("seq"),
        _pick(F.col("k") % 4, "regular", "user-agent", None, "inline").alias("origin"),
        F.when(F.col("k") != 3, F.concat(F.lit("s"), ((F.col("p") + F.col("k")) % 3).cast("string"))).alias("sheet_id"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("/css/"), _s("p"), F.lit(".css"))).alias("source_url"),
        (F.col("k") % 3).alias("start_line"), (F.col("k") % 2).alias("start_column"),
        F.when(F.col("k") == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(".c"), (F.col("k") % 3).cast("string")))).alias("selectors"),
    )


RULES_SQL = """fx_css_rules AS (SELECT page_id AS capture_id, url AS page_url, k AS seq, CASE k % 4 WHEN 0 THEN 'regular' WHEN 1 THEN 'user-agent' WHEN 3 THEN 'inline' END AS origin,
  CASE WHEN k <> 3 THEN 's' || ((page_id + k) % 3) END AS sheet_id, CASE WHEN k % 2 = 0 THEN '/css/' || page_id || '.css' END AS source_url, k % 3 AS start_line, k % 2 AS start_column,
  CASE WHEN k = 4 THEN []::VARCHAR[] ELSE ['.c' || (k % 3)] END AS selectors FROM pages, range(5) AS r(k))"""


def repeated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that come twice: the same again on even pages, from the next column on odd ones."""
    once = css_rules(spark, sf_dir)
    return once.unionByName(once.withColumns({"seq": F.col("seq") + 5, "start_column": F.col("start_column") + F.col("capture_id") % 2}))


REPEATED_SQL = """fx_rules_twice AS (SELECT * FROM fx_css_rules UNION ALL SELECT * REPLACE (seq + 5 AS seq, start_column + capture_id % 2 AS start_column) FROM fx_css_rules)"""


def css_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with url tokens of every form: quoted, with parentheses, data, unclosed, several, fragments."""
    d = _series(spark, sf_dir, 7)
    p = _s("p")
    value = _pick(
        F.col("k"),
        F.concat(F.lit('url("a('), p, F.lit(').png") no-repeat')),
        F.concat(F.lit("URL( 'b "), p, F.lit(".gif' ), url(c"), p, F.lit(".svg)")),
        F.concat(F.lit("url(data:image/svg+xml,<svg x='"), p, F.lit("'/>)")),
        F.concat(F.lit('url("data:image/svg+xml,<g fill=url(#in)>") url(#out'), p, F.lit(")")),
        F.concat(F.lit('url("open'), p, F.lit(") url(d.png)")),
        F.concat(F.lit("#frag"), p),
        F.lit("url() none"),
        F.concat(F.lit("url( '#q"), p, F.lit("' )")),
    )
    return d.select(F.col("p").alias("capture_id"), F.col("url").alias("page_url"), F.col("k").alias("seq"), value.alias("value"))


VALUES_SQL = """fx_values AS (SELECT page_id AS capture_id, url AS page_url, k AS seq, CASE k WHEN 0 THEN 'url("a(' || page_id || ').png") no-repeat' WHEN 1 THEN 'URL( ''b ' || page_id || '.gif'' ), url(c' || page_id || '.svg)'
  WHEN 2 THEN 'url(data:image/svg+xml,<svg x=' || chr(39) || page_id || chr(39) || '/>)' WHEN 3 THEN 'url("data:image/svg+xml,<g fill=url(#in)>") url(#out' || page_id || ')' WHEN 4 THEN 'url("open' || page_id || ') url(d.png)'
  WHEN 5 THEN '#frag' || page_id WHEN 6 THEN 'url() none' ELSE 'url( ' || chr(39) || '#q' || page_id || chr(39) || ' )' END AS value FROM pages, range(8) AS r(k))"""

#: What stands in for what in the pages with varied structure: (text, its replacement, on pages with this remainder of 3 or all).
VARIED = (
    ('<div class="ad">', '<div class="board layer" id="stage1" style="top:0; position : absolute" data-k="x">', None),
    ('<footer>', '<svg viewBox="0 0 9 9" onload="x()"><path d="M0" fill="url(#g1)"></path><use href="#g1"></use><mask id="g1"></mask></svg><iframe src="/f"></iframe><footer role="note" aria-label="a&amp;b&#39;s" onclick="go()">', 0),
    ('<footer>', '<linearGradient id="g1"><stop></stop></linearGradient><footer style="position:absolute" data-scene="1">', 1),
    ("<li>", '<li data-state="open" tabindex="0" draggable="true">', 1),
    ("<b>", '<b class="t1 overlay" style="color:red">', 2),
    ("<h1>", '<h1 title="x &lt; y"><span></span>', None),
)


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with attributes, scenes, graphics and references put into their HTML."""
    return _replaced(spark, sf_dir, VARIED)


def _replaced(spark: SparkSession, sf_dir: str, changes: tuple) -> DataFrame:
    html = F.col("html")
    for old, new, only in changes:
        changed = F.replace(html, F.lit(old), F.lit(new))
        html = changed if only is None else F.when(F.col("page_id") % 3 == only, changed).otherwise(html)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", html.alias("html"))


def _replaced_sql(name: str, changes: tuple) -> str:
    html = "html"
    for old, new, only in changes:
        quoted = [x.replace("'", "''") for x in (old, new)]
        changed = f"replace({html}, '{quoted[0]}', '{quoted[1]}')"
        html = changed if only is None else f"CASE WHEN page_id % 3 = {only} THEN {changed} ELSE {html} END"
    return f"{name} AS (SELECT page_id, url, {html} AS html FROM pages)"


VARIED_SQL = _replaced_sql("vpages", VARIED)


#: The sheet that stands in for the pages' own: combinators, attributes, lists, media, states, and what is not valid.
SHEET = (
    "p{margin:0;color:black} nav li:hover{color:red;top:1px} nav > ul > li:first-child a:focus-visible{color:blue} article *:active{outline:0}"
    " [title]:hover, h1[title^='x']:active{cursor:pointer} b + br, p ~ p:hover{left:2px} a[href^='/E' i]:focus-within{left:3px} div:not(.ad):active{x:1}"
    " a > :hover{bad:1} li:hover:focus{top:2px} p:nope, p{margin:9px} article br{left:4px;--gap:1} @media print{li{color:gray}} @media screen{li{color:teal!important}}"
    " nav ul .open{color:olive;top:5px} body{color:#111;font-size:12px;margin:8px} h1{color:inherit;font-size:initial} @keyframes k{from{top:0}} @font-face{font-family:W;src:url(/w.woff2)}"
)
STYLED = (
    ("<style>p{margin:0}</style>", f"<style>{SHEET}</style>", None), ("<h1>", '<h1 title="x">', 0), ("<h1>", '<h1 title="y" style="color:navy;margin:1px!important">', 1),
    ("<li>", '<li class="a open">', 2), ("<b>", "<b><i></i></b><br><b>", 1),
)


def styled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a larger sheet and some style attributes and classes."""
    return _replaced(spark, sf_dir, STYLED)


STYLED_SQL = _replaced_sql("spages", STYLED)


def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with linked sheets and shadow roots before their navigation."""
    name = lambda n: F.concat(F.lit("/s"), ((F.col("page_id") + n) % 7).cast("string"), F.lit(".css"))
    parts = (
        F.lit('<link rel="stylesheet" href="'), name(0), F.lit('"><x-a><template shadowrootmode="open"><style>@import "'), name(2), F.lit('"; i{a:b}</style><x-b><template shadowrootmode="open"><link rel="stylesheet" href="'),
        name(4), F.lit('"></template></x-b><link href="/t.css" rel="alternate StyleSheet"></template></x-a><nav>'),
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.replace("html", F.lit("<nav>"), F.concat(*parts)).alias("html"))


def css_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _series(spark, sf_dir, 4).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    i = (F.col("k") + F.col("d")) % 4
    return d.select(
        F.col("p").alias("capture_id"), F.col("url").alias("page_url"), F.col("k").alias("seq"), F.col("d").alias("ordinal"),
        _pick(i, "color", F.concat(F.lit("--v"), _s("k")), "background", "animation").alias("name"),
        _pick(
            i,
            F.concat(F.lit("var(--v"), _s("d"), F.lit(")")),
            "#f00",
            F.concat(F.lit("url(/i/"), _s("p"), F.lit(".png)")),
            F.concat(F.lit("250ms ease-in kf"), _s("k")),
        ).alias("value"),
    )


DECLS_SQL = """fx_css_decls AS (SELECT page_id AS capture_id, url AS page_url, k AS seq, d AS ordinal, CASE (k + d) % 4 WHEN 0 THEN 'color' WHEN 1 THEN '--v' || k WHEN 2 THEN 'background' ELSE 'animation' END AS name,
  CASE (k + d) % 4 WHEN 0 THEN 'var(--v' || d || ')' WHEN 1 THEN '#f00' WHEN 2 THEN 'url(/i/' || page_id || '.png)' ELSE '250ms ease-in kf' || k END AS value FROM pages, range(5) AS r(k), range(3) AS s(d))"""


def computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed custom properties: --v0 twice, and --v7."""
    d = _series(spark, sf_dir, 2)
    return d.select(
        F.col("p").alias("capture_id"), F.col("k").alias("ordinal"),
        _pick(F.col("k"), "--v0", "--v0", "--v7").alias("name"), F.concat(F.lit("c"), _s("k")).alias("value"),
    )


COMPUTED_SQL = """fx_computed AS (SELECT page_id AS capture_id, k AS ordinal, CASE WHEN k = 2 THEN '--v7' ELSE '--v0' END AS name, 'c' || k AS value FROM pages, range(3) AS r(k))"""


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _series(spark, sf_dir, 3)
    return d.select(
        F.col("p").alias("capture_id"), F.col("k").alias("ordinal"), F.concat(F.lit("kf"), (F.col("k") % 2).cast("string")).alias("name"),
        (F.col("k") % 3 == 0).alias("prefixed"), F.concat(F.lit("@keyframes b"), _s("k")).alias("css_text"),
    )


KEYFRAMES_SQL = """fx_keyframes AS (SELECT page_id AS capture_id, k AS ordinal, 'kf' || (k % 2) AS name, k % 3 = 0 AS prefixed, '@keyframes b' || k AS css_text FROM pages, range(4) AS r(k))"""


def shadow_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _series(spark, sf_dir, F.col("p") % 3)
    return d.select(
        F.col("p").alias("capture_id"), F.col("k").alias("ordinal"), (F.col("k") % 2 + 1).alias("depth"), F.lit("x-card").alias("tag"),
        F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), _s("k"))).alias("host_id"),
        F.when(F.col("p") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("host_classes"),
        _pick((F.col("p") + F.col("k")) % 4, "open", "closed", "unknown", "open").alias("mode"),
    )


SHADOW_SQL = """fx_shadow AS (SELECT page_id AS capture_id, k AS ordinal, k % 2 + 1 AS depth, 'x-card' AS tag, CASE WHEN k % 2 = 0 THEN '' ELSE 'h' || k END AS host_id, CASE WHEN page_id % 4 = 0 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS host_classes,
  (['open', 'closed', 'unknown', 'open'])[((page_id + k) % 4 + 1)::INT] AS mode FROM pages, LATERAL (SELECT unnest(range(page_id % 3 + 1)) AS k))"""


def shadow_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adopted sheets of open roots: repeated keys pair by place, one key in three pages is unknown."""
    d = _series(spark, sf_dir, 1)
    return d.select(
        F.col("p").alias("capture_id"), F.col("k").alias("ordinal"), F.lit(1).cast("long").alias("depth"), F.lit("x-card").alias("tag"),
        F.when((F.col("p") % 3 == 1) & (F.col("k") == 1), "zz").otherwise("").alias("host_id"), (F.col("k") + 1).alias("sheets"),
        F.when(F.col("p") % 8 == 4, F.array(F.lit("b"), F.lit("a"))).when(F.col("p") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("host_classes"),
    )


SHEETS_SQL = """fx_sheets AS (SELECT page_id AS capture_id, k AS ordinal, 1::BIGINT AS depth, 'x-card' AS tag, CASE WHEN page_id % 3 = 1 AND k = 1 THEN 'zz' ELSE '' END AS host_id, k + 1 AS sheets,
  CASE WHEN page_id % 8 = 4 THEN ['b', 'a'] WHEN page_id % 4 = 0 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS host_classes FROM pages, range(2) AS r(k))"""

#: Presence of each part of a capture, by a divisor of page_id: absent where the remainder is 0.
PRESENCE = {
    "full_page": 7, "clip": 5, "css_graph": 9, "keyframes": 4, "dom_snapshot": 6, "mapped": 3, "node_mapping": 11,
    "fingerprint": 8, "target_subtree": 10, "candidate": 12, "shadow_topology": 2, "resource_graph": 13,
}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a page: flags and counts of every part that scoring looks at."""
    p = F.col("capture_id")
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("capture_id"), F.col("url").alias("page_url"))
    flags = {f"has_{k}": p % n != 0 for k, n in PRESENCE.items()}
    return d.withColumns(flags).withColumns(
        {
            "rule_count": F.when(F.col("has_css_graph"), p % 4).otherwise(0),
            "inline_count": F.when(F.col("has_css_graph"), p % 3).otherwise(0),
            "degraded": F.col("has_css_graph") & (p % 4 == 0),
            "mismatch_ratio": F.when(p % 5 < 2, (p % 20).cast("double") / F.lit(100.0)),
            "mismatch_pixels": F.when(p % 5 < 2, p % 20 * 10),
            "dimensions_match": p % 10 != 1,
            "mapping_confidence": (p % 11).cast("double") / F.lit(10.0),
            "closed_roots": p % 6,
            "shadow_roots": p % 6 + p % 2,
            "text_length": p % 4,
            "assets": F.when(p % 4 == 0, 0).otherwise(p % 9),
            "required_assets": F.when(p % 4 == 0, 0).otherwise(F.least(p % 9, p % 3)),
            "required_unresolved": F.when(p % 4 == 0, 0).otherwise(F.least(p % 9, p % 3, p % 2)),
            "optional_unresolved": F.when(p % 4 == 0, 0).otherwise(F.greatest(p % 9 - F.least(p % 9, p % 3) - 2, F.lit(0))),
            "resource_nodes": p % 5,
            "graph_warnings": p % 7,
            "actions": p % 5,
            "mutations": p % 7,
            "linked": F.least(p % 5, p % 7),
            "total": p % 5 + p % 7,
            "covers_descendants": p % 4 != 1,
            "scene": p % 6 == 5,
            "css": F.when(p % 13 == 4, " ").otherwise("a {}"),
        }
    )


CAPTURES_SQL = f"""flags AS (SELECT page_id AS capture_id, url AS page_url, page_id AS p, {', '.join(f'page_id % {n} <> 0 AS has_{k}' for k, n in PRESENCE.items())} FROM pages),
fx_captures AS (SELECT *, CASE WHEN has_css_graph THEN p % 4 ELSE 0 END AS rule_count, CASE WHEN has_css_graph THEN p % 3 ELSE 0 END AS inline_count, has_css_graph AND p % 4 = 0 AS degraded,
  CASE WHEN p % 5 < 2 THEN (p % 20)::DOUBLE / 100::DOUBLE END AS mismatch_ratio, CASE WHEN p % 5 < 2 THEN p % 20 * 10 END AS mismatch_pixels, p % 10 <> 1 AS dimensions_match,
  (p % 11)::DOUBLE / 10::DOUBLE AS mapping_confidence, p % 6 AS closed_roots, p % 6 + p % 2 AS shadow_roots, p % 4 AS text_length,
  CASE WHEN p % 4 = 0 THEN 0 ELSE p % 9 END AS assets, CASE WHEN p % 4 = 0 THEN 0 ELSE least(p % 9, p % 3) END AS required_assets,
  CASE WHEN p % 4 = 0 THEN 0 ELSE least(p % 9, p % 3, p % 2) END AS required_unresolved, CASE WHEN p % 4 = 0 THEN 0 ELSE greatest(p % 9 - least(p % 9, p % 3) - 2, 0) END AS optional_unresolved,
  p % 5 AS resource_nodes, p % 7 AS graph_warnings, p % 5 AS actions, p % 7 AS mutations, least(p % 5, p % 7) AS linked, p % 5 + p % 7 AS total, p % 4 <> 1 AS covers_descendants, p % 6 = 5 AS scene, CASE WHEN p % 13 = 4 THEN ' ' ELSE 'a {{}}' END AS css FROM flags)"""


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of a portable export of each page, over all branches of their adjustment."""
    p = F.col("capture_id")
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("capture_id"))
    return d.select(
        "capture_id",
        (F.when(p % 13 == 0, None).otherwise((p % 101).cast("double") / F.lit(100.0))).alias("confidence"),
        F.when(p % 13 == 0, (p % 50).cast("double") / F.lit(100.0)).alias("confidence_penalty"),
        F.when(p % 2 == 0, "replay-capsule").otherwise("portable-fallback").alias("source"),
        F.when(p % 5 == 0, "render-scene").otherwise("semantic-ui").alias("target_class"),
        _pick(p % 4, "semantic-shell", "interactive-composite", "semantic-leaf", None).alias("class_hint"),
        _pick(p % 8, "search-like", "form-like", "generic", "board-like", "board-like", "toolbar-like", "form-like", "board-like").alias("subtype_hint"),
        F.when(p % 17 == 0, "fragile").alias("output_quality"),
        _pick(
            p % 9,
            F.array(F.lit("replay-capsule-empty-shell-export")),
            F.array(F.lit("replay-capsule-shadow-metadata-without-content")),
            F.array(F.lit("replay-capsule-html-structurally-thin")),
            F.array(F.lit("replay-capsule-scene-html-validated"), F.lit("replay-capsule-shadow-metadata-without-content")),
            F.array(F.lit("replay-capsule-preservation-reason:frame-chain-selector-hint-recovered")),
            F.array(F.lit("replay-capsule-preservation-reason:semantic-wrapper-hints-recovered")),
            F.array(F.lit("replay-capsule-preservation-reason:semantic-wrapper-depth-recovered:2")),
            F.array(F.lit("other")),
            F.array().cast("array<string>"),
        ).alias("warnings"),
    )


EXPORTS_SQL = """fx_exports AS (SELECT page_id AS capture_id, CASE WHEN page_id % 13 <> 0 THEN (page_id % 101)::DOUBLE / 100::DOUBLE END AS confidence, CASE WHEN page_id % 13 = 0 THEN (page_id % 50)::DOUBLE / 100::DOUBLE END AS confidence_penalty,
  CASE WHEN page_id % 2 = 0 THEN 'replay-capsule' ELSE 'portable-fallback' END AS source, CASE WHEN page_id % 5 = 0 THEN 'render-scene' ELSE 'semantic-ui' END AS target_class,
  CASE page_id % 4 WHEN 0 THEN 'semantic-shell' WHEN 1 THEN 'interactive-composite' WHEN 2 THEN 'semantic-leaf' END AS class_hint,
  (['search-like', 'form-like', 'generic', 'board-like', 'board-like', 'toolbar-like', 'form-like', 'board-like'])[(page_id % 8 + 1)::INT] AS subtype_hint, CASE WHEN page_id % 17 = 0 THEN 'fragile' END AS output_quality,
  CASE page_id % 9 WHEN 0 THEN ['replay-capsule-empty-shell-export'] WHEN 1 THEN ['replay-capsule-shadow-metadata-without-content'] WHEN 2 THEN ['replay-capsule-html-structurally-thin']
    WHEN 3 THEN ['replay-capsule-scene-html-validated', 'replay-capsule-shadow-metadata-without-content'] WHEN 4 THEN ['replay-capsule-preservation-reason:frame-chain-selector-hint-recovered']
    WHEN 5 THEN ['replay-capsule-preservation-reason:semantic-wrapper-hints-recovered'] WHEN 6 THEN ['replay-capsule-preservation-reason:semantic-wrapper-depth-recovered:2'] WHEN 7 THEN ['other'] ELSE [] END AS warnings FROM pages)"""
