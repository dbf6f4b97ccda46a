"""The resource graph of a capture: what its rules, shadow roots and strings refer to.

Every source is flattened to references in one shape, references become nodes by key, and the first
reference of a key gives its place.  Nodes are numbered inside a capture in order of emission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources import fixtures as X

KINDS = ("stylesheet", "font", "image", "script", "svg-reference", "other")


_REFERENCE = "array<struct<kind:string,url:string,ref:string,label:string,reason:string,group:int,i:int>>"


def _fragment_refs(value: Column, reason: Column) -> Column:
    none = F.lit(None).cast("string")
    found = U.fragments(value)
    return F.transform(found, lambda r, i: F.struct(F.lit("svg-reference").alias("kind"), none.alias("url"), r.alias("ref"), r.alias("label"), reason.alias("reason"), F.lit(0).alias("group"), i.alias("i")))


def _url_refs(urls: Column, base: Column, name: Column | None, reason: Column, group: int) -> Column:
    """References to resolved addresses; fragments and what does not resolve are left out."""
    none = F.lit(None).cast("string")
    resolved = F.transform(urls, lambda u: U.resolve(u, base))
    shaped = F.transform(
        resolved, lambda u, i: F.struct(U.kind(u, name).alias("kind"), u.alias("url"), none.alias("ref"), u.alias("label"), reason.alias("reason"), F.lit(group).alias("group"), i.alias("i"))
    )
    return F.filter(shaped, lambda r: r["url"].isNotNull() & ~r["url"].startswith("#"))


def _emitted(rows: DataFrame, stage: int, origin: Column, refs: Column, source: str, ordinal: Column) -> DataFrame:
    """One row a reference, from one pass over ``rows``; place orders emission inside a capture."""
    each = rows.select("capture_id", "seq", ordinal.cast("long").alias("o"), origin.alias("origin"), F.inline(refs.cast(_REFERENCE)))
    place = F.array(F.lit(stage).cast("long"), F.col("seq"), F.col("o"), F.col("group").cast("long"), F.col("i").cast("long"), F.lit(0).cast("long"))
    return each.select("capture_id", place.alias("place"), "origin", "kind", "url", "ref", "label", F.lit(source).alias("source"), "reason")


def rule_references(rules: DataFrame, declarations: DataFrame) -> DataFrame:
    """Stylesheets of rules, and fragments and URLs of their declarations."""
    # Every rule has an ordinal, which names its origin.
    origin = F.concat(F.lit("css-rule:"), F.col("seq").cast("string"))
    url = F.coalesce(U.resolve(F.col("source_url"), F.col("page_url")), F.col("source_url"))
    sheet = F.array(
        F.struct(F.lit("stylesheet"), url, F.lit(None).cast("string"), F.col("source_url"), F.lit("matched-rule-stylesheet"), F.lit(0), F.lit(0))
    )
    out = _emitted(rules.where(F.coalesce(F.trim("source_url"), F.lit("")) != ""), 1, origin, sheet, "cssGraph", F.lit(0))
    reason = F.concat(F.lit("declaration:"), F.col("name"))
    refs = F.concat(_fragment_refs(F.col("value"), reason), _url_refs(U.css_urls(F.col("value")), F.col("page_url"), F.col("name"), reason, 1))
    return out.unionByName(_emitted(declarations, 1, origin, refs, "cssGraph", F.col("ordinal") + 1))


def string_references(strings: DataFrame) -> DataFrame:
    """Fragments, CSS URLs and bare addresses in a snapshot's string table."""
    t, base = F.trim("value"), F.col("page_url")
    bare = F.when(U.likely_asset(t), F.array(t)).otherwise(F.array().cast("array<string>"))
    refs = F.concat(
        _fragment_refs(t, F.lit("dom-string")), _url_refs(U.css_urls(t), base, None, F.lit("dom-css-url"), 1), _url_refs(bare, base, None, F.lit("dom-literal"), 2)
    )
    return _emitted(strings.where(t != ""), 3, F.lit("dom-snapshot:string-table"), refs, "domSnapshot", F.lit(0))


def nodes(references: DataFrame) -> DataFrame:
    """Resource nodes: the first reference of each key, numbered by place inside the capture."""
    keys = ["capture_id", "kind", "url", "ref", "label", "source"]
    first = references.groupBy(*keys).agg(F.min("place").alias("place"))
    w = W.partitionBy("capture_id").orderBy("place", "kind", "label")
    required = F.col("kind").isin("stylesheet", "font")
    return first.select(
        *keys, (F.row_number().over(w) - 1).alias("ordinal"), U.fetch_mode(F.col("url")).alias("fetch_mode"), required.alias("required")
    )


def edges(references: DataFrame) -> DataFrame:
    """Distinct references from origins to resources."""
    return references.select("capture_id", "origin", "kind", "label", "source", "reason").distinct()


def shadow_references(sheets: DataFrame) -> DataFrame:
    """Sheets (capture_id, root, idx, href, page_url) that shadow roots adopt: by address, or constructed."""
    none = F.lit(None).cast("string")
    url = U.resolve(F.col("href"), F.col("page_url"))
    made = F.coalesce(F.trim("href"), F.lit("")) == ""
    ok = sheets.where(made | (url.isNotNull() & ~F.coalesce(url, F.lit("")).startswith("#")))
    zero = F.lit(0).cast("long")
    place = F.array(F.lit(2).cast("long"), F.col("root").cast("long"), F.col("idx").cast("long") + 1, zero, zero, zero)
    label = F.when(made, F.concat(F.lit("adopted-constructed:"), F.col("idx").cast("string"))).otherwise(url)
    return ok.select(
        "capture_id", place.alias("place"), F.concat(F.lit("shadow-root:"), F.col("root").cast("string")).alias("origin"), F.lit("stylesheet").alias("kind"),
        F.when(~made, url).alias("url"), none.alias("ref"), label.alias("label"), F.lit("shadowTopology").alias("source"), F.concat(F.lit("adoptedStyleSheet:"), F.col("idx").cast("string")).alias("reason"), made.alias("inline"),
    )


def origins(rules: DataFrame, roots: DataFrame, strings: DataFrame) -> DataFrame:
    """What references come from: rules, shadow roots with sheets, the string table."""
    long = lambda *v: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("long") for x in v])
    selectors = F.trim(F.array_join("selectors", ", "))
    rule = F.concat(F.lit("css-rule:"), F.col("seq").cast("string"))
    host = F.concat(F.coalesce(F.nullif(F.lower(F.trim("tag")), F.lit("")), F.lit("unknown-host")), F.when(F.trim("host_id") != "", F.concat(F.lit("#"), F.trim("host_id"))).otherwise(""))
    root = F.concat(F.lit("shadow-root:"), F.col("root").cast("string"))
    out = rules.select("capture_id", long(1, F.col("seq"), -1, 0, 0, 0).alias("place"), rule.alias("origin"), F.concat_ws(":", rule, F.nullif(selectors, F.lit(""))).alias("label"), F.lit("cssGraph").alias("source"), F.lit("css-rule").alias("reason"))
    out = out.unionByName(roots.select("capture_id", long(2, F.col("root"), -1, 0, 0, 0).alias("place"), root.alias("origin"), F.concat(root, F.lit(":"), host).alias("label"), F.lit("shadowTopology").alias("source"), F.lit("shadow-root").alias("reason")))
    table = F.lit("dom-snapshot:string-table")
    return out.unionByName(
        strings.select("capture_id").distinct().select("capture_id", long(3, -1, 0, 0, 0, 0).alias("place"), table.alias("origin"), table.alias("label"), F.lit("domSnapshot").alias("source"), F.lit("dom-snapshot").alias("reason"))
    )


_KEY = ("kind", "url", "ref", "label", "source", "inline")


def graph(captures: DataFrame, origin_rows: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (capture_id, id, ...) and edges (capture_id, from_id, to_id, kind, reason) of each capture.

    Nodes are named by place of first emission: the document, then each origin and what it refers to.
    ``captures`` are (capture_id, page_url).
    """
    none = F.lit(None).cast("string")
    start = F.array(*[F.lit(0).cast("long")] * 6)
    document = captures.select("capture_id", start.alias("place"), F.lit("document").alias("kind"), F.col("page_url").alias("url"), none.alias("ref"), F.lit("document").alias("label"), F.lit("capture").alias("source"), F.lit(False).alias("inline"))
    from_ = origin_rows.select("capture_id", "place", F.lit("origin").alias("kind"), none.alias("url"), none.alias("ref"), "label", "source", F.lit(False).alias("inline"))
    emitted = document.unionByName(from_).unionByName(references.select("capture_id", "place", *_KEY))
    w = W.partitionBy("capture_id").orderBy("place", "kind", "label")
    named = emitted.groupBy("capture_id", *_KEY).agg(F.min("place").alias("place")).withColumn("n", F.row_number().over(w) - 1)
    named = named.withColumn("id", F.concat(F.lit("res_"), F.col("n").cast("string")))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _KEY])
    ids = named.select("capture_id", key.alias("k"), "id", *_KEY)
    owner = origin_rows.join(named.where("kind = 'origin'").select("capture_id", "label", "source", "id"), ["capture_id", "label", "source"])
    contains = owner.select("capture_id", F.lit("res_0").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("kind"), "reason")
    to = references.withColumn("k", key).alias("r").join(ids.alias("i"), ["capture_id", "k"])
    for c in _KEY:
        to = to.where(F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")))
    to = to.select("capture_id", "origin", F.col("i.id").alias("to_id"), F.col("r.reason").alias("reason"))
    refers = to.join(owner.select("capture_id", "origin", F.col("id").alias("from_id")), ["capture_id", "origin"])
    edges_ = contains.unionByName(refers.select("capture_id", "from_id", "to_id", F.lit("references").alias("kind"), "reason")).distinct()
    return named.select("capture_id", "id", *_KEY), edges_


def graph_warnings(captures: DataFrame, strings: DataFrame, references: DataFrame, sheets: DataFrame) -> DataFrame:
    """Warnings of each capture's graph, in fixed order."""
    url = U.resolve(F.col("href"), F.col("page_url"))
    made = F.coalesce(F.trim("href"), F.lit("")) == ""
    flags = [
        (sheets.where(~made & (url.isNull() | F.coalesce(url, F.lit("")).startswith("#"))), "adopted-stylesheet-invalid-href"),
        (sheets.where(made), "adopted-stylesheet-constructed-unbundled"),
        (references.where("source = 'domSnapshot'"), "dom-snapshot-resource-scan-heuristic"),
    ]
    rows = [d.select("capture_id", F.lit(w).alias("w")) for d, w in flags]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("capture_id").agg(F.collect_set("w").alias("found"))
    some = lambda d, c: d.select("capture_id").distinct().withColumn(c, F.lit(True))
    d = captures.select("capture_id").join(found, "capture_id", "left").join(some(strings, "has_strings"), "capture_id", "left").join(some(references, "has_resources"), "capture_id", "left")
    has = lambda w: F.when(F.coalesce(F.array_contains("found", w), F.lit(False)), F.lit(w))
    parts = [has(flags[0][1]), has(flags[1][1]), F.when(F.col("has_strings").isNull(), "dom-snapshot-strings-missing"), has(flags[2][1]), F.when(F.col("has_resources").isNull(), "resource-graph-empty")]
    return d.select("capture_id", F.array_join(F.array_compact(F.array(*parts)), " ").alias("warnings"))


def diagnostics(resource_nodes: DataFrame) -> DataFrame:
    """Nodes of each kind, and those that can't be fetched, of each capture."""
    return resource_nodes.groupBy("capture_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in KINDS],
        F.count_if(F.col("fetch_mode") == "unresolved").alias("unresolved"),
        F.count_if("required").alias("required"),
    )


def references(spark, sf_dir) -> DataFrame:
    rules = rule_references(X.css_rules(spark, sf_dir), X.css_declarations(spark, sf_dir))
    return rules.unionByName(string_references(X.strings(spark, sf_dir)))


def _graph_inputs(s, d):
    """Shadow roots with up to two sheets each: by address, constructed, or with an address that leads nowhere."""
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), F.col("url").alias("page_url"))
    roots = X.shadow_sheets(s, d).where("capture_id % 4 > 0").select("capture_id", F.col("ordinal").alias("root"), "tag", "host_id", "sheets")
    k = F.col("capture_id") + F.col("idx")
    href = F.when(k % 3 == 0, F.concat(F.lit(" /ad/"), F.col("idx").cast("string"), F.lit(".css"))).when(k % 3 == 1, F.lit("#bad"))
    sheets = roots.select("capture_id", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sheets") - 1)).alias("idx")).join(pages, "capture_id").withColumn("href", href)
    strings = X.strings(s, d).where("capture_id % 5 > 0")
    refs = rule_references(X.css_rules(s, d), X.css_declarations(s, d)).unionByName(string_references(strings)).withColumn("inline", F.lit(False)).unionByName(shadow_references(sheets))
    return pages, origins(X.css_rules(s, d), roots, strings), refs, strings, sheets


def _q_graph(which):
    def run(s, d):
        pages, own, refs, _, _ = _graph_inputs(s, d)
        return graph(pages, own, refs)[which]

    return run


def _q_warnings(s, d):
    pages, _, refs, strings, sheets = _graph_inputs(s, d)
    return graph_warnings(pages, strings, refs, sheets)


def _q_classes(s, d):
    return X.strings(s, d).select("capture_id", "seq", U.resolve(F.col("value"), F.col("page_url")).alias("resolved")).select(
        "capture_id", "seq", "resolved", U.kind(F.col("resolved")).alias("kind"), U.fetch_mode(F.col("resolved")).alias("fetch_mode")
    )


def _q_tokens(s, d):
    v = X.css_values(s, d)
    urls, refs = U.css_urls(F.col("value")), U.fragments(F.col("value"))
    return v.select("capture_id", "seq", F.array_join(urls, " ; ").alias("urls"), F.array_join(refs, " ; ").alias("refs"), U.likely_asset(F.coalesce(F.get(urls, F.lit(0)), F.lit("../x.webp?y"))).alias("asset"))


QUERIES = {
    "resource_graph_nodes": _q_graph(0),
    "resource_graph_edges": _q_graph(1),
    "resource_graph_warnings": _q_warnings,
    "url_classification": _q_classes,
    "url_tokens": _q_tokens,
    "resource_nodes": lambda s, d: nodes(references(s, d)),
    "resource_edges": lambda s, d: edges(references(s, d)),
    "resource_diagnostics": lambda s, d: diagnostics(nodes(references(s, d))),
}


def sql_resolve(v: str, base: str) -> str:
    """Resolution of the references that the derived inputs contain."""
    origin = f"regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_replace(regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/')"
    up = f"regexp_replace({folder}, '[^/]+/$', '')"
    return f"""CASE WHEN {v} IS NULL OR trim({v}) = '' THEN NULL WHEN {v} LIKE '#%' OR {v} LIKE 'data:%' OR regexp_matches({v}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {v}
      WHEN {v} LIKE '/%' THEN {origin} || {v} WHEN {v} LIKE '../%' THEN {origin} || {up} || ({v})[4:] ELSE {origin} || {folder} || {v} END"""


def sql_kind(u: str, name: str = "''") -> str:
    path = f"regexp_extract({u}, '^([^?#]*)', 1)"
    return f"""CASE WHEN {u} LIKE 'data:image/%' THEN 'image' WHEN {u} LIKE 'data:%' THEN 'other' WHEN regexp_matches({path}, '(?i)\\.(woff2?|ttf|otf|eot)$') OR lower({name}) LIKE '%font%' THEN 'font'
      WHEN regexp_matches({path}, '(?i)\\.(png|jpe?g|gif|webp|avif|svg|bmp|ico)$') THEN 'image' WHEN regexp_matches({path}, '(?i)\\.css$') THEN 'stylesheet' WHEN regexp_matches({path}, '(?i)\\.(mjs|cjs|js)$') THEN 'script' ELSE 'other' END"""


_REFS = f"""WITH {X.STRINGS_SQL}, {X.RULES_SQL}, {X.DECLS_SQL},
ur AS (SELECT *, regexp_extract(value, '(?i)url\\(([^)]*)\\)', 1) AS u FROM fx_css_decls WHERE value LIKE '%url(%'),
us AS (SELECT *, regexp_extract(value, '(?i)url\\(([^)]*)\\)', 1) AS u FROM fx_strings WHERE value LIKE '%url(%'),
refs AS (
  SELECT capture_id, [1, seq, 0, 0, 0, 0] AS place, 'css-rule:' || seq AS origin, 'stylesheet' AS kind, {sql_resolve('source_url', 'page_url')} AS url, NULL AS ref, source_url AS label, 'cssGraph' AS source, 'matched-rule-stylesheet' AS reason FROM fx_css_rules WHERE source_url IS NOT NULL
  UNION ALL SELECT capture_id, [1, seq, ordinal + 1, 0, 0, 0], 'css-rule:' || seq, 'svg-reference', NULL, value, value, 'cssGraph', 'declaration:' || name FROM fx_css_decls WHERE value LIKE '#_%'
  UNION ALL SELECT capture_id, [1, seq, ordinal + 1, 1, 0, 0], 'css-rule:' || seq, {sql_kind('r', 'name')}, r, NULL, r, 'cssGraph', 'declaration:' || name FROM (SELECT *, {sql_resolve('u', 'page_url')} AS r FROM ur)
  UNION ALL SELECT capture_id, [3, seq, 0, 0, 0, 0], 'dom-snapshot:string-table', 'svg-reference', NULL, u, u, 'domSnapshot', 'dom-string' FROM us WHERE u LIKE '#%'
  UNION ALL SELECT capture_id, [3, seq, 0, 2, 0, 0], 'dom-snapshot:string-table', {sql_kind('r')}, r, NULL, r, 'domSnapshot', 'dom-literal' FROM (SELECT *, {sql_resolve('value', 'page_url')} AS r FROM fx_strings
    WHERE value LIKE 'http%' OR value LIKE 'data:%' OR regexp_matches(value, '(?i)^(/|\\./|\\.\\./).+\\.(css|mjs|cjs|js|woff2?|ttf|otf|eot|png|jpe?g|gif|webp|avif|svg|bmp|ico)([?#].*)?$'))),
first AS (SELECT capture_id, kind, url, ref, label, source, min(place) AS place FROM refs GROUP BY ALL),
nodes AS (SELECT capture_id, kind, url, ref, label, source, (row_number() OVER (PARTITION BY capture_id ORDER BY place, kind, label) - 1)::INT AS ordinal,
  CASE WHEN url LIKE 'data:%' THEN 'inline-data' WHEN url IS NOT NULL THEN 'network' ELSE 'unresolved' END AS fetch_mode, kind IN ('stylesheet', 'font') AS required FROM first)
"""

_GRAPH = _REFS + f""", pg AS (SELECT page_id AS capture_id, url AS page_url FROM pages), {X.SHEETS_SQL},
  rt AS (SELECT capture_id, ordinal AS root, tag, host_id, sheets FROM fx_sheets WHERE capture_id % 4 > 0),
  sh AS (SELECT capture_id, root, k AS idx, page_url, CASE (capture_id + k) % 3 WHEN 0 THEN '/ad/' || k || '.css' WHEN 1 THEN '#bad' END AS href FROM rt JOIN pg USING (capture_id), range(2) AS t(k) WHERE k < sheets),
  og AS (SELECT capture_id, [1, seq, -1, 0, 0, 0] AS place, 'css-rule:' || seq AS origin, 'css-rule:' || seq || coalesce(':' || nullif(array_to_string(selectors, ', '), ''), '') AS label, 'cssGraph' AS source, 'css-rule' AS reason FROM fx_css_rules
    UNION ALL SELECT capture_id, [2, root, -1, 0, 0, 0], 'shadow-root:' || root, 'shadow-root:' || root || ':' || tag || CASE WHEN host_id <> '' THEN '#' || host_id ELSE '' END, 'shadowTopology', 'shadow-root' FROM rt
    UNION ALL SELECT DISTINCT capture_id, [3, -1, 0, 0, 0, 0], 'dom-snapshot:string-table', 'dom-snapshot:string-table', 'domSnapshot', 'dom-snapshot' FROM fx_strings WHERE capture_id % 5 > 0),
  rf AS (SELECT capture_id, place, origin, kind, url, ref, label, source, reason, false AS inline FROM refs WHERE source <> 'domSnapshot' OR capture_id % 5 > 0
    UNION ALL SELECT capture_id, [2, root, idx + 1, 0, 0, 0], 'shadow-root:' || root, 'stylesheet', CASE WHEN href IS NOT NULL THEN {sql_resolve('href', 'page_url')} END, NULL, coalesce({sql_resolve('href', 'page_url')}, 'adopted-constructed:' || idx), 'shadowTopology', 'adoptedStyleSheet:' || idx, href IS NULL FROM sh WHERE href IS NULL OR href <> '#bad'),
  em AS (SELECT capture_id, [0, 0, 0, 0, 0, 0] AS place, 'document' AS kind, page_url AS url, NULL AS ref, 'document' AS label, 'capture' AS source, false AS inline FROM pg UNION ALL SELECT capture_id, place, 'origin', NULL, NULL, label, source, false FROM og UNION ALL SELECT capture_id, place, kind, url, ref, label, source, inline FROM rf),
  nk AS (SELECT capture_id, kind, url, ref, label, source, inline, min(place) AS place FROM em GROUP BY ALL),
  gn AS (SELECT *, 'res_' || (row_number() OVER (PARTITION BY capture_id ORDER BY place, kind, label) - 1) AS id FROM nk)
"""
ORACLE = {
    "resource_graph_nodes": _GRAPH + "SELECT capture_id, id, kind, url, ref, label, source, inline FROM gn",
    "resource_graph_edges": _GRAPH + """SELECT og.capture_id, 'res_0' AS from_id, gn.id AS to_id, 'contains' AS kind, og.reason FROM og JOIN gn ON gn.capture_id = og.capture_id AND gn.kind = 'origin' AND gn.label = og.label
      UNION SELECT rf.capture_id, f.id, t.id, 'references', rf.reason FROM rf JOIN og ON og.capture_id = rf.capture_id AND og.origin = rf.origin JOIN gn f ON f.capture_id = og.capture_id AND f.kind = 'origin' AND f.label = og.label
      JOIN gn t ON t.capture_id = rf.capture_id AND t.kind = rf.kind AND t.url IS NOT DISTINCT FROM rf.url AND t.ref IS NOT DISTINCT FROM rf.ref AND t.label = rf.label AND t.source = rf.source AND t.inline = rf.inline""",
    "resource_graph_warnings": _GRAPH + """SELECT capture_id, concat_ws(' ', CASE WHEN capture_id IN (SELECT capture_id FROM sh WHERE href = '#bad') THEN 'adopted-stylesheet-invalid-href' END, CASE WHEN capture_id IN (SELECT capture_id FROM sh WHERE href IS NULL) THEN 'adopted-stylesheet-constructed-unbundled' END,
      CASE WHEN capture_id % 5 = 0 THEN 'dom-snapshot-strings-missing' ELSE 'dom-snapshot-resource-scan-heuristic' END) AS warnings FROM pg""",
    "url_tokens": f"""WITH {X.VALUES_SQL}, c AS (SELECT *, capture_id::VARCHAR AS p FROM fx_values),
      m AS (SELECT capture_id, seq, value, list_transform(regexp_extract_all(value, '(?i)url\\(\\s*("[^"]*"\\s*\\)|''[^'']*''\\s*\\)|[^)]*\\))'), lambda t: trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^url\\(\\s*', ''), '\\s*\\)$', ''), '^"([^"]*)"$|^''([^'']*)''$', '\\1\\2'))) AS found FROM c),
      f AS (SELECT capture_id, seq, value, list_filter(found, lambda t: t <> '') AS urls FROM m)
      SELECT capture_id, seq, array_to_string(urls, ' ; ') AS urls, array_to_string(CASE WHEN value LIKE '#_%' THEN [value] ELSE list_filter(urls, lambda t: t LIKE '#_%') END, ' ; ') AS refs,
        CASE WHEN len(urls) = 0 THEN true ELSE urls[1] LIKE 'data:%' END AS asset FROM f""",
    "url_classification": f"WITH {X.STRINGS_SQL}, r AS (SELECT capture_id, seq, {sql_resolve('value', 'page_url')} AS resolved FROM fx_strings) SELECT *, {sql_kind('resolved')} AS kind, CASE WHEN resolved LIKE 'data:%' THEN 'inline-data' WHEN resolved IS NOT NULL THEN 'network' ELSE 'unresolved' END AS fetch_mode FROM r",
    "resource_nodes": _REFS + "SELECT * FROM nodes",
    "resource_edges": _REFS + "SELECT DISTINCT capture_id, origin, kind, label, source, reason FROM refs",
    "resource_diagnostics": _REFS + "SELECT capture_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in KINDS) + ", count(*) FILTER (fetch_mode = 'unresolved') AS unresolved, count(*) FILTER (required) AS required FROM nodes GROUP BY capture_id",
}
