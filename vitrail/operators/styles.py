"""Style graphs: rules without repeats, diagnostics, custom properties and keyframes.

Order decides which repeat stays, so every operator carries the source's ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as X

#: FIXED VALUES: words of an animation shorthand that are no name.
ANIMATION_WORDS = (
    "infinite", "normal", "reverse", "alternate", "alternate-reverse", "forwards", "backwards", "both", "none", "running", "paused", "ease",
    "ease-in", "ease-out", "ease-in-out", "linear", "step-start", "step-end", "initial", "inherit", "unset", "revert", "revert-layer",
)


def fingerprint() -> Column:
    """Key of a rule; absent parts keep their place."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", part("origin"), part("sheet_id"), part("start_line"), part("start_column"), F.array_join("selectors", ","))


def rule_projection(raw: DataFrame) -> DataFrame:
    """Rules as captured: origin (inline if the sheet is), selectors, sheet, and conditions without blanks.

    ``raw`` has media and supports as lists of texts, and layer_text and layer_name; of these the text wins.
    """
    texts = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    own = F.coalesce(inline(F.col("sheet_id"), F.col("source_url")), F.lit(False))
    return raw.select(
        "capture_id", "seq", F.coalesce("origin", F.when(own, "inline")).alias("origin"), "selectors", "sheet_id", "source_url", own.alias("inline"), texts("media").alias("media"),
        texts("supports").alias("supports"), F.coalesce(F.nullif(F.col("layer_text"), F.lit("")), F.nullif(F.col("layer_name"), F.lit(""))).alias("layer"),
    )


def distinct_rules(rules: DataFrame) -> DataFrame:
    """The first rule of each fingerprint in a capture."""
    first = F.min_by(F.struct(*[c for c in rules.columns if c != "capture_id"]), "seq")
    return rules.withColumn("fingerprint", fingerprint()).groupBy("capture_id", "fingerprint").agg(first.alias("r")).select("capture_id", "fingerprint", "r.*")


def inline(sheet: Column, url: Column) -> Column:
    return (F.col("origin") == "inline") | sheet.startswith("inspector-inline-sheet") | url.startswith("inspector://")


def diagnostics(rules: DataFrame) -> DataFrame:
    """Counts over a capture's rules: sheets, origins, selectors, incomplete metadata."""
    sheet, url = F.col("sheet_id"), F.col("source_url")
    is_inline = F.coalesce(inline(sheet, url), F.lit(False))
    incomplete = ~is_inline & (sheet.isNotNull() != url.isNotNull())
    return rules.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_distinct("sheet_id").alias("sheets"),
        F.count_if(F.col("origin").isNotNull()).alias("with_origin"),
        F.count_if(F.col("origin").isNull()).alias("without_origin"),
        F.count_if(F.size("selectors") == 0).alias("without_selector"),
        F.count_if(F.col("origin") == "user-agent").alias("user_agent"),
        F.count_if(incomplete).alias("incomplete"),
    )


def variables(value: Column) -> Column:
    """Distinct custom properties that a value refers to."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"var\(\s*(--[A-Za-z0-9_-]+)\s*(?:[,)]|$)"), 1))


def computed_projection(rows: DataFrame) -> DataFrame:
    """Computed properties with a name, names and values trimmed."""
    return rows.withColumns({"name": T.present(F.col("name")), "value": T.trim(F.coalesce("value", F.lit("")))}).where("name is not null")


def keyframe_sources(sheets: DataFrame, runtime: DataFrame) -> DataFrame:
    """Keyframes of style sheets and of the running page, these last: their ordinals go on from there."""
    last = sheets.groupBy("capture_id").agg(F.max("ordinal").alias("_last"))
    later = runtime.join(last, "capture_id", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    return sheets.withColumn("source", F.lit("sheet")).unionByName(later.withColumn("source", F.lit("runtime")))


def runtime_keyframes(rows: DataFrame) -> DataFrame:
    """Keyframes that a page reports: vendor prefixes are noted and taken off."""
    vendor = r"(?i)^\s*@-(?:webkit|moz|o|ms)-keyframes"
    return rows.withColumns({"prefixed": F.col("css_text").rlike(vendor), "css_text": F.regexp_replace("css_text", vendor, "@keyframes")})


def resolve_variables(declarations: DataFrame, computed: DataFrame) -> DataFrame:
    """References to custom properties with their computed value: of repeats the first, '' if none."""
    refs = declarations.select("capture_id", "seq", "ordinal", F.explode(variables(F.col("value"))).alias("name"))
    values = computed.where(F.col("name").startswith("--")).groupBy("capture_id", "name").agg(F.min_by("value", "ordinal").alias("value"))
    found = refs.join(values, ["capture_id", "name"], "left")
    return found.select("capture_id", "seq", "ordinal", "name", F.coalesce("value", F.lit("")).alias("value"), F.col("value").isNotNull().alias("resolved"))


def variable_counts(declarations: DataFrame, computed: DataFrame) -> DataFrame:
    """Distinct references of a capture, those never declared, and of these those without a value."""
    name = F.col("name")
    own = declarations.groupBy("capture_id").agg(
        F.array_distinct(F.flatten(F.collect_set(variables(F.col("value"))))).alias("referenced"),
        F.collect_set(F.when(name.startswith("--"), name)).alias("declared"),
    )
    known = computed.where(name.startswith("--")).groupBy("capture_id").agg(F.collect_set("name").alias("computed"))
    d = own.join(known, "capture_id", "left").withColumn("computed", F.coalesce("computed", F.array().cast("array<string>")))
    only = F.array_except("referenced", F.array_union("declared", "computed"))
    return d.select(
        "capture_id", F.size("referenced").alias("referenced"), F.size(only).alias("reference_only"),
        F.size(F.array_except(only, F.col("computed"))).alias("unresolved"),
        F.size(F.array_except("referenced", F.col("declared"))).alias("not_in_rules"),
    )


def animation_name(chunk: Column) -> Column:
    """Name in one animation of a shorthand: the first word that is no keyword, time, number or
    easing function (functions are cut at their commas and spaces, as the split does)."""
    words = F.filter(F.split(chunk, T.SPACES), lambda w: w != "")
    name = F.get(
        F.filter(
            words,
            lambda w: ~F.lower(w).isin(*ANIMATION_WORDS) & ~w.rlike(r"(?i)^-?[\d.]+m?s$") & ~w.rlike(r"^-?[\d.]+$") & ~w.startswith("cubic-bezier(") & ~w.startswith("steps("),
        ),
        F.lit(0),
    )
    return F.nullif(T.unquote(name), F.lit(""))


def animation_names(declarations: DataFrame) -> DataFrame:
    """(capture_id, seq, ordinal, place, name) of the keyframes that declarations name."""
    property_, chunks = F.lower("name"), F.transform(F.split("value", ","), T.trim)
    listed = F.transform(chunks, lambda c: F.nullif(T.unquote(c), F.lit("none")))
    names = F.when(property_ == "animation-name", listed).when(property_ == "animation", F.transform(chunks, animation_name))
    d = declarations.select("capture_id", "seq", "ordinal", F.posexplode(names).alias("place", "animation"))
    return d.where("animation is not null and animation <> ''").select("capture_id", "seq", "ordinal", "place", F.col("animation").alias("name"))


def resolve_keyframes(names: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Distinct names of a capture with their rule: unprefixed before prefixed, then the last."""
    order = F.struct((~F.col("prefixed")).alias("plain"), F.col("ordinal").alias("o"))
    best = keyframes.groupBy("capture_id", "name").agg(F.max_by("css_text", order).alias("css_text"))
    wanted = names.groupBy("capture_id", "name").agg(F.min(F.struct("seq", "ordinal", "place")).alias("first"))
    found = wanted.join(best, ["capture_id", "name"], "left")
    warning = F.when(F.col("css_text").isNull(), F.concat(F.lit("keyframes-name-undefined:"), F.col("name")))
    place = F.row_number().over(W.partitionBy("capture_id").orderBy("first"))
    return found.select("capture_id", "name", place.alias("place"), "css_text", warning.alias("warning"))


def subtree_only(subtree: DataFrame, root: DataFrame) -> DataFrame:
    """Rules of a subtree that the root does not have, by fingerprint."""
    key = ["capture_id", "fingerprint"]
    return distinct_rules(subtree).join(root.withColumn("fingerprint", fingerprint()).select(*key), key, "left_anti")


def declaration_block(selectors: Column, lines: Column) -> Column:
    """A rule as text: declarations without a name or value, and disabled ones, are left out; null if
    nothing is left, or no selector."""
    shown = F.filter(lines, lambda x: T.present(x["name"]).isNotNull() & T.present(x["value"]).isNotNull() & ~F.coalesce(x["disabled"], F.lit(False)))
    written = F.transform(shown, lambda x: F.concat(F.lit("  "), T.trim(x["name"]), F.lit(": "), T.trim(x["value"]), F.when(F.coalesce(x["important"], F.lit(False)), " !important").otherwise(""), F.lit(";")))
    names = F.filter(F.transform(selectors, T.trim), lambda x: x != "")
    text = F.concat(F.array_join(names, ", "), F.lit(" {\n"), F.array_join(written, "\n"), F.lit("\n}\n"))
    return F.when((F.size(names) > 0) & (F.size(written) > 0), text)


def stylesheet_text(rules: DataFrame, declarations: DataFrame, properties: DataFrame, inline: DataFrame, keyframes: DataFrame) -> DataFrame:
    """CSS text of each capture: custom properties, the picked element's own style, rules, keyframes.

    ``declarations`` (capture_id, seq, ordinal, name, value, important, disabled); ``inline`` the same
    with the picked ``selector`` instead of seq; ``properties`` and ``keyframes`` in order of ordinal.
    """
    line = F.struct("ordinal", "name", "value", "important", "disabled")
    lines = lambda d, *keys: d.groupBy("capture_id", *keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    pair = F.when(T.present(F.col("name")).isNotNull() & T.present(F.col("value")).isNotNull(), F.concat(F.lit("  "), T.trim(F.col("name")), F.lit(": "), T.trim(F.col("value")), F.lit(";\n")))
    own = properties.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce(pair, F.lit("")).alias("t")))).alias("l"))
    part = lambda d, rank, at, text: d.select("capture_id", F.lit(rank).alias("rank"), at.cast("long").alias("at"), text.alias("text"))
    parts = [
        part(own, 0, F.lit(0), F.concat(F.lit(":root {\n"), F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("}\n\n"))),
        part(lines(inline, "selector"), 1, F.lit(0), F.concat(F.coalesce(declaration_block(F.array("selector"), F.col("lines")), F.lit("")), F.lit("\n"))),
        part(lines(declarations, "seq").join(rules, ["capture_id", "seq"]), 2, F.col("seq"), declaration_block(F.col("selectors"), F.col("lines"))),
        part(keyframes, 3, F.col("ordinal"), F.concat(T.present(F.col("css_text")), F.lit("\n\n"))),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("text is not null")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "at", "text")))
    return every.groupBy("capture_id").agg(T.trim(F.array_join(F.transform(ordered, lambda x: x["text"]), "")).alias("css"))


def _blanks(s, d):
    c = X.computed(s, d)
    blank = F.when(F.col("ordinal") == 1, F.lit("  ")).when((F.col("ordinal") == 2) & (F.col("capture_id") % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit(" "), "name", F.lit("\t")))
    return c.select("capture_id", "ordinal", blank.alias("name"), F.concat(F.lit("\u00a0"), "value", F.lit(" ")).alias("value"))


def _runtime(s, d):
    k = X.keyframes(s, d).where("ordinal < 2")
    prefix = F.when(F.col("capture_id") % 2 == 0, F.lit("@-WebKit-keyframes ")).otherwise(F.lit("@keyframes "))
    return runtime_keyframes(k.select("capture_id", "ordinal", "name", F.concat(prefix, F.lit("r"), F.col("ordinal").cast("string")).alias("css_text")))


def _raw_rules(s, d):
    i = F.col("capture_id") + F.col("seq")
    listed = lambda k, *v: F.when(i % k > 0, F.array(*map(F.lit, v)))
    sheet = F.when(i % 6 == 0, F.lit("inspector-inline-sheet-1")).otherwise(F.col("sheet_id"))
    return X.css_rules(s, d).withColumns({"sheet_id": sheet, "media": listed(3, "print", ""), "supports": listed(4, "", "(a: b)"), "layer_text": F.when(i % 2 == 0, F.when(i % 4 == 0, "base").otherwise("")), "layer_name": F.when(i % 5 > 0, "named")})


def _projected(s, d):
    r = rule_projection(_raw_rules(s, d))
    return r.select("capture_id", "seq", "origin", "sheet_id", "inline", F.array_join("media", ",").alias("media"), F.array_join("supports", ",").alias("supports"), "layer")


def _css_text(s, d):
    i = F.col("seq") + F.col("ordinal")
    decls = X.css_declarations(s, d).withColumns({"important": i % 3 == 0, "disabled": i % 5 == 4, "value": F.when(i % 7 == 6, F.lit(" ")).otherwise(F.concat(F.col("value"), F.lit(" ")))})
    inline = decls.where("seq = 1 and capture_id % 3 > 0").drop("seq", "page_url").withColumn("selector", F.concat(F.lit("#t"), F.col("capture_id").cast("string")))
    frames = X.keyframes(s, d).withColumn("css_text", F.when(F.col("ordinal") == 2, F.lit(" ")).otherwise(F.col("css_text")))
    return stylesheet_text(X.css_rules(s, d).select("capture_id", "seq", "selectors"), decls, X.computed(s, d).where("capture_id % 4 > 0"), inline, frames)


QUERIES = {
    "css_rule_dedup": lambda s, d: distinct_rules(X.repeated_rules(s, d)).select("capture_id", "fingerprint", "seq"),
    "css_diagnostics": lambda s, d: diagnostics(X.css_rules(s, d)),
    "custom_property_resolution": lambda s, d: resolve_variables(X.css_declarations(s, d), X.computed(s, d)),
    "custom_property_counts": lambda s, d: variable_counts(X.css_declarations(s, d), X.computed(s, d)),
    "animation_names": lambda s, d: animation_names(X.css_declarations(s, d)),
    "keyframe_resolution": lambda s, d: resolve_keyframes(animation_names(X.css_declarations(s, d)), X.keyframes(s, d)),
    "subtree_only_rules": lambda s, d: subtree_only(X.repeated_rules(s, d), X.css_rules(s, d).where("seq < 2")).select("capture_id", "fingerprint", "seq"),
    "rule_projection": _projected,
    "computed_projection": lambda s, d: computed_projection(_blanks(s, d)),
    "keyframe_sources": lambda s, d: resolve_keyframes(animation_names(X.css_declarations(s, d)), keyframe_sources(X.keyframes(s, d), _runtime(s, d))).select("capture_id", "name", "css_text"),
    "css_text": _css_text,
}

_PRINT = "concat_ws('|', coalesce(origin, ''), coalesce(sheet_id, ''), coalesce(start_line::VARCHAR, ''), coalesce(start_column::VARCHAR, ''), array_to_string(selectors, ',')) AS fingerprint"
_RULES = f"WITH {X.RULES_SQL}, {X.REPEATED_SQL}, r AS (SELECT *, {_PRINT} FROM fx_rules_twice)"
_VARS = f"WITH {X.DECLS_SQL}, {X.COMPUTED_SQL}, refs AS (SELECT DISTINCT capture_id, seq, ordinal, unnest(regexp_extract_all(value, 'var\\(\\s*(--[A-Za-z0-9_-]+)\\s*(?:[,)]|$)', 1)) AS name FROM fx_css_decls), vals AS (SELECT capture_id, name, arg_min(value, ordinal) AS value FROM fx_computed GROUP BY ALL)"
_NAMES = f"WITH {X.DECLS_SQL}, {X.KEYFRAMES_SQL}, names AS (SELECT capture_id, seq, ordinal, 0 AS place, regexp_extract(value, '(\\S+)$', 1) AS name FROM fx_css_decls WHERE name = 'animation')"
ORACLE = {
    "css_rule_dedup": _RULES + " SELECT capture_id, fingerprint, min(seq) AS seq FROM r GROUP BY ALL",
    "css_diagnostics": f"WITH {X.RULES_SQL}, r AS (SELECT * FROM fx_css_rules)" + """ SELECT capture_id, count(*) AS rules, count(DISTINCT sheet_id) AS sheets, count(origin) AS with_origin, count(*) - count(origin) AS without_origin, count(*) FILTER (len(selectors) = 0) AS without_selector,
      count(*) FILTER (origin = 'user-agent') AS user_agent, count(*) FILTER (coalesce(origin, '') <> 'inline' AND (sheet_id IS NULL) <> (source_url IS NULL)) AS incomplete FROM r GROUP BY capture_id""",
    "custom_property_resolution": _VARS + " SELECT capture_id, seq, ordinal, name, coalesce(value, '') AS value, value IS NOT NULL AS resolved FROM refs LEFT JOIN vals USING (capture_id, name)",
    "custom_property_counts": _VARS + """, n AS (SELECT DISTINCT capture_id, name FROM refs), dec AS (SELECT DISTINCT capture_id, name FROM fx_css_decls WHERE name LIKE '--%')
      SELECT n.capture_id, count(*)::INT AS referenced, (count(*) FILTER (d.name IS NULL AND v.name IS NULL))::INT AS reference_only, (count(*) FILTER (d.name IS NULL AND v.name IS NULL))::INT AS unresolved, (count(*) FILTER (d.name IS NULL))::INT AS not_in_rules
      FROM n LEFT JOIN dec d USING (capture_id, name) LEFT JOIN vals v USING (capture_id, name) GROUP BY n.capture_id""",
    "animation_names": _NAMES + " SELECT capture_id, seq, ordinal, place, name FROM names",
    "keyframe_resolution": _NAMES + """, best AS (SELECT capture_id, name, arg_max(css_text, (NOT prefixed)::INT * 100 + ordinal) AS css_text FROM fx_keyframes GROUP BY ALL), w AS (SELECT capture_id, name, min(seq * 100 + ordinal) AS f FROM names GROUP BY ALL)
      SELECT capture_id, name, row_number() OVER (PARTITION BY capture_id ORDER BY f)::INT AS place, css_text, CASE WHEN css_text IS NULL THEN 'keyframes-name-undefined:' || name END AS warning FROM w LEFT JOIN best USING (capture_id, name)""",
    "subtree_only_rules": _RULES + " SELECT capture_id, fingerprint, min(seq) AS seq FROM r WHERE (capture_id, fingerprint) NOT IN (SELECT capture_id, fingerprint FROM r WHERE seq < 2) GROUP BY ALL",
    "rule_projection": f"""WITH {X.RULES_SQL}, i AS (SELECT *, capture_id + seq AS i FROM fx_css_rules), j AS (SELECT * REPLACE (CASE WHEN i % 6 = 0 THEN 'inspector-inline-sheet-1' ELSE sheet_id END AS sheet_id) FROM i)
      SELECT capture_id, seq, coalesce(origin, CASE WHEN i % 6 = 0 THEN 'inline' END) AS origin, sheet_id, coalesce(origin = 'inline', false) OR i % 6 = 0 AS inline, CASE WHEN i % 3 > 0 THEN 'print' ELSE '' END AS media, CASE WHEN i % 4 > 0 THEN '(a: b)' ELSE '' END AS supports,
        CASE WHEN i % 4 = 0 THEN 'base' WHEN i % 5 > 0 THEN 'named' END AS layer FROM j""",
    "computed_projection": f"WITH {X.COMPUTED_SQL} SELECT capture_id, ordinal, name, value FROM fx_computed WHERE ordinal <> 1 AND NOT (ordinal = 2 AND capture_id % 2 = 0)",
    "keyframe_sources": _NAMES + """, rt AS (SELECT capture_id, ordinal + 4 AS ordinal, name, capture_id % 2 = 0 AS prefixed, '@keyframes r' || ordinal AS css_text FROM fx_keyframes WHERE ordinal < 2),
      k AS (SELECT capture_id, ordinal, name, prefixed, css_text FROM fx_keyframes UNION ALL SELECT * FROM rt), best AS (SELECT capture_id, name, arg_max(css_text, (NOT prefixed)::INT * 100 + ordinal) AS css_text FROM k GROUP BY ALL)
      SELECT DISTINCT capture_id, name, css_text FROM names LEFT JOIN best USING (capture_id, name)""",
    "css_text": f"""WITH {X.RULES_SQL}, {X.DECLS_SQL}, {X.COMPUTED_SQL}, {X.KEYFRAMES_SQL},
      l AS (SELECT capture_id, seq, string_agg('  ' || name || ': ' || value || CASE WHEN (seq + ordinal) % 3 = 0 THEN ' !important' ELSE '' END || ';', chr(10) ORDER BY ordinal) AS body FROM fx_css_decls WHERE (seq + ordinal) % 5 <> 4 AND (seq + ordinal) % 7 <> 6 GROUP BY ALL),
      p AS (SELECT capture_id, 0 AS rank, 0 AS at_, ':root {{' || chr(10) || string_agg('  ' || name || ': ' || value || ';' || chr(10), '' ORDER BY ordinal) || '}}' || chr(10) || chr(10) AS t FROM fx_computed WHERE capture_id % 4 > 0 GROUP BY ALL
        UNION ALL SELECT capture_id, 1, 0, '#t' || capture_id || ' {{' || chr(10) || body || chr(10) || '}}' || chr(10) || chr(10) FROM l WHERE seq = 1 AND capture_id % 3 > 0
        UNION ALL SELECT capture_id, 2, seq, array_to_string(selectors, ', ') || ' {{' || chr(10) || body || chr(10) || '}}' || chr(10) FROM l JOIN fx_css_rules USING (capture_id, seq) WHERE len(selectors) > 0
        UNION ALL SELECT capture_id, 3, ordinal, css_text || chr(10) || chr(10) FROM fx_keyframes WHERE ordinal <> 2)
      SELECT capture_id, trim(string_agg(t, '' ORDER BY rank, at_), chr(10) || ' ') AS css FROM p GROUP BY capture_id""",
}
