"""Export decisions: which selector, class and tier, why an export fails, what its HTML holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..sources import fixtures as X
from . import fidelity as Q

#: FIXED VALUES: elements that draw a scene, and words that its layers are named by.
PRIMITIVES = (
    "canvas", "svg", "video", "img", "piece", "square", "cg-board", "cg-container", "model-viewer", "three-model", "spline-viewer", "lottie-player",
    "dotlottie-player", "iframe",
)
LAYERS = ("board", "scene", "canvas", "layer", "sprite", "piece", "square", "viewport", "stage", "overlay", "backdrop")


def target(c: DataFrame) -> DataFrame:
    """Class and mode of an export: a hint first, then whether the candidate is a scene."""
    scene = (F.col("class_hint") == "render-scene") | F.col("scene")
    return c.withColumns(
        {
            "target_class": F.when(F.coalesce(scene, F.lit(False)), "render-scene").otherwise("semantic-ui"),
            "export_mode": F.when(F.coalesce(scene, F.lit(False)), "render-scene-freeze").otherwise("semantic-ui-portable"),
        }
    )


def failure() -> Column:
    """The first reason for which a capsule can't be exported; null if it can."""
    return (
        F.when(~F.col("has_node_mapping"), "replay-capsule-missing")
        .when(F.coalesce("selector", F.lit("")) == "", "selector-missing")
        .when(~F.col("has_css_graph"), "css-graph-missing")
        .when((F.col("rule_count") == 0) & (F.col("inline_count") == 0), "css-rules-empty")
        .when(T.present(F.col("css")).isNull(), "css-serialize-empty")
        .when(~F.col("has_target_subtree") & ~F.col("has_candidate") & (F.col("shadow_roots") > 0), "empty-shell-export")
    )


def tier(ok: Column, quality: Column, fallback_nodes: Column) -> Column:
    """The capsule, unless it failed, or is fragile while the fallback has something."""
    return F.when(ok & ~((quality == "fragile") & (fallback_nodes > 0)), "capsule").otherwise("portable-fallback")


def choose(c: DataFrame) -> DataFrame:
    """Selector, failure, tier, class and mode of each capture's export."""
    selector = F.coalesce(F.when(F.col("has_fingerprint"), F.concat(F.lit("#t"), F.col("capture_id").cast("string"))), F.when(F.col("has_mapped"), F.lit("main > .c")))
    d = Q.capsule_confidence(c).withColumns({"selector": selector, "fallback_nodes": F.col("capture_id") % 3})
    d = target(d.withColumn("failure", failure()))
    return d.withColumn("tier", tier(F.col("failure").isNull(), F.col("quality"), F.col("fallback_nodes")))


def html_counts(html: Column, target_class: Column) -> Column:
    """What an exported fragment holds, scripts aside: elements, text, scene primitives and layers; and
    whether it is an empty shell, looks like a scene, or is too thin to stand for what was picked."""
    shown = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    n = lambda p: F.regexp_count(shown, F.lit(p))
    text = F.length(T.compact(F.regexp_replace(shown, "<[^>]+>", " ")))
    elements, ends = n("<[a-zA-Z][^>]*>"), n("</[a-zA-Z][^>]*>")
    values = lambda name: F.transform(F.regexp_extract_all(shown, F.lit(rf"(?is)\b(?:{name})\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27]"), 1), F.lower)
    named = lambda v: F.exists(F.array(*map(F.lit, LAYERS)), lambda w: F.contains(v, w))
    primitives = n(rf"(?i)<(?:{'|'.join(PRIMITIVES)})(?![a-z0-9_])")
    layers = F.size(F.filter(values("class|id|data-[a-z0-9_-]+"), named))
    absolute = F.size(F.filter(values("style"), lambda v: v.rlike(r"position\s*:\s*absolute")))
    thin = (elements <= 3) & (text <= 8)
    return F.struct(
        elements.alias("elements"), text.alias("text_length"), primitives.alias("primitives"), absolute.alias("absolute_layers"), layers.alias("layer_hints"),
        ((elements <= 1) & (ends <= 1) & (text == 0)).alias("only_shell"), ((primitives + absolute + layers >= 2) | (primitives >= 1)).alias("scene_like"),
        thin.alias("thin"), (thin & (target_class != "render-scene")).alias("fragile"),
    )


def structure_check(html: Column, script: Column) -> Column:
    """Missing parts of an exported artifact: its root, its start-up code, a frame around its content."""
    root = html.contains("data-root=")
    parts = F.array(
        F.when(~root, F.lit("root-missing")),
        F.when(~F.coalesce(script.contains("querySelector("), F.lit(False)), F.lit("bootstrap-missing")),
        F.when(root & ~html.rlike(r"(?is)data-root=[^>]*>\s*<[a-z]"), F.lit("frame-missing")),
    )
    return F.array_compact(parts)


def crop(d: DataFrame) -> DataFrame:
    """Pixel rectangle of a clip: scaled by the device's ratio and rounded, its size kept inside the image."""
    px = lambda c: N.half_up(F.col(c) * F.col("ratio")).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    d = d.withColumns({"crop_x": F.greatest(zero, px("x")), "crop_y": F.greatest(zero, px("y"))})
    inside = lambda size, limit, start: F.least(F.greatest(one, px(size)), F.greatest(one, F.col(limit) - F.col(start)))
    return d.withColumns({"crop_width": inside("width", "image_width", "crop_x"), "crop_height": inside("height", "image_height", "crop_y")})


def screenshot_source(clip: Column, is_bundle: Column, tab: Column) -> Column:
    """Where a component's picture comes from: the capture's own clip, the visible tab, cropped, or nowhere."""
    return F.when(is_bundle & T.present(clip).isNotNull(), "cdp-clip").when(T.present(tab).isNotNull(), "tab-crop").otherwise("none")


#: Order of selectors, for charts in rendered scenes and for all else (fp: the fingerprint's, seed: the seed's).
CHART_ORDER = ("fp_selected", "fp_stable", "seed_selected", "seed_stable", "fp_promoted_selected", "fp_promoted_stable", "graph_selector", "fallback_selector")
ORDER = ("fp_promoted_selected", "fp_promoted_stable", "fp_selected", "fp_stable", "seed_selected", "seed_stable", "graph_selector", "fallback_selector")
CLASSES = ("semantic-leaf", "semantic-shell", "interactive-composite", "noisy-container")


def pick_selector() -> Column:
    """The selector that an export stands under; empty if there is none."""
    first = lambda names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    chart = F.coalesce((F.col("class_hint") == "render-scene") & (F.col("subtype_hint") == "chart-like"), F.lit(False))
    return F.when(chart, first(CHART_ORDER)).otherwise(first(ORDER))


def portable_class() -> Column:
    """Class of an export: the hint, else what the candidate or the subtree say of a scene."""
    says = lambda c, *words: F.coalesce(F.exists(c, lambda w: F.contains(w, F.lit(words[0])) | F.contains(w, F.lit(words[-1]))), F.lit(False))
    return (
        F.when(F.col("class_hint") == "render-scene", "render-scene").when(F.col("class_hint").isin(*CLASSES), F.col("class_hint"))
        .when(F.col("profile") == "scene-like", "render-scene").when(F.col("reconstruction") == "scene-preserving", "render-scene")
        .when(says("candidate_warnings", "scene-like", "scene-preserving"), "render-scene").when(says("subtree_warnings", "scene"), "render-scene").otherwise("semantic-ui")
    )


def export_mode(target_class: Column) -> Column:
    return F.when(target_class == "render-scene", "render-scene-freeze").otherwise("semantic-ui-portable")


def rect(x: Column) -> Column:
    """A rectangle with a positive finite size, else null; positions that are not finite become 0."""
    fin = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != N.dbl(float("inf")))
    ok = fin(x["width"]) & fin(x["height"]) & (x["width"] > 0) & (x["height"] > 0)
    place = lambda v: F.when(fin(v), v).otherwise(N.dbl(0))
    return F.when(ok, F.struct(place(x["x"]).alias("x"), place(x["y"]).alias("y"), x["width"].alias("width"), x["height"].alias("height")))


def viewer(c: DataFrame, mode: str) -> DataFrame:
    """What a viewer shows of a capture: which image, which rectangle, and what is missing."""
    source = F.when(F.col("has_clip"), "clip").when(F.col("has_full_page"), "full").otherwise("none")
    d = c.select("capture_id", source.alias("image_source"), F.coalesce(rect(F.col("clip_rect")), rect(F.col("seed_rect"))).alias("target_rect"), "has_full_page")
    lost = (F.col("image_source") == "full") & F.col("target_rect").isNull()
    warnings = F.array_compact(
        F.array(
            F.when(F.col("image_source") == "none", F.lit("No screenshot available in replay capsule.")),
            F.when(lost, F.lit("Target crop unavailable: missing clipRect/boundingBox.")),
            F.when((F.lit(mode) == "spotlight") & (F.col("image_source") == "clip") & ~F.col("has_full_page"), F.lit("Spotlight context limited: only clipped screenshot is available.")),
            F.when((F.lit(mode) == "crop") & lost, F.lit("Crop mode needs clipRect/boundingBox; showing full screenshot instead.")),
        )
    )
    return d.select("capture_id", "image_source", F.col("target_rect.width").alias("width"), F.col("target_rect.x").alias("x"), warnings.alias("warnings"))


def _viewed(s, d):
    p = F.col("capture_id").cast("double")
    box = lambda x, w: F.struct(x.alias("x"), N.dbl(1).alias("y"), w.alias("width"), N.dbl(5).alias("height"))
    c = X.captures(s, d).withColumns(
        {
            "clip_rect": F.when(F.col("capture_id") % 4 != 0, box(F.when(F.col("capture_id") % 8 == 1, N.dbl(float("nan"))).otherwise(p), p % 3)),
            "seed_rect": F.when(F.col("capture_id") % 7 == 3, box(p, N.dbl(9))),
        }
    )
    return viewer(c, "crop").withColumn("warnings", F.array_join("warnings", "|"))


def _crops(s, d):
    p = F.col("page_id")
    c = s.read.parquet(f"{d}/pages.parquet").select(
        p.alias("capture_id"), (p % 50 - 5).cast("double").alias("x"), (p % 70).cast("double").alias("y"), (p % 90).cast("double").alias("width"), (p % 33 + 1).cast("double").alias("height"),
        (p % 3 + 1).cast("double").alias("ratio"), F.lit(200).cast("long").alias("image_width"), F.lit(100).cast("long").alias("image_height"),
    )
    return crop(c).select("capture_id", "crop_x", "crop_y", "crop_width", "crop_height")


def _picks(s, d):
    p = F.col("page_id")
    given = {n: F.when(p % k == 0, F.concat(F.lit(f"{n}-"), p.cast("string"))).when(p % k == 1, "") for n, k in zip(ORDER, (7, 6, 5, 4, 4, 3, 3, 2))}
    word = lambda k, *w: F.when(p % k == 0, F.array(*map(F.lit, w)))
    cols = {
        **given, "class_hint": F.when(p % 3 == 0, "render-scene").when(p % 8 == 1, "semantic-leaf").when(p % 8 == 2, "other"), "subtype_hint": F.when(p % 2 == 0, "chart-like"),
        "profile": F.when(p % 5 == 1, "scene-like"), "reconstruction": F.when(p % 5 == 2, "scene-preserving"), "candidate_warnings": word(4, "x", "has-scene-like-parts"), "subtree_warnings": word(5, "a-scene-b"),
        "clip": F.when(p % 3 > 0, F.when(p % 3 == 1, "data:c").otherwise(" ")), "tab": F.when(p % 4 > 0, "data:t"),
    }
    d = s.read.parquet(f"{d}/pages.parquet").select(p.alias("capture_id"), *[c.alias(n) for n, c in cols.items()])
    kind = portable_class()
    return d.select("capture_id", pick_selector().alias("selector"), kind.alias("target_class"), export_mode(kind).alias("export_mode"), screenshot_source(F.col("clip"), F.col("capture_id") % 5 > 0, F.col("tab")).alias("picture"))


def _html(s, d):
    p = F.col("page_id")
    # Every fifth page is only its footer, or a shell.
    html = F.when(p % 5 == 0, F.regexp_extract("html", "(?s)<footer.*</footer>", 0)).when(p % 5 == 1, F.lit("<div id='s'><script>x < y</script></div>")).otherwise(F.col("html"))
    kind = F.when(p % 2 == 0, "render-scene").otherwise("semantic-ui")
    return X.varied_pages(s, d).select(p.alias("capture_id"), html_counts(html, kind).alias("h")).select("capture_id", "h.*")


QUERIES = {
    "export_picks": _picks,
    "export_choice": lambda s, d: choose(X.captures(s, d).join(X.exports(s, d).select("capture_id", "class_hint"), "capture_id")).select("capture_id", "selector", "failure", "tier", "target_class", "export_mode"),
    "export_html_counts": _html,
    "screenshot_crop": _crops,
    "viewer_state": _viewed,
}

_GIVEN = {n: f"CASE WHEN page_id % {k} = 0 THEN '{n}-' || page_id END" for n, k in zip(ORDER, (7, 6, 5, 4, 4, 3, 3, 2))}
ORACLE = {
    "export_picks": f"""WITH k AS (SELECT page_id, CASE WHEN page_id % 3 = 0 OR (page_id % 8 <> 1 AND (page_id % 5 IN (0, 1, 2) OR page_id % 4 = 0)) THEN 'render-scene' WHEN page_id % 8 = 1 THEN 'semantic-leaf' ELSE 'semantic-ui' END AS target_class FROM pages)
      SELECT page_id AS capture_id, CASE WHEN page_id % 6 = 0 THEN coalesce({', '.join(_GIVEN[n] for n in CHART_ORDER)}, '') ELSE coalesce({', '.join(_GIVEN[n] for n in ORDER)}, '') END AS selector, target_class,
        CASE WHEN target_class = 'render-scene' THEN 'render-scene-freeze' ELSE 'semantic-ui-portable' END AS export_mode, CASE WHEN page_id % 5 > 0 AND page_id % 3 = 1 THEN 'cdp-clip' WHEN page_id % 4 > 0 THEN 'tab-crop' ELSE 'none' END AS picture FROM k""",
    "export_choice": f"""WITH {X.CAPTURES_SQL}, {X.EXPORTS_SQL}, d AS (SELECT c.*, e.class_hint, CASE WHEN has_fingerprint THEN '#t' || c.capture_id WHEN has_mapped THEN 'main > .c' END AS selector FROM fx_captures c JOIN fx_exports e USING (capture_id)),
      f AS (SELECT *, CASE WHEN NOT has_node_mapping THEN 'replay-capsule-missing' WHEN coalesce(selector, '') = '' THEN 'selector-missing' WHEN NOT has_css_graph THEN 'css-graph-missing' WHEN rule_count = 0 AND inline_count = 0 THEN 'css-rules-empty' WHEN trim(css) = '' THEN 'css-serialize-empty'
        WHEN NOT has_target_subtree AND NOT has_candidate AND shadow_roots > 0 THEN 'empty-shell-export' END AS failure, coalesce(class_hint = 'render-scene', false) OR scene AS is_scene FROM d)
      SELECT capture_id, selector, failure, CASE WHEN failure IS NULL AND NOT (NOT covers_descendants AND capture_id % 3 > 0) THEN 'capsule' ELSE 'portable-fallback' END AS tier, CASE WHEN is_scene THEN 'render-scene' ELSE 'semantic-ui' END AS target_class,
      CASE WHEN is_scene THEN 'render-scene-freeze' ELSE 'semantic-ui-portable' END AS export_mode FROM f""",
    "export_html_counts": f"WITH {X.VARIED_SQL}, " + r"""h AS (SELECT page_id AS capture_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(html, '(?s)<footer.*</footer>') WHEN page_id % 5 = 1 THEN '<div id=''s''><script>x < y</script></div>' ELSE html END AS html FROM vpages),
      t AS (SELECT capture_id, regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g') AS h FROM h),
      tags AS (SELECT capture_id, unnest(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) AS tag FROM t),
      g AS (SELECT capture_id, count(*)::INT AS elements,
          count(*) FILTER (lower(regexp_extract(tag, '^<([a-zA-Z0-9-]+)', 1)) IN ('canvas','svg','video','img','piece','square','cg-board','cg-container','model-viewer','three-model','spline-viewer','lottie-player','dotlottie-player','iframe'))::INT AS primitives,
          count(*) FILTER (regexp_matches(regexp_extract(tag, '\bstyle="([^"]*)"', 1), 'position\s*:\s*absolute'))::INT AS absolute_layers,
          coalesce(sum(len(list_filter(regexp_extract_all(tag, '\b(?:class|id|data-[a-z]+)=["'']([^"'']*)["'']', 1), lambda v: regexp_matches(v, 'board|scene|canvas|layer|sprite|piece|square|viewport|stage|overlay|backdrop')))), 0)::INT AS layer_hints FROM tags GROUP BY ALL),
      c AS (SELECT t.capture_id, elements, primitives, absolute_layers, layer_hints, length(trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')))::INT AS text_length, len(regexp_extract_all(h, '</[a-zA-Z]')) AS ends FROM t JOIN g USING (capture_id))
      SELECT capture_id, elements, text_length, primitives, absolute_layers, layer_hints, elements <= 1 AND ends <= 1 AND text_length = 0 AS only_shell, primitives + absolute_layers + layer_hints >= 2 OR primitives >= 1 AS scene_like,
        elements <= 3 AND text_length <= 8 AS thin, elements <= 3 AND text_length <= 8 AND capture_id % 2 = 1 AS fragile FROM c""",
    "screenshot_crop": """WITH c AS (SELECT page_id AS capture_id, (page_id % 50 - 5)::DOUBLE AS x, (page_id % 70)::DOUBLE AS y, (page_id % 90)::DOUBLE AS width, (page_id % 33 + 1)::DOUBLE AS height, (page_id % 3 + 1)::DOUBLE AS ratio FROM pages),
      s AS (SELECT *, greatest(0, floor(x * ratio + 0.5::DOUBLE)::BIGINT) AS crop_x, greatest(0, floor(y * ratio + 0.5::DOUBLE)::BIGINT) AS crop_y FROM c)
      SELECT capture_id, crop_x, crop_y, least(greatest(1, floor(width * ratio + 0.5::DOUBLE)::BIGINT), greatest(1, 200 - crop_x)) AS crop_width, least(greatest(1, floor(height * ratio + 0.5::DOUBLE)::BIGINT), greatest(1, 100 - crop_y)) AS crop_height FROM s""",
    "viewer_state": f"""WITH {X.CAPTURES_SQL}, v AS (SELECT *, CASE WHEN p % 4 <> 0 AND p % 3 > 0 THEN (p % 3)::DOUBLE WHEN p % 7 = 3 THEN 9::DOUBLE END AS width,
        CASE WHEN p % 4 <> 0 AND p % 3 > 0 THEN CASE WHEN p % 8 = 1 THEN 0::DOUBLE ELSE p::DOUBLE END WHEN p % 7 = 3 THEN p::DOUBLE END AS x, CASE WHEN has_clip THEN 'clip' WHEN has_full_page THEN 'full' ELSE 'none' END AS image_source FROM fx_captures)
      SELECT capture_id, image_source, width, x, concat_ws('|', CASE WHEN image_source = 'none' THEN 'No screenshot available in replay capsule.' END, CASE WHEN image_source = 'full' AND width IS NULL THEN 'Target crop unavailable: missing clipRect/boundingBox.' END,
        CASE WHEN image_source = 'full' AND width IS NULL THEN 'Crop mode needs clipRect/boundingBox; showing full screenshot instead.' END) AS warnings FROM v""",
}
