"""Fidelity of a capture: four dimensions, their weighted overall, and what an export does to it.

Every operator is a projection of one wide capture row (``sources.fixtures.captures``): no shuffle.
Sums are added in the order the rules are listed, so the third decimal is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..sources import fixtures as X
from . import timeline as TL

#: FIXED VALUES: weights of the dimensions in the overall score and confidence.
SCORE_WEIGHTS = {"visual": 0.38, "interaction": 0.24, "asset": 0.2, "structure": 0.18}
CONFIDENCE_WEIGHTS = {"visual": 0.34, "interaction": 0.26, "asset": 0.2, "structure": 0.2}
SCORE_BANDS = [(0.9, "excellent"), (0.75, "strong"), (0.6, "usable"), (0.4, "fragile")]
CONFIDENCE_BANDS = [(0.85, "high confidence"), (0.65, "moderate confidence")]


def total(base: float, *parts: tuple[Column, float | Column]) -> Column:
    """``base`` plus each part whose condition holds, in order.

    Every sum stands once in the expression; a ``when`` over the sums would double it at each part.
    """
    out = N.dbl(base)
    for when, x in parts:
        out = out + F.when(when, N.dbl(x)).otherwise(N.dbl(0))
    return out


def listed(*parts: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, distinct and in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in parts])))


def _n(text: str, x: Column) -> Column:
    return F.concat(F.lit(text), x.cast("string"))


def visual(c: DataFrame) -> DataFrame:
    full, clip = F.col("has_full_page"), F.col("has_clip")
    shot, rules, inline = full | clip, F.col("rule_count") > 0, F.col("inline_count") > 0
    frames = F.col("has_keyframes") & F.col("has_css_graph")
    dom, degraded, ratio = F.col("has_dom_snapshot"), F.col("degraded"), F.col("mismatch_ratio")
    diff = ratio.isNotNull()
    score = total(0.16, (shot, 0.3), (~shot, -0.1), (clip, 0.07), (rules, 0.24), (~rules, -0.08), (inline, 0.07), (frames, 0.08), (dom, 0.1), (degraded, -0.08))
    mixed = score * N.dbl(0.45) + (N.dbl(1) - N.clamp(ratio)) * N.dbl(0.55)
    score = F.when(diff, F.when(~F.col("dimensions_match"), mixed - N.dbl(0.08)).otherwise(mixed)).otherwise(score)
    confidence = total(0.34, (shot, 0.2), (~shot, -0.12), (clip, 0.06), (rules, 0.2), (~rules, -0.1), (inline, 0.05), (dom, 0.08), (degraded, -0.1), (diff, 0.24))
    warnings = listed(
        (~shot, "visual-screenshot-missing"),
        (~rules, "visual-css-rules-missing"),
        (~frames, "visual-keyframes-missing"),
        (~dom, "visual-dom-snapshot-missing"),
        (degraded, "visual-css-provenance-degraded"),
        (diff & ~F.col("dimensions_match"), "visual-pixel-diff-dimensions-mismatch"),
        (ratio > 0.15, "visual-pixel-diff-high-mismatch"),
        ((ratio > 0) & (ratio <= 0.15), "visual-pixel-diff-nonzero-mismatch"),
    )
    evidence = listed(
        (shot, "visual-screenshot-captured"),
        (clip, "visual-target-clip-captured"),
        (rules, _n("visual-css-rules:", F.col("rule_count"))),
        (inline, _n("visual-inline-style-declarations:", F.col("inline_count"))),
        (dom, "visual-dom-snapshot-present"),
        (diff, _n("visual-pixel-diff-pixels:", F.col("mismatch_pixels"))),
    )
    return _with(c, "visual", score, confidence, evidence, warnings)


def interaction(c: DataFrame) -> DataFrame:
    d = TL.interaction_dimension(c)
    return d.withColumnsRenamed({k: f"interaction_{k}" for k in ("score", "confidence", "evidence", "warnings")})


def asset(c: DataFrame) -> DataFrame:
    graph, n = F.col("has_resource_graph"), F.col("assets")
    req, req_bad, opt_bad = F.col("required_assets"), F.col("required_unresolved"), F.col("optional_unresolved")
    share = lambda good, of: F.try_divide(good.cast("double"), of.cast("double"))
    coverage = share(n - (req_bad + opt_bad), n)
    required = F.when(req > 0, share(req - req_bad, req)).otherwise(coverage)
    some, nodes = n > 0, F.col("resource_nodes") > 0
    score = F.when(some, N.dbl(0.25) + coverage * N.dbl(0.45) + required * N.dbl(0.3)).when(nodes, N.dbl(0.5)).otherwise(N.dbl(0.38))
    confidence = F.when(some, N.dbl(0.45) + N.dbl(0.2)).when(nodes, N.dbl(0.35)).otherwise(N.dbl(0.28))
    warned = F.col("graph_warnings") > 0
    confidence = F.when(warned, confidence - F.least(N.dbl(0.2), F.col("graph_warnings").cast("double") * N.dbl(0.05))).otherwise(confidence)
    warnings = listed(
        (~graph, "assets-resource-graph-missing"),
        (graph & ~some & nodes, "assets-bundler-assets-missing"),
        (graph & ~some & ~nodes, "assets-resource-evidence-thin"),
        (graph & (req_bad > 0), _n("assets-required-unresolved:", req_bad)),
        (graph & (opt_bad > 0), _n("assets-optional-unresolved:", opt_bad)),
        (graph & warned, "assets-resource-graph-warnings-present"),
    )
    evidence = listed(
        (graph & some, _n("assets-bundle-assets:", n)),
        (graph & some, _n("assets-required-unresolved:", req_bad)),
        (graph & ~some & nodes, _n("assets-resource-nodes:", F.col("resource_nodes"))),
    )
    return _with(c, "asset", F.when(graph, score).otherwise(N.dbl(0.25)), F.when(graph, confidence).otherwise(N.dbl(0.2)), evidence, warnings)


def structure(c: DataFrame) -> DataFrame:
    mapped = F.col("has_node_mapping") & F.col("has_mapped")
    # A confidence of 0 counts as unknown.
    sure = N.clamp(F.coalesce(F.nullif(F.col("mapping_confidence"), F.lit(0.0)), N.dbl(0.5)))
    dom, mark, raw, cand, shadow = (F.col(f"has_{k}") for k in ("dom_snapshot", "fingerprint", "target_subtree", "candidate", "shadow_topology"))
    closed = shadow & (F.col("closed_roots") > 0)
    n = F.col("closed_roots").cast("double")
    score = total(0.25, (mapped, N.dbl(0.2) + sure * N.dbl(0.25)), (dom, 0.2), (mark, 0.08), (raw, 0.08), (cand, 0.12), (shadow, 0.1), (closed, -F.least(N.dbl(0.12), n * N.dbl(0.03))))
    confidence = total(0.35, (mapped, sure * N.dbl(0.25)), (dom, 0.1), (mark, 0.1), (raw, 0.06), (cand, 0.1), (shadow, 0.08), (closed, -F.least(N.dbl(0.1), n * N.dbl(0.02))))
    warnings = listed(
        (~mapped, "structure-node-mapping-unresolved"),
        (~dom, "structure-dom-snapshot-missing"),
        (~mark, "structure-target-fingerprint-missing"),
        (~raw, "structure-target-subtree-missing"),
        (~cand, "structure-candidate-subtree-missing"),
        (closed, _n("structure-closed-shadow-roots:", F.col("closed_roots"))),
    )
    evidence = listed((mark, "structure-target-fingerprint-present"), (shadow, _n("structure-shadow-roots:", F.col("shadow_roots"))))
    return _with(c, "structure", score, confidence, evidence, warnings)


def _with(c: DataFrame, name: str, score: Column, confidence: Column, evidence: Column, warnings: Column) -> DataFrame:
    return c.withColumns(
        {f"{name}_score": N.score3(score), f"{name}_confidence": N.score3(confidence), f"{name}_evidence": evidence, f"{name}_warnings": warnings}
    )


def dimensions(c: DataFrame) -> DataFrame:
    return structure(asset(interaction(visual(c))))


def overall(c: DataFrame) -> DataFrame:
    """``c`` with raw_score and raw_confidence: weighted sums of the rounded dimensions."""

    def weighted(weights: dict[str, float], what: str) -> Column:
        out = None
        for k, w in weights.items():
            term = F.col(f"{k}_{what}") * N.dbl(w)
            out = term if out is None else out + term
        return out

    return c.withColumns({"raw_score": weighted(SCORE_WEIGHTS, "score"), "raw_confidence": weighted(CONFIDENCE_WEIGHTS, "confidence")})


PRESERVED = "replay-capsule-preservation-reason:"


def adjust(c: DataFrame) -> DataFrame:
    """The overall under an export's diagnostics (same row): blend, floors and caps, then gates."""
    p = N.clamp(F.coalesce(F.col("confidence"), N.dbl(1) - F.col("confidence_penalty"), F.col("raw_score")))
    c = c.withColumn("portable_confidence", p)
    p = F.col("portable_confidence")
    w = F.col("warnings")
    has = lambda x: F.array_contains(w, F.lit(x))
    reasons = F.transform(F.filter(w, lambda x: x.startswith(PRESERVED)), lambda x: F.substring(x, len(PRESERVED) + 1, 10_000))
    scene = F.col("target_class") == "render-scene"
    hint, sub = F.coalesce("class_hint", F.lit("")), F.coalesce("subtype_hint", F.lit(""))
    capsule = F.col("source") == "replay-capsule"

    recovered = F.exists(reasons, lambda r: r.isin("frame-chain-selector-hint-recovered", "scene-frame-hints-recovered"))
    wrapped = F.exists(reasons, lambda r: (r == "semantic-wrapper-hints-recovered") | r.startswith("semantic-wrapper-depth-recovered:"))
    deep = F.exists(w, lambda x: x.contains("semantic-wrapper-depth-recovered"))
    empty = has("replay-capsule-empty-shell-export")
    shell = empty | ((F.coalesce("output_quality", F.lit("")) == "fragile") & ~scene)
    bare, thin = has("replay-capsule-shadow-metadata-without-content"), has("replay-capsule-html-structurally-thin")
    fragile = ~shell & ((~scene & (bare | (p < 0.25) | thin)) | (scene & ~has("replay-capsule-scene-html-validated") & bare))

    # (condition, floor and cap of the score, floor and cap of the confidence), in order.  A step's cap
    # comes before its floor; floors are never over the export's own confidence.
    steps = [
        (~capsule, None, 0.82, None, 0.8),
        (scene & capsule, 0.58, None, 0.58, 0.72),
        (scene & (sub == "board-like"), 0.64, None, 0.62, None),
        (recovered, 0.62, None, 0.6, None),
        (wrapped, 0.58, None, 0.56, None),
        ((hint == "semantic-shell") & (sub == "search-like"), 0.66, None, 0.62, None),
        ((hint == "interactive-composite") & (sub == "form-like"), 0.61, None, 0.58, None),
        (hint == "semantic-leaf", None, 0.88, None, None),
        ((hint == "semantic-leaf") & deep, None, None, None, 0.72),
        (shell, None, 0.28, None, 0.22),
        (fragile & scene, None, 0.52, None, 0.44),
        (fragile & ~scene, None, 0.42, None, 0.35),
    ]
    s = F.col("raw_score") * N.dbl(0.85) + p * N.dbl(0.15)
    k = F.least(F.col("raw_confidence"), N.clamp(p + N.dbl(0.15)))

    def bound(x: Column, when: Column, floor: float | None, cap: float | None) -> Column:
        # least and greatest pass over nulls, so a bound whose condition fails changes nothing.
        x = x if cap is None else F.least(x, F.when(when, N.dbl(cap)))
        return x if floor is None else F.greatest(x, F.when(when, F.least(p, N.dbl(floor))))

    for when, s_floor, s_cap, k_floor, k_cap in steps:
        s, k = bound(s, when, s_floor, s_cap), bound(k, when, k_floor, k_cap)
    gate = F.when(shell, "portable-output-empty-shell-gated").when(fragile & scene, "portable-output-scene-fragile-gated").when(fragile, "portable-output-fragile-gated")
    return c.withColumns({"overall_score": N.score3(s), "overall_confidence": N.score3(k), "gate": gate})


def capsule_confidence(c: DataFrame) -> DataFrame:
    """Penalty and confidence of an export from a replay capsule, and its quality."""
    raw, covers = F.col("has_target_subtree"), F.col("covers_descendants")
    unresolved = F.col("required_unresolved")
    shadow = F.col("has_shadow_topology") & (F.col("shadow_roots") > 0)
    penalty = total(
        0.14,
        (~raw, 0.18),
        (raw & (F.col("text_length") == 0) & ~F.col("scene"), 0.06),
        (shadow, 0.06),
        (F.col("has_resource_graph") & (unresolved > 0), F.least(N.dbl(0.35), unresolved.cast("double") * N.dbl(0.08))),
        (~F.col("has_keyframes"), 0.04),
        (~F.col("has_fingerprint"), 0.12),
        (~F.col("has_resource_graph"), 0.18),
        (~covers, 0.18),
    )
    penalty = N.clamp(penalty, 0, 0.92)
    return c.withColumns(
        {
            "penalty": N.thousandths(penalty),
            "export_confidence": N.thousandths(N.clamp(N.dbl(1) - penalty, 0.08, 1)),
            "quality": F.when(covers, "portable").otherwise("fragile"),
        }
    )


def fallback_confidence(stats: DataFrame) -> DataFrame:
    """Penalty and confidence of the fallback export from its counters."""
    n = lambda c: F.col(c).cast("double")
    capped = lambda c, cap, each: (F.col(c) > 0, F.least(N.dbl(cap), n(c) * N.dbl(each)))
    penalty = total(
        0.32,
        capped("shadow_hosts", 0.2, 0.04),
        capped("removed_attributes", 0.1, 0.002),
        capped("asset_failures", 0.2, 0.03),
        (F.col("pseudo_rules") == 0, 0.02),
        (F.col("keyframe_rules") == 0, 0.02),
        (F.col("nodes") > 160, 0.05),
    )
    penalty = N.clamp(penalty, 0, 0.92)
    return stats.withColumns({"penalty": N.thousandths(penalty), "export_confidence": N.thousandths(N.clamp(N.dbl(1) - penalty, 0.08, 1))})


def missing_artifacts(c: DataFrame) -> DataFrame:
    """Comma-joined parts that a capsule lacks, in fixed order."""
    parts = [
        (~(F.col("has_full_page") | F.col("has_clip")), "screenshot"),
        (~F.col("has_dom_snapshot"), "domSnapshot"),
        (~F.col("has_node_mapping"), "nodeMapping"),
        (~F.col("has_css_graph"), "cssGraph"),
        (~F.col("has_shadow_topology"), "shadowTopology"),
        (~F.col("has_target_subtree"), "targetSubtree"),
        (~F.col("has_candidate"), "candidateSubtree"),
        (~F.col("has_resource_graph"), "resourceGraph"),
    ]
    return c.select("capture_id", F.array_join(listed(*parts), ",").alias("missing"))


def report(c: DataFrame) -> DataFrame:
    """A text report of each scored capture."""
    line = lambda name, s, k: F.concat(F.lit(f"{name}: "), F.format_string("%.3f", s), F.lit(" ("), N.band(s, SCORE_BANDS, "poor"), F.lit(", "), N.band(k, CONFIDENCE_BANDS, "low confidence"), F.lit(")"))
    lines = [line("overall", F.col("overall_score"), F.col("overall_confidence"))]
    lines += [line(k, F.col(f"{k}_score"), F.col(f"{k}_confidence")) for k in SCORE_WEIGHTS]
    return c.select("capture_id", F.concat_ws("\n", *lines).alias("report"))


def _captures(s, d):
    return X.captures(s, d)


def _scored(s, d):
    return adjust(overall(dimensions(_captures(s, d))).join(X.exports(s, d), "capture_id"))


def _dim(f, name):
    def run(s, d):
        return f(_captures(s, d)).select("capture_id", f"{name}_score", f"{name}_confidence", F.array_join(f"{name}_evidence", ",").alias("evidence"), F.array_join(f"{name}_warnings", ",").alias("warnings"))

    return run


def _stats(s, d):
    p = F.col("page_id")
    return s.read.parquet(f"{d}/pages.parquet").select(
        p.alias("capture_id"), (p % 7).alias("shadow_hosts"), (p % 60).alias("removed_attributes"), (p % 9).alias("asset_failures"),
        (p % 2).alias("pseudo_rules"), (p % 3).alias("keyframe_rules"), (p % 5 * 50).alias("nodes"),
    )


QUERIES = {
    "visual_score": _dim(visual, "visual"),
    "asset_score": _dim(asset, "asset"),
    "structural_score": _dim(structure, "structure"),
    "overall_fidelity": lambda s, d: overall(dimensions(_captures(s, d))).select("capture_id", N.score3(F.col("raw_score")).alias("score"), N.score3(F.col("raw_confidence")).alias("confidence")),
    "portable_adjustment": lambda s, d: _scored(s, d).select("capture_id", "overall_score", "overall_confidence", "gate"),
    "capsule_confidence": lambda s, d: capsule_confidence(_captures(s, d)).select("capture_id", "penalty", "export_confidence", "quality"),
    "fallback_confidence": lambda s, d: fallback_confidence(_stats(s, d)).select("capture_id", "penalty", "export_confidence"),
    "missing_artifacts": lambda s, d: missing_artifacts(_captures(s, d)),
    "fidelity_report": lambda s, d: report(_scored(s, d)),
}


def _sum(base: str, *parts: tuple[str, str]) -> str:
    out = f"{base}::DOUBLE"
    for when, x in parts:
        out = f"({out} + CASE WHEN {when} THEN {x}::DOUBLE ELSE 0::DOUBLE END)"
    return out


_SHOT = "(has_full_page OR has_clip)"
_FRAMES = "(has_keyframes AND has_css_graph)"
_VS = _sum("0.16", (_SHOT, "0.3"), (f"NOT {_SHOT}", "(-0.1)"), ("has_clip", "0.07"), ("rule_count > 0", "0.24"), ("NOT rule_count > 0", "(-0.08)"), ("inline_count > 0", "0.07"), (_FRAMES, "0.08"), ("has_dom_snapshot", "0.1"), ("degraded", "(-0.08)"))
_VM = f"({_VS} * 0.45::DOUBLE + (1::DOUBLE - greatest(0::DOUBLE, least(1::DOUBLE, mismatch_ratio))) * 0.55::DOUBLE)"
_VSCORE = N.sql_score3(f"CASE WHEN mismatch_ratio IS NULL THEN {_VS} WHEN NOT dimensions_match THEN {_VM} - 0.08::DOUBLE ELSE {_VM} END")
_VCONF = N.sql_score3(_sum("0.34", (_SHOT, "0.2"), (f"NOT {_SHOT}", "(-0.12)"), ("has_clip", "0.06"), ("rule_count > 0", "0.2"), ("NOT rule_count > 0", "(-0.1)"), ("inline_count > 0", "0.05"), ("has_dom_snapshot", "0.08"), ("degraded", "(-0.1)"), ("mismatch_ratio IS NOT NULL", "0.24")))
_COV = "((assets - (required_unresolved + optional_unresolved))::DOUBLE / nullif(assets, 0)::DOUBLE)"
_REQ = f"CASE WHEN required_assets > 0 THEN (required_assets - required_unresolved)::DOUBLE / required_assets::DOUBLE ELSE {_COV} END"
_ASCORE = N.sql_score3(f"CASE WHEN NOT has_resource_graph THEN 0.25::DOUBLE WHEN assets > 0 THEN 0.25::DOUBLE + {_COV} * 0.45::DOUBLE + ({_REQ}) * 0.3::DOUBLE WHEN resource_nodes > 0 THEN 0.5::DOUBLE ELSE 0.38::DOUBLE END")
_AC = "CASE WHEN assets > 0 THEN 0.45::DOUBLE + 0.2::DOUBLE WHEN resource_nodes > 0 THEN 0.35::DOUBLE ELSE 0.28::DOUBLE END"
_ACONF = N.sql_score3(f"CASE WHEN NOT has_resource_graph THEN 0.2::DOUBLE WHEN graph_warnings > 0 THEN ({_AC}) - least(0.2::DOUBLE, graph_warnings::DOUBLE * 0.05::DOUBLE) ELSE {_AC} END")
_SURE = "greatest(0::DOUBLE, least(1::DOUBLE, coalesce(nullif(mapping_confidence, 0::DOUBLE), 0.5::DOUBLE)))"
_MAP, _CLOSED = "(has_node_mapping AND has_mapped)", "(has_shadow_topology AND closed_roots > 0)"
_SSCORE = N.sql_score3(_sum("0.25", (_MAP, f"(0.2::DOUBLE + {_SURE} * 0.25::DOUBLE)"), ("has_dom_snapshot", "0.2"), ("has_fingerprint", "0.08"), ("has_target_subtree", "0.08"), ("has_candidate", "0.12"), ("has_shadow_topology", "0.1"), (_CLOSED, "(-least(0.12::DOUBLE, closed_roots::DOUBLE * 0.03::DOUBLE))")))
_SCONF = N.sql_score3(_sum("0.35", (_MAP, f"({_SURE} * 0.25::DOUBLE)"), ("has_dom_snapshot", "0.1"), ("has_fingerprint", "0.1"), ("has_target_subtree", "0.06"), ("has_candidate", "0.1"), ("has_shadow_topology", "0.08"), (_CLOSED, "(-least(0.1::DOUBLE, closed_roots::DOUBLE * 0.02::DOUBLE))")))


def _texts(*parts: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in parts) + ")"


_VIS = f"""SELECT capture_id, {_VSCORE} AS visual_score, {_VCONF} AS visual_confidence, {_texts((_SHOT, "'visual-screenshot-captured'"), ("has_clip", "'visual-target-clip-captured'"), ("rule_count > 0", "'visual-css-rules:' || rule_count"),
  ("inline_count > 0", "'visual-inline-style-declarations:' || inline_count"), ("has_dom_snapshot", "'visual-dom-snapshot-present'"), ("mismatch_ratio IS NOT NULL", "'visual-pixel-diff-pixels:' || mismatch_pixels"))} AS evidence,
  {_texts((f"NOT {_SHOT}", "'visual-screenshot-missing'"), ("rule_count = 0", "'visual-css-rules-missing'"), (f"NOT {_FRAMES}", "'visual-keyframes-missing'"), ("NOT has_dom_snapshot", "'visual-dom-snapshot-missing'"), ("degraded", "'visual-css-provenance-degraded'"),
  ("mismatch_ratio IS NOT NULL AND NOT dimensions_match", "'visual-pixel-diff-dimensions-mismatch'"), ("mismatch_ratio > 0.15::DOUBLE", "'visual-pixel-diff-high-mismatch'"), ("mismatch_ratio > 0 AND mismatch_ratio <= 0.15::DOUBLE", "'visual-pixel-diff-nonzero-mismatch'"))} AS warnings FROM fx_captures"""
_AST = f"""SELECT capture_id, {_ASCORE} AS asset_score, {_ACONF} AS asset_confidence, {_texts(("has_resource_graph AND assets > 0", "'assets-bundle-assets:' || assets"), ("has_resource_graph AND assets > 0", "'assets-required-unresolved:' || required_unresolved"),
  ("has_resource_graph AND assets = 0 AND resource_nodes > 0", "'assets-resource-nodes:' || resource_nodes"))} AS evidence, {_texts(("NOT has_resource_graph", "'assets-resource-graph-missing'"), ("has_resource_graph AND assets = 0 AND resource_nodes > 0", "'assets-bundler-assets-missing'"),
  ("has_resource_graph AND assets = 0 AND resource_nodes = 0", "'assets-resource-evidence-thin'"), ("has_resource_graph AND required_unresolved > 0", "'assets-required-unresolved:' || required_unresolved"), ("has_resource_graph AND optional_unresolved > 0", "'assets-optional-unresolved:' || optional_unresolved"),
  ("has_resource_graph AND graph_warnings > 0", "'assets-resource-graph-warnings-present'"))} AS warnings FROM fx_captures"""
_STR = f"""SELECT capture_id, {_SSCORE} AS structure_score, {_SCONF} AS structure_confidence, {_texts(("has_fingerprint", "'structure-target-fingerprint-present'"), ("has_shadow_topology", "'structure-shadow-roots:' || shadow_roots"))} AS evidence,
  {_texts((f"NOT {_MAP}", "'structure-node-mapping-unresolved'"), ("NOT has_dom_snapshot", "'structure-dom-snapshot-missing'"), ("NOT has_fingerprint", "'structure-target-fingerprint-missing'"), ("NOT has_target_subtree", "'structure-target-subtree-missing'"),
  ("NOT has_candidate", "'structure-candidate-subtree-missing'"), (_CLOSED, "'structure-closed-shadow-roots:' || closed_roots"))} AS warnings FROM fx_captures"""

_SCORED = f"""WITH {X.CAPTURES_SQL}, {X.EXPORTS_SQL},
dims AS (SELECT capture_id, {_VSCORE} AS visual_score, {_VCONF} AS visual_confidence, {TL.SCORE_SQL} AS interaction_score, {TL.CONFIDENCE_SQL} AS interaction_confidence,
  {_ASCORE} AS asset_score, {_ACONF} AS asset_confidence, {_SSCORE} AS structure_score, {_SCONF} AS structure_confidence FROM fx_captures),
raw AS (SELECT *, visual_score * 0.38::DOUBLE + interaction_score * 0.24::DOUBLE + asset_score * 0.2::DOUBLE + structure_score * 0.18::DOUBLE AS raw_score,
  visual_confidence * 0.34::DOUBLE + interaction_confidence * 0.26::DOUBLE + asset_confidence * 0.2::DOUBLE + structure_confidence * 0.2::DOUBLE AS raw_confidence FROM dims),
a0 AS (SELECT r.*, e.*, greatest(0::DOUBLE, least(1::DOUBLE, coalesce(confidence, 1::DOUBLE - confidence_penalty, raw_score))) AS p, target_class = 'render-scene' AS is_scene,
  list_contains(warnings, 'replay-capsule-empty-shell-export') OR (coalesce(output_quality, '') = 'fragile' AND target_class <> 'render-scene') AS shell,
  list_contains(warnings, 'replay-capsule-shadow-metadata-without-content') AS bare, list_contains(warnings, 'replay-capsule-html-structurally-thin') AS thin, list_contains(warnings, 'replay-capsule-scene-html-validated') AS valid
  FROM raw r JOIN fx_exports e USING (capture_id)),
a1 AS (SELECT *, raw_score * 0.85::DOUBLE + p * 0.15::DOUBLE AS s, least(raw_confidence, greatest(0::DOUBLE, least(1::DOUBLE, p + 0.15::DOUBLE))) AS k,
  NOT shell AND ((NOT is_scene AND (bare OR p < 0.25::DOUBLE OR thin)) OR (is_scene AND NOT valid AND bare)) AS fragile FROM a0)"""
_STEPS = [
    ("source <> 'replay-capsule'", "least(s, 0.82::DOUBLE)", "least(k, 0.8::DOUBLE)"),
    ("is_scene AND source = 'replay-capsule'", "greatest(s, least(p, 0.58::DOUBLE))", "greatest(least(k, 0.72::DOUBLE), least(p, 0.58::DOUBLE))"),
    ("is_scene AND subtype_hint = 'board-like'", "greatest(s, least(p, 0.64::DOUBLE))", "greatest(k, least(p, 0.62::DOUBLE))"),
    ("array_to_string(warnings, ',') LIKE '%reason:frame-chain-selector-hint-recovered%'", "greatest(s, least(p, 0.62::DOUBLE))", "greatest(k, least(p, 0.6::DOUBLE))"),
    ("array_to_string(warnings, ',') LIKE '%reason:semantic-wrapper-%'", "greatest(s, least(p, 0.58::DOUBLE))", "greatest(k, least(p, 0.56::DOUBLE))"),
    ("class_hint = 'semantic-shell' AND subtype_hint = 'search-like'", "greatest(s, least(p, 0.66::DOUBLE))", "greatest(k, least(p, 0.62::DOUBLE))"),
    ("class_hint = 'interactive-composite' AND subtype_hint = 'form-like'", "greatest(s, least(p, 0.61::DOUBLE))", "greatest(k, least(p, 0.58::DOUBLE))"),
    ("class_hint = 'semantic-leaf'", "least(s, 0.88::DOUBLE)", "k"),
    ("class_hint = 'semantic-leaf' AND array_to_string(warnings, ',') LIKE '%depth-recovered%'", "s", "least(k, 0.72::DOUBLE)"),
    ("shell", "least(s, 0.28::DOUBLE)", "least(k, 0.22::DOUBLE)"),
    ("fragile AND is_scene", "least(s, 0.52::DOUBLE)", "least(k, 0.44::DOUBLE)"),
    ("fragile AND NOT is_scene", "least(s, 0.42::DOUBLE)", "least(k, 0.35::DOUBLE)"),
]
for _i, (_w, _a, _b) in enumerate(_STEPS):
    _SCORED += f",\na{_i + 2} AS (SELECT * EXCLUDE (s, k), CASE WHEN {_w} THEN {_a} ELSE s END AS s, CASE WHEN {_w} THEN {_b} ELSE k END AS k FROM a{_i + 1})"
_SCORED += f""",
scored AS (SELECT *, {N.sql_score3('s')} AS overall_score, {N.sql_score3('k')} AS overall_confidence,
  CASE WHEN shell THEN 'portable-output-empty-shell-gated' WHEN fragile AND is_scene THEN 'portable-output-scene-fragile-gated' WHEN fragile THEN 'portable-output-fragile-gated' END AS gate FROM a{len(_STEPS) + 1})
"""


def _line(name: str) -> str:
    s, k = f"{name}_score", f"{name}_confidence"
    return f"""'{name}: ' || format('{{:.3f}}', {s}) || ' (' || CASE WHEN {s} >= 0.9::DOUBLE THEN 'excellent' WHEN {s} >= 0.75::DOUBLE THEN 'strong' WHEN {s} >= 0.6::DOUBLE THEN 'usable' WHEN {s} >= 0.4::DOUBLE THEN 'fragile' ELSE 'poor' END
  || ', ' || CASE WHEN {k} >= 0.85::DOUBLE THEN 'high confidence' WHEN {k} >= 0.65::DOUBLE THEN 'moderate confidence' ELSE 'low confidence' END || ')'"""


_PEN = _sum("0.14", ("NOT has_target_subtree", "0.18"), ("has_target_subtree AND text_length = 0 AND NOT scene", "0.06"), ("has_shadow_topology AND shadow_roots > 0", "0.06"), ("has_resource_graph AND required_unresolved > 0", "least(0.35::DOUBLE, required_unresolved::DOUBLE * 0.08::DOUBLE)"), ("NOT has_keyframes", "0.04"), ("NOT has_fingerprint", "0.12"), ("NOT has_resource_graph", "0.18"), ("NOT covers_descendants", "0.18"))
_FPEN = _sum("0.32", ("page_id % 7 > 0", "least(0.2::DOUBLE, (page_id % 7)::DOUBLE * 0.04::DOUBLE)"), ("page_id % 60 > 0", "least(0.1::DOUBLE, (page_id % 60)::DOUBLE * 0.002::DOUBLE)"), ("page_id % 9 > 0", "least(0.2::DOUBLE, (page_id % 9)::DOUBLE * 0.03::DOUBLE)"), ("page_id % 2 = 0", "0.02"), ("page_id % 3 = 0", "0.02"), ("page_id % 5 * 50 > 160", "0.05"))


def _confidences(penalty: str) -> str:
    p = f"least(0.92::DOUBLE, greatest(0::DOUBLE, {penalty}))"
    return f"{N.sql_round3(p)} AS penalty, {N.sql_round3(f'least(1::DOUBLE, greatest(0.08::DOUBLE, 1::DOUBLE - {p}))')} AS export_confidence"


ORACLE = {
    "visual_score": f"WITH {X.CAPTURES_SQL} {_VIS}",
    "asset_score": f"WITH {X.CAPTURES_SQL} {_AST}",
    "structural_score": f"WITH {X.CAPTURES_SQL} {_STR}",
    "overall_fidelity": _SCORED + f"SELECT capture_id, {N.sql_score3('raw_score')} AS score, {N.sql_score3('raw_confidence')} AS confidence FROM raw",
    "portable_adjustment": _SCORED + "SELECT capture_id, overall_score, overall_confidence, gate FROM scored",
    "capsule_confidence": f"WITH {X.CAPTURES_SQL} SELECT capture_id, {_confidences(_PEN)}, CASE WHEN covers_descendants THEN 'portable' ELSE 'fragile' END AS quality FROM fx_captures",
    "fallback_confidence": f"SELECT page_id AS capture_id, {_confidences(_FPEN)} FROM pages",
    "missing_artifacts": f"""WITH {X.CAPTURES_SQL} SELECT capture_id, {_texts((f"NOT {_SHOT}", "'screenshot'"), ("NOT has_dom_snapshot", "'domSnapshot'"), ("NOT has_node_mapping", "'nodeMapping'"), ("NOT has_css_graph", "'cssGraph'"),
  ("NOT has_shadow_topology", "'shadowTopology'"), ("NOT has_target_subtree", "'targetSubtree'"), ("NOT has_candidate", "'candidateSubtree'"), ("NOT has_resource_graph", "'resourceGraph'"))} AS missing FROM fx_captures""",
    "fidelity_report": _SCORED + "SELECT capture_id, concat_ws(chr(10), " + ", ".join(_line(n) for n in ("overall", *SCORE_WEIGHTS)) + ") AS report FROM scored",
}
