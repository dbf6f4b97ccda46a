"""The whole capture plan: pages, their trees and traces to one scored, exportable row a capture.

    traces ─ link ─ count ─────────────┐
    pages ── parse ─ match ── mapping ─┤
             └────── candidate ────────┼─ wide row ─ dimensions ─ overall ─ adjust ─ report
    resource and style graphs ─────────┘

Every stage is a DataFrame function; the wide row is built by joins on capture_id of tables already
reduced to one row a capture, so no join here multiplies rows.  Catalyst plans all of it at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import fidelity, matching, resources, shadow, styles, timeline
from ..sources import fixtures, traces


def wide(spark: SparkSession, sf_dir: str, tolerance_ms: int = timeline.LINK_MS) -> DataFrame:
    """One row a page with everything that scoring reads, measured where the tables allow it."""
    base = fixtures.captures(spark, sf_dir).drop(
        "actions", "mutations", "linked", "total", "has_mapped", "mapping_confidence", "rule_count", "closed_roots", "shadow_roots", "assets", "required_assets",
        "required_unresolved", "optional_unresolved", "resource_nodes",
    )
    events = timeline.counts(timeline.link_mutations(traces.read(spark, sf_dir), tolerance_ms))
    mapped = matching._matched(spark, sf_dir).select(
        "capture_id", F.col("resolved").alias("has_mapped"), F.col("confidence").alias("mapping_confidence")
    )
    rules = styles.diagnostics(fixtures.css_rules(spark, sf_dir)).select("capture_id", F.col("rules").alias("rule_count"))
    roots = shadow.diagnostics(shadow.merge_sheets(fixtures.shadow_roots(spark, sf_dir), fixtures.shadow_sheets(spark, sf_dir)))
    roots = roots.select("capture_id", F.col("closed").alias("closed_roots"), F.col("roots").alias("shadow_roots"))
    graph = resources.nodes(resources.references(spark, sf_dir))
    bad = F.col("fetch_mode") == "unresolved"
    assets = graph.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if("required").alias("required_assets"),
        F.count_if(F.col("required") & bad).alias("required_unresolved"), F.count_if(~F.col("required") & bad).alias("optional_unresolved"),
    )
    out = base
    for part in (events, mapped, rules, roots, assets):
        out = out.join(part, "capture_id", "left")
    counts = ["actions", "mutations", "linked", "total", "rule_count", "closed_roots", "shadow_roots", "assets", "required_assets", "required_unresolved", "optional_unresolved"]
    filled = {c: F.coalesce(c, F.lit(0)) for c in counts}
    return out.withColumns({**filled, "resource_nodes": F.coalesce("assets", F.lit(0)), "has_mapped": F.coalesce("has_mapped", F.lit(False)), "mapping_confidence": F.coalesce("mapping_confidence", F.lit(0.0))})


def scored(spark: SparkSession, sf_dir: str, tolerance_ms: int = timeline.LINK_MS) -> DataFrame:
    """Dimensions, overall and adjusted scores of every capture."""
    dims = fidelity.overall(fidelity.dimensions(wide(spark, sf_dir, tolerance_ms)))
    return fidelity.adjust(dims.join(fixtures.exports(spark, sf_dir), "capture_id"))


def _query(spark, sf_dir):
    d = scored(spark, sf_dir, timeline.CHECK_LINK_MS)
    return d.select("capture_id", *[f"{k}_score" for k in fidelity.SCORE_WEIGHTS], N.score3(F.col("raw_score")).alias("overall"), "overall_score", "overall_confidence", "gate")


QUERIES = {"capture_plan": _query}

#: The twin reads the twins of the plan's parts.
_P = dict((("events", timeline.ORACLE["interaction_score"]), ("mapped", matching.ORACLE["fingerprint_match"]), ("rules", styles.ORACLE["css_diagnostics"]), ("roots", shadow.ORACLE["shadow_diagnostics"]), ("graph", resources.ORACLE["resource_nodes"])))
_WIDE = f"""WITH {fixtures.CAPTURES_SQL}, {fixtures.EXPORTS_SQL},
g AS (SELECT capture_id, count(*) AS n, count(*) FILTER (required) AS req, count(*) FILTER (required AND fetch_mode = 'unresolved') AS rbad, count(*) FILTER (NOT required AND fetch_mode = 'unresolved') AS obad FROM ({_P['graph']}) GROUP BY capture_id),
own AS (SELECT c.* REPLACE (coalesce(e.actions, 0) AS actions, coalesce(e.mutations, 0) AS mutations, coalesce(e.linked, 0) AS linked, coalesce(e.total, 0) AS total, coalesce(m.resolved, false) AS has_mapped,
    coalesce(m.confidence, 0::DOUBLE) AS mapping_confidence, coalesce(r.rules, 0) AS rule_count, coalesce(s.closed, 0) AS closed_roots, coalesce(s.roots, 0) AS shadow_roots, coalesce(g.n, 0) AS assets, coalesce(g.req, 0) AS required_assets,
    coalesce(g.rbad, 0) AS required_unresolved, coalesce(g.obad, 0) AS optional_unresolved, coalesce(g.n, 0) AS resource_nodes)
  FROM fx_captures c LEFT JOIN ({_P['events']}) e USING (capture_id) LEFT JOIN ({_P['mapped']}) m USING (capture_id) LEFT JOIN ({_P['rules']}) r USING (capture_id) LEFT JOIN ({_P['roots']}) s USING (capture_id) LEFT JOIN g USING (capture_id))"""
_TAIL = fidelity._SCORED[fidelity._SCORED.index("dims AS (") :].replace("FROM fx_captures", "FROM own")
ORACLE = {
    "capture_plan": _WIDE + ",\n" + _TAIL + "SELECT capture_id, visual_score, interaction_score, asset_score, structure_score, " + N.sql_score3("raw_score") + " AS overall, overall_score, overall_confidence, gate FROM scored",
}
