"""Suites of scenarios: expansion of groups, status, drift against a baseline, text reports, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..sources import fixtures as X
from . import fidelity as Q
from . import htmltree as H
from . import matching as M

#: FIXED VALUES: the scenarios (id, title, expected class, expected subtype), and which are in a matrix.
SCENARIOS = (
    ("google-search-bar", "Google search bar", "semantic-shell", "search-like"),
    ("reddit-header", "Reddit header", "interactive-composite", "generic"),
    ("lichess-board", "Lichess board", "render-scene", "board-like"),
    ("primary-cta-button", "Primary CTA button", "semantic-leaf", "generic"),
    ("login-form-card", "Login form card", "interactive-composite", "form-like"),
    ("marketing-hero-section", "Marketing hero section", "noisy-container", "generic"),
    ("editor-toolbar-cluster", "Editor toolbar cluster", "semantic-shell", "toolbar-like"),
    ("analytics-chart-card", "Analytics chart card", "render-scene", "chart-like"),
    ("pricing-card", "Pricing card", "semantic-shell", "card-like"),
    ("mini-board", "Mini strategy board", "render-scene", "board-like"),
    ("city-map", "City map", "render-scene", "map-like"),
    ("canvas-revenue-chart", "Canvas revenue chart", "render-scene", "chart-like"),
    ("dashboard-hero", "Dashboard hero", "noisy-container", "generic"),
)
LIVE = ("google-search-bar", "reddit-header", "lichess-board")


def _relation(spark: SparkSession, rows, names: tuple[str, ...]) -> DataFrame:
    """Rows of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def registry(spark: SparkSession, scenarios=SCENARIOS, live=LIVE) -> DataFrame:
    """The suite's own scenarios as a table (id, title, target_class, subtype, live)."""
    return _relation(spark, [(*r, r[0] in live) for r in scenarios], ("id", "title", "target_class", "subtype", "live"))


def members(scenarios: DataFrame) -> DataFrame:
    """(name, id): each scenario under its id, its class, its part of the matrix, and what names all."""
    part = F.when(F.coalesce("live", F.lit(False)), F.lit("matrix:core")).otherwise(F.lit("matrix:deterministic"))
    names = F.array("id", F.lit("all"), F.lit("matrix:extended"), F.concat(F.lit("class:"), "target_class"), part)
    return scenarios.select(F.explode(F.array_compact(names)).alias("name"), "id")


def expand(wanted: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Distinct scenarios named by ``name``: an id, a group, or ``all``.  Unknown names raise."""
    names = wanted.select("name").distinct()
    found = names.join(members(scenarios), "name", "left")
    checked = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown scenario: "), "name"))).otherwise(F.col("id"))
    return scenarios.join(found.select(checked.alias("id")).distinct(), "id")


def status(structural_failure: Column, scored: Column) -> Column:
    return F.when(structural_failure, "failed").when(scored, "passed").otherwise("skipped")


def _or_none(x: Column) -> Column:
    return F.coalesce(T.present(x), F.lit("n/a"))


def _difference(name: str, ratio: Column, pixels: Column, same: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.when(ratio.isNull(), "not available").otherwise(F.concat(F.lit("mismatch="), T.fixed(ratio), F.lit(" pixels="), pixels.cast("string"), F.lit(" dimensionsMatch="), same.cast("string"))))


def _structure(name: str, warnings: Column, evidence: Column, kept: Column) -> Column:
    texts = {"warnings": warnings, "evidence": evidence, "preservation": kept}
    full = F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), F.when(F.size(v) > 0, F.array_join(v, ", ")).otherwise("none")) for k, v in texts.items()])
    nothing = (F.size(warnings) <= 0) & (F.size(evidence) <= 0) & (F.size(kept) <= 0)
    return F.concat(F.lit(f"{name}: "), F.when(nothing, "not available").otherwise(full))


def scenario_report(d: DataFrame) -> Column:
    """The text report of one scenario's result; sections without a score are left out."""
    head = {
        "Status": F.col("status"), "URL": F.col("url"), "Selector": _or_none(F.col("selector")), "Original selector": _or_none(F.col("original_selector")),
        "Promoted selector": _or_none(F.col("promoted_selector")), "Promotion reason": _or_none(F.col("promotion_reason")),
        "Promotion path": _or_none(F.array_join("promotion_path", " -> ")), "Export tier": _or_none(F.col("tier")), "Expected target class": _or_none(F.col("expected_class")),
        "Expected target subtype": _or_none(F.col("expected_subtype")), "Target class": _or_none(F.col("target_class")), "Target subtype": _or_none(F.col("target_subtype")),
        "Target class reasons": _or_none(F.array_join("reasons", ", ")), "Started": F.col("started"), "Completed": F.col("completed"),
    }
    lines = [F.lit("Benchmark scenario"), F.concat(F.lit("Scenario: "), "title", F.lit(" ("), "id", F.lit(")"))]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in head.items()]
    lines.append(F.when(F.col("baseline").isNotNull(), F.concat(F.lit("Baseline: "), "baseline", F.lit(" (updated="), F.col("baseline_updated").cast("string"), F.lit(")"))))
    lines.append(F.when(F.col("baseline").isNotNull(), _difference("Baseline drift", F.col("drift_ratio"), F.col("drift_pixels"), F.col("drift_same"))))
    lines += [F.when(F.size(F.col(c)) > 0, F.concat(F.lit(f"{c.capitalize()}: "), F.array_join(c, ", "))) for c in ("warnings", "notes")]
    for part in ("replay", "portable"):
        c = lambda n: F.col(f"{part}_{n}")  # noqa: B023, E731
        section = F.concat_ws(
            "\n", F.lit(""), c("report"), _difference(f"{part.capitalize()} diff", c("ratio"), c("pixels"), c("same")),
            _structure(f"{part.capitalize()} structure", c("warnings"), c("evidence"), c("kept")),
        )
        lines.append(F.when(c("report").isNotNull(), section))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def drift(current: DataFrame, baseline: DataFrame, limit: float = 0.02) -> DataFrame:
    """Each capture against its old baseline: new, same or drifted, and by how much."""
    j = current.join(baseline.select("capture_id", F.col("score").alias("old")), "capture_id", "left")
    by = N.thousandths(F.abs(F.col("score") - F.col("old")))
    state = F.when(F.col("old").isNull(), "new").when(by > limit, "drifted").otherwise("same")
    return j.select("capture_id", "score", "old", by.alias("drift"), state.alias("state"))


def suite(results: DataFrame) -> DataFrame:
    """One row a suite: counts by status and a report line."""
    n = lambda s: F.count_if(F.col("status") == s)
    d = results.groupBy("suite").agg(
        n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"), N.thousandths(F.avg(F.col("score"))).alias("mean_score")
    )
    return d.withColumn("line", F.format_string("passed %d, failed %d, skipped %d", "passed", "failed", "skipped"))


def log_ring(events: DataFrame, size: int = 120) -> DataFrame:
    """The newest rows of a log, newest first; a limit, so no task sorts more than its own part."""
    return events.orderBy(F.desc("seq")).limit(size)


def upsert(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``store`` with the rows of ``changes`` in place of those with their key; other keys stay."""
    return store.join(changes.select(key), key, "left_anti").unionByName(changes)


def warnings_with_stage(stages: dict[str, Column]) -> Column:
    """Warnings of several stages, each with its stage's name, without repeats or blanks."""
    parts = [F.transform(F.coalesce(w, F.array().cast("array<string>")), lambda x: F.when(x != "", x)) for w in stages.values()]
    named = [F.transform(F.array_compact(p), _prefix(name)) for name, p in zip(stages, parts)]
    return F.array_distinct(F.concat(*named))


def _prefix(name: str):
    return lambda x: F.concat(F.lit(f"{name}: "), x)


def _results(s, d):
    c = Q.overall(Q.dimensions(X.captures(s, d)))
    failed, scored = F.col("capture_id") % 11 == 0, F.col("capture_id") % 5 != 0
    return c.select("capture_id", (F.col("capture_id") % 4).alias("suite"), N.score3(F.col("raw_score")).alias("score"), status(failed, scored).alias("status"))


def _drift(s, d):
    now = _results(s, d).select("capture_id", "score")
    old = now.where("capture_id % 6 <> 0").select("capture_id", N.thousandths(F.col("score") - (F.col("capture_id") % 5).cast("double") / 100).alias("score"))
    return drift(now, old)


def _scenario_rows(s, d):
    p = F.col("page_id")
    text = lambda n, t: F.when(p % n != 0, F.concat(F.lit(t), p.cast("string")))
    some = lambda n, *v: F.when(p % n != 0, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    cols = {
        "id": F.concat(F.lit("s"), p.cast("string")), "title": F.concat(F.lit("Page "), p.cast("string")), "status": status(p % 11 == 0, p % 5 != 0), "selector": text(2, "#s"), "original_selector": text(3, "#o"), "promoted_selector": F.lit(" "),
        "promotion_reason": text(4, "why"), "promotion_path": some(3, "a", "b"), "tier": F.lit("capsule"), "expected_class": text(5, "e"), "expected_subtype": F.lit(None).cast("string"), "target_class": text(6, "t"),
        "target_subtype": F.lit("generic"), "reasons": some(2, "r1", "r2"), "started": F.lit("t0"), "completed": F.lit("t1"), "baseline": text(3, "/b/"), "baseline_updated": p % 2 == 0,
        "drift_ratio": F.when(p % 4 > 0, (p % 4).cast("double") / 8), "drift_pixels": p % 7, "drift_same": p % 3 == 1, "warnings": some(5, "w"), "notes": some(2, "n1", "n2"),
        "replay_report": text(2, "R"), "replay_ratio": F.lit(0.5), "replay_pixels": p, "replay_same": F.lit(True), "replay_warnings": some(3, "x"), "replay_evidence": some(4, "y", "z"), "replay_kept": F.array().cast("array<string>"),
        "portable_report": text(3, "P"), "portable_ratio": F.lit(None).cast("double"), "portable_pixels": p, "portable_same": F.lit(False), "portable_warnings": some(7, "q"), "portable_evidence": some(5, "v"), "portable_kept": some(2, "k"),
    }
    return s.read.parquet(f"{d}/pages.parquet").select(p.alias("capture_id"), "url", *[c.alias(n) for n, c in cols.items()])


def _page_scenarios(s, d):
    """Each page as a scenario: its class by its content; pages on secure hosts are live."""
    p = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), F.col("url").alias("title"))
    kinds = M.target_class(H.nodes(H._read(s, d), paths=False)).select("capture_id", "target_class", "subtype")
    rows = p.join(kinds, "capture_id")
    return rows.select(F.concat(F.lit("p"), F.col("capture_id").cast("string")).alias("id"), "title", "target_class", "subtype", F.col("title").startswith("https:").alias("live"))


def _wanted(s, d):
    """One class, the live part, and every tenth page by name."""
    ids = s.read.parquet(f"{d}/pages.parquet").where("page_id % 10 = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"))
    return ids.unionByName(ids.select(F.lit("class:noisy-container").alias("name"))).unionByName(ids.select(F.lit("matrix:core").alias("name")))


QUERIES = {
    "scenario_report": lambda s, d: _scenario_rows(s, d).select("capture_id", scenario_report(None).alias("report")),
    "suite_summary": lambda s, d: suite(_results(s, d)),
    "baseline_drift": _drift,
    "scenario_expansion": lambda s, d: expand(_wanted(s, d), _page_scenarios(s, d)),
    "scenario_groups": lambda s, d: members(_page_scenarios(s, d)).groupBy("name").agg(F.count(F.lit(1)).alias("scenarios")).where("name like '%:%' or name = 'all'"),
    "log_ring": lambda s, d: log_ring(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), "event_type")),
}

_R = Q._SCORED + f""", res AS (SELECT capture_id, capture_id % 4 AS suite, {N.sql_score3('raw_score')} AS score, CASE WHEN capture_id % 11 = 0 THEN 'failed' WHEN capture_id % 5 <> 0 THEN 'passed' ELSE 'skipped' END AS status FROM raw)
"""
ORACLE = {
    "suite_summary": _R + f"""SELECT suite, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, {N.sql_round3('avg(score)')} AS mean_score,
      'passed ' || count(*) FILTER (status = 'passed') || ', failed ' || count(*) FILTER (status = 'failed') || ', skipped ' || count(*) FILTER (status = 'skipped') AS line FROM res GROUP BY suite""",
    "baseline_drift": _R + f""", o AS (SELECT capture_id, {N.sql_round3('score - (capture_id % 5)::DOUBLE / 100')} AS old FROM res WHERE capture_id % 6 <> 0),
      j AS (SELECT capture_id, score, old, {N.sql_round3('abs(score - old)')} AS drift FROM res LEFT JOIN o USING (capture_id)) SELECT *, CASE WHEN old IS NULL THEN 'new' WHEN drift > 0.02::DOUBLE THEN 'drifted' ELSE 'same' END AS state FROM j""",
    "scenario_expansion": f"""SELECT 'p' || c.capture_id AS id, url AS title, target_class, subtype, starts_with(url, 'https:') AS live FROM ({M.ORACLE["target_class"]}) c JOIN pages ON page_id = capture_id
      WHERE target_class = 'noisy-container' OR starts_with(url, 'https:') OR page_id % 10 = 0""",
    "scenario_groups": f"""WITH c AS (SELECT capture_id, target_class, starts_with(url, 'https:') AS live FROM ({M.ORACLE["target_class"]}) t JOIN pages ON page_id = capture_id)
      SELECT 'class:' || target_class AS name, count(*) AS scenarios FROM c GROUP BY ALL UNION ALL SELECT 'matrix:' || CASE WHEN live THEN 'core' ELSE 'deterministic' END, count(*) FROM c GROUP BY ALL
      UNION ALL SELECT unnest(['all', 'matrix:extended']), (SELECT count(*) FROM c)""",
    "scenario_report": """WITH p AS (SELECT page_id AS i, url FROM pages),
      h AS (SELECT i, 'Benchmark scenario' || chr(10) || 'Scenario: Page ' || i || ' (s' || i || ')' || chr(10) || 'Status: ' || CASE WHEN i % 11 = 0 THEN 'failed' WHEN i % 5 <> 0 THEN 'passed' ELSE 'skipped' END || chr(10) || 'URL: ' || url || chr(10) || 'Selector: ' || CASE WHEN i % 2 = 0 THEN 'n/a' ELSE '#s' || i END || chr(10)
        || 'Original selector: ' || CASE WHEN i % 3 = 0 THEN 'n/a' ELSE '#o' || i END || chr(10) || 'Promoted selector: n/a' || chr(10) || 'Promotion reason: ' || CASE WHEN i % 4 = 0 THEN 'n/a' ELSE 'why' || i END || chr(10) || 'Promotion path: ' || CASE WHEN i % 3 = 0 THEN 'n/a' ELSE 'a -> b' END || chr(10) || 'Export tier: capsule' || chr(10)
        || 'Expected target class: ' || CASE WHEN i % 5 = 0 THEN 'n/a' ELSE 'e' || i END || chr(10) || 'Expected target subtype: n/a' || chr(10) || 'Target class: ' || CASE WHEN i % 6 = 0 THEN 'n/a' ELSE 't' || i END || chr(10) || 'Target subtype: generic' || chr(10) || 'Target class reasons: ' || CASE WHEN i % 2 = 0 THEN 'n/a' ELSE 'r1, r2' END || chr(10) || 'Started: t0' || chr(10) || 'Completed: t1' AS t FROM p),
      x AS (SELECT i, t || CASE WHEN i % 3 <> 0 THEN chr(10) || 'Baseline: /b/' || i || ' (updated=' || (i % 2 = 0) || ')' || chr(10) || 'Baseline drift: ' || CASE i % 4 WHEN 0 THEN 'not available' WHEN 1 THEN 'mismatch=0.125' WHEN 2 THEN 'mismatch=0.250' ELSE 'mismatch=0.375' END || CASE WHEN i % 4 > 0 THEN ' pixels=' || i % 7 || ' dimensionsMatch=' || (i % 3 = 1) ELSE '' END ELSE '' END
        || CASE WHEN i % 5 <> 0 THEN chr(10) || 'Warnings: w' ELSE '' END || CASE WHEN i % 2 <> 0 THEN chr(10) || 'Notes: n1, n2' ELSE '' END
        || CASE WHEN i % 2 <> 0 THEN chr(10) || chr(10) || 'R' || i || chr(10) || 'Replay diff: mismatch=0.500 pixels=' || i || ' dimensionsMatch=true' || chr(10) || 'Replay structure: ' || CASE WHEN i % 3 = 0 AND i % 4 = 0 AND i % 1000000000 = 0 THEN 'not available' WHEN i % 3 = 0 AND i % 4 = 0 THEN 'not available' ELSE 'warnings=' || CASE WHEN i % 3 = 0 THEN 'none' ELSE 'x' END || ' | evidence=' || CASE WHEN i % 4 = 0 THEN 'none' ELSE 'y, z' END || ' | preservation=none' END ELSE '' END
        || CASE WHEN i % 3 <> 0 THEN chr(10) || chr(10) || 'P' || i || chr(10) || 'Portable diff: not available' || chr(10) || 'Portable structure: ' || CASE WHEN i % 7 = 0 AND i % 5 = 0 AND i % 2 = 0 THEN 'not available' ELSE 'warnings=' || CASE WHEN i % 7 = 0 THEN 'none' ELSE 'q' END || ' | evidence=' || CASE WHEN i % 5 = 0 THEN 'none' ELSE 'v' END || ' | preservation=' || CASE WHEN i % 2 = 0 THEN 'none' ELSE 'k' END END ELSE '' END || chr(10) AS report FROM h)
      SELECT i AS capture_id, report FROM x""",
    "log_ring": "SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 120",
}
