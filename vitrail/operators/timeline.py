"""Timelines of a session: normalised traces, their merge, and which action caused which mutation.

Order is (at_ms, actions first, seq).  ``seq`` is the order of arrival, so every sort is total.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..sources import traces as S

#: How long after an action a mutation still counts as caused by it (ms).
LINK_MS = 1400
#: The driver's events are hours apart; its checks link within six hours.
CHECK_LINK_MS = 21_600_000
ACTION_BUFFER, MUTATION_BUFFER, HOVER_MS = 180, 240, 120
#: Width of the spans in which long sessions are sorted.
SPAN_MS = 86_400_000
TAGS, PREVIEW = 6, 140

#: FIXED VALUES: labels of actions and transitions, and the attributes of visual states.
ACTION_LABELS = {"click": "Click", "hover": "Hover", "input": "Input", "focus": "Focus", "keyboard": "Keyboard"}
TRANSITION_LABELS = {
    "input-sync": "Mutation (input sync)",
    "structure-update": "Mutation (structure)",
    "content-update": "Mutation (content)",
    "visual-state": "Mutation (visual state)",
    "attribute-update": "Mutation",
}
STATE_ATTRIBUTES = ("class", "style", "open", "hidden", "disabled", "checked", "selected")
TRACEABLE = (*STATE_ATTRIBUTES, "value", "role", "tabindex", "src", "href")


def link_mutations(traces: DataFrame, tolerance_ms: int = LINK_MS) -> DataFrame:
    """``traces`` with action_type, action_at_ms and action_seq of the last action that is no hover,
    at most ``tolerance_ms`` before a mutation (null: none).

    An as-of join without one task a session: time is cut into spans of the tolerance, and each
    action also stands in the span after its own.  A mutation's cause is in its span or the one
    before, so windows run over (session, span) and stay small in sessions of any length.
    """
    span = F.floor(F.col("at_ms") / F.lit(max(1, tolerance_ms))).cast("long")
    cause = (F.col("kind") == S.ACTION) & (F.col("type") != "hover")
    place = lambda at, copy: F.struct(at.alias("_span"), F.lit(copy).alias("_copy"))
    places = F.when(cause, F.array(place(span, False), place(span + 1, True))).otherwise(F.array(place(span, False)))
    rows = traces.select("*", F.inline(places))
    w = (
        W.partitionBy("capture_id", "_span")
        .orderBy("at_ms", F.when(F.col("kind") == S.ACTION, 0).otherwise(1), "seq")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    last = F.last(F.when(cause, F.struct("type", "at_ms", "seq")), ignorenulls=True).over(w)
    near = (F.col("kind") == S.MUTATION) & (F.col("at_ms") - F.col("_a.at_ms") <= tolerance_ms)
    found = rows.withColumn("_a", last).where("not _copy")
    return found.select(
        *traces.columns,
        F.when(near, F.col("_a.type")).alias("action_type"),
        F.when(near, F.col("_a.at_ms")).alias("action_at_ms"),
        F.when(near, F.col("_a.seq")).alias("action_seq"),
    )


def transition(kind: Column, attribute: Column, action: Column) -> Column:
    """What a mutation means; the first that fits."""
    state = attribute.isin(*STATE_ATTRIBUTES) | attribute.startswith("aria-") | attribute.startswith("data-state")
    synced = (action == "input") & ((kind == "characterData") | (attribute == "value"))
    return (
        F.when(synced, "input-sync")
        .when(kind == "childList", "structure-update")
        .when(kind == "characterData", "content-update")
        .when(state, "visual-state")
        .otherwise("attribute-update")
    )


def label(kind: Column, type_: Column, change: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in {**ACTION_LABELS, **TRANSITION_LABELS}.items() for x in kv])
    return F.try_element_at(table, F.when(kind == S.ACTION, type_).otherwise(change))


def project(linked: DataFrame) -> DataFrame:
    """Timeline rows: whole times, transition, label, and a payload without absent fields."""
    change = F.when(F.col("kind") == S.MUTATION, transition(F.col("type"), F.col("attribute_name"), F.col("action_type")))
    tags = F.slice(F.transform("added_tag_names", F.lower), 1, TAGS)
    text = lambda c: F.col(c).cast("string")
    mutation = F.col("kind") == S.MUTATION
    fields = {
        "type": F.col("type"),
        "transition": F.col("transition"),
        "selector": F.nullif(F.col("selector"), F.lit("")),
        "tagName": F.nullif(F.lower("tag_name"), F.lit("")),
        "attributeName": F.nullif(F.col("attribute_name"), F.lit("")),
        "addedNodes": text("added_nodes"),
        "removedNodes": text("removed_nodes"),
        "actionType": F.when(mutation, F.col("action_type")),
        "actionAtMs": F.when(mutation, text("action_at_ms")),
        "value": F.substring(X.compact(F.col("value")), 1, PREVIEW),
        "addedTagNames": F.nullif(F.array_join("tags", ","), F.lit("")),
    }
    rows = linked.withColumns({"transition": change, "tags": tags, "at_ms": N.whole_ms(F.col("at_ms").cast("double"))})
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull())
    return rows.select(
        "capture_id", "seq", "kind", "at_ms", "transition",
        label(F.col("kind"), F.col("type"), F.col("transition")).alias("label"),
        F.map_from_entries(entries).alias("payload"),
        "action_seq",
    )


def merge(timeline: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """``timeline`` with position, the place of each row in its session's merged timeline.

    Rows are numbered inside spans of time; a span begins after the rows of all earlier ones, which
    are summed over one row a span.  So a session of any length is sorted in many tasks.
    """
    span = F.floor(F.col("at_ms") / F.lit(span_ms)).cast("long")
    t = timeline.withColumn("_span", span)
    earlier = W.partitionBy("capture_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    sizes = t.groupBy("capture_id", "_span").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("capture_id", "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    w = W.partitionBy("capture_id", "_span").orderBy("at_ms", F.when(F.col("kind") == S.ACTION, 0).otherwise(1), "seq")
    placed = t.join(starts, ["capture_id", "_span"]).withColumn("position", (F.row_number().over(w) + F.col("_start")).cast("int"))
    return placed.select(*timeline.columns, "position")


def trailing(traces: DataFrame, actions: int = ACTION_BUFFER, mutations: int = MUTATION_BUFFER) -> DataFrame:
    """The last rows of each kind that a session's bounded buffers hold.

    Ranked with a limit: Spark cuts each task's rows of a session before the shuffle.
    """
    w = W.partitionBy("capture_id", "kind").orderBy(F.desc("seq"))
    ranked = traces.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(actions, mutations))
    return ranked.where((F.col("kind") == S.MUTATION) & (F.col("_r") <= mutations) | (F.col("kind") == S.ACTION) & (F.col("_r") <= actions)).drop("_r")


def together(actions: DataFrame, mutations: DataFrame) -> DataFrame:
    """One timeline of two tables with columns of their own: what a side lacks is null there."""
    return actions.withColumn("kind", F.lit(S.ACTION)).unionByName(mutations.withColumn("kind", F.lit(S.MUTATION)), allowMissingColumns=True)


def recordings(events: DataFrame, actions: int = ACTION_BUFFER, mutations: int = MUTATION_BUFFER, span: int = 50_000) -> DataFrame:
    """What each closed recording of a session holds: the last rows of each kind between a start and the
    stop that follows it, with times since the start.

    ``events`` are traces with ``control``: ``start``, ``stop`` or null.  Rows outside a recording are
    ignored; a second start drops what the first one had; a recording that never stops gives nothing.

    Starts are counted in spans of ``seq``, and the counts of earlier spans added, so a session of any
    length is many small windows; the newest rows are taken with a limit, which Spark applies before the
    shuffle.
    """
    starts = F.when(F.col("control") == "start", 1).otherwise(0)
    spans = events.withColumn("_span", F.floor(F.col("seq") / span).cast("long"))
    in_span = W.partitionBy("capture_id", "_span").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("_n").over(W.partitionBy("capture_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    earlier = spans.groupBy("capture_id", "_span").agg(F.sum(starts).alias("_n")).select("capture_id", "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = spans.withColumn("_own", F.sum(starts).over(in_span)).join(earlier, ["capture_id", "_span"])
    numbered = numbered.withColumn("recording", F.col("_own") + F.col("_before")).where("recording > 0").drop("_span", "_own", "_before")
    bounds = numbered.groupBy("capture_id", "recording").agg(
        F.min(F.when(F.col("control") == "start", F.col("at_ms"))).alias("began"), F.min(F.when(F.col("control") == "stop", F.col("seq"))).alias("stop")
    )
    held = numbered.where("control is null").join(bounds.where("stop is not null"), ["capture_id", "recording"]).where("seq < stop")
    held = held.withColumn("at_ms", F.greatest(F.lit(0).cast("long"), F.col("at_ms") - F.col("began")))
    newest = W.partitionBy("capture_id", "recording", "kind").orderBy(F.desc("seq"))
    ranked = held.withColumn("_r", F.row_number().over(newest))
    kept = ranked.where((F.col("_r") <= max(actions, mutations)) & (F.col("_r") <= F.when(F.col("kind") == S.ACTION, actions).otherwise(mutations)))
    return kept.select("capture_id", F.col("recording").cast("int").alias("recording"), "kind", "seq", "type", "at_ms")


def with_controls(traces: DataFrame, every: int = 40) -> DataFrame:
    """``traces`` with the control rows that test inputs have: by the row's number."""
    at = F.col("seq") % every
    return traces.withColumn("control", F.when(at.isin(1, 2), "start").when(at.isin(every - 1, every - 9), "stop"))


def throttle_hovers(traces: DataFrame, pause_ms: int = HOVER_MS) -> DataFrame:
    """Hovers that are recorded: another target than the last recorded one, and ``pause_ms`` after it.

    Whether a row is kept depends on rows kept before it, so a session is read in order.  Sessions
    are sorted by Spark (which spills) and streamed through a fold that holds one row a session.
    """
    hovers = traces.where((F.col("kind") == S.ACTION) & (F.col("type") == "hover")).select("capture_id", "at_ms", "seq", "selector")
    parts = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = hovers.repartition(parts, "capture_id").sortWithinPartitions("capture_id", "at_ms", "seq")

    def fold(batches):
        session = at = target = None
        for b in batches:
            keep = []
            for c, t, s in zip(b["capture_id"].to_pylist(), b["at_ms"].to_pylist(), b["selector"].to_pylist()):
                if c != session:
                    session, at, target = c, None, None
                kept = s != target and (at is None or t - at >= pause_ms)
                if kept:
                    at, target = t, s
                keep.append(kept)
            yield b.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(fold, hovers.schema)


def counts(linked: DataFrame) -> DataFrame:
    """Actions, mutations, linked mutations and all events of each session."""
    action, mutation = F.col("kind") == S.ACTION, F.col("kind") == S.MUTATION
    return linked.groupBy("capture_id").agg(
        F.count_if(action).alias("actions"),
        F.count_if(mutation).alias("mutations"),
        F.count_if(mutation & F.col("action_seq").isNotNull()).alias("linked"),
        F.count(F.lit(1)).alias("total"),
    )


def interaction_dimension(counted: DataFrame) -> DataFrame:
    """``counted`` with the interaction score, confidence, evidence and warnings."""
    a, m, k, n = (F.col(c) for c in ("actions", "mutations", "linked", "total"))

    def add(base: float, *parts: tuple[Column, float]) -> Column:
        out = N.dbl(base)
        for when, x in parts:
            out = out + F.when(when, N.dbl(x)).otherwise(N.dbl(0))
        return N.score3(out)

    some = lambda c: c > 0
    evidence = [
        F.when(some(a), F.format_string("interaction-action-events:%d", a)),
        F.when(some(m), F.format_string("interaction-mutation-events:%d", m)),
        F.when(some(a) & some(m), F.lit("interaction-action-mutation-coverage")),
        F.when(some(k), F.format_string("interaction-linked-mutations:%d", k)),
        F.when(n > 8, F.format_string("interaction-event-volume:%d", n)),
    ]
    warnings = [
        F.when(~some(a), F.lit("interaction-action-timeline-missing")),
        F.when(~some(m), F.lit("interaction-mutation-timeline-missing")),
        F.when(some(m) & ~some(k), F.lit("interaction-mutations-unlinked")),
        F.when(n == 0, F.lit("interaction-timeline-empty")),
    ]
    return counted.withColumns(
        {
            "score": add(0.1, (some(a), 0.38), (some(m), 0.34), (some(a) & some(m), 0.1), (some(k), 0.08), (n > 8, 0.05)),
            "confidence": add(0.3, (some(a), 0.16), (some(m), 0.16), (some(a) & some(m), 0.08), (some(k), 0.06), (n > 8, 0.04), (n == 0, -0.15)),
            "evidence": F.array_compact(F.array(*evidence)),
            "warnings": F.array_compact(F.array(*warnings)),
        }
    )


def _linked(spark, sf_dir):
    return link_mutations(S.read(spark, sf_dir), CHECK_LINK_MS)


def _q_projection(spark, sf_dir):
    p = project(_linked(spark, sf_dir))
    sorted_payload = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return p.select("capture_id", "seq", "kind", "at_ms", "label", sorted_payload.alias("payload"))


def _q_asof(spark, sf_dir):
    return _linked(spark, sf_dir).where(F.col("kind") == S.MUTATION).select("capture_id", "seq", "at_ms", "action_type", "action_at_ms", "action_seq")


def _q_transition(spark, sf_dir):
    p = project(_linked(spark, sf_dir)).where("transition is not null")
    return p.groupBy("transition", "label").agg(F.count(F.lit(1)).alias("n"))


def _q_interaction(spark, sf_dir):
    d = interaction_dimension(counts(_linked(spark, sf_dir)))
    return d.select("capture_id", "actions", "mutations", "linked", "total", "score", "confidence", F.array_join("evidence", ",").alias("evidence"), F.array_join("warnings", ",").alias("warnings"))


def _sides(s, d):
    t = S.read(s, d)
    return t.where(F.col("kind") == S.ACTION).select("capture_id", "seq", "type", "value"), t.where(F.col("kind") == S.MUTATION).select("capture_id", "seq", "type", "attribute_name", "added_nodes")


QUERIES = {
    "timeline_union": lambda s, d: together(*_sides(s, d)),
    "recording_sessions": lambda s, d: recordings(with_controls(S.read(s, d), 25), 3, 4, 60),
    "interaction_score": _q_interaction,
    "mutation_action_asof": _q_asof,
    "mutation_transition": _q_transition,
    "trace_projection": _q_projection,
    "timeline_merge": lambda s, d: merge(project(_linked(s, d))).select("capture_id", "seq", "kind", "at_ms", "position"),
    "trace_ring_buffer": lambda s, d: trailing(S.read(s, d), 20, 12).select("capture_id", "kind", "seq", "at_ms"),
    "hover_throttle": lambda s, d: throttle_hovers(S.read(s, d), 3_600_000),
}

_LINKED = f"""WITH {S.SQL},
linked AS (
  SELECT *, CASE WHEN kind = 'mutation' AND at_ms - a.at_ms <= {CHECK_LINK_MS} THEN a END AS act FROM (
    SELECT *, last_value(CASE WHEN kind = 'action-trace' AND type <> 'hover' THEN {{'type': type, 'at_ms': at_ms, 'seq': seq}} END IGNORE NULLS) OVER (
      PARTITION BY capture_id ORDER BY at_ms, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM traces)),
shown AS (
  SELECT *, CASE WHEN kind = 'mutation' THEN CASE
      WHEN act.type = 'input' AND (type = 'characterData' OR attribute_name = 'value') THEN 'input-sync'
      WHEN type = 'childList' THEN 'structure-update' WHEN type = 'characterData' THEN 'content-update'
      WHEN attribute_name IN ('class', 'style', 'open', 'hidden', 'disabled', 'checked', 'selected') OR attribute_name LIKE 'aria-%' OR attribute_name LIKE 'data-state%' THEN 'visual-state'
      ELSE 'attribute-update' END END AS transition FROM linked),
named AS (
  SELECT *, CASE coalesce(transition, type) WHEN 'click' THEN 'Click' WHEN 'hover' THEN 'Hover' WHEN 'input' THEN 'Input' WHEN 'input-sync' THEN 'Mutation (input sync)'
      WHEN 'structure-update' THEN 'Mutation (structure)' WHEN 'content-update' THEN 'Mutation (content)' WHEN 'visual-state' THEN 'Mutation (visual state)' ELSE 'Mutation' END AS label FROM shown)
"""

_COUNTS = """, c AS (SELECT capture_id, count(*) FILTER (kind = 'action-trace') AS actions, count(*) FILTER (kind = 'mutation') AS mutations,
  count(*) FILTER (kind = 'mutation' AND act IS NOT NULL) AS linked, count(*) AS total FROM linked GROUP BY capture_id)"""

SCORE_SQL = N.sql_score3(
    "((((0.1::DOUBLE + CASE WHEN actions > 0 THEN 0.38 ELSE 0 END::DOUBLE) + CASE WHEN mutations > 0 THEN 0.34 ELSE 0 END::DOUBLE)"
    " + CASE WHEN actions > 0 AND mutations > 0 THEN 0.1 ELSE 0 END::DOUBLE) + CASE WHEN linked > 0 THEN 0.08 ELSE 0 END::DOUBLE) + CASE WHEN total > 8 THEN 0.05 ELSE 0 END::DOUBLE"
)
CONFIDENCE_SQL = N.sql_score3(
    "(((((0.3::DOUBLE + CASE WHEN actions > 0 THEN 0.16 ELSE 0 END::DOUBLE) + CASE WHEN mutations > 0 THEN 0.16 ELSE 0 END::DOUBLE)"
    " + CASE WHEN actions > 0 AND mutations > 0 THEN 0.08 ELSE 0 END::DOUBLE) + CASE WHEN linked > 0 THEN 0.06 ELSE 0 END::DOUBLE) + CASE WHEN total > 8 THEN 0.04 ELSE 0 END::DOUBLE)"
    " - CASE WHEN total = 0 THEN 0.15 ELSE 0 END::DOUBLE"
)

ORACLE = {
    "timeline_union": f"WITH {S.SQL} SELECT capture_id, seq, type, value, kind, CASE WHEN kind = 'mutation' THEN attribute_name END AS attribute_name, CASE WHEN kind = 'mutation' THEN added_nodes END AS added_nodes FROM traces",
    "recording_sessions": f"""WITH {S.SQL}, c AS (SELECT *, CASE WHEN seq % 25 IN (1, 2) THEN 'start' WHEN seq % 25 IN (24, 16) THEN 'stop' END AS control FROM traces),
      n AS (SELECT *, sum((coalesce(control, '') = 'start')::INT) OVER (PARTITION BY capture_id ORDER BY seq) AS recording FROM c), b AS (SELECT capture_id, recording, min(at_ms) FILTER (control = 'start') AS began, min(seq) FILTER (control = 'stop') AS stop FROM n WHERE recording > 0 GROUP BY ALL),
      h AS (SELECT n.*, began, row_number() OVER (PARTITION BY n.capture_id, n.recording, kind ORDER BY seq DESC) AS r FROM n JOIN b ON n.capture_id = b.capture_id AND n.recording = b.recording WHERE control IS NULL AND seq < stop)
      SELECT capture_id, recording::INT AS recording, kind, seq, type, greatest(0, at_ms - began) AS at_ms FROM h WHERE r <= CASE WHEN kind = 'action-trace' THEN 3 ELSE 4 END""",
    "interaction_score": _LINKED + _COUNTS + f"""
SELECT capture_id, actions, mutations, linked, total, {SCORE_SQL} AS score, {CONFIDENCE_SQL} AS confidence,
  concat_ws(',', CASE WHEN actions > 0 THEN 'interaction-action-events:' || actions END, CASE WHEN mutations > 0 THEN 'interaction-mutation-events:' || mutations END,
    CASE WHEN actions > 0 AND mutations > 0 THEN 'interaction-action-mutation-coverage' END, CASE WHEN linked > 0 THEN 'interaction-linked-mutations:' || linked END,
    CASE WHEN total > 8 THEN 'interaction-event-volume:' || total END) AS evidence,
  concat_ws(',', CASE WHEN actions = 0 THEN 'interaction-action-timeline-missing' END, CASE WHEN mutations = 0 THEN 'interaction-mutation-timeline-missing' END,
    CASE WHEN mutations > 0 AND linked = 0 THEN 'interaction-mutations-unlinked' END) AS warnings FROM c""",
    "mutation_action_asof": _LINKED + "SELECT capture_id, seq, at_ms, act.type AS action_type, act.at_ms AS action_at_ms, act.seq AS action_seq FROM linked WHERE kind = 'mutation'",
    "mutation_transition": _LINKED + "SELECT transition, label, count(*) AS n FROM named WHERE transition IS NOT NULL GROUP BY ALL",
    "trace_projection": _LINKED + """SELECT capture_id, seq, kind, at_ms, label, concat_ws(';',
    'actionAtMs=' || act.at_ms, 'actionType=' || act.type, 'addedNodes=' || added_nodes,
    'addedTagNames=' || array_to_string(list_transform((added_tag_names)[1:6], lambda x: lower(x)), ','), 'attributeName=' || attribute_name,
    'removedNodes=' || removed_nodes, 'selector=' || selector, 'tagName=' || lower(tag_name), 'transition=' || transition, 'type=' || type, 'value=' || trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS payload FROM named""",
    "timeline_merge": _LINKED + "SELECT capture_id, seq, kind, at_ms, row_number() OVER (PARTITION BY capture_id ORDER BY at_ms, kind, seq)::INT AS position FROM linked",
    "trace_ring_buffer": f"""WITH {S.SQL} SELECT capture_id, kind, seq, at_ms FROM traces
QUALIFY row_number() OVER (PARTITION BY capture_id, kind ORDER BY seq DESC) <= CASE WHEN kind = 'mutation' THEN 12 ELSE 20 END""",
    "hover_throttle": f"""WITH RECURSIVE {S.SQL},
h AS (SELECT capture_id, at_ms, seq, selector, row_number() OVER (PARTITION BY capture_id ORDER BY at_ms, seq) AS r FROM traces WHERE type = 'hover'),
f AS (
  SELECT capture_id, r, at_ms AS last_at, selector AS last_target, true AS kept FROM h WHERE r = 1
  UNION ALL
  SELECT h.capture_id, h.r, CASE WHEN h.selector <> f.last_target AND h.at_ms - f.last_at >= 3600000 THEN h.at_ms ELSE f.last_at END,
    CASE WHEN h.selector <> f.last_target AND h.at_ms - f.last_at >= 3600000 THEN h.selector ELSE f.last_target END,
    h.selector <> f.last_target AND h.at_ms - f.last_at >= 3600000 FROM f JOIN h ON h.capture_id = f.capture_id AND h.r = f.r + 1)
SELECT capture_id, at_ms, seq, selector FROM f JOIN h USING (capture_id, r) WHERE kept""",
}
