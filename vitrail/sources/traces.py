"""Interaction traces from the table ``events``: actions and mutations of each session.

A session is a user; its clock starts at its first event.  ``click``, ``view`` and ``signup`` events
are actions (click, hover, input), ``purchase`` and ``error`` mutations (childList, attributes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION, MUTATION = "action-trace", "mutation"
ACTION_TYPES = {"click": "click", "view": "hover", "signup": "input"}
MUTATION_TYPES = {"purchase": "childList", "error": "attributes"}
ATTRIBUTES = ("class", "aria-expanded", "value", "open", "href")


def _cases(column: str, table: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def traces(events: DataFrame) -> DataFrame:
    """(capture_id, seq, kind, type, at_ms, selector, tag_name, attribute_name, added_nodes,
    removed_nodes, added_tag_names, value)."""
    e = events.select(
        F.col("user_id").alias("capture_id"),
        F.col("event_id").alias("seq"),
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"),
        "value",
    )
    # Sessions' starts are aggregated before the join, so a hot session is one small row.
    starts = e.groupBy("capture_id").agg(F.min("ms").alias("start"))
    e = e.join(starts, "capture_id")
    action, mutation = _cases("event_type", ACTION_TYPES), _cases("event_type", MUTATION_TYPES)
    child = mutation == "childList"
    return e.select(
        "capture_id",
        "seq",
        F.when(action.isNotNull(), ACTION).when(mutation.isNotNull(), MUTATION).alias("kind"),
        F.coalesce(action, mutation).alias("type"),
        (F.col("ms") - F.col("start")).alias("at_ms"),
        F.concat(F.lit("#n"), F.col("k").cast("string")).alias("selector"),
        F.when(F.col("k") % 2 == 0, "DIV").otherwise("BUTTON").alias("tag_name"),
        F.when(mutation == "attributes", F.get(F.array(*map(F.lit, ATTRIBUTES)), F.col("k") % len(ATTRIBUTES))).alias("attribute_name"),
        F.when(child, F.col("k") % 4 + 1).alias("added_nodes"),
        F.when(child, F.col("k") % 3).alias("removed_nodes"),
        F.when(child, F.transform(F.sequence(F.lit(0), F.col("k") % 4), lambda i: F.when(i % 2 == 0, "LI").otherwise("#text"))).alias("added_tag_names"),
        F.when(action == "input", F.format_string("  v %d  ", "k")).alias("value"),
    ).where("kind is not null")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark.read.parquet(f"{sf_dir}/events.parquet"))


SQL = """
e AS (SELECT user_id AS capture_id, event_id AS seq, event_type, epoch_us(ts) // 1000 AS ms, coalesce((json_extract_string(props, '$.k'))::INT, 0) AS k, value AS v FROM events),
traces AS (
  SELECT capture_id, seq,
    CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'action-trace' ELSE 'mutation' END AS kind,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'hover' WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'childList' ELSE 'attributes' END AS type,
    ms - min(ms) OVER (PARTITION BY capture_id) AS at_ms, '#n' || k AS selector, CASE WHEN k % 2 = 0 THEN 'DIV' ELSE 'BUTTON' END AS tag_name,
    CASE WHEN event_type = 'error' THEN (['class', 'aria-expanded', 'value', 'open', 'href'])[k % 5 + 1] END AS attribute_name,
    CASE WHEN event_type = 'purchase' THEN k % 4 + 1 END AS added_nodes, CASE WHEN event_type = 'purchase' THEN k % 3 END AS removed_nodes,
    CASE WHEN event_type = 'purchase' THEN list_transform(range(k % 4 + 1), lambda i: CASE WHEN i % 2 = 0 THEN 'LI' ELSE '#text' END) END AS added_tag_names,
    CASE WHEN event_type = 'signup' THEN '  v ' || k || '  ' END AS value
  FROM e WHERE event_type IN ('click', 'view', 'signup', 'purchase', 'error'))"""
