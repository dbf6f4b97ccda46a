"""Live recording: traces arrive as a stream, links and throttling are keyed state.

Batch operators order a session by (at_ms, seq).  Live, order is that of arrival: inside a
micro-batch rows are sorted the same way, across batches a late row sees the state it finds.  State is
a few values a session, dropped when its session is idle for ``idle_ms`` (processing time), so it is
bounded by the number of active sessions.  A run over what is there (``run_once``) needs
``idle_ms=None``: a query with timeouts always has another batch to run and would not end.

Watermarks and event-time windows are extensions: recording itself has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import timeline as TL
from ..sources import traces as S

IDLE_MS = 30 * 60 * 1000

LINKED = "capture_id long, seq long, kind string, type string, at_ms long, action_type string, action_at_ms long, action_seq long"
LINK_STATE = "type string, at_ms long, seq long"
HOVERS = "capture_id long, at_ms long, seq long, selector string"
HOVER_STATE = "at_ms long, selector string"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def live_traces(events: DataFrame) -> DataFrame:
    """Traces of a stream: as ``traces.traces``, with absolute times (a session's start needs its end)."""
    action, mutation = S._cases("event_type", S.ACTION_TYPES), S._cases("event_type", S.MUTATION_TYPES)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return events.select(
        F.col("user_id").alias("capture_id"), F.col("event_id").alias("seq"),
        F.when(action.isNotNull(), S.ACTION).when(mutation.isNotNull(), S.MUTATION).alias("kind"),
        F.coalesce(action, mutation).alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.concat(F.lit("#n"), k.cast("string")).alias("selector"),
    ).where("kind is not null")


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def link(traces: DataFrame, tolerance_ms: int = TL.LINK_MS, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Each trace with the last action of its session that is no hover, if near enough."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at_ms", "kind", "seq"], kind="stable")
        last = state.get if state.exists else (None, None, None)
        out = []
        for r in rows.itertuples(index=False):
            near = r.kind == S.MUTATION and last[1] is not None and r.at_ms - last[1] <= tolerance_ms
            out.append((key[0], r.seq, r.kind, r.type, r.at_ms, *(last if near else (None, None, None))))
            if r.kind == S.ACTION and r.type != "hover":
                last = (r.type, r.at_ms, r.seq)
        if last[1] is not None:
            state.update(last)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        names = [c.split(" ")[0] for c in LINKED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"action_at_ms": "Int64", "action_seq": "Int64"})

    rows = traces.select("capture_id", "seq", "kind", "type", "at_ms")
    return rows.groupBy("capture_id").applyInPandasWithState(step, LINKED, LINK_STATE, "append", _timeout(idle_ms))


def throttle(traces: DataFrame, pause_ms: int = TL.HOVER_MS, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Hovers on another target than the last recorded one, ``pause_ms`` after it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at_ms", "seq"], kind="stable")
        at, target = state.get if state.exists else (None, None)
        out = []
        for r in rows.itertuples(index=False):
            if r.selector != target and (at is None or r.at_ms - at >= pause_ms):
                at, target = r.at_ms, r.selector
                out.append((key[0], r.at_ms, r.seq, r.selector))
        state.update((at, target))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["capture_id", "at_ms", "seq", "selector"])

    hovers = traces.where((F.col("kind") == S.ACTION) & (F.col("type") == "hover")).select("capture_id", "at_ms", "seq", "selector")
    return hovers.groupBy("capture_id").applyInPandasWithState(step, HOVERS, HOVER_STATE, "append", _timeout(idle_ms))


RECORDED = "capture_id long, recording int, kind string, seq long, type string, at_ms long"
RECORDING_STATE = "recording int, began long, held string"


def record(events: DataFrame, actions: int = TL.ACTION_BUFFER, mutations: int = TL.MUTATION_BUFFER, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Recordings as they close: ``timeline.recordings`` live.

    State is what the open recording of a session holds, which the buffers bound; a start empties it, a
    stop sends it and closes, and rows outside a recording leave no trace.
    """
    room = {S.ACTION: actions, S.MUTATION: mutations}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, began, held = state.get if state.exists else (0, None, "{}")
        buffers, out = json.loads(held), []
        for r in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.control == "start":
                number, began, buffers = number + 1, int(r.at_ms), {}
            elif r.control == "stop":
                if began is not None:
                    out += [(key[0], number, kind, *row) for kind, rows in buffers.items() for row in rows]
                began, buffers = None, {}
            elif began is not None:
                rows = buffers.setdefault(r.kind, [])
                rows.append((int(r.seq), r.type, max(0, int(r.at_ms) - began)))
                del rows[: -room[r.kind]]
        state.update((number, began, json.dumps(buffers)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RECORDED.split(", ")])

    rows = events.select("capture_id", "seq", "kind", "type", "at_ms", "control")
    return rows.groupBy("capture_id").applyInPandasWithState(step, RECORDED, RECORDING_STATE, "append", _timeout(idle_ms))


ANSWERS = "request_id long, seq long, answer long"


def answer(log: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Answers of a request registry: ``capsule.popped`` live.  State is the tab of a request that waits;
    an answer forgets it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tab, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.op == "register":
                tab = int(r.tab_id)
            else:
                out.append((key[0], r.seq, tab))
                tab = None
        if tab is None:
            if state.exists:
                state.remove()
        else:
            state.update((tab,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["request_id", "seq", "answer"]).astype({"answer": "Int64"})

    rows = log.select("request_id", "seq", "op", "tab_id")
    return rows.groupBy("request_id").applyInPandasWithState(step, ANSWERS, "tab_id long", "append", _timeout(idle_ms))


def session_counts(events: DataFrame, lateness: str = "1 hour", window: str = "6 hours") -> DataFrame:
    """Extension: traces of each kind in event-time windows, late rows dropped by a watermark."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    kind = F.coalesce(S._cases("event_type", {k: S.ACTION for k in S.ACTION_TYPES}), F.lit(S.MUTATION))
    return e.groupBy(F.window("at", window), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, exactly once, into Parquet files."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
