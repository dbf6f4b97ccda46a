"""Live recording gives the rows of the batch operators."""

from pyspark.sql import functions as F

from vitrail.operators import report, timeline
from vitrail.sources import sinks
from vitrail.streaming import recording as R


def files(spark, sf, tmp_path):
    """Events in three files, in order of time."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 6")
    folder = f"{tmp_path}/in"
    bounds = events.approxQuantile("event_id", [0.33, 0.66], 0.0)
    for i, (a, b) in enumerate(zip([-1, *bounds], [*bounds, 10**9])):
        events.where((F.col("event_id") > a) & (F.col("event_id") <= b)).coalesce(1).write.parquet(f"{folder}/{i}")
    return events, folder


def test_stream_equals_batch(spark, sf, tmp_path):
    events, folder = files(spark, sf, tmp_path)
    stream = R.live_traces(R.read_events(spark, f"{folder}/*", events.schema))
    R.run_once(R.link(stream, timeline.CHECK_LINK_MS, None), f"{tmp_path}/links", f"{tmp_path}/c1")
    R.run_once(R.throttle(stream, 3_600_000, None), f"{tmp_path}/hovers", f"{tmp_path}/c2")
    batch = R.live_traces(events)
    columns = ("capture_id", "seq", "action_type", "action_at_ms", "action_seq")
    want = timeline.link_mutations(batch, timeline.CHECK_LINK_MS).select(*columns).collect()
    got = spark.read.parquet(f"{tmp_path}/links").select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.action_seq is not None for r in got)
    hovers = timeline.throttle_hovers(batch, 3_600_000).select("capture_id", "seq").collect()
    assert sorted(spark.read.parquet(f"{tmp_path}/hovers").select("capture_id", "seq").collect()) == sorted(hovers)


def test_recordings_and_registry_live(spark, sf, tmp_path):
    from vitrail.operators import capsule

    events, folder = files(spark, sf, tmp_path)
    stream = R.read_events(spark, f"{folder}/*", events.schema)
    R.run_once(R.record(timeline.with_controls(R.live_traces(stream), 25), 3, 4, None), f"{tmp_path}/records", f"{tmp_path}/c3")
    want = timeline.recordings(timeline.with_controls(R.live_traces(events), 25), 3, 4)
    got = spark.read.parquet(f"{tmp_path}/records").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5

    def log(e):
        op = F.when(F.col("event_id") % 3 == 0, "pop").otherwise("register")
        return e.select((F.col("user_id") % 5).alias("request_id"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "register", F.col("event_id") % 17).alias("tab_id"))

    R.run_once(R.answer(log(stream), None), f"{tmp_path}/answers", f"{tmp_path}/c4")
    got = spark.read.parquet(f"{tmp_path}/answers").select("request_id", "seq", "answer").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, capsule.popped(log(events)).collect())))
    assert {r.answer is None for r in got} == {True, False}


def test_windows_with_watermark(spark, sf, tmp_path):
    events, folder = files(spark, sf, tmp_path)
    counted = R.session_counts(R.read_events(spark, f"{folder}/*", events.schema), "3650 days")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_sinks(spark, tmp_path):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "request_id string, v int")
    changes = spark.createDataFrame([("b", 3), ("c", 4)], "request_id string, v int")
    sinks.write_store(report.upsert(store, changes, "request_id"), f"{tmp_path}/store")
    back = spark.read.parquet(f"{tmp_path}/store")
    assert sorted(map(tuple, back.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sinks.lookup(back, "b").first().v == 3
    parts = spark.createDataFrame([("l", "component.html", "<p>"), ("l", "meta.json", "{}")], "label string, name string, content string")
    sinks.write_artifacts(parts, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("name = 'meta.json'").first().content == "{}"
    meta = spark.createDataFrame([(1, None)], "a int, b int").select(sinks.meta_json(["a", "b"]).alias("m")).first().m
    assert meta == '{"a":1}'
    label = spark.sql("select timestamp'2024-01-02 03:04:05' as t").select(sinks.export_label(F.col("t"), F.lit("a b/c")).alias("x")).first().x
    assert label == "2024-01-02T03-04-05_a_b_c"
    sinks.write_reports(spark.createDataFrame([("one\ntwo",)], "report string"), f"{tmp_path}/reports")


def test_screenshots_from_files_and_data_urls(spark, tmp_path):
    import base64

    import pytest

    from vitrail.sources import screenshots

    (tmp_path / "shots" / "deep").mkdir(parents=True)
    (tmp_path / "shots" / "7.full.png").write_bytes(b"\x89PNG1")
    (tmp_path / "shots" / "deep" / "8.clip.png").write_bytes(b"\x89PNG22")
    (tmp_path / "shots" / "9.other.png").write_bytes(b"x")
    (tmp_path / "shots" / "notes.txt").write_text("x")
    got = sorted((r.capture_id, r.kind, bytes(r.png), r.length) for r in screenshots.read_images(spark, f"{tmp_path}/shots").collect())
    assert got == [("7", "full", b"\x89PNG1", 5), ("8", "clip", b"\x89PNG22", 6)]
    url = "data:image/png;base64," + base64.b64encode(b"abc").decode()
    assert bytes(spark.range(1).select(screenshots.decoded(F.lit(url))).first()[0]) == b"abc"
    with pytest.raises(Exception, match="not a PNG"):
        spark.range(1).select(screenshots.decoded(F.col("id").cast("string"))).collect()
    assert tuple(spark.range(1).select(screenshots.clip_size(F.lit(0.2), F.lit(3.0))).first()[0]) == (1.0, 3.0)


def test_warnings_keep_their_stage(spark):
    a, b = F.array(F.lit("x"), F.lit(""), F.lit("x")), F.lit(None).cast("array<string>")
    got = spark.range(1).select(report.warnings_with_stage({"css": a, "dom": b}).alias("w")).first().w
    assert got == ["css: x"]
