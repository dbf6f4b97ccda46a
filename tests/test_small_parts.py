"""Small operators over rows that tell their rules apart."""

import json

from pyspark.sql import functions as F

from vitrail.functions import text
from vitrail.operators import export, projections, subtree_choice


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def strings(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def test_snapshot_stats(spark):
    raw = json.dumps({"documents": [{"nodes": {"parentIndex": [-1, 0, 0]}}, {"nodes": {"parentIndex": [-1]}}], "strings": []})
    got = [tuple(one(spark, projections.snapshot_stats(F.lit(x)).alias("s")).s) for x in (raw, '{"documents": []}', "{}", "no json")]
    assert got == [(2, 3), (0, 0), (0, 0), (0, 0)]


def test_snapshot_hints(spark):
    table = strings("t1", "DIV", "card", "x")
    hints = lambda id_, tag, *classes: one(spark, projections.snapshot_hints(table, F.lit(tag), F.lit(id_), strings(*classes)).alias("n")).n
    assert hints("t1", "div", "no", "card", "x") == 3
    assert hints("", "div") == 1 and hints("t2", "p", "y") == 0 and hints("t1", "p") == 1


def test_preservation_reasons(spark):
    w = strings("reason:a", "other", "reason:b:c", "areason:d")
    assert one(spark, projections.preservation_reasons(w, "reason:").alias("r")).r == ["a", "b:c"]


def test_css_escape(spark):
    assert one(spark, text.css_escape(F.lit("a b.c#d_e-f")).alias("x")).x == "a\\ b\\.c\\#d_e-f"


def test_structure_check(spark):
    check = lambda html, script: one(spark, export.structure_check(F.lit(html), F.lit(script)).alias("x")).x
    good = '<div data-root="true"> <p>x</p></div>'
    assert check(good, "document.querySelector('x')") == []
    assert check(good, None) == ["bootstrap-missing"]
    assert check('<div data-root="true">text</div>', "querySelector(") == ["frame-missing"]
    assert check("<p></p>", "") == ["root-missing", "bootstrap-missing"]


def test_provenance(spark):
    rows = [
        ("#p", "#s", "#sel", "#el", '<div data-root="true">', "render-scene"), (" ", None, "#sel", "#el", "<board></board>", "render-scene"),
        (None, None, None, "#el", '<board class="main-board">', "render-scene"), (None, "", "", "#el", "<board></board>", "semantic-ui"),
    ]
    names = "promoted_selector string, stable_selector string, selected_selector string, element_selector string, html string, target_class string"
    got = [(r.picked, r.promoted, r.exported, r.frame, r.frame_failure) for r in subtree_choice.provenance(spark.createDataFrame(rows, names)).collect()]
    assert got == [
        ("#s", "#p", '[data-root="true"]', "frame-complete", None), ("#sel", "#el", "#el", "frame-incomplete", "leaf-without-frame"),
        ("#el", "#el", "#el", "frame-complete", None), ("#el", "#el", "#el", "frame-complete", None),
    ]


def test_declarations_and_usable_rules(spark):
    kind = "array<struct<name:string,value:string,important:boolean,disabled:boolean>>"
    raw = lambda *rows: F.from_json(F.lit(json.dumps([dict(zip(("name", "value", "important", "disabled"), r)) for r in rows])), kind)
    got = one(spark, projections.declarations(raw((" color ", " red ", True, False), (" ", "x", False, False), ("top", None, False, True))).alias("d")).d
    assert [tuple(x) for x in got] == [("color", "red", True, None), ("top", "", None, True)]
    usable = lambda selectors, *rows: one(spark, projections.usable(selectors, raw(*rows)).alias("u")).u
    on, off = ("a", "b", False, False), ("a", "b", False, True)
    assert usable(strings("p"), off, on) and not usable(strings("p"), off) and not usable(strings(), on) and not usable(strings("p"))


def test_assets_are_inlined_by_place(spark):
    from vitrail.operators import fallback

    values = [(1, "url(a.png) url(/x/a.png)"), (2, "url('a.png'), a.png url(\"a.png\")"), (3, "none"), (4, None), (5, "url() url(#g) url(data:x)"), (6, "url(a.png)" * 3000), (7, "URL(a.png) url(a b)")]
    df = spark.createDataFrame(values, "place int, value string")
    assets = spark.createDataFrame([("a.png", "data:A"), ("unused", "data:U")], "url string, data string")
    got = {r.place: (r.value, r.requested, r.failed) for r in fallback.inline_assets(df, assets).collect()}
    assert got == {
        1: ('url("data:A") url("/x/a.png")', 2, 1), 2: ('url("data:A"), a.png url("data:A")', 2, 0), 3: ("none", 0, 0), 4: (None, 0, 0),
        5: ('url("") url("#g") url("data:x")', 3, 2), 6: ('url("data:A")' * 3000, 3000, 0), 7: ('URL(a.png) url("a b")', 1, 1),
    }
    from pyspark.sql import functions as F

    based = spark.createDataFrame([(1, "https://h/p/q", "url(a.png) url(//c/d) url(#e)")], "id int, page string, value string")
    one = fallback.inline_assets(based, spark.createDataFrame([("https://h/p/a.png", "data:A")], "url string, data string"), F.col("page")).first()
    assert (one.value, one.requested, one.failed) == ('url("data:A") url("//c/d") url("#e")', 3, 2)


def test_scenarios_expand_by_names_and_groups(spark):
    import pytest

    from vitrail.operators import report

    suite = report.registry(spark)
    of = lambda *names: sorted(r.id for r in report.expand(spark.createDataFrame([(n,) for n in names], "name string"), suite).collect())
    assert of("reddit-header", "reddit-header") == ["reddit-header"] and of("all") == of("matrix:extended") == sorted(r[0] for r in report.SCENARIOS)
    assert of("matrix:core") == sorted(report.LIVE) and len(of("class:render-scene", "matrix:core")) == 7
    with pytest.raises(Exception, match="unknown scenario: nobody"):
        of("all", "nobody")
