"""What a query reads of a page or a fragment more than once is made once."""

from pyspark.sql import functions as F

from vitrail.operators import fallback_export as X
from vitrail.operators import mapping as G
from vitrail.operators import matching as M
from vitrail.operators import sheetlist as L
from vitrail.operators import subtree_choice as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_fragment_is_cut_once(spark):
    html = '<div><div><input type="hidden" a="1"><p hidden>x<b>y</b></p></div></div>'
    d = spark.createDataFrame([(html, k) for k in ("form", "leaf", "")], "h string, k string")
    made = d.select("k", C.sanitise(F.col("h"), F.col("k")).alias("out"))
    assert plan(made).count("regexp_extract_all") == 1
    assert {r["k"]: r["out"] for r in made.collect()} == {"form": "<div><div></div></div>", "leaf": html[5:-6], "": html}


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, '<style>@import "/a";p{b:c}</style><link rel="stylesheet" href="/a"><p id="k">x</p>')], "page_id long, html string")
    fetched = spark.createDataFrame([("/a", "p{}")], "address string, css string")
    listed = L.listing(pages, fetched, 1)
    assert plan(listed).count("regexp_extract_all(html") == 1
    assert [(r.source, r.address, r.missing) for r in listed.orderBy("place").collect()] == [("style", None, False), ("import", "/a", False)]
    tried = G.mapped(pages, lambda n: F.lit(False), M._box, lambda i: M._box(i, 9), F.lit(True), F.lit(True))
    assert plan(tried).count("regexp_extract_all(html") <= 1 and "Join" not in plan(tried)


def test_an_export_reads_its_pages_once(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<b>t</b></li></ul>"), (2, "<p>x</p>")], "page_id long, html string")
    rules = spark.createDataFrame([(1, 0, "li:hover", "color", "red")], "capture_id long, ordinal long, selector_text string, name string, value string")
    elements, states = X.elements_and_states(pages, rules, lambda n: n["tag"] == "b")
    assert "regexp_extract_all(html" not in plan(elements.join(states, ["capture_id", "place"]))
    assert [(r.capture_id, r.place, r.tag) for r in elements.orderBy("capture_id", "place").collect()] == [(1, 0, "ul"), (1, 1, "li"), (1, 2, "b"), (2, 0, "p")]
    assert [tuple(r) for r in states.collect()] == [(1, 1, "hover", "color", "red")]


def test_attributes_of_a_node_are_read_once(spark, monkeypatch):
    pages = spark.createDataFrame([(1, '<p><a id="X" class="B c">t</a></p>')], "page_id long, html string")
    monkeypatch.setattr(M.H, "attributes", lambda raw: F.create_map(F.lit("id"), F.concat(F.lit("MARK"), raw)))
    assert plan(M.described(pages)).count("MARK") == 1
    monkeypatch.undo()
    e = M.described(pages).select(F.get("els", F.lit(1)).alias("e")).first()["e"]
    assert (e["tag"], e["id"], e["classes"], e["attrs"], e["element_place"]) == ("a", "x", ["b", "c"], {"id": "X", "class": "B c"}, 0)
