"""Mapping by stages and listing of style sheets on small cases."""

from pyspark.sql import functions as F

from vitrail.operators import mapping as MP
from vitrail.operators import matching as M
from vitrail.operators import sheetlist as S

PAGE = '<nav><a href="/x">one</a><a id="t" class="k" href="/y">two</a></nav>'


def mapped(spark, rows, runtime, document, drift=9):
    pages = spark.createDataFrame(rows, "page_id int, html string")
    found = MP.mapped(pages, lambda n: F.lit(False), M._box, lambda i: M._box(i, drift), runtime, document)
    return {r.capture_id: r for r in found.collect()}


def test_stages_stop_at_the_first_that_resolves(spark):
    c = F.col("capture_id")
    got = mapped(spark, [(1, PAGE), (2, PAGE), (3, PAGE), (4, "<p>no link</p>"), (5, None)], c.isin(2, 3), c == 3)
    assert set(got) == {1, 2, 3}
    names = {i: [a.strategy for a in r.attempts] for i, r in got.items()}
    assert names == {1: [MP.RUNTIME], 2: [MP.DOCUMENT], 3: [MP.SELECTOR]} and {r.node_idx for r in got.values()} == {3}
    # The page's strings have the id, the tag in upper case and the class.
    assert {r.hints for r in got.values()} == {3}
    assert all(got[i].confidence == min(1, round(got[i].attempts[0].confidence + 0.045, 3)) for i in (1, 2)) and got[3].confidence == M.SELECTOR_CONFIDENCE
    assert got[2].warnings[0] == "runtime mapping failed" and got[3].warnings == ["runtime mapping failed", "dom traversal failed", "selector-only mapping has weak confidence"]


def test_a_weak_stage_is_left_for_the_next(spark):
    weak, strong = M.RUNTIME_RESOLVED, M.RESOLVED
    M.RUNTIME_RESOLVED = 10_000
    try:
        got = mapped(spark, [(1, PAGE)], F.lit(False), F.lit(False))[1]
        M.RESOLVED = 10_000
        last = mapped(spark, [(1, PAGE)], F.lit(False), F.lit(False))[1]
    finally:
        M.RUNTIME_RESOLVED, M.RESOLVED = weak, strong
    assert [(a.strategy, a.resolved) for a in got.attempts] == [(MP.NONE, False), (MP.DOCUMENT, True)] and got.strategy == MP.DOCUMENT
    assert [(a.strategy, a.resolved) for a in last.attempts] == [(MP.NONE, False), (MP.NONE, False), (MP.SELECTOR, True)] and last.node_idx == 3


def listed(spark, html, fetched, rounds=8):
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    have = spark.createDataFrame(fetched, "address string, css string")
    return [(r.source, r.depth, r.address, r.missing) for r in S.listing(pages, have, rounds).orderBy("place").collect()]


def test_sheets_are_listed_root_by_root(spark):
    html = (
        '<link rel=\'x\'><link rel="stylesheet" href="a"><x-h><template shadowrootmode="open"><style>@import url(c);</style><link rel="icon" href="no"></template></x-h>'
        '<style>q{}</style><template><link rel="stylesheet" href="d"></template><link rel="stylesheet" href="a">'
    )
    fetched = [("a", "@import 'b';@import 'c';"), ("b", "@import 'a';@import \"b\"; p{@import 'e';}"), ("c", None), ("unused", "@import 'z';")]
    assert listed(spark, html, fetched) == [
        ("link", 0, "a", False), ("import", 0, "b", False), ("import", 0, "c", False), ("style", 0, None, False), ("link", 0, "d", True), ("style", 1, None, False)
    ]
    assert listed(spark, html, []) == [("link", 0, "a", True), ("style", 0, None, False), ("link", 0, "d", True), ("style", 1, None, False), ("import", 1, "c", True)]
    assert listed(spark, "<p>x</p>", fetched) == [] and listed(spark, None, fetched) == []


def test_long_chains_end_at_the_bound(spark):
    fetched = [(f"s{i}", f"@import 's{i + 1}';") for i in range(6)]
    html = '<link rel="stylesheet" href="s0">'
    assert [a for _, _, a, _ in listed(spark, html, fetched, 3)] == ["s0", "s1", "s2", "s3"]
    assert [a for _, _, a, _ in listed(spark, html, fetched, 8)] == [f"s{i}" for i in range(7)]
