"""Raw events of any shape as rows."""

import json

from vitrail.operators import raw_events as R

EL = {"nodeType": 1, "tag": "DIV", "attrs": {"id": "a", "class": "k"}}


def rows(spark, *events, ignored=()):
    raw = [(1, i, e if e is None or isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    return {r.seq: r for r in R.normalised(spark.createDataFrame(raw, "capture_id int, seq int, raw string"), ignored).collect()}


def test_what_cannot_be_read_costs_its_own_row(spark):
    got = rows(spark, None, "", "{", "[]", "3", '"click"', "{}", {"type": "unknown"}, {"type": 5}, {"type": "click"}, {"type": "click", "target": 3, "at": {}, "text": ["x"], "more": {"y": 1}})
    assert set(got) == {9, 10}
    assert (got[9].selector, got[9].tag_name, got[9].at_ms, got[9].extra) == (None, None, 0, {})
    assert got[10].text == '["x"]' and got[10].extra == {"more": '{"y":1}'}


def test_mutations(spark):
    text = {"nodeType": 3, "text": "  some \n text " + "x" * 200, "parent": EL}
    got = rows(
        spark, {"type": "attributes", "target": EL, "attributeName": "CLASS", "at": 7.5}, {"type": "attributes", "target": EL, "attributeName": "data-x"}, {"type": "attributes", "target": EL},
        {"type": "attributes", "target": EL, "attributeName": "aria-label"}, {"type": "characterData", "target": text}, {"type": "characterData", "target": {"nodeType": 3, "text": " ", "parent": EL}},
        {"type": "characterData", "target": {"nodeType": 3, "text": "orphan"}}, {"type": "childList", "target": EL, "added": [], "removed": []},
        {"type": "childList", "target": EL, "added": [{"nodeType": 1, "tag": "B"}, {"nodeType": 3}, {"nodeType": 8}, {}] * 3}, {"type": "childList", "target": {"nodeType": 1, "tag": "g", "svg": True, "parent": EL}, "removed": [{"nodeType": 1, "tag": "i"}]},
    )
    assert set(got) == {0, 3, 4, 8, 9}
    assert (got[0].attribute_name, got[0].value_preview, got[0].at_ms, got[0].selector) == ("class", "k", 8, "#a")
    assert got[3].value_preview is None and got[4].value_preview.startswith("some text x") and len(got[4].value_preview) == R.PREVIEW
    assert (got[8].added_nodes, got[8].removed_nodes, got[8].added_tag_names, got[8].removed_tag_names) == (12, 0, ["b", "#text", "#node", "#node"] * 2, None)
    assert (got[9].tag_name, got[9].removed_tag_names) == ("div", ["i"])


def test_ignored_elements_and_no_events(spark):
    change = {"type": "attributes", "target": EL, "attributeName": "class"}
    assert rows(spark, change, ignored=("a",)) == {} and len(rows(spark, change, ignored=("b",))) == 1
    assert R.normalised(spark.createDataFrame([], "capture_id int, seq int, raw string")).collect() == []
