"""Small cases whose results were worked out by hand."""

from pyspark.sql import functions as F

from vitrail.functions import numbers as N
from vitrail.functions import text as T
from vitrail.functions import url as U
from vitrail.operators import fidelity, htmltree, rewrite, shadow, styles, timeline


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_interaction_scores(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 2), (2, 0, 0, 0, 0)], "capture_id long, actions long, mutations long, linked long, total long")
    got = {r.capture_id: (r.score, r.confidence) for r in timeline.interaction_dimension(rows).collect()}
    assert got == {1: (1.0, 0.76), 2: (0.1, 0.15)}


def test_fallback_confidence(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1, 1, 10), (2, 3, 24, 2, 0, 0, 260)], "capture_id long, shadow_hosts long, removed_attributes long, asset_failures long, pseudo_rules long, keyframe_rules long, nodes long")
    got = {r.capture_id: (r.penalty, r.export_confidence) for r in fidelity.fallback_confidence(rows).collect()}
    assert got == {1: (0.32, 0.68), 2: (0.638, 0.362)}


def test_rounding_is_half_up_on_doubles(spark):
    assert one(spark, N.thousandths(F.lit(0.5035))) == 0.503
    assert one(spark, N.score3(F.lit(1.7))) == 1.0
    assert one(spark, N.whole_ms(F.lit(-3.0))) == 0
    assert one(spark, N.whole_ms(F.lit(17.6))) == 18
    assert one(spark, N.whole_ms(F.lit(float("nan")))) == 0


def test_links_take_the_last_action_that_is_no_hover(spark):
    rows = [(1, 1, "action-trace", "click", 0), (1, 2, "action-trace", "hover", 900), (1, 3, "mutation", "childList", 1400), (1, 4, "mutation", "childList", 1401), (1, 5, "mutation", "childList", 9000)]
    t = spark.createDataFrame(rows, "capture_id long, seq long, kind string, type string, at_ms long")
    got = {r.seq: r.action_seq for r in timeline.link_mutations(t, 1400).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: None}


def test_merge_puts_actions_first_at_one_time(spark):
    rows = [(1, 1, "mutation", 15), (1, 2, "mutation", 22), (1, 3, "action-trace", 15), (1, 4, "action-trace", 35)]
    t = spark.createDataFrame(rows, "capture_id long, seq long, kind string, at_ms long")
    assert [r.seq for r in timeline.merge(t).orderBy("position").collect()] == [3, 1, 2, 4]


def test_parser_rules(spark):
    html = '<!DOCTYPE html><p a="1" a="2&amp;" b>x <br>y</p></div><i>z</i>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = htmltree.nodes(pages).orderBy("node_idx").collect()
    assert [(r.tag, r.depth) for r in rows] == [(None, 1), ("p", 1), (None, 2), ("br", 2), (None, 2), ("i", 1), (None, 2)]
    assert rows[0].text == "!DOCTYPE html>"
    assert rows[1].attrs == {"a": "2&", "b": ""}


def test_unmatched_end_tag_closes_everything(spark):
    pages = spark.createDataFrame([(1, "<a><b><c></x>t</a>")], "page_id long, html string")
    assert [r.depth for r in htmltree.nodes(pages).orderBy("node_idx").collect()] == [1, 2, 3, 1]


def test_both_parsers_agree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    native = {r.capture_id: (r.elements, r.texts) for r in htmltree.counts(htmltree.nodes(pages)).collect()}
    for r in pages.collect():
        own = list(rewrite.walk(rewrite.parse(r.html)))
        assert native[r.page_id] == (sum(isinstance(n, rewrite.Element) for n in own), sum(isinstance(n, str) for n in own))


def test_candidate_rewrites():
    c = lambda h, **k: rewrite.Rewriter(rewrite.Config(**k)).candidate(h)
    assert c("  ") is None
    out = c('<div class="w"><span data-x="1"><button class="b" onclick="f()">Go</button></span></div><script>x</script>')
    assert out["html"] == '<button class="b">Go</button>'
    assert out["removed_tags"] == {"script": 1} and out["removed_attributes"]["onclick"] == 1 and out["collapsed_wrappers"] == 2
    assert c('<x-wrap data-a="1"><a href="/p">t</a></x-wrap>', wrapper_tags=frozenset(["x-wrap"]))["html"] == '<a href="/p">t</a>'
    svg = '<button><svg viewBox="0 0 1 1">' + "<circle r='1'></circle>" * 5 + "</svg></button>"
    assert '<circle cx="50%"' in c(svg)["html"] and c(svg)["compacted_svgs"] == 1
    assert c("<button><svg><defs></defs></svg>x</button>")["html"] == "<button>x</button>"
    form = '<form role="search"><input name="q"><ul role="menu"><button>no</button></ul><button>ok</button></form>'
    assert "no" not in c(form)["html"] and "ok" in c(form)["html"]


def test_scene_stays():
    pieces = "".join(f'<piece style="position:absolute;left:{i}px"></piece>' for i in range(5))
    out = rewrite.Rewriter().candidate(f'<div class="board"><div>{pieces}</div></div>')
    assert out["mode"] == "scene-preserving" and out["html"].count("<piece") == 5 and 'class="board"' in out["html"]


def test_keyframes_prefer_plain_then_last(spark):
    k = [(1, 0, "kf", False, "a"), (1, 1, "kf", True, "b"), (1, 2, "kf", False, "c")]
    frames = spark.createDataFrame(k, "capture_id long, ordinal long, name string, prefixed boolean, css_text string")
    names = spark.createDataFrame([(1, 0, 0, 0, "kf"), (1, 0, 0, 1, "gone")], "capture_id long, seq long, ordinal long, place int, name string")
    got = {r.name: (r.css_text, r.warning) for r in styles.resolve_keyframes(names, frames).collect()}
    assert got == {"kf": ("c", None), "gone": (None, "keyframes-name-undefined:gone")}


def test_missing_variable_resolves_to_nothing(spark):
    d = spark.createDataFrame([(1, 0, 0, "color", "var(--missing-color)")], "capture_id long, seq long, ordinal long, name string, value string")
    none = spark.createDataFrame([], "capture_id long, ordinal long, name string, value string")
    assert [(r.name, r.value, r.resolved) for r in styles.resolve_variables(d, none).collect()] == [("--missing-color", "", False)]
    c = styles.variable_counts(d, none).first()
    assert (c.referenced, c.reference_only, c.unresolved) == (1, 1, 1)


def test_animation_shorthand_keeps_its_quirk(spark):
    name = lambda v: one(spark, styles.animation_name(F.lit(v)))
    assert name("250ms ease-in spin infinite") == "spin"
    assert name("'spin' 2s") == "spin"
    assert name("1s linear") is None
    assert name("2s cubic-bezier(0.1") is None


def test_shadow_roots_pair_in_order(spark):
    roots = spark.createDataFrame([(1, 0, 1, "x", "", "open"), (1, 1, 2, "x", "", "closed")], "capture_id long, ordinal long, depth long, tag string, host_id string, mode string")
    sheets = spark.createDataFrame([(1, 0, 1, "x", "", 3), (1, 1, 9, "y", "", 1)], "capture_id long, ordinal long, depth long, tag string, host_id string, sheets long")
    d = shadow.diagnostics(shadow.merge_sheets(roots, sheets)).first()
    assert (d.roots, d.open, d.closed, d.sheets, d.max_depth) == (3, 2, 1, 4, 9)


def test_urls(spark):
    r = lambda v, b="https://h.example/a/b/c.html?x": one(spark, U.resolve(F.lit(v), F.lit(b)))
    assert r("../i.png") == "https://h.example/a/i.png"
    assert r("/x/./y/../z?q#f") == "https://h.example/x/z?q#f"
    assert r("//cdn/x") == "https://cdn/x"
    assert r("?y") == "https://h.example/a/b/c.html?y"
    assert r(" 'q.css' ") == "https://h.example/a/b/q.css"
    assert r("data:x") == "data:x" and r("#g") == "#g" and r("  ") is None
    kind = lambda u, n=None: one(spark, U.kind(F.lit(u), None if n is None else F.lit(n)))
    assert kind("https://a/b.woff2?x") == "font" and kind("https://a/b", "font-face") == "font"
    assert kind("data:image/png;base64,AA") == "image" and kind("https://a/b.mjs") == "script" and kind("https://a/b") == "other"


def test_text_functions(spark):
    assert one(spark, T.compact(F.lit(" a \t b  "))) == "a b"
    assert one(spark, T.path_segment(F.lit(" A b/c! "))) == "a-b-c" and one(spark, T.path_segment(F.lit("!!"))) == "artifact"
    assert one(spark, T.decode_entities(F.lit("&amp;lt; &quot;"))) == '&lt; "'
    assert one(spark, T.escape_attribute(F.lit("<a&\"'>"), single=True)) == "&lt;a&amp;&quot;&#39;&gt;"
    assert one(spark, T.selector_list(F.lit("a, b ,a,"))) == ["a", "b"]
    assert one(spark, T.without_states(F.lit("a:hover b:focus-within"))) == "a b"
    p = one(spark, T.selector_parts(F.lit("div#x.a.b:hover > p")))
    assert (p.tag, p.id, p.classes) == ("div", "x", ["a", "b"])
    assert one(spark, T.data_url_bytes(F.lit("data:text/plain,a%20+b"))) == b"a +b"
    assert one(spark, T.data_url_bytes(T.data_url(F.lit("hé"), "text/plain"))) == "hé".encode()


def test_deep_and_wide_pages_are_rewritten():
    c = rewrite.Rewriter().candidate
    deep = c('<div class="w">' * 60_000 + "<a href='/x'>t</a>" + "</div>" * 60_000)
    assert (deep["html"], deep["collapsed_wrappers"], deep["nodes"]) == ("<a>t</a>", 60_000, 2)
    assert c("<svg>" * 30_000 + "<path>")["html"].count("<svg>") == 3  # the inner ones are small once theirs are replaced
    wide = c('<div role="x"><a href="y">k</a></div>' * 30_000)
    assert wide["nodes"] == 60_000 and wide["html"].startswith('<a href="y">k</a><a')
    scene = "".join(f'<x-piece style="position:absolute;left:{i}px"></x-piece>' for i in range(9))
    found = c('<div id="k">' * 20_000 + f'<div class="board">{scene}</div>')
    assert found["mode"] == "scene-preserving" and (found["scene_custom"], found["scene_primitives"]) == (9, 9) and found["scene_containers"] >= 1
