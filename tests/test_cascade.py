"""Sheets, selectors and the cascade: against a plain matcher, and on odd sheets."""

import random

import pytest
from pyspark.sql import functions as F

from vitrail.functions import selectors as Z
from vitrail.functions import sheets as CSS
from vitrail.operators import cascade as C
from vitrail.operators import htmltree as H


def rules_of(spark, css):
    return spark.createDataFrame([(css,)], "css string").select(F.inline(CSS.rules(F.col("css")))).collect()


@pytest.mark.parametrize(
    "css, found",
    [
        ("a{b:c}", [("a", [], [("b", "c", False)])]),
        ("/* x{y:z} */ a , b{ B : c ! Important ;--X-y: 1; ;d:}", [("a , b", [], [("b", "c", True), ("--X-y", "1", False)])]),
        ("a{b:'};{'}c{d:url(x;y{})}", [("a", [], [("b", "'};{'", False)]), ("c", [], [("d", "url(x;y{})", False)])]),
        ("@media print{a{b:c}}@supports (x:y){@media screen{d{e:f}}}", [("a", ["@media print"], [("b", "c", False)]), ("d", ["@supports (x:y)", "@media screen"], [("e", "f", False)])]),
        ("@import 'x';@font-face{font-family:f}@-webkit-keyframes k{from{a:b}}", []),
        ("a{b:c", [("a", [], [("b", "c", False)])]),
        ("a{b:\"open", [("a", [], [("b", '"open', False)])]),
        ("a{} }b{c:d}", [("b", [], [("c", "d", False)])]),
        ("", []),
    ],
)
def test_rules(spark, css, found):
    assert [(r.selector, r.context, [tuple(d) for d in r.declarations]) for r in rules_of(spark, css)] == found


def test_long_sheets_and_attributes(spark):
    css = "".join(f".c{i}{{top:{i}px;left:url(a;{i})}}" for i in range(3000))
    found = rules_of(spark, css)
    assert len(found) == 3000 and found[-1].declarations[1].value == "url(a;2999)"
    own = spark.createDataFrame([("color:red;top:1px!important; x ;a:url(b;c)",), (None,)], "s string").select(CSS.declarations(F.col("s")).alias("d"), CSS.statements(F.lit("@import 'a;b' screen; p{x:y} @charset \"u\";")).alias("i"))
    rows = own.collect()
    assert [tuple(d) for d in rows[0].d] == [("color", "red", False), ("top", "1px", True), ("a", "url(b;c)", False)] and rows[1].d == []
    assert rows[0].i == ["@import 'a;b' screen", '@charset "u"']


@pytest.mark.parametrize(
    "selector, valid, specificity",
    [
        ("nav li", True, 2), ("#a.b[c]:hover::before", True, 1_003_001), ("*", True, 0), ("a >", False, None), ("> a", False, None), ("a,b", False, None), ("", False, None), ("a:unknown", False, None),
        (":is(a, #b, .c) d", True, 1_000_001), (":where(#b) d", True, 1), (":not(.x, p)", True, 1_000), ("a:nth-child( 2N + 1 )", True, 1_001), ("a:nth-child(x)", False, None), ("a..b", False, None),
        ("a[b", False, None), ("a[b='c d' I]", True, 1_001), ("é > a\\:b", True, 2), ("1a", False, None), ("a  >b+c~d", True, 4), (":hover()", False, None),
    ],
)
def test_compiled(spark, selector, valid, specificity):
    c = spark.createDataFrame([(selector,)], "s string").select(Z.compile(F.col("s")).alias("c")).first().c
    assert c.valid == valid and (not valid or c.specificity == specificity)


# A plain matcher: nodes as dicts, compounds as (type, classes, attribute or None, pseudo or None).


def tree(nodes):
    els = {n.node_idx: {"i": n.node_idx, "up": n.parent_idx, "tag": n.tag, "attrs": n.attrs or {}, "kids": []} for n in nodes if n.tag}
    tops = []
    for e in els.values():
        (els[e["up"]]["kids"] if e["up"] is not None else tops).append(e["i"])
    filled = {n.parent_idx for n in nodes}
    for e in els.values():
        e["line"] = els[e["up"]]["kids"] if e["up"] is not None else tops
        e["empty"] = e["i"] not in filled
    return els


def fits(e, c):
    tag, classes, attr, pseudo = c
    own = e["attrs"].get("class", "").split()
    place, of = e["line"].index(e["i"]) + 1, len(e["line"])
    ok = tag in ("", "*", e["tag"]) and all(x in own for x in classes)
    if attr:
        v = e["attrs"].get(attr[0])
        test = {"": lambda: True, "=": lambda: v == attr[2], "^=": lambda: v.startswith(attr[2]), "$=": lambda: v.endswith(attr[2]), "*=": lambda: attr[2] in v, "~=": lambda: attr[2] in v.split(), "|=": lambda: v == attr[2] or v.startswith(attr[2] + "-")}
        ok = ok and v is not None and test[attr[1]]()
    tests = {
        None: True, ":first-child": place == 1, ":last-child": place == of, ":only-child": of == 1, ":empty": e["empty"], ":root": e["up"] is None, ":nth-child(2n+1)": place % 2 == 1,
        ":nth-child(-n+2)": place <= 2, ":nth-last-child(2)": of - place == 1, ":not(.m, p)": "m" not in own and e["tag"] != "p", ":is(b, .m)": "m" in own or e["tag"] == "b", ":hover": False,
    }
    return ok and tests[pseudo]


def matches(els, e, steps):
    """Backtracking, from the right: steps are [compound, (combinator, compound) ...] from the right."""
    if not fits(e, steps[0]):
        return False
    if len(steps) == 1:
        return True
    comb, rest = steps[1], steps[2:]
    line, at = e["line"], e["line"].index(e["i"])
    up, chain = e["up"], []
    while up is not None:
        chain.append(up)
        up = els[up]["up"]
    to = {" ": chain, ">": chain[:1], "+": line[max(0, at - 1) : at], "~": line[:at]}[comb]
    return any(matches(els, els[j], rest) for j in to)


def written(c):
    tag, classes, attr, pseudo = c
    a = f"[{attr[0]}{attr[1]}'{attr[2]}']" if attr and attr[1] else f"[{attr[0]}]" if attr else ""
    return (tag + "".join("." + x for x in classes) + a + (pseudo or "")) or "*"


def test_matches_are_those_of_a_plain_matcher(spark):
    dice = random.Random(5)
    tags, classes = ["div", "p", "b", "li"], ["m", "n"]
    pseudos = [":first-child", ":last-child", ":only-child", ":empty", ":root", ":nth-child(2n+1)", ":nth-child(-n+2)", ":nth-last-child(2)", ":not(.m, p)", ":is(b, .m)", ":hover"]
    compound = lambda: (
        dice.choice(["", "*", *tags, *tags]), [dice.choice(classes)] if dice.random() < 0.3 else [],
        (dice.choice(["data-k", "lang"]), dice.choice(["", "=", "^=", "$=", "*=", "~=", "|="]), dice.choice(["en", "x", "en-x"])) if dice.random() < 0.2 else None, dice.choice(pseudos) if dice.random() < 0.3 else None,
    )
    selectors = []
    for _ in range(120):
        steps = [compound()]
        for _ in range(dice.choice([0, 1, 1, 2, 3])):
            steps += [dice.choice([" ", " ", ">", "+", "~"]), compound()]
        text = written(steps[-1])
        for k in range(len(steps) - 2, 0, -2):
            text += {" ": " "}.get(steps[k], f" {steps[k]} ") + written(steps[k - 1])
        selectors.append((text, steps))
    pages = []
    for i in range(12):
        html = "".join(
            dice.choice(["<{0} class=\"{1}\" lang=\"{2}\">", "<{0} data-k=\"{2}\">", "<{0}>", "</{0}>", "</{0}>", "t", "<{0}></{0}>"]).format(dice.choice(tags), dice.choice(["m", "n", "m n", "mm"]), dice.choice(["en", "en-x", "x en", "xen"]))
            for _ in range(60)
        )
        pages.append((i, html, [s for s, _ in selectors]))
    d = C.trees(spark.createDataFrame(pages, "page_id int, html string, s array<string>"), s=F.col("s"))
    d = d.withColumn("_given", F.transform("s", lambda s: F.struct(s.alias("selector"))))
    d = C.once(d, given=C.compiled("_given"))
    found = {(r.capture_id, r.node_idx, r.s) for r in C.with_hits(d, "given").select("capture_id", F.inline("hits"), "given").select("capture_id", "node_idx", F.get(F.col("given"), F.col("r"))["selector"].alias("s")).collect()}
    nodes = {i: [] for i, *_ in pages}
    for n in H.nodes(spark.createDataFrame([p[:2] for p in pages], "page_id int, html string")).collect():
        nodes[n.capture_id].append(n)
    expected = set()
    for i, *_ in pages:
        els = tree(sorted(nodes[i], key=lambda n: n.node_idx))
        expected |= {(i, e["i"], text) for e in els.values() for text, steps in selectors if matches(els, e, steps)}
    assert found == expected and len(found) > 500


def state_rows(spark, html):
    return sorted((r.node_idx, r.state, r.name, r.value) for r in C.state_styles(spark.createDataFrame([(1, html)], "page_id int, html string")).collect())


def test_states_are_three_and_follow_whole_selectors(spark):
    html = '<style>nav li:hover{a:1} *:hover{b:2} [data-x]:hover{c:3} .x:focus-within{d:4} .x:focus{d:5} li > :hover{e:6} li:foo:active, li:active{f:7}</style><nav><li data-x="1">t</li></nav><p class="x">u</p>'
    found = state_rows(spark, html)
    li, p, nav = 3, 5, 2
    assert (li, "hover", "a", "1") in found and (nav, "hover", "a", "1") not in found
    assert {i for i, _, n, _ in found if n == "b"} == {0, nav, li, p} and [x for x in found if x[2] == "c"] == [(li, "hover", "c", "3")]
    assert [x for x in found if x[2] == "d"] == [(p, "focus", "d", "5")]
    assert not [x for x in found if x[2] == "e"] and [x for x in found if x[2] == "f"] == [(li, "active", "f", "7")]


def test_given_rules_match_as_those_of_the_page(spark):
    pages = spark.createDataFrame([(1, "<nav><li>t</li></nav>"), (2, "<li>t</li>"), (3, None)], "page_id int, html string")
    rules = spark.createDataFrame([(1, 0, "nav li:hover, a:hover", "color", "red"), (1, 1, "li:hover", "color", "blue"), (2, 0, "nav li:hover", "color", "red"), (3, 0, "p:hover", "a", "b"), (4, 0, "p:hover", "a", "b")], "capture_id int, ordinal int, selector_text string, name string, value string")
    assert [tuple(r) for r in C.given_state_styles(pages, rules).collect()] == [(1, 1, "hover", "color", "blue")]


def test_cascade_and_inheritance(spark):
    html = (
        "<style>p{color:a} .k{color:b} p{color:c} #i{color:d!important} p{top:1px} body{font-size:9px;top:0} div{color:q;--v:1}</style>"
        '<body><div><p id="i" class="k" style="color:e;top:2px">x</p><p class="k">y</p><p style="color:inherit;--v:inherit">z</p><b style="color:initial">w</b></div></body>'
    )
    d = C.style_rules(C.trees(spark.createDataFrame([(1, html)], "page_id int, html string")))
    found = {(r.node_idx, r.name): (r.value, r.from_node, r.origin) for r in C.styles(d, lambda e, i: e["tag"].isin("p", "b")).collect()}
    assert found[4, "color"] == ("d", 4, "regular") and found[4, "top"] == ("2px", 4, "inline") and found[4, "font-size"] == ("9px", 2, "regular")
    assert found[6, "color"] == ("b", 6, "regular") and found[6, "top"] == ("1px", 6, "regular")
    assert found[8, "color"] == ("q", 3, "regular") and found[8, "--v"] == ("1", 3, "regular")
    assert (10, "color") not in found and (10, "top") not in found


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "text"), (4, "<p style=''>x</p>"), (5, "<style></style><style>p{</style><p>"), (6, "<style>p:bad,p{a:b}</style><p>x</p>")]
    d = C.style_rules(C.trees(spark.createDataFrame(rows, "page_id int, html string")))
    assert C.matched_declarations(d).collect() == []
    got = C.capture_styles(spark.createDataFrame(rows, "page_id int, html string"), lambda e, i: e["tag"] == "p", {"computed": F.col("page_id") == 4}).collect()
    assert sorted((r.capture_id, r.matched, r.computed, r.inline, r.warnings) for r in got) == [(4, 0, None, 0, "computed-style-failed,css-capture-partial-failure"), (5, 0, 0, 0, ""), (6, 0, 0, 0, "")]
