"""Record linkage of fingerprints and nodes: additive scores, margins and calibrated confidence.

The fingerprint of a capture and its nodes share the capture's key, so scoring is an equi-join on it;
there is no cross join, and each pair is scored in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.arrays import let, once, scan
from ..sources import fixtures as X
from . import fallback as B
from . import htmltree as H

#: FIXED VALUES: points of the signals of a match by document traversal.
POINTS = {
    "tag": 24, "id": 32, "class": 4, "class_cap": 18, "sibling": 7, "children_same": 5, "children_near": 2, "children_far": -4,
    "attribute": 4, "attribute_cap": 14, "ancestor_tag": 3, "ancestor_id": 4, "ancestor_class": 1, "ancestor_cap": 18,
    "shadow_same": 3, "shadow_other": -10, "depth_same": 5, "depth_near": 1, "depth_far": -6, "host": 3, "host_cap": 8, "host_none": -5,
}
LEVELS, SUMMARY_LEVELS, RESOLVED, WINDOW = 5, 8, 32, 9
SELECTOR_CONFIDENCE = 0.28


def _lower_attribute(attrs: Column, name: str) -> Column:
    return F.lower(F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit("")))


def described(pages: DataFrame, in_shadow=None) -> DataFrame:
    """(capture_id, nodes, els): the elements of each page with what matching looks at, inside the row.

    An element has its places among all children and among the elements of its parent, its numbers of
    children of both sorts, id, classes, attributes, its ancestors (nearest first, with id and classes)
    and the hosts of the shadow roots around it.  ``in_shadow`` says of a node whether it hangs in its
    parent's shadow root.
    """
    in_shadow = in_shadow or (lambda n: F.lit(False))
    d = H.parsed(pages, paths=True)
    # Nodes in order of parents: places are counted along them, and the last of a parent tells its children.
    rows = F.array_sort(F.transform("nodes", lambda n: F.struct(F.coalesce(n["parent_idx"], F.lit(-1)).alias("up"), n["node_idx"].alias("i"), n["tag"].isNotNull().cast("int").alias("e"))))

    def count(_: Column, a: Column, x: Column) -> Column:
        same = x["up"] == a["up"]
        place, before = F.when(same, a["k"]).otherwise(0), F.when(same, a["n"]).otherwise(0)
        own = F.struct(x["i"].alias("i"), x["up"].alias("up"), place.alias("place"), before.alias("element_place"), (before + x["e"]).alias("elements"))
        return F.struct(F.struct(x["up"].alias("up"), (place + 1).alias("k"), (before + x["e"]).alias("n")).alias("s"), own.alias("o"))

    start = F.struct(F.lit(-2).alias("up"), F.lit(0).alias("k"), F.lit(0).alias("n"))
    d = once(d, _places=scan(rows, start, count, "struct<i:int,up:int,place:int,element_place:int,elements:int>"))
    last = F.filter("_places", lambda x, k: F.coalesce(F.get(F.col("_places"), k + 1)["up"] != x["up"], F.lit(True)))
    d = once(d, _kids=F.map_from_entries(F.transform(last, lambda x: F.struct(x["up"], F.struct((x["place"] + 1).alias("all"), x["elements"].alias("elements"))))))
    d = once(d, _at=F.array_sort("_places")).drop("_places")

    def shape(n: Column) -> Column:
        # What is read more than once is computed once a node: lambdas repeat it otherwise.
        read = F.struct(F.get(F.col("_at"), n["node_idx"]).alias("at"), F.try_element_at("_kids", n["node_idx"]).alias("kids"), H.attributes(F.coalesce(n["attrs"], F.lit(""))).alias("attrs"))

        def own(x: Column) -> Column:
            at, kids, attrs = x["at"], x["kids"], x["attrs"]
            return F.struct(
                n["node_idx"].alias("i"), n["parent_idx"].alias("up"), n["tag"].alias("tag"), n["path"].alias("path"), at["place"].alias("place"), at["element_place"].alias("element_place"),
                F.coalesce(kids["all"], F.lit(0)).alias("children"), F.coalesce(kids["elements"], F.lit(0)).alias("element_children"),
                _lower_attribute(attrs, "id").alias("id"), F.transform(T.class_tokens(F.try_element_at(attrs, F.lit("class"))), F.lower).alias("classes"), attrs.alias("attrs"), in_shadow(n).alias("shadow"),
            )

        return let(read, own)

    d = once(d, _all=F.transform("nodes", shape))
    at = lambda i: F.get(F.col("_all"), i)

    def context(e: Column) -> Column:
        up = F.transform(F.slice(F.reverse(e["path"]), 1, SUMMARY_LEVELS), at)
        summary = F.transform(up, lambda x: F.struct(x["tag"].alias("tag"), x["id"].alias("id"), F.slice(x["classes"], 1, 8).alias("classes")))
        roots = F.filter(F.transform(F.reverse(F.concat(e["path"], F.array(e["i"]))), at), lambda x: x["shadow"])
        hosts = F.transform(F.transform(roots, lambda x: at(x["up"])), lambda h: F.concat(h["tag"], F.when(h["id"] != "", F.concat(F.lit("#"), h["id"])).otherwise(""), F.array_join(F.transform(F.slice(h["classes"], 1, 2), lambda c: F.concat(F.lit("."), c)), "")))
        return F.struct(
            *[e[c].alias(c) for c in ("i", "tag", "place", "element_place", "children", "element_children", "id", "classes", "attrs")], summary.alias("ancestors"), hosts.alias("hosts")
        )

    els = F.transform(F.filter("_all", lambda e: e["tag"].isNotNull()), context)
    return once(d, els=els).select("capture_id", "nodes", "els")


def picked(els: Column, tag: str = "a") -> Column:
    """The element that was picked: the second link, or the only one."""
    links = F.filter(els, lambda e: e["tag"] == tag)
    return F.coalesce(F.get(links, F.lit(1)), F.get(links, F.lit(0)))


def _class_points(p: dict, e: Column, fp: Column) -> Column:
    return F.least(F.lit(p["class_cap"]), p["class"] * F.size(F.array_intersect(e["classes"], fp["classes"])))


def _hint_points(p: dict, e: Column, fp: Column) -> Column:
    own = lambda h: F.lower(T.compact(F.coalesce(F.try_element_at(e["attrs"], h["name"]), F.lit(""))))
    same = F.filter(fp["hints"], lambda h: (F.lower(h["value"]) != "") & (own(h) == F.lower(h["value"])))
    return F.least(F.lit(p["attribute_cap"]), p["attribute"] * F.size(same))


def _ancestor_points(p: dict, e: Column, fp: Column) -> Column:
    pairs = F.arrays_zip(F.slice(fp["ancestors"], 1, LEVELS).alias("x"), F.slice(e["ancestors"], 1, LEVELS).alias("y"))
    level = lambda z: (
        F.when(z["x"]["tag"] == z["y"]["tag"], p["ancestor_tag"]).otherwise(0) + F.when((z["x"]["id"] != "") & (z["x"]["id"] == z["y"]["id"]), p["ancestor_id"]).otherwise(0)
        + p["ancestor_class"] * F.greatest(F.coalesce(F.size(F.array_intersect(z["x"]["classes"], z["y"]["classes"])), F.lit(0)), F.lit(0))
    )
    both = F.filter(pairs, lambda z: z["x"].isNotNull() & z["y"].isNotNull())
    return F.least(F.lit(p["ancestor_cap"]), F.aggregate(both, F.lit(0), lambda a, z: a + level(z)))


def _child_points(p: dict, apart: Column) -> Column:
    return F.when(apart == 0, p["children_same"]).when(apart <= 2, p["children_near"]).otherwise(p["children_far"])


def _shadow_points(p: dict, e: Column, fp: Column) -> list[Column]:
    """Points for the shadow roots around: inside or not, how deep, and whose."""
    inside, own = F.size(fp["hosts"]) > 0, F.size(e["hosts"]) > 0
    apart = F.abs(F.size(fp["hosts"]) - F.size(e["hosts"]))
    names = F.transform(e["ancestors"], lambda x: F.concat(x["tag"], F.when(x["id"] != "", F.concat(F.lit("#"), x["id"])).otherwise("")))
    met = F.size(F.filter(fp["hosts"], lambda h: F.exists(names, lambda x: F.contains(x, h))))
    return [
        F.when(inside == own, p["shadow_same"]).otherwise(p["shadow_other"]),
        F.when(inside & own, F.when(apart == 0, p["depth_same"]).when(apart == 1, p["depth_near"]).otherwise(p["depth_far"])).otherwise(0),
        F.when(inside & own, F.when(met > 0, F.least(F.lit(p["host_cap"]), p["host"] * met)).otherwise(p["host_none"])).otherwise(0),
    ]


def with_fingerprint(d: DataFrame, extra=None) -> DataFrame:
    """``d`` with the picked element's fingerprint: the element, and hints from its attributes."""
    d = once(d, _fp=picked(F.col("els"))).where("_fp is not null")
    return once(d, fp=F.col("_fp").withField("hints", B.attribute_hints(F.col("_fp.attrs")))).drop("_fp")


def candidates(els: Column, fp: Column) -> Column:
    """Score, node_idx, tag and penalty of every element with points, the best first.

    Candidates count all children, the fingerprint counted elements, as the two sides do.
    """
    p = POINTS

    def points(e: Column) -> Column:
        apart = F.abs(e["children"] - fp["element_children"])

        def own(parts: Column) -> Column:
            total = (
                F.when(e["tag"] == fp["tag"], p["tag"]).otherwise(0) + F.when((e["id"] != "") & (e["id"] == fp["id"]), p["id"]).otherwise(0) + _class_points(p, e, fp)
                + F.when(e["place"] == fp["element_place"], p["sibling"]).otherwise(0) + _hint_points(p, e, fp) + _ancestor_points(p, e, fp) + F.aggregate(parts, F.lit(0), lambda a, x: a + x)
            )
            penalty = F.aggregate(parts, F.lit(0), lambda a, x: a + F.greatest(F.lit(0), -x))
            return F.struct((-total).alias("s"), e["i"].alias("node_idx"), e["tag"].alias("tag"), penalty.alias("penalty"))

        return let(F.array(_child_points(p, apart), *_shadow_points(p, e, fp)), own)

    return F.array_sort(F.filter(F.transform(els, points), lambda x: x["s"] < 0))


def score(d: DataFrame) -> DataFrame:
    """``d`` with ``c``, the candidates for its fingerprint."""
    return once(d, c=candidates(F.col("els"), F.col("fp")))


def confidence(best: Column, margin: Column, penalty: Column, near: Column) -> Column:
    """Calibrated confidence of a document match."""
    base = N.clamp(best.cast("double") / N.dbl(100), 0.16, 0.93)
    bonus = N.clamp(margin.cast("double") / N.dbl(30), 0, 0.08)
    drift = N.clamp(penalty.cast("double") / N.dbl(35), 0, 0.28)
    crowd = F.when(near > 1, F.least(N.dbl(0.2), (near - 1).cast("double") * N.dbl(0.06))).otherwise(N.dbl(0))
    return F.greatest(N.dbl(0.05), F.least(N.dbl(1), base + bonus - drift - crowd))


def runtime_confidence(best: Column, margin: Column, penalty: Column, near: Column) -> Column:
    """Calibrated confidence of a match in the running page."""
    base = N.clamp(best.cast("double") / N.dbl(130), 0.18, 0.97)
    bonus = N.clamp(margin.cast("double") / N.dbl(35), 0, 0.08)
    drift = N.clamp(penalty.cast("double") / N.dbl(45), 0, 0.3)
    crowd = F.when(near > 1, F.least(N.dbl(0.22), (near - 1).cast("double") * N.dbl(0.07))).otherwise(N.dbl(0))
    return F.greatest(N.dbl(0.05), F.least(N.dbl(1), base + bonus - drift - crowd))


#: FIXED VALUES: points of the signals of a match in the running page.
RUNTIME_POINTS = {
    "tag": 26, "id": 34, "class": 4, "class_cap": 20, "text_same": 18, "text_near": 8, "text_far": -8, "sibling": 8, "children_same": 6, "children_near": 2,
    "children_far": -6, "attribute": 5, "attribute_cap": 18, "ancestor_tag": 4, "ancestor_id": 4, "ancestor_class": 1, "ancestor_cap": 20,
    "shadow_same": 4, "shadow_other": -12, "overlap_high": 26, "overlap_mid": 16, "centre": 8,
}
RUNTIME_RESOLVED, RUNTIME_WINDOW, TEXT_OVERLAP = 28, 12, 0.45


def content(nodes: Column, i: Column, limit: int = 280) -> Column:
    """Compact lower-case text below a node, cut to ``limit``."""
    inside = F.slice(nodes, i + 1, F.get(nodes, i)["end_idx"] - i + 1)
    below = F.filter(inside, lambda n: n["tag"].isNull())
    return F.substring(F.lower(T.compact(F.array_join(F.transform(below, lambda n: n["text"]), ""))), 1, limit)


def box_points(fp: Column, own: Column) -> tuple[Column, Column]:
    """Points for where an element is, and penalty points for drift (which do not lower the score)."""
    cut = lambda p, s: F.greatest(N.dbl(0), F.least(fp[p] + fp[s], own[p] + own[s]) - F.greatest(fp[p], own[p]))
    inter, area_a, area_b = cut("x", "width") * cut("y", "height"), fp["width"] * fp["height"], own["width"] * own["height"]
    iou = inter / F.greatest(N.dbl(1), area_a + area_b - inter)
    ratio = F.greatest(area_a, area_b) / F.greatest(N.dbl(1), F.least(area_a, area_b))
    mid = lambda b, p, s: b[p] + b[s] / 2
    near = N.hypotenuse_distance(mid(fp, "x", "width"), mid(fp, "y", "height"), mid(own, "x", "width"), mid(own, "y", "height"))
    close = near / F.greatest(N.dbl(1), fp["width"], fp["height"]) <= 0.6
    r = RUNTIME_POINTS
    high = r["overlap_high"] + F.when(ratio <= 1.5, 4).when(ratio <= 2.2, 2).otherwise(0)
    points = F.when(iou >= 0.6, high).when(iou >= 0.35, r["overlap_mid"] + F.when(ratio <= 1.8, 2).otherwise(0)).when(close, r["centre"]).otherwise(0)
    drift = F.when((iou < 0.35) & ~close, F.when(ratio > 3, 14).otherwise(8)).otherwise(0)
    return points, drift


def runtime_score(d: DataFrame, box) -> DataFrame:
    """``d`` with ``c`` as ``score`` gives it, of the elements with the fingerprint's tag in the light document.

    ``box`` gives an element's box; ``fp`` has its own as ``box``.
    """
    p, fp = RUNTIME_POINTS, F.col("fp")
    words = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    same = F.filter("els", lambda e: (e["tag"] == fp["tag"]) & (F.size(e["hosts"]) == 0))
    d = once(d, _same=F.transform(same, lambda e: e.withField("content", content(F.col("nodes"), e["i"]))), _text=F.substring(content(F.col("nodes"), fp["i"]), 1, 220))

    def points(e: Column) -> Column:
        mine, theirs = e["content"], F.col("_text")
        contained = F.contains(mine, theirs) | F.contains(theirs, F.substring(mine, 1, 80))
        text = F.when((theirs == "") | (mine == ""), 0).when(contained, p["text_same"]).when(T.overlap(words(mine), words(theirs)) >= TEXT_OVERLAP, p["text_near"]).otherwise(p["text_far"])
        children = _child_points(p, F.abs(e["element_children"] - fp["element_children"]))
        shadow = F.when(F.size(fp["hosts"]) == 0, p["shadow_same"]).otherwise(p["shadow_other"])
        where, drift = box_points(fp["box"], box(e["i"], 0))
        total = (
            p["tag"] + F.when((e["id"] != "") & (e["id"] == fp["id"]), p["id"]).otherwise(0) + _class_points(p, e, fp) + text
            + F.when(e["element_place"] == fp["element_place"], p["sibling"]).otherwise(0) + children + _hint_points(p, e, fp) + _ancestor_points(p, e, fp) + shadow + where
        )
        penalty = F.aggregate(F.array(text, children, shadow), drift, lambda a, x: a + F.greatest(F.lit(0), -x))
        return F.struct((-total).alias("s"), e["i"].alias("node_idx"), e["tag"].alias("tag"), penalty.alias("penalty"))

    return once(d, c=F.array_sort(F.filter(F.transform("_same", points), lambda x: x["s"] < 0)))


def resolve(scored: DataFrame, calibrate=None, cut: int = RESOLVED, window: int = WINDOW) -> DataFrame:
    """The best candidate of each capture (ties: the first in the document), margin and confidence."""
    d = scored.where(F.size("c") > 0)
    best, second = F.col("c")[0], F.get(F.col("c"), F.lit(1))
    top = -best["s"]
    margin = F.coalesce(top + second["s"], top)
    near = F.size(F.filter("c", lambda x: top + x["s"] < window))
    line = lambda x: F.concat(x["tag"], F.lit(":"), (-x["s"]).cast("string"), F.lit("(-"), x["penalty"].cast("string"), F.lit(")"))
    return d.select(
        "capture_id", best["node_idx"].alias("node_idx"), top.alias("score"), margin.alias("margin"), near.alias("near"),
        N.thousandths((calibrate or confidence)(top, margin, best["penalty"], near)).alias("confidence"),
        (top >= cut).alias("resolved"), F.size("c").alias("candidates"),
        ((second.isNotNull() & (margin < window)) | (near > 1)).alias("ambiguous"),
        F.array_join(F.transform(F.slice("c", 1, 3), line), ", ").alias("top3"),
        (best["node_idx"] == F.col("fp.i")).alias("is_true"),
    )


def cascade(pages: DataFrame, matched: DataFrame, hints: DataFrame) -> DataFrame:
    """Strategy of each capture: the document match if resolved, else the selector, else none.

    Hints in the snapshot's strings add up to 0.06 to a match.
    """
    n = F.coalesce("hints", F.lit(0))
    bonus = F.when(n == 0, N.dbl(0)).otherwise(F.least(N.dbl(0.06), N.dbl(0.015) + N.dbl(0.01) * n))
    d = pages.select("capture_id", "has_selector").join(matched, "capture_id", "left").join(hints, "capture_id", "left")
    ok = F.coalesce("resolved", F.lit(False))
    strategy = F.when(ok, "dom-traversal").when(F.col("has_selector"), "selector-fallback").otherwise("unresolved")
    sure = F.when(ok, N.clamp(F.col("confidence") + bonus)).when(F.col("has_selector"), N.dbl(SELECTOR_CONFIDENCE)).otherwise(N.dbl(0))
    return d.select("capture_id", strategy.alias("strategy"), N.thousandths(sure).alias("confidence"))


def stable_selector(tag: Column, attrs: Column) -> Column:
    """The most stable selector of an element."""
    get = lambda k: F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit(""))
    esc = lambda x: F.regexp_replace(x, "([\"'\\\\.#:\\[\\]()\\s])", "\\\\$1")
    attr = lambda k: F.concat(tag, F.lit(f'[{k}="'), esc(get(k)), F.lit('"]'))
    classes = F.slice(T.class_tokens(F.try_element_at(attrs, F.lit("class"))), 1, 2)
    return F.coalesce(
        F.concat(F.lit('[data-testid="'), esc(F.coalesce(get("data-testid"), get("data-test"))), F.lit('"]')),
        F.concat(F.lit("#"), esc(get("id"))),
        attr("role"),
        attr("aria-label"),
        F.when(F.size(classes) > 0, F.concat(tag, F.lit("."), F.array_join(F.transform(classes, esc), "."))),
        tag,
    )


def component_kind(tag: Column, attrs: Column) -> Column:
    get = lambda k: F.lower(F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit("")))
    search = (get("type") == "search") | get("aria-label").contains("search") | get("placeholder").contains("search")
    return (
        F.when((tag == "input") & search, "search-input").when(tag.isin("input", "textarea"), "text-input")
        .when((tag == "button") | (get("role") == "button"), "button").when(tag == "a", "link").when(tag == "img", "image")
        .when((tag == "article") | ((tag == "div") & get("class").contains("card")), "card").otherwise("unknown")
    )


def target_class(nodes: DataFrame) -> DataFrame:
    """Class and subtype of each capture's root, from counts over its nodes; the first that fits."""
    tag = F.col("tag")
    n = lambda *t: F.count_if(tag.isin(*t))
    has = lambda k: F.lower(F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("")))
    d = nodes.groupBy("capture_id").agg(
        (n("svg") + n("canvas")).alias("surfaces"), n("path").alias("paths"), n("polyline", "polygon").alias("polys"), n("line").alias("lines"),
        n("rect").alias("rects"), n("text").alias("labels"), n("h1", "h2", "h3").alias("headings"), n("p").alias("paragraphs"), n("div").alias("divs"),
        n("button").alias("buttons"), n("form").alias("forms"), F.count_if(has("role") == "search").alias("search"),
        F.count_if(has("class").contains("card")).alias("cards"),
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.length(T.compact(F.col("text"))))), F.lit(0)).alias("text_length"),
    )
    c = F.col
    chart = (c("surfaces") >= 1) & ((c("paths") >= 2) | (c("polys") >= 1) | (c("lines") >= 4) | (c("rects") >= 6) | (c("labels") >= 3))
    toolbar = (c("buttons") >= 3) & (c("text_length") <= 40)
    noisy = (c("headings") >= 1) & (c("paragraphs") >= 1) & ((c("cards") >= 1) | (c("buttons") >= 2) | (c("divs") >= 8) | (c("text_length") > 120))
    pick = lambda *v: F.when(c("search") >= 1, v[0]).when(chart, v[1]).when(c("forms") >= 1, v[2]).when(toolbar, v[3]).when(noisy, v[4]).otherwise(v[5])
    return d.select(
        "capture_id",
        pick("semantic-shell", "render-scene", "interactive-composite", "semantic-shell", "noisy-container", "semantic-shell").alias("target_class"),
        pick("search-like", "chart-like", "form-like", "toolbar-like", "generic", "generic").alias("subtype"),
        "headings", "paragraphs", "divs", "text_length",
    )


#: FIXED VALUES: words and elements by which targets are told apart.
CHART_WORDS = ("chart", "graph", "plot", "series", "trend", "analytics", "axis")
SCENE_WORDS = ("board", "puzzle__board", "main-board", "cg-wrap", "overlay", "coords")
SCENE_TAGS = ("piece", "square", "coord", "coords", "cg-board", "cg-container", "cg-wrap")
LEAVES = ("button", "input", "textarea", "select", "img", "svg")
SEARCH_WORDS = ("rnnxgb", "a8sbwf")
SEARCH_FIELD_WORD = "glfyf"


def classified(pages: DataFrame, pick: Column, viewport: float) -> DataFrame:
    """Class, subtype and reasons of each capture's target, the first rule that fits.

    ``pick`` names the root's tag (the first element of it); the target is the root's first element
    child if it is a link, an input or a leaf, else the root itself.  All signals are counted inside the
    row, over the root's subtree without itself; sizes follow from node numbers, as pages have no layout.
    """
    d = H.parsed(pages, pick=pick)
    d = d.withColumn("top", F.get(F.filter("nodes", lambda n: n["tag"] == F.col("pick")), F.lit(0))).where("top is not null")
    d = d.withColumn("under", F.slice("nodes", F.col("top.node_idx") + 2, F.col("top.end_idx") - F.col("top.node_idx")))
    shape = lambda n: F.struct(n["node_idx"].alias("i"), n["parent_idx"].alias("up"), n["tag"].alias("tag"), H.attributes(F.coalesce(n["attrs"], F.lit(""))).alias("a"), n["text"].alias("text"))
    d = d.select("capture_id", shape(F.col("top")).alias("root"), F.transform("under", shape).alias("below"))
    value = lambda n, k: F.lower(F.coalesce(F.try_element_at(n["a"], F.lit(k)), F.lit("")))
    children = F.filter("below", lambda n: (n["up"] == F.col("root.i")) & n["tag"].isNotNull())
    first = F.get(children, F.lit(0))
    d = d.withColumn("target", F.when(first["tag"].isin("a", *LEAVES), first).otherwise(F.col("root"))).withColumn("children", children)
    root, target = F.col("root"), F.col("target")
    count = lambda p: F.size(F.filter("below", lambda n: n["tag"].isNotNull() & p(n)))
    tags = lambda *t: count(lambda n: n["tag"].isin(*t))
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    button = lambda n: (n["tag"] == "button") | (value(n, "role") == "button")
    own = lambda *t: F.when(root["tag"].isin(*t), 1).otherwise(0)
    classes = F.concat(value(target, "class"), F.lit(" "), value(root, "class"))
    text = F.length(T.compact(F.array_join(F.transform(F.filter("below", lambda n: n["tag"].isNull()), lambda n: n["text"]), "")))
    width, height = root["i"] % 180 + 20, root["i"] % 60 + 10
    search = (target["tag"].isin("textarea", "input") & ((value(target, "name") == "q") | (value(target, "role") == "combobox") | F.contains(value(target, "class"), F.lit(SEARCH_FIELD_WORD))))
    search = search | any_of(value(root, "class"), SEARCH_WORDS) | ((root["tag"] == "form") & (value(root, "role") == "search"))
    scene = target["tag"].isin(*SCENE_TAGS) | root["tag"].isin(*SCENE_TAGS) | any_of(value(root, "class"), SCENE_WORDS)
    drawn = (tags("path") >= 2) | (tags("polyline", "polygon") >= 1) | (tags("line") >= 4) | (tags("rect") >= 6) | (tags("text") >= 3) | any_of(classes, CHART_WORDS)
    chart = (tags("svg", "canvas") + own("svg", "canvas") >= 1) & drawn
    controls = count(lambda n: button(n) | ((n["tag"] == "input") & value(n, "type").isin("button", "submit")))
    direct = F.size(F.filter("children", button))
    role = F.coalesce(F.nullif(value(root, "role"), F.lit("")), value(target, "role"))
    toolbar = (role == "toolbar") | ((controls >= 3) & (direct >= 3) & (width > height * 2) & (text <= 40))
    leaf = target["tag"].isin(*LEAVES) & (target["i"] == root["i"])
    named = lambda w: count(lambda n: F.contains(value(n, "class"), F.lit(w)))
    progress = count(lambda n: (n["tag"] == "progress") | (value(n, "role") == "progressbar"))
    dense = (named("badge") + named("pill") >= 1) | (named("card") >= 1) | (progress >= 1) | (count(button) >= 2) | (tags("div") >= 8) | (text > 120)
    ratio = F.greatest(N.dbl(1), (width * height).cast("double")) / N.dbl(viewport)
    noisy = (ratio > 0.12) & (tags("h1", "h2", "h3") >= 1) & (tags("p") >= 1) & (F.size("children") >= 2) & dense
    rules = (
        (search, "semantic-shell", "search-like", "class-evidence:search-field-present class-evidence:functional-wrapper-present"),
        (scene, "render-scene", "board-like", "class-evidence:scene-primitives-present class-evidence:frame-chain-required"),
        (chart, "render-scene", "chart-like", "class-evidence:chart-primitives-present class-evidence:scene-visualization-dominant"),
        (root["tag"] == "form", "interactive-composite", "form-like", "class-evidence:form-root"),
        (toolbar, "semantic-shell", "toolbar-like", "class-evidence:toolbar-cluster-present"),
        (leaf, "semantic-leaf", "generic", "class-evidence:leaf-interactive-node"),
        (noisy, "noisy-container", "generic", "class-evidence:multi-region-dense-container"),
        (F.lit(True), "semantic-shell", "generic", "class-evidence:bounded-shell-default"),
    )
    fits = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("target_class"), F.lit(v).alias("subtype"), F.lit(r).alias("reasons"))) for c, k, v, r in rules])
    return d.select("capture_id", target["tag"].alias("target_tag"), text.alias("text_length"), fits.alias("f")).select("capture_id", "target_tag", "text_length", "f.*")


def token_overlap(texts: DataFrame, previews: DataFrame, cut: float = 0.2) -> DataFrame:
    """Pairs of a text and a preview whose token overlap reaches ``cut``.

    A pair over the cut shares at least ``cut`` of the preview's tokens, so it shares one of any
    ``1 - cut`` of them and one more: only a preview's tokens that fewest previews have are joined,
    which leaves the most common words out.  A text cannot have over 1 / cut times the tokens of the
    longest preview, and a long one must share more.  Candidate pairs are then compared exactly.
    """
    # Generated columns are computed once; a plain projection would be repeated in filter and joins.
    a = texts.select("doc_id", F.inline(F.array(F.struct(F.array_distinct(T.tokens(F.col("text"))).alias("a")))))
    b = previews.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("b"))
    longest = b.agg(F.max(F.size("b")).alias("longest"))  # one row
    a = a.join(F.broadcast(longest), F.size("a") <= F.floor(F.col("longest") / cut)).drop("longest")
    terms = b.select("item_id", F.size("b").alias("nb"), F.explode("b").alias("t"))
    rarity = terms.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    order = F.row_number().over(W.partitionBy("item_id").orderBy("f", "t"))
    rare = terms.join(rarity, "t").withColumn("r", order).where(F.col("r") <= F.col("nb") - F.ceil(F.col("nb") * cut) + 1)
    shared = a.select("doc_id", F.size("a").alias("na"), F.explode("a").alias("t")).join(rare.select("item_id", "nb", "t"), "t")
    counted = shared.groupBy("doc_id", "item_id", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    # Of the tokens left out a pair shares all at most; the rest of what it needs must be here.
    need = F.ceil(F.greatest("na", "nb") * cut) - F.ceil(F.col("nb") * cut) + 1
    pairs = counted.where(F.col("m") >= need).select("doc_id", "item_id")
    found = pairs.join(a, "doc_id").join(b, "item_id")
    return found.select("doc_id", "item_id", N.thousandths(T.overlap(F.col("a"), F.col("b"))).alias("overlap")).where(F.col("overlap") >= cut)


def box_overlap(a: DataFrame) -> DataFrame:
    """Intersection over union, area ratio and centre distance of the boxes in each row."""
    w = F.greatest(F.lit(0.0), F.least(F.col("ax") + F.col("aw"), F.col("bx") + F.col("bw")) - F.greatest("ax", "bx"))
    h = F.greatest(F.lit(0.0), F.least(F.col("ay") + F.col("ah"), F.col("by") + F.col("bh")) - F.greatest("ay", "by"))
    inter, area_a, area_b = w * h, F.col("aw") * F.col("ah"), F.col("bw") * F.col("bh")
    mid = lambda p, s: F.col(p) + F.col(s) / 2
    return a.withColumns(
        {
            "iou": N.thousandths(F.coalesce(F.try_divide(inter, area_a + area_b - inter), F.lit(0.0))),
            "area_ratio": N.thousandths(F.coalesce(F.try_divide(F.least(area_a, area_b), F.greatest(area_a, area_b)), F.lit(0.0))),
            "distance": N.thousandths(N.hypotenuse_distance(mid("ax", "aw"), mid("ay", "ah"), mid("bx", "bw"), mid("by", "bh"))),
        }
    )


def _boxes(s, d):
    p = F.col("page_id").cast("double")
    return s.read.parquet(f"{d}/pages.parquet").select(
        F.col("page_id").alias("capture_id"), (p * 7 % 90).alias("ax"), (p * 13 % 70).alias("ay"), (p % 18 + 20).alias("aw"), (p % 6 + 10).alias("ah"),
        (p * 5 % 90).alias("bx"), (p * 11 % 70).alias("by"), (p % 9 + 30).alias("bw"), (p % 5 + 20).alias("bh"),
    )


def _nodes(s, d):
    return H.nodes(H._read(s, d), paths=False)


def _in_shadow(n: Column) -> Column:
    return (n["tag"] == "li") & (n["node_idx"] % 4 == 0)


def _described(s, d):
    return with_fingerprint(described(H.spread(X.varied_pages(s, d)), _in_shadow))


def _matched(s, d):
    return resolve(score(_described(s, d)))


def _box(i: Column, shift: int) -> Column:
    return F.struct((i * 7 % 900 + shift).cast("double").alias("x"), (i * 13 % 700).cast("double").alias("y"), (i % 180 + 20).cast("double").alias("width"), (i % 60 + 10).cast("double").alias("height"))


def _runtime(s, d):
    c = _described(s, d).withColumnRenamed("fp", "_fp")
    c = once(c, fp=F.col("_fp").withField("box", _box(F.col("_fp.i"), 9)))
    return resolve(runtime_score(c, _box), runtime_confidence, RUNTIME_RESOLVED, RUNTIME_WINDOW)


def _fingerprint_rows(s, d):
    fp = F.col("fp")
    return _described(s, d).select(
        "capture_id", fp["i"].alias("node_idx"), fp["tag"].alias("tag"), fp["element_place"].alias("sibling_index"), fp["element_children"].alias("child_count"),
        F.array_join(F.transform(fp["hints"], lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("hints"),
        F.array_join(F.transform(fp["ancestors"], lambda x: F.concat(x["tag"], F.lit("#"), x["id"], F.lit("."), F.array_join(x["classes"], "."))), ">").alias("ancestry"),
        F.size(fp["hosts"]).alias("shadow_depth"), F.array_join(fp["hosts"], ">").alias("host_chain"),
    )


def _cascade(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), (F.col("page_id") % 3 != 0).alias("has_selector"))
    hints = pages.select("capture_id", (F.col("capture_id") % 5).alias("hints"))
    weak = _matched(s, d).withColumn("resolved", F.col("resolved") & (F.col("capture_id") % 4 != 0))
    return cascade(pages, weak, hints)


def _elements(s, d):
    return _nodes(s, d).where("kind = 'element'")


_PICKS = ("div", "article", "nav", "footer", "svg", "body", "h1")


def _classified(s, d):
    pages = X.varied_pages(s, d)
    pick = F.element_at(F.array(*map(F.lit, _PICKS)), (F.col("page_id") % len(_PICKS) + 1).cast("int"))
    return classified(H.spread(pages), pick, 9_000.0)


QUERIES = {
    "target_classification": _classified,
    "target_fingerprint": _fingerprint_rows,
    "fingerprint_match": _matched,
    "runtime_match": _runtime,
    "mapping_cascade": _cascade,
    "stable_selector": lambda s, d: _elements(s, d).select("capture_id", "node_idx", stable_selector(F.col("tag"), F.col("attrs")).alias("selector")),
    "component_kind": lambda s, d: _elements(s, d).groupBy(component_kind(F.col("tag"), F.col("attrs")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "target_class": lambda s, d: target_class(_nodes(s, d)),
    "token_overlap": lambda s, d: token_overlap(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet")),
    "box_overlap": lambda s, d: box_overlap(_boxes(s, d)).select("capture_id", "iou", "area_ratio", "distance"),
}

_ELEMENTS = f"""WITH RECURSIVE {H.SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY capture_id, parent_idx ORDER BY node_idx) - 1 AS sibling_idx FROM nodes),
kids AS (SELECT capture_id, parent_idx AS node_idx, count(*)::INT AS children FROM nodes WHERE parent_idx IS NOT NULL GROUP BY ALL),
names AS (SELECT capture_id, map(list(node_idx), list(tag)) AS names FROM nodes WHERE tag IS NOT NULL GROUP BY capture_id),
el AS (SELECT p.capture_id, p.node_idx, p.tag, p.sibling_idx, coalesce(k.children, 0) AS children, lower(regexp_extract(raw, '(?:^|\\s)id\\s*=\\s*"([^"]*)"', 1)) AS id, list_filter(string_split_regex(lower(regexp_extract(raw, '(?:^|\\s)class\\s*=\\s*"([^"]*)"', 1)), '\\s+'), lambda x: x <> '') AS classes,
  regexp_extract(raw, 'href\\s*=\\s*"([^"]*)"', 1) AS href, list_transform(list_reverse(path)[1:5], lambda i: names[i]) AS ancestors, raw
  FROM placed p LEFT JOIN kids k USING (capture_id, node_idx) JOIN names n USING (capture_id) WHERE tag IS NOT NULL)
"""
_SHADOWED = f"""WITH RECURSIVE {X.VARIED_SQL}, {H.sql_over('vpages')},
pl AS (SELECT *, (row_number() OVER (PARTITION BY capture_id, path[-1] ORDER BY node_idx) - 1)::INT AS place, (count(tag) OVER (PARTITION BY capture_id, path[-1] ORDER BY node_idx) - (tag IS NOT NULL)::INT)::INT AS eplace FROM nodes),
kd AS (SELECT capture_id, path[-1] AS node_idx, count(*)::INT AS kids, count(tag)::INT AS ekids FROM nodes WHERE len(path) > 0 GROUP BY ALL),
e0 AS (SELECT p.*, coalesce(kids, 0) AS kids, coalesce(ekids, 0) AS ekids, lower(regexp_extract(raw, '(?:^|\\s)id\\s*=\\s*"([^"]*)"', 1)) AS id, list_filter(string_split_regex(lower(regexp_extract(raw, '(?:^|\\s)class\\s*=\\s*"([^"]*)"', 1)), '\\s+'), lambda x: x <> '') AS classes FROM pl p LEFT JOIN kd k ON k.capture_id = p.capture_id AND k.node_idx = p.node_idx WHERE tag IS NOT NULL),
m AS (SELECT capture_id, map(list(node_idx), list(tag)) AS mt, map(list(node_idx), list(id)) AS mi, map(list(node_idx), list(classes)) AS mc, map(list(node_idx), list(coalesce(path[-1], -1))) AS mp, list(node_idx) FILTER (tag = 'li' AND node_idx % 4 = 0) AS sh FROM e0 GROUP BY ALL),
el AS (SELECT e0.*, list_transform(list_reverse(path)[1:8], lambda i: mt[i]) AS at_, list_transform(list_reverse(path)[1:8], lambda i: mi[i]) AS ai, list_transform(list_reverse(path)[1:8], lambda i: mc[i]) AS ac,
  list_transform(list_filter(list_reverse(list_append(path, node_idx)), lambda i: list_contains(coalesce(sh, []), i)), lambda i: mt[mp[i]] || CASE WHEN mi[mp[i]] <> '' THEN '#' || mi[mp[i]] ELSE '' END || CASE WHEN len(mc[mp[i]]) > 0 THEN '.' || array_to_string(mc[mp[i]][1:2], '.') ELSE '' END) AS hosts,
  regexp_extract(raw, '(?:^|\\s)href\\s*=\\s*"([^"]*)"', 1) AS href FROM e0 JOIN m USING (capture_id)),
f2 AS (SELECT * FROM el WHERE tag = 'a' QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY node_idx) <= 2), f AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY node_idx DESC) = 1),
pr AS (SELECT e.*, f.node_idx AS true_idx, f.tag AS ftag, f.id AS fid, f.classes AS fclasses, f.eplace AS feplace, f.ekids AS fekids, f.href AS fhref, f.hosts AS fhosts, len(e.hosts) AS sd, len(f.hosts) AS fsd,
  list_transform(range(1, least(5, len(e.at_), len(f.at_)) + 1), lambda i: [(e.at_[i] = f.at_[i])::INT, (f.ai[i] <> '' AND e.ai[i] = f.ai[i])::INT, len(list_intersect(e.ac[i], f.ac[i]))::INT]) AS lv,
  len(list_filter(f.hosts, lambda h: len(list_filter(range(1, len(e.at_) + 1), lambda i: contains(e.at_[i] || CASE WHEN e.ai[i] <> '' THEN '#' || e.ai[i] ELSE '' END, h))) > 0)) AS met FROM el e JOIN f USING (capture_id))
"""
_MATCH = _SHADOWED + f""", sp AS (SELECT *, CASE WHEN kids = fekids THEN 5 WHEN abs(kids - fekids) <= 2 THEN 2 ELSE -4 END AS cp, CASE WHEN (fsd > 0) = (sd > 0) THEN 3 ELSE -10 END AS s1, CASE WHEN fsd > 0 AND sd > 0 THEN CASE abs(fsd - sd) WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE -6 END ELSE 0 END AS s2,
  CASE WHEN fsd > 0 AND sd > 0 THEN CASE WHEN met > 0 THEN least(8, 3 * met) ELSE -5 END ELSE 0 END AS s3 FROM pr),
sc AS (SELECT capture_id, node_idx, tag, true_idx, (CASE WHEN tag = ftag THEN 24 ELSE 0 END + CASE WHEN id <> '' AND id = fid THEN 32 ELSE 0 END + least(18, 4 * len(list_intersect(classes, fclasses))) + CASE WHEN place = feplace THEN 7 ELSE 0 END + cp + CASE WHEN href <> '' AND lower(href) = lower(fhref) THEN 4 ELSE 0 END
  + least(18, coalesce(list_sum(list_transform(lv, lambda z: z[1] * 3 + z[2] * 4 + z[3])), 0)) + s1 + s2 + s3)::INT AS score, greatest(0, -cp) + greatest(0, -s1) + greatest(0, -s2) + greatest(0, -s3) AS penalty FROM sp),
rk AS (SELECT *, row_number() OVER w AS r, max(score) OVER (PARTITION BY capture_id) AS top, lead(score) OVER w AS second, count(*) OVER (PARTITION BY capture_id) AS candidates FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY capture_id ORDER BY score DESC, node_idx)),
nr AS (SELECT capture_id, count(*) FILTER (top - score < 9) AS near, string_agg(tag || ':' || score::INT || '(-' || penalty || ')', ', ' ORDER BY r) FILTER (r <= 3) AS top3 FROM rk GROUP BY capture_id),
matched AS (SELECT capture_id, node_idx, top::INT AS score, coalesce(top - second, top)::INT AS margin, near::INT AS near, {N.sql_round3('''greatest(0.05::DOUBLE, least(1::DOUBLE, greatest(0.16::DOUBLE, least(0.93::DOUBLE, top::DOUBLE / 100::DOUBLE)) + greatest(0::DOUBLE, least(0.08::DOUBLE, coalesce(top - second, top)::DOUBLE / 30::DOUBLE))
  - greatest(0::DOUBLE, least(0.28::DOUBLE, penalty::DOUBLE / 35::DOUBLE)) - CASE WHEN near > 1 THEN least(0.2::DOUBLE, (near - 1)::DOUBLE * 0.06::DOUBLE) ELSE 0::DOUBLE END))''')} AS confidence,
  top >= 32 AS resolved, candidates::INT AS candidates, (second IS NOT NULL AND top - second < 9) OR near > 1 AS ambiguous, top3, node_idx = true_idx AS is_true FROM rk JOIN nr USING (capture_id) WHERE r = 1)
"""
_RUN = _SHADOWED + f""", tx AS (SELECT capture_id, node_idx AS t, text, unnest(path) AS node_idx FROM nodes WHERE tag IS NULL),
ct AS (SELECT capture_id, node_idx, lower(trim(regexp_replace(string_agg(text, '' ORDER BY t), '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')))[1:280] AS content FROM tx GROUP BY ALL),
c AS (SELECT pr.*, coalesce(ct.content, '') AS content, coalesce(fc.content, '')[1:220] AS ftext, (pr.node_idx * 7 % 900)::DOUBLE AS x, (pr.node_idx * 13 % 700)::DOUBLE AS y, (pr.node_idx % 180 + 20)::DOUBLE AS w, (pr.node_idx % 60 + 10)::DOUBLE AS h,
  (true_idx * 7 % 900 + 9)::DOUBLE AS fx, (true_idx * 13 % 700)::DOUBLE AS fy, (true_idx % 180 + 20)::DOUBLE AS fw, (true_idx % 60 + 10)::DOUBLE AS fh FROM pr LEFT JOIN ct ON ct.capture_id = pr.capture_id AND ct.node_idx = pr.node_idx LEFT JOIN ct fc ON fc.capture_id = pr.capture_id AND fc.node_idx = true_idx WHERE tag = ftag AND sd = 0),
b0 AS (SELECT *, greatest(0::DOUBLE, least(fx + fw, x + w) - greatest(fx, x)) * greatest(0::DOUBLE, least(fy + fh, y + h) - greatest(fy, y)) AS inter, sqrt((fx + fw / 2 - (x + w / 2)) * (fx + fw / 2 - (x + w / 2)) + (fy + fh / 2 - (y + h / 2)) * (fy + fh / 2 - (y + h / 2))) AS dist FROM c),
b1 AS (SELECT *, inter / greatest(1::DOUBLE, fw * fh + w * h - inter) AS iou, greatest(fw * fh, w * h) / greatest(1::DOUBLE, least(fw * fh, w * h)) AS ratio, dist / greatest(1::DOUBLE, fw, fh) <= 0.6::DOUBLE AS close,
  list_distinct(list_filter(string_split(content, ' '), lambda t: t <> '')) AS wa, list_distinct(list_filter(string_split(ftext, ' '), lambda t: t <> '')) AS wb FROM b0),
b2 AS (SELECT *, CASE WHEN ftext = '' OR content = '' THEN 0 WHEN contains(content, ftext) OR contains(ftext, content[1:80]) THEN 18 WHEN len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), len(wb)) >= 0.45::DOUBLE THEN 8 ELSE -8 END AS tp FROM b1),
sc AS (SELECT capture_id, node_idx, tag, true_idx, (26 + CASE WHEN id <> '' AND id = fid THEN 34 ELSE 0 END + least(20, 4 * len(list_intersect(classes, fclasses))) + tp + CASE WHEN eplace = feplace THEN 8 ELSE 0 END
  + CASE WHEN ekids = fekids THEN 6 WHEN abs(ekids - fekids) <= 2 THEN 2 ELSE -6 END + CASE WHEN href <> '' AND lower(href) = lower(fhref) THEN 5 ELSE 0 END + least(20, coalesce(list_sum(list_transform(lv, lambda z: z[1] * 4 + z[2] * 4 + z[3])), 0)) + CASE WHEN fsd = 0 THEN 4 ELSE -12 END
  + CASE WHEN iou >= 0.6::DOUBLE THEN 26 + CASE WHEN ratio <= 1.5::DOUBLE THEN 4 WHEN ratio <= 2.2::DOUBLE THEN 2 ELSE 0 END WHEN iou >= 0.35::DOUBLE THEN 16 + CASE WHEN ratio <= 1.8::DOUBLE THEN 2 ELSE 0 END WHEN close THEN 8 ELSE 0 END)::INT AS score,
  CASE WHEN tp < 0 THEN 8 ELSE 0 END + CASE WHEN abs(ekids - fekids) > 2 THEN 6 ELSE 0 END + CASE WHEN fsd = 0 THEN 0 ELSE 12 END + CASE WHEN iou < 0.35::DOUBLE AND NOT close THEN CASE WHEN ratio > 3 THEN 14 ELSE 8 END ELSE 0 END AS penalty FROM b2),
rk AS (SELECT *, row_number() OVER w AS r, max(score) OVER (PARTITION BY capture_id) AS top, lead(score) OVER w AS second, count(*) OVER (PARTITION BY capture_id) AS candidates FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY capture_id ORDER BY score DESC, node_idx)),
nr AS (SELECT capture_id, count(*) FILTER (top - score < 12) AS near, string_agg(tag || ':' || score::INT || '(-' || penalty || ')', ', ' ORDER BY r) FILTER (r <= 3) AS top3 FROM rk GROUP BY capture_id)
SELECT capture_id, node_idx, top::INT AS score, coalesce(top - second, top)::INT AS margin, near::INT AS near, {N.sql_round3('''greatest(0.05::DOUBLE, least(1::DOUBLE, greatest(0.18::DOUBLE, least(0.97::DOUBLE, top::DOUBLE / 130::DOUBLE)) + greatest(0::DOUBLE, least(0.08::DOUBLE, coalesce(top - second, top)::DOUBLE / 35::DOUBLE))
  - greatest(0::DOUBLE, least(0.3::DOUBLE, penalty::DOUBLE / 45::DOUBLE)) - CASE WHEN near > 1 THEN least(0.22::DOUBLE, (near - 1)::DOUBLE * 0.07::DOUBLE) ELSE 0::DOUBLE END))''')} AS confidence,
  top >= 28 AS resolved, candidates::INT AS candidates, (second IS NOT NULL AND top - second < 12) OR near > 1 AS ambiguous, top3, node_idx = true_idx AS is_true FROM rk JOIN nr USING (capture_id) WHERE r = 1
"""
_CLASS = f"""WITH RECURSIVE {X.VARIED_SQL}, {H.sql_over('vpages')},
g AS (SELECT n.capture_id, min(node_idx) AS r FROM nodes n WHERE tag = ([{", ".join(f"'{t}'" for t in _PICKS)}])[(n.capture_id % {len(_PICKS)} + 1)::INT] GROUP BY ALL),
w AS (SELECT n.*, g.r, lower(regexp_extract(raw, '(?:^|\\s)class\\s*=\\s*"([^"]*)"', 1)) AS cls, lower(regexp_extract(raw, '(?:^|\\s)role\\s*=\\s*"([^"]*)"', 1)) AS role FROM nodes n JOIN g USING (capture_id) WHERE node_idx = r OR list_contains(path, r)),
rt AS (SELECT capture_id, r, any_value(tag) AS rtag, any_value(cls) AS rcls, any_value(role) AS rrole FROM w WHERE node_idx = r GROUP BY ALL),
k AS (SELECT capture_id, count(*) AS kids, arg_min(tag, node_idx) AS ftag, arg_min(cls, node_idx) AS fcls, arg_min(role, node_idx) AS frole FROM w WHERE tag IS NOT NULL AND path[-1] = r GROUP BY ALL),
c AS (SELECT capture_id, count(*) FILTER (tag IN ('svg', 'canvas')) AS surfaces, count(*) FILTER (tag = 'path') AS paths, count(*) FILTER (tag IN ('h1', 'h2', 'h3')) AS heads, count(*) FILTER (tag = 'p') AS ps, count(*) FILTER (tag = 'div') AS divs, count(*) FILTER (tag = 'button' OR role = 'button') AS buttons,
  length(trim(regexp_replace(coalesce(string_agg(text, '' ORDER BY node_idx) FILTER (tag IS NULL), ''), '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')))::INT AS text_length FROM w WHERE node_idx <> r GROUP BY ALL),
j AS (SELECT rt.*, coalesce(kids, 0) AS kids, CASE WHEN ftag IN ('a', 'button', 'input', 'textarea', 'select', 'img', 'svg') THEN ftag ELSE rtag END AS ttag, CASE WHEN ftag IN ('a', 'button', 'input', 'textarea', 'select', 'img', 'svg') THEN fcls ELSE rcls END AS tcls, coalesce(ftag IN ('a', 'button', 'input', 'textarea', 'select', 'img', 'svg'), false) AS moved,
  coalesce(surfaces, 0) + (rtag IN ('svg', 'canvas'))::INT AS surfaces, coalesce(paths, 0) AS paths, coalesce(heads, 0) AS heads, coalesce(ps, 0) AS ps, coalesce(divs, 0) AS divs, coalesce(buttons, 0) AS buttons, coalesce(text_length, 0) AS text_length, greatest(1, (r % 180 + 20) * (r % 60 + 10))::DOUBLE / 9000::DOUBLE AS ratio
  FROM rt LEFT JOIN k USING (capture_id) LEFT JOIN c USING (capture_id)),
q AS (SELECT *, CASE WHEN regexp_matches(rcls, 'board|cg-wrap|overlay|coords') THEN 1 WHEN surfaces >= 1 AND (paths >= 2 OR regexp_matches(tcls || ' ' || rcls, 'chart|graph|plot|series|trend|analytics|axis')) THEN 2
  WHEN ttag IN ('button', 'input', 'textarea', 'select', 'img', 'svg') AND NOT moved THEN 3 WHEN ratio > 0.12::DOUBLE AND heads >= 1 AND ps >= 1 AND kids >= 2 AND (buttons >= 2 OR divs >= 8 OR text_length > 120) THEN 4 ELSE 5 END AS k FROM j)
SELECT capture_id, ttag AS target_tag, text_length, (['render-scene', 'render-scene', 'semantic-leaf', 'noisy-container', 'semantic-shell'])[k] AS target_class, (['board-like', 'chart-like', 'generic', 'generic', 'generic'])[k] AS subtype,
  (['class-evidence:scene-primitives-present class-evidence:frame-chain-required', 'class-evidence:chart-primitives-present class-evidence:scene-visualization-dominant', 'class-evidence:leaf-interactive-node', 'class-evidence:multi-region-dense-container', 'class-evidence:bounded-shell-default'])[k] AS reasons FROM q"""
ORACLE = {
    "target_classification": _CLASS,
    "target_fingerprint": _SHADOWED + """ SELECT capture_id, node_idx, tag, eplace AS sibling_index, ekids AS child_count, CASE WHEN href <> '' THEN 'href=' || href ELSE '' END AS hints,
      array_to_string(list_transform(range(1, len(at_) + 1), lambda i: at_[i] || '#' || ai[i] || '.' || array_to_string(ac[i], '.')), '>') AS ancestry, len(hosts)::INT AS shadow_depth, array_to_string(hosts, '>') AS host_chain FROM f""",
    "runtime_match": _RUN,
    "fingerprint_match": _MATCH + "SELECT * FROM matched",
    "mapping_cascade": _MATCH + f"""SELECT p.page_id AS capture_id, CASE WHEN m.resolved AND p.page_id % 4 <> 0 THEN 'dom-traversal' WHEN p.page_id % 3 <> 0 THEN 'selector-fallback' ELSE 'unresolved' END AS strategy,
      {N.sql_round3('''CASE WHEN m.resolved AND p.page_id % 4 <> 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, m.confidence + CASE WHEN p.page_id % 5 = 0 THEN 0::DOUBLE ELSE least(0.06::DOUBLE, 0.015::DOUBLE + 0.01::DOUBLE * (p.page_id % 5)) END)) WHEN p.page_id % 3 <> 0 THEN 0.28::DOUBLE ELSE 0::DOUBLE END''')} AS confidence
      FROM pages p LEFT JOIN matched m ON m.capture_id = p.page_id""",
    "stable_selector": _ELEMENTS + "SELECT capture_id, node_idx, CASE WHEN id <> '' THEN '#' || id WHEN len(classes) > 0 THEN tag || '.' || array_to_string(classes[1:2], '.') ELSE tag END AS selector FROM el",
    "component_kind": _ELEMENTS + "SELECT CASE WHEN tag IN ('input', 'textarea') THEN 'text-input' WHEN tag = 'button' THEN 'button' WHEN tag = 'a' THEN 'link' WHEN tag = 'img' THEN 'image' WHEN tag = 'article' OR (tag = 'div' AND array_to_string(classes, ' ') LIKE '%card%') THEN 'card' ELSE 'unknown' END AS kind, count(*) AS n FROM el GROUP BY ALL",
    "target_class": f"""WITH RECURSIVE {H.SQL}, c AS (SELECT capture_id, count(*) FILTER (tag IN ('h1', 'h2', 'h3')) AS headings, count(*) FILTER (tag = 'p') AS paragraphs, count(*) FILTER (tag = 'div') AS divs, count(*) FILTER (tag = 'button') AS buttons, count(*) FILTER (tag = 'form') AS forms,
      coalesce(sum(length(trim(text, E' \\n\\t\\r'))), 0)::BIGINT AS text_length FROM nodes GROUP BY capture_id)
      SELECT capture_id, CASE WHEN forms >= 1 THEN 'interactive-composite' WHEN buttons >= 3 AND text_length <= 40 THEN 'semantic-shell' WHEN headings >= 1 AND paragraphs >= 1 AND (buttons >= 2 OR divs >= 8 OR text_length > 120) THEN 'noisy-container' ELSE 'semantic-shell' END AS target_class,
      CASE WHEN forms >= 1 THEN 'form-like' WHEN buttons >= 3 AND text_length <= 40 THEN 'toolbar-like' ELSE 'generic' END AS subtype, headings, paragraphs, divs, text_length FROM c""",
    "token_overlap": """WITH a AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{FEFF}]+', ' ', 'g'))), ' '), lambda t: t <> '')) AS a FROM documents),
      b AS (SELECT item_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{FEFF}]+', ' ', 'g'))), ' '), lambda t: t <> '')) AS b FROM benchmark),
      s AS (SELECT doc_id, item_id, na, nb, count(*) AS n FROM (SELECT doc_id, len(a) AS na, unnest(a) AS t FROM a) JOIN (SELECT item_id, len(b) AS nb, unnest(b) AS t FROM b) USING (t) GROUP BY ALL)
      SELECT doc_id, item_id, """ + N.sql_round3("n::DOUBLE / greatest(na, nb)::DOUBLE") + " AS overlap FROM s WHERE " + N.sql_round3("n::DOUBLE / greatest(na, nb)::DOUBLE") + " >= 0.2::DOUBLE",
    "box_overlap": f"""WITH b AS (SELECT page_id AS capture_id, (page_id * 7 % 90)::DOUBLE AS ax, (page_id * 13 % 70)::DOUBLE AS ay, (page_id % 18 + 20)::DOUBLE AS aw, (page_id % 6 + 10)::DOUBLE AS ah, (page_id * 5 % 90)::DOUBLE AS bx, (page_id * 11 % 70)::DOUBLE AS by_, (page_id % 9 + 30)::DOUBLE AS bw, (page_id % 5 + 20)::DOUBLE AS bh FROM pages),
      i AS (SELECT *, greatest(0::DOUBLE, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0::DOUBLE, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS inter, aw * ah AS aa, bw * bh AS ab FROM b)
      SELECT capture_id, {N.sql_round3('inter / (aa + ab - inter)')} AS iou, {N.sql_round3('least(aa, ab) / greatest(aa, ab)')} AS area_ratio, {N.sql_round3('sqrt(((ax + aw / 2) - (bx + bw / 2)) * ((ax + aw / 2) - (bx + bw / 2)) + ((ay + ah / 2) - (by_ + bh / 2)) * ((ay + ah / 2) - (by_ + bh / 2)))')} AS distance FROM i""",
}
