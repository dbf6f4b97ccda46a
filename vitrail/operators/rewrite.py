"""Cleaning captured subtrees: scene detection, normalising, reconstruction, pruning.

These rewrites look at a node's original children in some rules and at its rewritten children in
others, and scene rules look two levels down, so they run bottom-up over one page's tree in Python, by a
fold that keeps its own stack (pages of any depth), batch by batch through Arrow, without a shuffle.  Pages without scenes need none of this: for them
``htmltree.anchor_html`` gives the same candidate with built-in functions.

What is particular to some sites (wrapper tags, class tokens) is configuration, not code.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import htmltree as H

#: FIXED VALUES: attribute names and style fragments that the rules name.
SAFE_WRAPPER = frozenset("class id role tabindex aria-hidden aria-controls aria-describedby aria-expanded aria-labelledby aria-owns".split())
DROPPED = frozenset("style tabindex aria-controls aria-describedby aria-flowto aria-labelledby aria-live aria-owns aria-relevant".split())
DROPPED_PREFIXES = ("data-", "on")
CLASSLESS = frozenset(("div", "span", "label"))
KEPT = frozenset(
    "style href src srcset alt loading title type name value placeholder autocomplete for id class role aria-label aria-hidden viewBox viewbox width height"
    " x y x1 y1 x2 y2 cx cy r rx ry d points fill stroke stroke-width xmlns xlink:href".split()
)
LABELLED = frozenset(("role", "aria-label", "aria-hidden"))
SVG_KEPT = frozenset(
    "class id role aria-hidden viewbox viewBox width height fill stroke stroke-width preserveaspectratio preserveAspectRatio xmlns xlink:href href".split()
)
SVG_MEANING = frozenset(("text", "textpath", "foreignobject", "image", "title", "desc"))
POSITIONED = (
    "position:absolute", "position:relative", "position:fixed", "transform:", "translate(", "scale(", "rotate(", "matrix(", "top:", "left:", "right:",
    "bottom:", "width:", "height:", "aspect-ratio:", "background:", "background-color:", "border:", "border-color:", "opacity:", "z-index:",
)
PLACEHOLDERS = (
    (("circle", "ellipse"), "circle", {"cx": "50%", "cy": "50%", "r": "38%"}),
    (("polygon", "polyline"), "polygon", {"points": "50,16 84,84 16,84"}),
    ((), "rect", {"x": "12%", "y": "12%", "width": "76%", "height": "76%", "rx": "18%"}),
)
WRAPPERS, ANCHORS, NOISE, VOID = (frozenset(x) for x in (H.WRAPPERS, H.ANCHORS, H.NOISE, H.VOID))


@dataclass(frozen=True)
class Config:
    """What depends on the captured sites."""

    wrapper_tags: frozenset = frozenset()
    scene_tokens: tuple = ("board", "piece", "square", "coord", "coords", "layer", "overlay", "highlight", "ghost", "arrow")
    scene_tags: frozenset = frozenset(("piece", "square", "coord", "coords"))
    search_fields: tuple = ()
    search_roots: tuple = ()
    search_noise: tuple = ()
    search_labels: tuple = ()


@dataclass(slots=True)
class Element:
    """An element and, once its children are complete, what the rules ask of the subtree below it."""

    tag: str
    attrs: dict
    children: list = field(default_factory=list)  # of Element and str
    text: bool = False  #: any text in it
    anchor: bool = False  #: any anchor below it
    meaning: bool = False  #: any text, or an element of a drawing that has a meaning, below it
    long: bool = False  #: a long path in it or below
    count: int = 1  #: elements, with itself
    size: int = 0  #: characters of attributes, with its own
    likely: bool = False  #: likely part of a scene


_TOKEN = re.compile(r"<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+", re.S)
_ATTRIBUTE = re.compile(H.ATTRIBUTE)
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_BLANK = re.compile("[\\s\u00a0\ufeff]+")


def squeeze(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def _decoded(x: str) -> str:
    for a, b in _ENTITIES:
        x = x.replace(a, b)
    return x


def parse(html: str) -> list:
    """The same tree as ``htmltree.parse``, as nested elements."""
    top = Element("", {})
    open_ = [top]
    for t in _TOKEN.findall(html):
        if t.startswith("<!--"):
            continue
        if t.startswith("</"):
            name = t[2:-1].strip().lower()
            depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == name), 1)
            del open_[depth:]
        elif t.startswith("<"):
            alone = t.endswith("/>")
            head, *rest = t[1 : -2 if alone else -1].strip().split(None, 1) or [""]
            node = Element(head.lower(), {k: _decoded(v) for k, v in _ATTRIBUTE.findall(rest[0] if rest else "")})
            open_[-1].children.append(node)
            if not alone and node.tag not in VOID:
                open_.append(node)
        elif text := _decoded(_BLANK.sub(" ", t)):
            if text.strip(" \u00a0\ufeff"):
                open_[-1].children.append(text)
    return top.children


def walk(nodes: list):
    """All nodes below, in document order."""
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        yield n
        if isinstance(n, Element):
            todo.extend(reversed(n.children))


def elements(nodes: list) -> list:
    return [n for n in nodes if isinstance(n, Element)]


def folded(nodes: list, leave, enter=lambda n, given: given, given=None) -> list:
    """``nodes`` rewritten from the leaves up, however deep they lie.

    ``enter`` of an element and what its parent was given gives what its children are given, or None to
    drop it; ``leave`` of the element, its rewritten children and what it was given says what stands in
    its place.  Texts are squeezed, blank ones go.
    """
    done: list = []
    work = [(None, given, iter(nodes), done)]
    while work:
        node, own, todo, out = work[-1]
        for n in todo:
            if isinstance(n, str):
                if text := squeeze(n):
                    out.append(text)
            elif (below := enter(n, own)) is not None:
                work.append((n, below, iter(n.children), []))
                break
        else:
            work.pop()
            if work:
                work[-1][3].extend(leave(node, out, own))
    return done


class Scene:
    """Predicates of rendered scenes (boards, layered figures)."""

    def __init__(self, config: Config):
        self.config, self.on, self.drawn = config, True, True  # what is asked of a page: scene parts, drawings

    def classed(self, attrs: dict) -> bool:
        name = attrs.get("class", "").lower()
        return any(t in name for t in self.config.scene_tokens)

    def tagged(self, tag: str) -> bool:
        return tag in self.config.scene_tags or any(t in tag for t in self.config.scene_tokens)

    @staticmethod
    def positioned(attrs: dict) -> bool:
        style = attrs.get("style", "").lower()
        return any(p in style for p in POSITIONED)

    def marked(self, n: Element) -> bool:
        return "-" in n.tag or self.tagged(n.tag) or self.positioned(n.attrs) or self.classed(n.attrs)

    def primitive(self, n: Element) -> bool:
        """Marked, and without content."""
        return not any(isinstance(c, Element) or squeeze(c) for c in n.children) and self.marked(n)

    def settled(self, n: Element) -> Element:
        """``n`` with what is known of its subtree, from its children alone."""
        inner = elements(n.children)
        n.text = len(inner) < len(n.children) and any(isinstance(c, str) and squeeze(c) for c in n.children) or any([c.text for c in inner])
        n.anchor = any([c.anchor or c.tag in ANCHORS for c in inner])
        if self.drawn:
            n.meaning = n.text or any([c.meaning or c.tag in SVG_MEANING for c in inner])
            n.long = any(len(n.attrs.get(k, "")) > 120 for k in ("d", "points")) or any([c.long for c in inner])
            n.count = 1 + sum([c.count for c in inner])
            n.size = sum([len(k) + len(v) for k, v in n.attrs.items()]) + sum([c.size for c in inner])
        n.likely = self.on and (n.tag == "svg" or self.marked(n) or sum(c.likely for c in inner) >= 2)
        return n

    def payload(self, n: Element) -> bool:
        """A bare wrapper around one scene element."""
        inner = elements(n.children)
        return n.tag in WRAPPERS and len(inner) == 1 and not n.text and inner[0].likely

    def carrier(self, n: Element) -> bool:
        return n.likely or self.payload(n)

    def container(self, n: Element) -> bool:
        """Whether a wrapper must stay for the scene inside it."""
        if n.tag not in WRAPPERS and "-" not in n.tag:
            return False
        if self.classed(n.attrs) or self.positioned(n.attrs):
            return True
        inner = elements(n.children)
        carriers = [c for c in inner if self.carrier(c)]
        if len(carriers) >= 2:
            return True
        if carriers and (n.attrs or (len(n.children) == 1 and not n.text)):
            return True
        return len(inner) >= 3 and len(carriers) == len(inner)

    def relevant(self, n: Element) -> bool:
        return n.likely or self.container(n)

    def counts(self, nodes: list) -> dict:
        own = [n for n in walk(nodes) if isinstance(n, Element)]
        return {
            "elements": len(own),
            "custom": sum("-" in n.tag for n in own),
            "positioned": sum(self.positioned(n.attrs) for n in own),
            "primitives": sum(self.primitive(n) for n in own),
            "tagged": sum(self.tagged(n.tag) or self.classed(n.attrs) for n in own),
            "text_length": sum(len(squeeze(n)) for n in walk(nodes) if isinstance(n, str)),
        }

    @staticmethod
    def is_scene(c: dict) -> bool:
        """Little text, and enough of any of four combinations."""
        if c["text_length"] > max(24, 2 * c["elements"]):
            return False
        return (
            (c["custom"] >= 1 and c["positioned"] >= 3)
            or (c["positioned"] >= 6 and c["primitives"] >= 4)
            or (c["tagged"] >= 2 and c["positioned"] >= 2 and c["primitives"] >= 2)
            or (c["primitives"] >= 6 and (c["custom"] >= 1 or c["positioned"] >= 4))
        )


def _collapsible(attrs: dict) -> bool:
    return all(k in SAFE_WRAPPER or k.startswith(DROPPED_PREFIXES) for k in attrs)


class Rewriter:
    def __init__(self, config: Config = Config()):
        self.config, self.scene = config, Scene(config)

    def candidate(self, html: str | None) -> dict | None:
        """The cleaned subtree of a page and what was done to it; null for blank pages."""
        if not (html or "").strip():
            return None
        self.tags, self.names, self.collapsed, self.compacted = Counter(), Counter(), 0, 0
        tree = parse(html)
        counts = self.scene.counts(tree)
        own = elements(list(walk(tree)))
        self.in_scene = self.scene.on = self.scene.is_scene(counts)
        self.scene.drawn = any(n.tag == "svg" for n in own)
        for n in reversed(own):
            self.scene.settled(n)
        normal = folded(tree, self.normal, self.noiseless, True)
        rebuilt = folded(normal, self.rebuilt, lambda n, drawing: drawing or n.tag == "svg", False)
        out = rebuilt or normal
        if not self.in_scene and self.is_search(out):
            out = folded(out, lambda n, children, _: [self.made(n.tag, n.attrs, children)], lambda n, _: None if self.search_noise(n) else True, True)
        kept = [n for n in walk(out)]
        own = [n for n in kept if isinstance(n, Element)]
        anchors, wrappers = sum(n.tag in ANCHORS for n in own), sum(n.tag in WRAPPERS for n in own)
        if self.in_scene:
            profile = "scene-like"
        elif anchors and wrappers <= anchors:
            profile = "anchor-dense"
        else:
            profile = "wrapper-heavy" if wrappers >= max(3, 2 * anchors) else "balanced"
        third = lambda a, b: int(a / b * 1000 + 0.5) / 1000 if b else None
        return {
            "html": serialise(out),
            "source": "reconstructed-subtree" if rebuilt else "normalized-subtree",
            "removed_tags": dict(self.tags),
            "removed_attributes": dict(self.names),
            "collapsed_wrappers": self.collapsed,
            "compacted_svgs": self.compacted,
            "nodes": len(kept),
            "text_length": sum(len(n) for n in kept if isinstance(n, str)),
            "anchors": anchors,
            "wrappers": wrappers,
            "anchor_density": third(anchors, len(kept)) or 0.0,
            "wrapper_density": third(wrappers, len(kept)) or 0.0,
            "wrapper_ratio": third(wrappers, anchors),
            "profile": profile,
            "mode": "scene-preserving" if self.in_scene else "semantic",
            "scene_primitives": sum(self.scene.primitive(n) for n in own) if self.in_scene else 0,
            "scene_containers": sum(self.scene.container(n) for n in own) if self.in_scene else 0,
            "scene_custom": sum("-" in n.tag for n in own) if self.in_scene else 0,
        }

    def made(self, tag: str, attrs: dict, children: list) -> Element:
        return self.scene.settled(Element(tag, attrs, children))

    def unwrapped(self, attrs: dict, children: list) -> list:
        self.names.update(attrs.keys())
        self.collapsed += 1
        return children

    def noiseless(self, n: Element, _) -> bool | None:
        if n.tag not in NOISE:
            return True
        self.tags[n.tag] += 1
        return None

    def normal(self, n: Element, children: list, _) -> list:
        """One element with fewer attributes, and without wrappers that hold nothing but one child."""
        if n.tag in self.config.wrapper_tags:
            return self.unwrapped(n.attrs, children)
        styled = self.in_scene and ("style" in n.attrs or "class" in n.attrs) and self.scene.relevant(n)
        gone = [k for k in n.attrs if not (styled and k in ("style", "class")) and (k in DROPPED or k.startswith(DROPPED_PREFIXES) or (k == "class" and n.tag in CLASSLESS))]
        self.names.update(gone)
        out = self.made(n.tag, {k: v for k, v in n.attrs.items() if k not in gone}, children)
        if n.tag == "svg":
            inner = elements(children)
            if not inner:
                self.tags["svg"] += 1
                return []
            if self.heavy(n, inner):
                self.compacted += 1
                return [self.made("svg", {k: v for k, v in out.attrs.items() if k in SVG_KEPT}, [self.placeholder(inner)])]
        if n.tag not in WRAPPERS:
            return [out]
        # A wrapper that is left: bare ones go, unless a scene needs them.
        needed, holds = (self.in_scene and self.scene.relevant(out)), (self.in_scene and self.scene.container(out))
        if _collapsible(out.attrs):
            if len(children) == 1 and not needed:
                return self.unwrapped(out.attrs, children)
            if not children:
                if needed:
                    return [out]
                self.tags[n.tag] += 1
                return self.unwrapped(out.attrs, [])
        if children and not out.attrs and not holds:
            self.collapsed += len(children) == 1
            return children
        return [out]

    @staticmethod
    def heavy(n: Element, inner: list) -> bool:
        """Whether a drawing is replaced: much geometry, and no text, image or title."""
        return not n.meaning and (sum(x.count for x in inner) > 3 or n.size > 280 or n.long)

    def placeholder(self, inner: list) -> Element:
        tags = {x.tag for x in inner}
        shape, attrs = next((t, a) for of, t, a in PLACEHOLDERS if not of or tags & set(of))
        return self.made(shape, dict(attrs), [])

    def rebuilt(self, n: Element, children: list, drawing: bool) -> list:
        """Anchors, drawings, scene elements and labelled containers; the rest is unwrapped."""
        attrs = {k: v for k, v in n.attrs.items() if v and k in KEPT}
        out = self.made(n.tag, attrs, children)
        if drawing or n.tag in ANCHORS or (self.in_scene and self.scene.relevant(out)):
            return [out]
        bare = n.tag in WRAPPERS and (not out.children or _collapsible(attrs) or out.anchor)
        return [out] if out.children and not bare and LABELLED & attrs.keys() else out.children

    def is_search(self, nodes: list) -> bool:
        own = [n for n in walk(nodes) if isinstance(n, Element)]
        low = lambda n, k: n.attrs.get(k, "").lower()
        fields = any(
            n.tag in ("textarea", "input") and (low(n, "name") == "q" or low(n, "role") == "combobox" or any(t in low(n, "class") for t in self.config.search_fields)) for n in own
        )
        return fields and any((n.tag == "form" and low(n, "role") == "search") or any(t in low(n, "class") for t in self.config.search_roots) for n in own)

    def search_noise(self, n: Element) -> bool:
        low = lambda k: n.attrs.get(k, "").lower()
        return (
            n.tag in ("script", "style")
            or (n.tag == "input" and low("type") == "file")
            or low("role") in ("menu", "menuitem", "dialog")
            or any(t in low("class") for t in self.config.search_noise)
            or any(t in low("aria-label") for t in self.config.search_labels)
        )


def serialise(nodes: list) -> str:
    text = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out, todo = [], list(reversed(nodes))  # of nodes, and of end tags as tuples
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(text(n))
        else:
            out.append(f"<{n.tag}{''.join(' {}="{}"'.format(k, text(v).replace('"', "&quot;")) for k, v in n.attrs.items() if v)}>")
            if n.tag not in VOID:
                todo.append((f"</{n.tag}>",))
                todo += reversed(n.children)
    return "".join(out)


FIELDS = pa.schema(
    [
        ("html", pa.string()), ("source", pa.string()), ("removed_tags", pa.map_(pa.string(), pa.int64())), ("removed_attributes", pa.map_(pa.string(), pa.int64())),
        ("collapsed_wrappers", pa.int64()), ("compacted_svgs", pa.int64()), ("nodes", pa.int64()), ("text_length", pa.int64()), ("anchors", pa.int64()),
        ("wrappers", pa.int64()), ("anchor_density", pa.float64()), ("wrapper_density", pa.float64()), ("wrapper_ratio", pa.float64()), ("profile", pa.string()),
        ("mode", pa.string()), ("scene_primitives", pa.int64()), ("scene_containers", pa.int64()), ("scene_custom", pa.int64()),
    ]
)


def candidates(pages: DataFrame, config: Config = Config(), key: str = "page_id", html: str = "html") -> DataFrame:
    """The candidate of every page: one row each, blank pages left out."""
    schema = (
        "capture_id long, html string, source string, removed_tags map<string,long>, removed_attributes map<string,long>, collapsed_wrappers long,"
        " compacted_svgs long, nodes long, text_length long, anchors long, wrappers long, anchor_density double, wrapper_density double, wrapper_ratio double,"
        " profile string, mode string, scene_primitives long, scene_containers long, scene_custom long"
    )

    def run(batches):
        rewriter = Rewriter(config)
        for b in batches:
            found = [(i, c) for i, h in zip(b["id"].to_pylist(), b["html"]) if (c := rewriter.candidate(h.as_py())) is not None]
            rows = [{k: list(v.items()) if isinstance(v, dict) else v for k, v in c.items()} for _, c in found]
            cols = pa.RecordBatch.from_pylist(rows, FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), *cols.columns], ["capture_id", *FIELDS.names])

    return pages.select(F.col(key).alias("id"), F.col(html).alias("html")).mapInArrow(run, schema)


def scene_pages(spark, sf_dir: str) -> DataFrame:
    """A small positioned board for every page: 4 to 12 pieces."""
    p = F.col("page_id")
    piece = lambda k: F.format_string('<piece class="p%d" style="position:absolute;left:%dpx;top:%dpx"></piece>', k, k * 10, k * 7)
    pieces = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), p % 9 + 4), piece), "")
    html = F.concat(F.lit('<div class="board" data-id="x"><div><span>'), p.cast("string"), F.lit("</span></div>"), pieces, F.lit('<script>x()</script></div>'))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.alias("html"))


def _plain(s, d):
    c = candidates(H._read(s, d))
    return c.select("capture_id", "html", F.col("nodes").cast("int").alias("nodes"), "anchors", "wrappers", "anchor_density", "profile")


QUERIES = {
    "candidate_quality": _plain,
    "scene_candidate": lambda s, d: candidates(scene_pages(s, d)).select(
        "capture_id", "html", "mode", "profile", "nodes", "scene_primitives", F.element_at("removed_tags", "script").alias("scripts"), F.element_at("removed_attributes", "data-id").alias("data_ids")
    ),
}

_CAND = H.ORACLE["candidate_html"]
ORACLE = {
    "candidate_quality": f"""SELECT c.capture_id, c.html, c.nodes, (length(c.html) - length(replace(c.html, '</a>', '')))::BIGINT // 4 AS anchors, 0::BIGINT AS wrappers,
      floor(((length(c.html) - length(replace(c.html, '</a>', ''))) // 4)::DOUBLE / c.nodes * 1000 + 0.5) / 1000 AS anchor_density,
      CASE WHEN contains(c.html, '</a>') THEN 'anchor-dense' ELSE 'balanced' END AS profile FROM ({_CAND}) c""",
    "scene_candidate": """SELECT page_id AS capture_id, '<div style="" '[1:4] || ' class="board">' || page_id::VARCHAR || list_aggregate(list_transform(range(1, page_id % 9 + 5), lambda k: '<piece class="p' || k || '" style="position:absolute;left:' || (k * 10) || 'px;top:' || (k * 7) || 'px"></piece>'), 'string_agg', '') || '</div>' AS html,
      'scene-preserving' AS mode, 'scene-like' AS profile, page_id % 9 + 6 AS nodes, page_id % 9 + 4 AS scene_primitives, 1::BIGINT AS scripts, 1::BIGINT AS data_ids FROM pages""",
}
