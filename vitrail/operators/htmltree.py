"""HTML fragments as node tables, parsed by built-in functions.

A page is tokenised by one regular expression and folded over a stack of open elements, all inside
its own row.  Rules of the parser, which are part of the data model:

* tokens are comments, tags that begin with a letter, and runs of text; anything else loses its ``<``
  (so a doctype becomes text);
* an end tag closes open elements up to its own; without one of its own it closes all;
* void and self-closing elements stay closed; script content is tokenised like the rest;
* text is white-space collapsed, blank text is dropped;
* of repeated attributes the last wins; only double-quoted values count, others are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import CHUNK, built, let, once, scan

#: FIXED VALUES: elements without content, subtrees dropped as noise, elements kept as anchors, and
#: wrappers that carry no meaning of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NOISE = ("script", "style", "template", "slot", "noscript", "defs", "symbol")
ANCHORS = ("a", "button", "input", "textarea", "select", "option", "label", "img", "picture", "source", "svg", "canvas", "video", "audio")
WRAPPERS = ("div", "span")

TOKEN = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+"
ATTRIBUTE = r'([:@a-zA-Z0-9_-]+)(?:\s*=\s*"([^"]*)")?'
#: Rows of one task (``spread``).
PAGES_A_TASK = 2_000
#: Limits of a captured subtree.
MAX_NODES, MAX_DEPTH = 300, 6


def tokens(html: Column) -> Column:
    """Structs (close, tag, selfclosed, attrs, text) of the tokens of a page, comments left out."""
    found = F.filter(F.regexp_extract_all(html, F.lit(TOKEN), 0), lambda t: ~t.startswith("<!--"))

    def read(t: Column) -> Column:
        tagged, close = t.startswith("<"), t.startswith("</")
        selfclosed = t.endswith("/>")
        end = F.when(selfclosed, 2).otherwise(1)
        bare = F.when(close, F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(F.substring(t, F.lit(2), F.length(t) - 1 - end))
        inner, plain = X.trim(bare), ~t.rlike(X.SPACES)
        tag = F.lower(F.when(plain, bare).when(close, inner).otherwise(F.regexp_extract(inner, r"^(\S*)", 1)))
        body = X.decode_entities(X.collapse(t))
        return F.struct(
            close.alias("close"),
            F.when(tagged, tag).alias("tag"),
            (selfclosed & ~close).alias("selfclosed"),
            F.when(tagged & ~close, F.when(plain, F.lit("")).otherwise(F.regexp_extract(inner, r"(?s)^\S*\s(.*)$", 1))).alias("attrs"),
            F.when(~tagged, body).alias("text"),
        )

    return F.filter(F.transform(found, read), lambda t: t["text"].isNull() | t["text"].rlike(r"[^\s\u00a0\ufeff]"))


def attributes(raw: Column) -> Column:
    """Attribute map of a raw attribute string."""
    names = F.regexp_extract_all(raw, F.lit(ATTRIBUTE), 1)
    values = F.transform(F.regexp_extract_all(raw, F.lit(ATTRIBUTE), 2), X.decode_entities)
    return F.when(raw == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.arrays_zip(names.alias("k"), values.alias("v"))))


_PLACE = "struct<parent_idx:int,depth:int,closed:array<struct<i:int,end_idx:int>>>"
_PATH = "struct<path:array<int>,path_tags:array<string>>"

#: Open elements are text, \x01 tag \x02 index of each: Spark copies text as one block.
_BEFORE, _AFTER = "\x01", "\x02"


def _walked(found: Column, finish) -> Column:
    """Of each token: its parent and depth, and the elements that it closes with the last node in each.

    The top of the stack is at hand; what lies deeper is in blocks, of which the last is fetched when the
    top is used up and searched only for an end tag whose element the top does not hold.
    """
    near = F.struct(F.lit("").alias("top"), F.lit(0).alias("held"), F.lit(0).alias("blocks"), F.lit(0).alias("n"))
    key = lambda t: F.concat(F.lit(_BEFORE), F.translate(t["tag"], _BEFORE + _AFTER, ""), F.lit(_AFTER))
    entries = lambda text: F.filter(F.split(text, _BEFORE), lambda x: x != "")
    index = lambda entry: F.substring_index(entry, _AFTER, -1).cast("int")
    state = lambda top, held, blocks, n: F.struct(top.alias("top"), held.alias("held"), blocks.alias("blocks"), n.alias("n"))
    cut = lambda text, own: F.substring(text, F.lit(1), F.length(text) - F.length(F.call_function("substring_index", text, own, F.lit(-1))) - F.length(own))

    def step(far: Column, s: Column, t: Column) -> Column:
        return F.when(t["close"], let(key(t), lambda own: let(left(far, s, own), lambda x: close(far, s, x)))).otherwise(add(s, t))

    def add(s: Column, t: Column) -> Column:
        parent = F.when(s["held"] > 0, index(s["top"]))
        now = state(
            F.when(opens(t), F.concat(s["top"], key(t), s["n"].cast("string"))).otherwise(s["top"]), s["held"] + opens(t).cast("int"), s["blocks"], s["n"] + 1
        )
        place = F.struct(parent.alias("parent_idx"), (s["blocks"] * CHUNK + s["held"] + 1).alias("depth"), F.lit(None).cast("array<struct<i:int,end_idx:int>>").alias("closed"))
        return F.struct(now.alias("s"), place.alias("o"))

    def left(far: Column, s: Column, own: Column) -> Column:
        """What an end tag leaves: the top, and how many blocks; nothing if it has no element."""
        here = F.struct(cut(s["top"], own).alias("top"), s["blocks"].alias("blocks"))
        holding = F.when(s["blocks"] > 0, F.array_max(F.filter(F.sequence(F.lit(1), s["blocks"]), lambda k: F.contains(F.get(far, k - 1), own))))
        deeper = let(holding, lambda k: F.struct(F.coalesce(cut(F.get(far, k - 1), own), F.lit("")).alias("top"), F.coalesce(k - 1, F.lit(0)).alias("blocks")))
        return F.when(F.contains(s["top"], own), here).otherwise(deeper)

    def close(far: Column, s: Column, x: Column) -> Column:
        same = x["blocks"] == s["blocks"]
        was = F.when(same, s["top"]).otherwise(F.concat(F.array_join(F.slice(far, x["blocks"] + 1, s["blocks"] - x["blocks"]), ""), s["top"]))
        gone = F.transform(entries(F.substring(was, F.length(x["top"]) + 1, F.length(was))), lambda e: F.struct(index(e).alias("i"), (s["n"] - 1).alias("end_idx")))
        fetch = (x["top"] == "") & (x["blocks"] > 0)
        now = F.when(fetch, state(F.get(far, x["blocks"] - 1), F.lit(CHUNK), x["blocks"] - 1, s["n"])).otherwise(state(x["top"], F.size(entries(x["top"])), x["blocks"], s["n"]))
        return F.struct(now.alias("s"), F.struct(F.lit(None).cast("int").alias("parent_idx"), F.lit(None).cast("int").alias("depth"), gone.alias("closed")).alias("o"))

    def between(far: Column, s: Column) -> Column:
        kept = F.when(F.size(far) > s["blocks"], F.slice(far, F.lit(1), s["blocks"])).otherwise(far)
        block = F.substring_index(s["top"], _BEFORE, CHUNK + 1)
        deep = F.struct(F.concat(kept, F.array(block)).alias("f"), state(F.substring(s["top"], F.length(block) + 1, F.length(s["top"])), s["held"] - CHUNK, s["blocks"] + 1, s["n"]).alias("s"))
        return F.when(s["held"] > 2 * CHUNK, deep).otherwise(F.struct(kept.alias("f"), s.alias("s")))

    def ended(far: Column, s: Column, places: Column) -> Column:
        left = F.transform(entries(F.concat(F.array_join(far, ""), s["top"])), lambda e: F.struct(index(e).alias("i"), (s["n"] - 1).alias("end_idx")))
        return finish(left, places)

    return scan(found, near, step, _PLACE, F.array().cast("array<string>"), between, ended)


def opens(t: Column) -> Column:
    """Whether a token opens an element that later tokens may lie in."""
    return t["tag"].isNotNull() & ~t["close"] & ~t["selfclosed"] & ~t["tag"].isin(*VOID)


def parse(html: Column) -> Column:
    """Nodes of a page in document order: node_idx, parent_idx, depth, end_idx (the last node inside it,
    itself if none), tag, attrs, text.  An ancestor is one with node_idx below and end_idx not below."""

    def assembled(found: Column):
        def of(left: Column, places: Column) -> Column:
            shown = F.filter(F.arrays_zip(found.alias("t"), places.alias("p")), lambda x: ~x["t"]["close"])
            return let(shown, lambda given: let(ends(left, places, given), lambda last: F.transform(given, lambda x, i: node(x, i, F.get(last, i)["end_idx"]))))

        return of

    def ends(left: Column, places: Column, given: Column) -> Column:
        closed = F.flatten(F.array_compact(F.transform(places, lambda p: p["closed"])))
        alone = F.array_compact(F.transform(given, lambda x, i: F.when(~opens(x["t"]), F.struct(i.alias("i"), i.alias("end_idx")))))
        return F.array_sort(F.concat(closed, left, alone))

    def node(x: Column, i: Column, end: Column) -> Column:
        t, p = x["t"], x["p"]
        return F.struct(
            i.alias("node_idx"), p["parent_idx"].alias("parent_idx"), p["depth"].alias("depth"), end.alias("end_idx"), t["tag"].alias("tag"), t["attrs"].alias("attrs"), t["text"].alias("text")
        )

    return let(tokens(html), lambda found: _walked(found, assembled(found)))


def with_paths(parsed: Column) -> Column:
    """Parsed nodes with path and path_tags, their open ancestors from the root on.  As long as the sum of
    all depths, so only for those who ask."""
    start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<string>").alias("tag"))

    def step(_: Column, chain: Column, n: Column) -> Column:
        up, tags = (F.slice(chain[c], F.lit(1), n["depth"] - 1) for c in ("i", "tag"))
        path = F.struct(up.alias("path"), tags.alias("path_tags"))
        longer = F.struct(F.concat(up, F.array(n["node_idx"])).alias("i"), F.concat(tags, F.array(n["tag"])).alias("tag"))
        down = F.when(n["end_idx"] > n["node_idx"], longer).otherwise(chain)
        return F.struct(down.alias("s"), path.alias("o"))

    def joined(nodes: Column) -> Column:
        return let(scan(nodes, start, step, _PATH), lambda paths: F.transform(nodes, lambda n, i: n.withField("path", F.get(paths, i)["path"]).withField("path_tags", F.get(paths, i)["path_tags"])))

    return let(parsed, joined)


@built
def _tree(paths: bool) -> Column:
    found = parse(F.col("html"))
    return with_paths(found) if paths else found


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html", paths: bool = False, **more: Column) -> DataFrame:
    """(capture_id, nodes) and ``more`` of each page, parsed once whatever reads the nodes."""
    return once(pages.select(F.col(key).alias("capture_id"), F.col(html).alias("html"), *(c.alias(k) for k, c in more.items())), nodes=_tree(paths)).drop("html")


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", paths: bool = True) -> DataFrame:
    """(capture_id, node_idx, parent_idx, depth, end_idx, kind, tag, attrs, text): one row a node; with
    path and path_tags if asked for."""
    return parsed(pages, key, html, paths).select("capture_id", F.inline("nodes")).withColumns(
        {"kind": F.when(F.col("tag").isNotNull(), "element").otherwise("text"), "attrs": attributes(F.coalesce("attrs", F.lit("")))}
    )


def counts(table: DataFrame) -> DataFrame:
    """Elements, texts, text length, anchors, wrappers and depth of each capture."""
    element = F.col("kind") == "element"
    return table.groupBy("capture_id").agg(
        F.count_if(element).alias("elements"),
        F.count_if(~element).alias("texts"),
        F.coalesce(F.sum(F.when(~element, F.length(X.trim(F.col("text"))))), F.lit(0)).cast("long").alias("text_length"),
        F.count_if(F.col("tag").isin(*ANCHORS)).alias("anchors"),
        F.count_if(F.col("tag").isin(*WRAPPERS)).alias("wrappers"),
        F.max("depth").alias("max_depth"),
    )


def siblings(table: DataFrame) -> DataFrame:
    """Elements with sibling_idx, their place among their parent's elements from 0."""
    w = W.partitionBy("capture_id", "parent_idx").orderBy("node_idx")
    return table.where("kind = 'element'").withColumn("sibling_idx", F.row_number().over(w) - 1)


def ancestry(table: DataFrame, limit: int = 8) -> DataFrame:
    """(capture_id, node_idx, level, tag) of the nearest ``limit`` ancestors of each element."""
    up = F.posexplode(F.slice(F.reverse("path_tags"), 1, limit)).alias("level", "ancestor_tag")
    return table.where("kind = 'element'").select("capture_id", "node_idx", up)


def under(nodes: Column, marked) -> Column:
    """Of each node, in document order, whether it has an ancestor that is ``marked``."""

    def step(_: Column, end: Column, n: Column) -> Column:
        reach = F.when(marked(n), F.greatest(end, n["end_idx"])).otherwise(end)
        return F.struct(reach.alias("s"), (n["node_idx"] <= end).alias("o"))

    return scan(nodes, F.lit(-1), step, "boolean")


def capped(pages: DataFrame, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Each capture's node count, the nodes that its limits keep, and whether it was cut.

    Cut inside the row: nodes beyond the limits never become rows.
    """
    shallow = F.filter("nodes", lambda n: n["depth"] <= max_depth)
    return parsed(pages).select(
        "capture_id",
        F.size("nodes").alias("nodes"),
        F.least(F.size(shallow), F.lit(max_nodes)).alias("kept"),
        (F.size(shallow) > max_nodes).alias("truncated"),
        F.size(F.filter("nodes", lambda n: n["depth"] > max_depth)).alias("too_deep"),
    )


def removed_tags(pages: DataFrame) -> DataFrame:
    """How many subtrees of each noise element a capture loses (noise inside noise goes with it).

    Found inside the row: only the roots of what goes become rows.
    """
    noise = lambda n: n["tag"].isin(*NOISE)
    d = once(parsed(pages), inside=under(F.col("nodes"), noise))
    top = F.transform(F.filter("nodes", lambda n, i: noise(n) & ~F.get(F.col("inside"), i)), lambda n: n["tag"])
    return d.select("capture_id", F.explode(top).alias("tag")).groupBy("capture_id", "tag").agg(F.count(F.lit(1)).alias("removed"))


def anchor_html(pages: DataFrame) -> DataFrame:
    """The cleaned subtree of pages without scenes, custom elements or labels: links and text.

    For such pages normalising and reconstructing come down to a filter: nodes below noise go, links
    and texts stay, other elements are unwrapped.  Serialised inside the row: starts and ends of links
    and texts are sorted by the nodes that they stand at.
    """
    d = once(parsed(pages), inside=under(F.col("nodes"), lambda n: n["tag"].isin(*NOISE)))
    kept = F.filter("nodes", lambda n, i: ~F.get(F.col("inside"), i) & (n["tag"].isNull() | (n["tag"] == "a")))
    d = once(d.select("capture_id", "nodes", "inside"), kept=kept)
    part = lambda at, rank, text: F.struct(at.alias("at"), F.lit(rank).alias("rank"), text.alias("text"))

    def start(n: Column) -> Column:
        href = F.try_element_at(attributes(n["attrs"]), F.lit("href"))
        link = F.when(F.coalesce(href, F.lit("")) == "", F.lit("<a>")).otherwise(F.concat(F.lit('<a href="'), X.escape_attribute(href), F.lit('">')))
        return part(n["node_idx"], 0, F.when(n["tag"].isNull(), X.escape_text(X.compact(n["text"]))).otherwise(link))

    ends = F.transform(F.filter("kept", lambda n: n["tag"].isNotNull()), lambda n: part(n["end_idx"], 1, F.lit("</a>")))
    written = F.array_join(F.transform(F.array_sort(F.concat(F.transform("kept", start), ends)), lambda x: x["text"]), "")
    return d.select("capture_id", written.alias("html"), F.size("kept").alias("nodes"))


def spread(pages: DataFrame) -> DataFrame:
    """``pages`` dealt over all cores, in tasks of PAGES_A_TASK: parsing costs far more than moving a page,
    and with tasks as large as files are cut the longest one would grow with the input."""
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // PAGES_A_TASK))
    return pages.repartition(tasks) if pages.rdd.getNumPartitions() < tasks else pages


def _read(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


QUERIES = {
    "html_node_counts": lambda s, d: counts(nodes(_read(s, d), paths=False)),
    "node_sibling_index": lambda s, d: siblings(nodes(_read(s, d), paths=False)).select("capture_id", "node_idx", "tag", "sibling_idx"),
    "node_ancestry": lambda s, d: ancestry(nodes(_read(s, d))).select("capture_id", "node_idx", "level", "ancestor_tag"),
    "node_attributes": lambda s, d: nodes(_read(s, d), paths=False).select("capture_id", "node_idx", F.explode("attrs").alias("name", "value")),
    "removed_tag_histogram": lambda s, d: removed_tags(_read(s, d)),
    "subtree_caps": lambda s, d: capped(_read(s, d), 30, 5),
    "candidate_html": lambda s, d: anchor_html(_read(s, d)),
}

#: Nodes by a recursive walk over each page's tokens, one token a step.
SQL = r"""
tok0 AS (SELECT page_id AS capture_id, unnest(list_filter(regexp_extract_all(html, '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+'), lambda t: NOT starts_with(t, '<!--'))) AS t,
  generate_subscripts(list_filter(regexp_extract_all(html, '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+'), lambda t: NOT starts_with(t, '<!--')), 1) AS k FROM pages),
tok1 AS (SELECT capture_id, k, t, starts_with(t, '</') AS closing, starts_with(t, '<') AS tagged, ends_with(t, '/>') AS selfclosed,
  regexp_replace(t, '[\s\x{00A0}\x{FEFF}]+', ' ', 'g') AS c FROM tok0),
tok2 AS (SELECT *, replace(replace(replace(replace(replace(c, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body,
  trim(CASE WHEN closing THEN t[3:-2] WHEN selfclosed THEN t[2:-3] ELSE t[2:-2] END, E' \n\t\r') AS inside FROM tok1),
tok AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY k) AS k, closing, tagged, selfclosed, body,
    CASE WHEN tagged THEN lower(CASE WHEN closing THEN inside ELSE regexp_extract(inside, '^(\S*)', 1) END) END AS tag,
    CASE WHEN tagged AND NOT closing THEN regexp_extract(inside, '(?s)^\S*\s(.*)$', 1) END AS raw
  FROM tok2 WHERE tagged OR trim(body, E' \n\t\r') <> ''),
walk AS (
  SELECT capture_id, 0::BIGINT AS k, []::VARCHAR[] AS tags, []::INT[] AS path, 0 AS n, NULL::INT AS node_idx, NULL::INT[] AS own_path, NULL::VARCHAR[] AS own_tags, NULL::VARCHAR AS tag, NULL::VARCHAR AS raw, NULL::VARCHAR AS body FROM (SELECT DISTINCT capture_id FROM tok)
  UNION ALL
  SELECT w.capture_id, t.k,
    CASE WHEN t.closing THEN CASE WHEN list_contains(w.tags, t.tag) THEN w.tags[1:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] ELSE [] END
         WHEN t.tagged AND NOT t.selfclosed AND t.tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') THEN list_append(w.tags, t.tag) ELSE w.tags END,
    CASE WHEN t.closing THEN CASE WHEN list_contains(w.tags, t.tag) THEN w.path[1:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] ELSE [] END
         WHEN t.tagged AND NOT t.selfclosed AND t.tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') THEN list_append(w.path, w.n) ELSE w.path END,
    CASE WHEN t.closing THEN w.n ELSE w.n + 1 END, CASE WHEN t.closing THEN NULL ELSE w.n END, w.path, w.tags, t.tag, t.raw, CASE WHEN t.tagged THEN NULL ELSE t.body END
  FROM walk w JOIN tok t ON t.capture_id = w.capture_id AND t.k = w.k + 1),
nodes AS (SELECT capture_id, node_idx, own_path[-1] AS parent_idx, (len(own_path) + 1)::INT AS depth, tag, raw, body AS text, own_path AS path, own_tags AS path_tags FROM walk WHERE node_idx IS NOT NULL)"""



def sql_over(table: str) -> str:
    """The same over another table of pages."""
    return SQL.replace("FROM pages)", f"FROM {table})")


_NOISE_SQL = """, noise AS (SELECT capture_id, list(node_idx) AS noise FROM nodes WHERE tag IN ('script','style','template','slot','noscript','defs','symbol') GROUP BY capture_id)"""

ORACLE = {
    "html_node_counts": f"""WITH RECURSIVE {SQL}
SELECT capture_id, count(tag) AS elements, count(*) - count(tag) AS texts, coalesce(sum(length(trim(text, E' \\n\\t\\r'))), 0)::BIGINT AS text_length,
  count(*) FILTER (tag IN ('a','button','input','textarea','select','option','label','img','picture','source','svg','canvas','video','audio')) AS anchors,
  count(*) FILTER (tag IN ('div','span')) AS wrappers, max(depth) AS max_depth FROM nodes GROUP BY capture_id""",
    "node_sibling_index": f"""WITH RECURSIVE {SQL}
SELECT capture_id, node_idx, tag, (row_number() OVER (PARTITION BY capture_id, parent_idx ORDER BY node_idx) - 1)::INT AS sibling_idx FROM nodes WHERE tag IS NOT NULL""",
    "node_ancestry": f"""WITH RECURSIVE {SQL},
up AS (SELECT capture_id, node_idx, unnest(list_reverse(path)[1:8]) AS ancestor, generate_subscripts(list_reverse(path)[1:8], 1) - 1 AS level FROM nodes WHERE tag IS NOT NULL)
SELECT u.capture_id, u.node_idx, u.level::INT AS level, n.tag AS ancestor_tag FROM up u JOIN nodes n ON n.capture_id = u.capture_id AND n.node_idx = u.ancestor""",
    "node_attributes": f"""WITH RECURSIVE {SQL},
a AS (SELECT capture_id, node_idx, unnest(regexp_extract_all(raw, '([:@a-zA-Z0-9_-]+)(?:\\s*=\\s*"([^"]*)")?', 1)) AS name,
  unnest(regexp_extract_all(raw, '([:@a-zA-Z0-9_-]+)(?:\\s*=\\s*"([^"]*)")?', 2)) AS value, generate_subscripts(regexp_extract_all(raw, '([:@a-zA-Z0-9_-]+)(?:\\s*=\\s*"([^"]*)")?', 1), 1) AS i FROM nodes WHERE raw IS NOT NULL)
SELECT capture_id, node_idx, name, arg_max(value, i) AS value FROM a GROUP BY capture_id, node_idx, name""",
    "removed_tag_histogram": f"""WITH RECURSIVE {SQL}{_NOISE_SQL}
SELECT capture_id, tag, count(*) AS removed FROM nodes JOIN noise USING (capture_id)
WHERE tag IN ('script','style','template','slot','noscript','defs','symbol') AND NOT list_has_any(path, noise) GROUP BY capture_id, tag""",
    "subtree_caps": f"""WITH RECURSIVE {SQL}
SELECT capture_id, count(*)::INT AS nodes, least(count(*) FILTER (depth <= 5), 30)::INT AS kept, count(*) FILTER (depth <= 5) > 30 AS truncated, (count(*) FILTER (depth > 5))::INT AS too_deep FROM nodes GROUP BY capture_id""",
    "candidate_html": f"""WITH RECURSIVE {SQL}{_NOISE_SQL},
kept AS (SELECT n.* FROM nodes n LEFT JOIN noise USING (capture_id) WHERE (n.tag IS NULL OR n.tag = 'a') AND (noise IS NULL OR NOT list_has_any(n.path, noise))),
links AS (SELECT capture_id, list(node_idx) AS links FROM kept WHERE tag = 'a' GROUP BY capture_id),
up AS (SELECT k.*, coalesce(list_filter(k.path, lambda i: list_contains(l.links, i)), []) AS within FROM kept k LEFT JOIN links l USING (capture_id)),
seq AS (SELECT *, lead(within) OVER w AS next_within, lead(tag) OVER w AS next_tag, lead(node_idx) OVER w AS next_idx FROM up WINDOW w AS (PARTITION BY capture_id ORDER BY node_idx)),
part AS (SELECT capture_id, node_idx,
  CASE WHEN tag IS NULL THEN replace(replace(replace(trim(text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
       ELSE coalesce('<a href="' || replace(nullif(regexp_extract(raw, 'href\\s*=\\s*"([^"]*)"', 1), ''), '"', '&quot;') || '">', '<a>') END
  || repeat('</a>', (len(within) + CASE WHEN tag = 'a' THEN 1 ELSE 0 END - len(list_filter(CASE WHEN tag = 'a' THEN list_append(within, node_idx) ELSE within END, lambda i: list_contains(coalesce(next_within, []), i))))::INT) AS s FROM seq)
SELECT capture_id, string_agg(s, '' ORDER BY node_idx) AS html, count(*)::INT AS nodes FROM part GROUP BY capture_id""",
}
