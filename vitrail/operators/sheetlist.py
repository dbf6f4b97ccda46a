"""All style sheets of a page in order: its own, those of its shadow roots, and what they import.

A root's sheets come in document order, then those of the shadow roots below it, host by host; shadow
roots stand in the HTML as ``<template shadowrootmode>``.  An imported sheet follows its importer.  A sheet
counts once, at its first place.

Imports are closed over addresses, not over pages: of every two addresses the least place of the second
below the first is kept and improved, round by round, until ``rounds`` is reached.  A cycle never gives a
smaller place, so it is cut by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sheets as CSS
from ..functions.arrays import once
from ..sources import fixtures as X
from . import htmltree as H

ROUNDS = 8
_IMPORT = r"""(?i)^@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""


def imports(css: Column) -> Column:
    """Addresses that a sheet imports, in order."""
    found = F.transform(CSS.statements(css), lambda t: F.regexp_extract(t, _IMPORT, 1))
    return F.filter(found, lambda a: a != "")


def page_sheets(pages: DataFrame) -> DataFrame:
    """(capture_id, rank, depth, node_idx, address, css): style and link elements; ``depth`` is how many shadow roots deep."""
    d = H.parsed(pages)
    attr = lambda n, k: F.try_element_at(H.attributes(F.coalesce(n["attrs"], F.lit(""))), F.lit(k))
    hosts = F.transform(F.filter("nodes", lambda n: (n["tag"] == "template") & attr(n, "shadowrootmode").isNotNull()), lambda n: F.struct(n["node_idx"].alias("i"), n["end_idx"].alias("end")))
    d = once(d, _roots=hosts)
    around = lambda n: F.transform(F.filter("_roots", lambda r: (r["i"] < n["node_idx"]) & (n["node_idx"] <= r["end"])), lambda r: r["i"])
    link = lambda n: (n["tag"] == "link") & F.array_contains(F.split(F.lower(F.coalesce(attr(n, "rel"), F.lit(""))), r"\s+"), "stylesheet")
    text = lambda n: F.array_join(F.transform(F.filter(F.slice("nodes", n["node_idx"] + 2, n["end_idx"] - n["node_idx"]), lambda x: x["tag"].isNull()), lambda x: x["text"]), "")
    own = F.transform(
        F.filter("nodes", lambda n: (n["tag"] == "style") | link(n)),
        lambda n: F.struct(around(n).alias("root"), n["node_idx"].alias("node_idx"), F.when(n["tag"] == "link", attr(n, "href")).alias("address"), F.when(n["tag"] == "style", text(n)).alias("css")),
    )
    rows = once(d.select("capture_id", "nodes", "_roots"), _own=F.array_sort(own)).select("capture_id", F.posexplode("_own").alias("rank", "x"))
    return rows.select("capture_id", "rank", F.size("x.root").alias("depth"), "x.node_idx", "x.address", "x.css")


def reachable(fetched: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(address, target, place): every address that an address leads to, itself at the empty place, and the
    least sequence of import numbers on the way there."""
    edges = fetched.select(F.col("address").alias("target"), F.posexplode(imports(F.col("css"))).alias("k", "next"))
    start = fetched.select("address").unionByName(edges.select(F.col("next").alias("address"))).distinct()
    # A step to itself keeps what a round has found, so each round reads the one before once.
    steps = edges.unionByName(start.select(F.col("address").alias("target"), F.lit(None).cast("int").alias("k"), F.col("address").alias("next")))
    reach = start.select("address", F.col("address").alias("target"), F.array().cast("array<int>").alias("place"))
    for _ in range(rounds):
        way = F.when(F.col("k").isNull(), F.col("place")).otherwise(F.concat("place", F.array("k")))
        reach = reach.join(steps, "target").select("address", F.col("next").alias("target"), way.alias("place")).groupBy("address", "target").agg(F.min("place").alias("place"))
    return reach


def listing(pages: DataFrame, fetched: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(capture_id, place, source, depth, address, missing): every sheet of each page once, in order.

    ``fetched`` has the sheets that could be read (address, css), one row an address.
    """
    own = page_sheets(pages)
    none = F.array().cast("array<int>")
    # What a sheet names (links themselves, styles their imports) and the styles are rows of one table: pages are parsed once.
    name = lambda k, a, linked: F.struct(k.alias("at"), a.alias("first"), linked.alias("linked"), F.lit(None).cast("int").alias("style"))
    link = F.array(name(none, F.col("address"), F.lit(True)))
    style = F.array(F.struct(none.alias("at"), F.lit(None).cast("string").alias("first"), F.lit(False).alias("linked"), F.col("rank").alias("style")))
    named = F.transform(imports(F.col("css")), lambda a, k: name(F.array(k), a, F.lit(False)))
    asked = own.select("capture_id", "rank", "depth", F.inline(F.when(F.col("address").isNotNull(), link).otherwise(F.concat(style, F.coalesce(named, F.slice(style, 1, 0))))))
    # Styles look nothing up; keys of their own keep them from meeting in one task.
    asked = asked.withColumn("_key", F.coalesce("first", F.concat(F.lit("\0"), F.col("capture_id").cast("string"))))
    reach = reachable(fetched, rounds).withColumnRenamed("address", "_from")
    found = asked.join(reach, (F.col("_key") == F.col("_from")) & F.col("style").isNull(), "left").select(
        "capture_id", "rank", "depth", F.concat("at", F.coalesce("place", none)).alias("at"), F.coalesce("target", "first").alias("address"), "style",
        F.when(F.col("style").isNotNull(), "style").when(F.col("linked") & (F.size(F.coalesce("place", none)) == 0), "link").otherwise("import").alias("source"),
    )
    first = found.groupBy("capture_id", "address", "style").agg(F.min(F.struct("rank", "at", "depth", "source")).alias("x")).select("capture_id", "x.*", "address", "style")
    have = fetched.select(F.col("address").alias("_have"))
    known = (F.coalesce("address", F.concat(F.lit("\0"), F.col("capture_id").cast("string"))) == F.col("_have")) & F.col("style").isNull()
    rows = first.join(have, known, "left").withColumn("missing", F.col("style").isNull() & F.col("_have").isNull())
    place = F.row_number().over(W.partitionBy("capture_id").orderBy("rank", "at")) - 1
    return rows.select("capture_id", place.alias("place"), "source", "depth", "address", "missing")


def _sheet_pages(s, d) -> DataFrame:
    return H.spread(X.sheet_pages(s, d))


def _fetched(s, d) -> DataFrame:
    """Seven sheets that import each other in cycles, of which one is missing."""
    i = F.col("i")
    name = lambda n: F.concat(F.lit("/s"), (n % 7).cast("string"), F.lit(".css"))
    css = F.concat(F.lit('@charset "x"; @import "'), name(i + 1), F.lit('"; @import url( '), name(i * 3 + 2), F.lit(" ) screen; p{a:b}"))
    ids = s.read.parquet(f"{d}/pages.parquet").select((F.col("page_id") % 7).alias("i")).distinct().where("i <> 5")
    return ids.select(name(i).alias("address"), css.alias("css"))


QUERIES = {"style_sheet_listing": lambda s, d: listing(_sheet_pages(s, d), _fetched(s, d))}

#: All simple ways through the imports, and the least of them.
ORACLE = {
    "style_sheet_listing": """WITH RECURSIVE f AS (SELECT DISTINCT page_id % 7 AS i FROM pages WHERE page_id % 7 <> 5), g AS (SELECT i, 0 AS k, (i + 1) % 7 AS j FROM f UNION ALL SELECT i, 1, (i * 3 + 2) % 7 FROM f),
      way AS (SELECT a, a AS t, []::INT[] AS at_, [a] AS seen FROM (SELECT unnest(range(7)) AS a) UNION ALL SELECT w.a, g.j, list_append(w.at_, g.k), list_append(w.seen, g.j) FROM way w JOIN g ON g.i = w.t WHERE NOT list_contains(w.seen, g.j)),
      least AS (SELECT a, t, min(at_) AS at_ FROM way GROUP BY ALL),
      refs AS (SELECT page_id AS capture_id, 1 AS rank, 0 AS depth, []::INT[] AS at_, page_id % 7 AS a, true AS linked FROM pages UNION ALL SELECT page_id, 2, 1, [0], (page_id + 2) % 7, false FROM pages UNION ALL SELECT page_id, 4, 2, [], (page_id + 4) % 7, true FROM pages),
      hit AS (SELECT capture_id, rank, list_concat(refs.at_, least.at_) AS at_, depth, CASE WHEN linked AND len(least.at_) = 0 THEN 'link' ELSE 'import' END AS source, '/s' || t || '.css' AS address, t = 5 AS missing FROM refs JOIN least USING (a)),
      one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY capture_id, address ORDER BY rank, at_) = 1),
      every AS (SELECT * FROM one UNION ALL SELECT page_id, 0, [], 0, 'style', NULL, false FROM pages UNION ALL SELECT page_id, 2, [], 1, 'style', NULL, false FROM pages UNION ALL SELECT page_id, 3, [], 1, 'link', '/t.css', true FROM pages)
      SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY rank, at_) - 1)::INT AS place, source, depth, address, missing FROM every""",
}
