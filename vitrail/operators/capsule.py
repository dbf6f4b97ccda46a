"""Capture bundles: the seed of a capture, its guard, its replay capsule, requests and tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as X
from . import fidelity as Q


def is_bundle(d: DataFrame) -> Column:
    """Whether a row is a capture bundle: recorded by the debug protocol, of version 0, with a seed."""
    return F.coalesce((F.col("backend") == "cdp") & (F.col("version") == "0") & F.col("seed").isNotNull(), F.lit(False))


def first_of(*names: str) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[T.present(F.col(n)) for n in names])


def seed(d: DataFrame) -> DataFrame:
    """Selectors and hints of a capture's seed from a stored payload and its fingerprint.

    A chart in a rendered scene keeps the selector that was picked; other targets take the promoted one.
    """
    kind, sub = first_of("fp_class", "element_class"), first_of("fp_subtype", "element_subtype")
    picked = F.coalesce((kind == "render-scene") & (sub == "chart-like"), F.lit(False))
    pick = lambda n: F.when(picked, first_of(f"original_{n}", n, f"promoted_{n}", "element_selector")).otherwise(first_of(f"promoted_{n}", n, "element_selector"))
    return d.withColumns(
        {"seed_stable": pick("stable"), "seed_selected": pick("selected"), "seed_class": kind, "seed_subtype": sub, "seed_box": F.coalesce("clip_box", F.lit(None).cast("string"))}
    )


def resolved_object(d: DataFrame) -> DataFrame:
    """Where a target was found: the mapped object, else its node, else its selector; and by which."""
    ways = {"mapped": "object_id", "node": "node_object", "selector": "selector_object"}
    by = F.coalesce(*[F.when(T.present(F.col(c)).isNotNull(), k) for k, c in ways.items()])
    return d.withColumns({"object": first_of(*ways.values()), "resolved_by": by})


def preferred(replay: str, capture: str) -> Column:
    """A part of the replay capsule, or the capture's own where the capsule has none."""
    return F.coalesce(F.col(replay), F.col(capture))


def capsules(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One replay capsule a capture: how many events its timeline holds, what is missing, warnings."""
    n = events.groupBy("capture_id").agg(F.count(F.lit(1)).alias("events"))
    d = captures.select("capture_id").join(Q.missing_artifacts(captures), "capture_id").join(n, "capture_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    lost = F.when(F.col("missing") != "", F.concat(F.lit("replay-capsule-missing-artifacts:"), "missing"))
    empty = F.when(F.col("events") == 0, F.lit("replay-capsule-empty-timeline"))
    return d.select("capture_id", F.lit("0").alias("version"), F.lit("snapshot-first").alias("mode"), "events", "missing", F.array_compact(F.array(lost, empty)).alias("warnings"))


def popped(log: DataFrame) -> DataFrame:
    """Tabs that requests are answered with: of a log of ``register`` (with its tab) and ``pop`` by
    request, each pop gets the tab of the last entry before it, if that is a registration: popping
    forgets it.  Only a request's own entries are ordered."""
    w = W.partitionBy("request_id").orderBy("seq")
    known = F.when(F.lag("op").over(w) == "register", F.lag("tab_id").over(w))
    return log.withColumn("answer", known).where("op = 'pop'").select("request_id", "seq", "answer")


def address(url: Column) -> Column:
    """Origin and path of a URL; other text stays as it is."""
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_extract(url, "^([^?#]*)", 1)).otherwise(url)


def target_tab(wanted: DataFrame, tabs: DataFrame) -> DataFrame:
    """The tab of each wanted page: the first with its address, else the first active one; not those of
    extensions.  The fallback is one row, so only it meets all pages."""
    own = tabs.where(~F.coalesce(F.col("url"), F.lit("")).startswith("chrome-extension://") & F.col("tab_id").isNotNull())
    same = own.where("url is not null").groupBy(address(F.col("url")).alias("address")).agg(F.min_by("tab_id", "ordinal").alias("same"))
    active = own.where("active").agg(F.min_by("tab_id", "ordinal").alias("active"))
    d = wanted.withColumn("address", address(F.col("url"))).join(same, "address", "left").join(F.broadcast(active), F.lit(True), "left")
    return d.select("capture_id", F.coalesce("same", "active").alias("tab_id"), F.when(F.col("same").isNotNull(), "address").when(F.col("active").isNotNull(), "active").alias("found_by"))


def build_metadata(d: DataFrame, sha: str | None, version: str | None) -> DataFrame:
    """``d`` with the commit (its first seven digits) and version of the build; ``unknown`` without."""
    return d.withColumns({"commit": F.substring(F.lit((sha or "").strip() or "unknown"), 1, 7), "version": F.lit((version or "").strip() or "unknown")})


def shim(selector: Column) -> Column:
    """Script of an exported root: marks a clicked control for a moment."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(selector, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    body = "if(!root)return;root.addEventListener('click',function(e){var hit=e.target.closest('button,a,[role=\"button\"]');if(!hit)return;hit.classList.add('pressed');setTimeout(function(){hit.classList.remove('pressed')},180)})"
    return F.concat(F.lit("(function(){var root=document.querySelector("), quoted, F.lit(");"), F.lit(body), F.lit("})();"))


def preview(title: Column, html: Column, css: Column, script: Column) -> Column:
    """A page that shows an exported fragment."""
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), T.escape_text(title), F.lit("</title><style>"), css, F.lit("</style></head>"))
    return F.concat(head, F.lit("<body>"), html, F.lit("<script>"), script, F.lit("</script></body></html>"))


def _payloads(s, d):
    p = F.col("page_id")
    given = lambda n, text: F.when(p % n != 0, F.concat(F.lit(text), p.cast("string"))).when(p % 2 == 0, F.lit(" "))
    return s.read.parquet(f"{d}/pages.parquet").select(
        p.alias("capture_id"), F.when(p % 3 == 0, "render-scene").alias("fp_class"), F.when(p % 5 > 1, "semantic-ui").alias("element_class"),
        F.when(p % 2 == 0, "chart-like").alias("fp_subtype"), F.lit("generic").alias("element_subtype"), given(3, "#os").alias("original_stable"), given(5, "#s").alias("stable"),
        given(2, "#ps").alias("promoted_stable"), given(4, "#oe").alias("original_selected"), given(7, "#e").alias("selected"), given(6, "#pe").alias("promoted_selected"),
        F.lit("div").alias("element_selector"), F.when(p % 3 == 1, "1,2,3,4").alias("clip_box"), F.when(p % 4 == 0, "cdp").otherwise("tab").alias("backend"),
        F.when(p % 8 < 5, "0").alias("version"), F.when(p % 3 > 0, "{}").alias("seed"), given(3, "o").alias("object_id"), given(4, "n").alias("node_object"), given(5, "q").alias("selector_object"),
    )


_PAYLOADS_SQL = "pay AS (SELECT page_id AS capture_id, page_id % 3 = 0 AS scene, CASE WHEN page_id % 3 = 0 THEN 'render-scene' WHEN page_id % 5 > 1 THEN 'semantic-ui' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'chart-like' ELSE 'generic' END AS sub, " + ", ".join(
    f"CASE WHEN page_id % {n} <> 0 THEN '{t}' || page_id END AS {c}"
    for c, n, t in (("os", 3, "#os"), ("st", 5, "#s"), ("ps", 2, "#ps"), ("oe", 4, "#oe"), ("se", 7, "#e"), ("pe", 6, "#pe"), ("ob", 3, "o"), ("no", 4, "n"), ("so", 5, "q"))
) + " FROM pages)"


def _log(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 3 == 0, "pop").otherwise("register")
    return e.select((F.col("user_id") % 50).alias("request_id"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "register", F.col("event_id") % 17).alias("tab_id"))


def _tabs(s, d):
    p = F.col("page_id")
    url = F.when(p % 4 == 0, F.concat("url", F.lit("?q=1#x"))).when(p % 4 == 1, F.lit("chrome-extension://abc/x")).when(p % 4 == 2, F.col("url"))
    return s.read.parquet(f"{d}/pages.parquet").select(F.when(p % 9 > 0, p + 1000).alias("tab_id"), url.alias("url"), (p % 10 == 7).alias("active"), p.alias("ordinal"))


def _wanted(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), F.concat("url", F.lit("#top")).alias("url"))


def _precedence(s, d):
    p = F.col("capture_id")
    c = X.captures(s, d).withColumns({"replay_text": F.when(p % 3 > 0, F.concat(F.lit("r"), p.cast("string"))), "capture_text": F.when(p % 4 > 0, F.concat(F.lit("c"), p.cast("string")))})
    return c.select("capture_id", preferred("replay_text", "capture_text").alias("part"))


def _previews(s, d):
    p = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("capture_id"), F.concat(F.lit("<"), F.col("url"), F.lit(">")).alias("t"), F.concat(F.lit("[data-k='"), F.col("page_id").cast("string"), F.lit("']")).alias("sel"))
    page = build_metadata(p.withColumn("page", preview(F.col("t"), F.lit("<b>x</b>"), F.lit("b{}"), shim(F.col("sel")))), "0123456789abc", None)
    return page.select("capture_id", "page", "commit", "version")


QUERIES = {
    "capture_seed": lambda s, d: seed(_payloads(s, d)).select("capture_id", "seed_stable", "seed_selected", "seed_class", "seed_subtype", "seed_box"),
    "bundle_guard": lambda s, d: _payloads(s, d).where(is_bundle(None)).select("capture_id"),
    "object_resolution": lambda s, d: resolved_object(_payloads(s, d)).select("capture_id", "object", "resolved_by"),
    "replay_precedence": _precedence,
    "replay_capsules": lambda s, d: capsules(X.captures(s, d), s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") * 3).alias("capture_id"))).withColumn("warnings", F.array_join("warnings", " ")),
    "request_registry": lambda s, d: popped(_log(s, d)),
    "target_tab": lambda s, d: target_tab(_wanted(s, d), _tabs(s, d)),
    "export_preview": _previews,
}

_LOST = Q.ORACLE["missing_artifacts"]
ORACLE = {
    "capture_seed": f"""WITH {_PAYLOADS_SQL}, k AS (SELECT *, scene AND sub = 'chart-like' AS picked FROM pay) SELECT capture_id, CASE WHEN picked THEN coalesce(os, st, ps, 'div') ELSE coalesce(ps, st, 'div') END AS seed_stable,
      CASE WHEN picked THEN coalesce(oe, se, pe, 'div') ELSE coalesce(pe, se, 'div') END AS seed_selected, kind AS seed_class, sub AS seed_subtype, CASE WHEN capture_id % 3 = 1 THEN '1,2,3,4' END AS seed_box FROM k""",
    "bundle_guard": "SELECT page_id AS capture_id FROM pages WHERE page_id % 4 = 0 AND page_id % 8 < 5 AND page_id % 3 > 0",
    "object_resolution": f"WITH {_PAYLOADS_SQL} SELECT capture_id, coalesce(ob, no, so) AS object, CASE WHEN ob IS NOT NULL THEN 'mapped' WHEN no IS NOT NULL THEN 'node' WHEN so IS NOT NULL THEN 'selector' END AS resolved_by FROM pay",
    "replay_precedence": "SELECT page_id AS capture_id, CASE WHEN page_id % 3 > 0 THEN 'r' || page_id WHEN page_id % 4 > 0 THEN 'c' || page_id END AS part FROM pages",
    "replay_capsules": f"""WITH lost AS ({_LOST}), n AS (SELECT user_id * 3 AS capture_id, count(*) AS events FROM events GROUP BY ALL)
      SELECT capture_id, '0' AS version, 'snapshot-first' AS mode, coalesce(events, 0) AS events, missing, concat_ws(' ', CASE WHEN missing <> '' THEN 'replay-capsule-missing-artifacts:' || missing END, CASE WHEN events IS NULL THEN 'replay-capsule-empty-timeline' END) AS warnings FROM lost LEFT JOIN n USING (capture_id)""",
    "request_registry": """WITH l AS (SELECT user_id % 50 AS request_id, event_id AS seq, event_id % 3 = 0 AS pop, event_id % 17 AS tab FROM events)
      SELECT request_id, seq, (SELECT CASE WHEN NOT p.pop THEN p.tab END FROM l p WHERE p.request_id = l.request_id AND p.seq < l.seq ORDER BY p.seq DESC LIMIT 1) AS answer FROM l WHERE pop""",
    "target_tab": """WITH t AS (SELECT page_id + 1000 AS tab_id, url, page_id % 4 AS m, page_id % 10 = 7 AS active, page_id AS ordinal FROM pages WHERE page_id % 9 > 0 AND page_id % 4 <> 1),
      s AS (SELECT regexp_extract(url, '^([^?#]*)', 1) AS address, arg_min(tab_id, ordinal) AS same FROM t WHERE m IN (0, 2) GROUP BY 1)
      SELECT page_id AS capture_id, coalesce(same, a) AS tab_id, CASE WHEN same IS NOT NULL THEN 'address' WHEN a IS NOT NULL THEN 'active' END AS found_by FROM pages LEFT JOIN s ON address = regexp_extract(url, '^([^?#]*)', 1), (SELECT arg_min(tab_id, ordinal) AS a FROM t WHERE active)""",
    "export_preview": r"""SELECT page_id AS capture_id, '<!doctype html><html><head><meta charset="utf-8"><title>&lt;' || replace(url, '&', '&amp;') || '&gt;</title><style>b{}</style></head><body><b>x</b><script>(function(){var root=document.querySelector(''[data-k=\''' || page_id || '\'']'');if(!root)return;root.addEventListener(''click'',function(e){var hit=e.target.closest(''button,a,[role="button"]'');if(!hit)return;hit.classList.add(''pressed'');setTimeout(function(){hit.classList.remove(''pressed'')},180)})})();</script></body></html>' AS page, '0123456' AS "commit", 'unknown' AS version FROM pages""",
}
