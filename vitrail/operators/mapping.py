"""A target is mapped by stages: in the running page, then in the document, then by its selector.

A later stage works only on what the earlier ones left.  All share a page's row, parsed once: when a capture
is resolved the second has no elements to score, and the third, which compiles the selector and holds it
against the elements, has no nodes to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import selectors as Z
from ..functions.arrays import let, once
from ..sources import fixtures as X
from . import cascade as K
from . import htmltree as H
from . import matching as M
from . import projections as P

#: FIXED VALUES: names of the strategies, warnings of the stages, gains of hints in a snapshot's strings.
RUNTIME, DOCUMENT, SELECTOR, NONE = "runtime-structural", "dom-traversal", "selector-fallback", "unresolved"
WARNINGS = {
    "runtime": ("runtime mapping failed", "runtime structural mapping did not find a strong candidate", "multiple close runtime candidates detected"),
    "document": ("dom traversal failed", "dom traversal found candidates but none reached confidence threshold", "dom traversal found close competing candidates"),
    "nothing": "dom traversal did not find a matching node", "selector": "selector-only mapping has weak confidence", "missed": "selector fallback did not find node for selector",
}
HINT_BASE, HINT, HINT_MOST = 0.015, 0.01, 0.06

_ATTEMPT = "struct<strategy:string,resolved:boolean,confidence:double,candidates:int,node_idx:int,warning:string>"


def strings(nodes: Column) -> Column:
    """A page's string table: element names, upper case, attribute values, texts."""
    values = F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"].isNotNull()), lambda n: F.concat(F.array(F.upper(n["tag"])), F.map_values(H.attributes(F.coalesce(n["attrs"], F.lit("")))))))
    return F.array_distinct(F.concat(values, F.array_compact(F.transform(nodes, lambda n: n["text"]))))


def attempt(c: Column, stage: str, strategy: str, calibrate, cut: int, window: int) -> Column:
    """What a stage makes of its candidates."""
    _, weak, close = WARNINGS[stage]
    best, second = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    top = -best["s"]
    margin = F.coalesce(top + second["s"], top)
    near = F.size(F.filter(c, lambda x: top + x["s"] < window))
    crowded = (second.isNotNull() & (margin < window)) | (near > 1)
    none = F.lit(weak if stage == "runtime" else WARNINGS["nothing"])
    warning = F.when(F.size(c) == 0, none).when(top < cut, F.lit(weak)).when(crowded, F.lit(close))
    ok = (F.size(c) > 0) & (top >= cut)
    return F.struct(
        F.when(ok, F.lit(strategy)).otherwise(F.lit(NONE)).alias("strategy"), ok.alias("resolved"), F.when(F.size(c) > 0, N.thousandths(calibrate(top, margin, best["penalty"], near))).otherwise(N.dbl(0)).alias("confidence"),
        F.size(c).alias("candidates"), F.when(ok, best["node_idx"]).alias("node_idx"), warning.alias("warning"),
    ).cast(_ATTEMPT)


def mapped(pages: DataFrame, in_shadow, box, drifted, runtime_fails: Column, document_fails: Column) -> DataFrame:
    """(capture_id, strategy, node_idx, confidence, hints, attempts, warnings) of every capture with a target.

    ``drifted`` gives the fingerprint's box; the two conditions over capture_id say where a stage's call
    fails: that leaves a warning and no attempt.  Hints in the page's strings add to a match's confidence,
    not to a selector's.
    """
    d = M.with_fingerprint(M.described(pages, in_shadow)).withColumnRenamed("fp", "_fp")
    d = once(d, fp=F.col("_fp").withField("box", drifted(F.col("_fp.i"))), _strings=strings(F.col("nodes"))).drop("_fp")
    d = once(d, hints=let(F.col("fp"), lambda fp: P.snapshot_hints(F.col("_strings"), fp["tag"], fp["id"], fp["classes"]))).drop("_strings")
    d = M.runtime_score(d, box)
    d = once(d, runtime=F.when(~runtime_fails, attempt(F.col("c"), "runtime", RUNTIME, M.runtime_confidence, M.RUNTIME_RESOLVED, M.RUNTIME_WINDOW)))
    open_ = ~F.coalesce(F.col("runtime.resolved"), F.lit(False))
    second = let(F.col("fp"), lambda fp: let(M.candidates(F.col("els"), fp), lambda c: attempt(c, "document", DOCUMENT, M.confidence, M.RESOLVED, M.WINDOW)))
    d = once(d, document=F.when(open_ & ~document_fails, second))
    settled = F.coalesce(F.col("runtime.resolved"), F.lit(False)) | F.coalesce(F.col("document.resolved"), F.lit(False))
    d = d.select("capture_id", "nodes", "hints", "runtime", "document", settled.alias("settled"), open_.alias("open"), let(F.col("fp"), lambda fp: M.stable_selector(fp["tag"], fp["attrs"])).alias("selector"))
    d = _selected(K.shaped(once(d, _left=F.filter("nodes", lambda n: ~F.col("settled"))).drop("nodes").withColumnRenamed("_left", "nodes")))
    failed = lambda stage, tried, condition: F.when(tried & condition, F.lit(WARNINGS[stage][0]))
    warnings = F.array_compact(F.array(
        failed("runtime", F.lit(True), runtime_fails), F.col("runtime.warning"), failed("document", F.col("open"), document_fails), F.col("document.warning"), F.col("fallback.warning"),
    ))
    # A resolved runtime match says no more than its own warnings.
    won = F.when(F.col("runtime.resolved"), F.col("runtime")).when(F.col("document.resolved"), F.col("document")).otherwise(F.col("fallback"))
    n = F.col("hints")
    bonus = F.when((n > 0) & F.col("settled"), F.least(N.dbl(HINT_MOST), N.dbl(HINT_BASE) + N.dbl(HINT) * n)).otherwise(N.dbl(0))
    return d.select(
        "capture_id", won["strategy"].alias("strategy"), won["node_idx"].alias("node_idx"), N.thousandths(N.clamp(won["confidence"] + bonus)).alias("confidence"), "hints",
        F.array_compact(F.array("runtime", "document", "fallback")).alias("attempts"), warnings.alias("warnings"),
    )


def _selected(d: DataFrame) -> DataFrame:
    """The attempt by selector: the first element that it matches; none for captures that are settled."""
    d = once(d, _compiled=F.when(~F.col("settled"), Z.compile(F.col("selector"))))
    at = F.filter(F.transform("els", lambda e, i: F.when(e.isNotNull() & Z.matches(F.col("els"), F.col("children"), i, F.col("_compiled.steps")), i)), lambda i: i.isNotNull())
    first = F.when(F.col("_compiled.valid"), F.get(at, F.lit(0)))
    made = lambda i: F.struct(
        F.when(i.isNotNull(), F.lit(SELECTOR)).otherwise(F.lit(NONE)).alias("strategy"), i.isNotNull().alias("resolved"), F.when(i.isNotNull(), N.dbl(M.SELECTOR_CONFIDENCE)).otherwise(N.dbl(0)).alias("confidence"),
        F.lit(None).cast("int").alias("candidates"), i.alias("node_idx"), F.when(i.isNotNull(), F.lit(WARNINGS["selector"])).otherwise(F.lit(WARNINGS["missed"])).alias("warning"),
    ).cast(_ATTEMPT)
    return once(d, fallback=F.when(~F.col("settled"), let(first, made))).drop("nodes", "els", "children")


def _mapped(s, d):
    c = F.col("capture_id")
    found = mapped(H.spread(X.varied_pages(s, d)), M._in_shadow, M._box, lambda i: M._box(i, 9), c % 3 == 0, c % 6 == 0)
    line = F.transform("attempts", lambda a: F.concat_ws(":", a["strategy"], a["resolved"].cast("string"), N.whole_ms(a["confidence"] * 1000).cast("string"), a["candidates"].cast("string")))
    return found.select("capture_id", "strategy", "node_idx", "confidence", "hints", F.array_join(line, " ").alias("attempts"), F.array_join("warnings", "; ").alias("warnings"))


QUERIES = {"mapping_attempts": _mapped}

#: The two matches by their own SQL; a selector is #id, tag.class.class or the tag, the first such element.
_R, _D = (f"({M.ORACLE[k]})" for k in ("runtime_match", "fingerprint_match"))
ORACLE = {
    "mapping_attempts": f"""WITH rt AS (SELECT * FROM {_R}), dt AS (SELECT * FROM {_D}), fp AS (SELECT * FROM ({M._SHADOWED} SELECT capture_id, node_idx, tag, id, classes FROM f)),
      el AS (SELECT * FROM ({M._SHADOWED} SELECT capture_id, node_idx, tag, id, classes, raw FROM e0 WHERE tag IS NOT NULL)), tx AS (SELECT * FROM ({M._SHADOWED} SELECT capture_id, text FROM nodes WHERE tag IS NULL)),
      words AS (SELECT capture_id, upper(tag) AS w FROM el UNION SELECT capture_id, replace(replace(replace(replace(replace(unnest(regexp_extract_all(raw, '([:@a-zA-Z0-9_-]+)(?:\\s*=\\s*"([^"]*)")?', 2)), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') FROM el UNION SELECT capture_id, text FROM tx),
      hint AS (SELECT fp.capture_id, (fp.id <> '' AND bool_or(w = fp.id))::INT + bool_or(w = upper(fp.tag) OR w = fp.tag)::INT + bool_or(list_contains(fp.classes, w))::INT AS hints FROM fp JOIN words USING (capture_id) GROUP BY fp.capture_id, fp.id, fp.tag, fp.classes),
      sel AS (SELECT fp.capture_id, min(el.node_idx) AS node_idx FROM fp JOIN el ON el.capture_id = fp.capture_id AND CASE WHEN fp.id <> '' THEN el.id = fp.id WHEN len(fp.classes) > 0 THEN el.tag = fp.tag AND list_has_all(el.classes, fp.classes[1:2]) ELSE el.tag = fp.tag END GROUP BY ALL),
      j AS (SELECT fp.capture_id, hints, fp.capture_id % 3 = 0 AS nort, fp.capture_id % 6 = 0 AS nodt, rt.node_idx AS rn, rt.confidence AS rc, rt.candidates AS rk, rt.ambiguous AS ra, dt.node_idx AS dn, dt.confidence AS dc, dt.candidates AS dk, dt.ambiguous AS da, sel.node_idx AS sn
        FROM fp JOIN rt USING (capture_id) JOIN dt USING (capture_id) JOIN hint USING (capture_id) LEFT JOIN sel USING (capture_id))
      SELECT capture_id, CASE WHEN NOT nort THEN 'runtime-structural' WHEN NOT nodt THEN 'dom-traversal' ELSE 'selector-fallback' END AS strategy, CASE WHEN NOT nort THEN rn WHEN NOT nodt THEN dn ELSE sn END AS node_idx,
        {N.sql_round3('''CASE WHEN nodt THEN 0.28::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN nort THEN dc ELSE rc END + CASE WHEN hints = 0 THEN 0::DOUBLE ELSE least(0.06::DOUBLE, 0.015::DOUBLE + 0.01::DOUBLE * hints) END)) END''')} AS confidence, hints::INT AS hints,
        CASE WHEN NOT nort THEN 'runtime-structural:true:' || floor(rc * 1000 + 0.5)::BIGINT || ':' || rk WHEN NOT nodt THEN 'dom-traversal:true:' || floor(dc * 1000 + 0.5)::BIGINT || ':' || dk ELSE 'selector-fallback:true:280' END AS attempts,
        concat_ws('; ', CASE WHEN nort THEN 'runtime mapping failed' WHEN ra THEN 'multiple close runtime candidates detected' END, CASE WHEN nort AND nodt THEN 'dom traversal failed' WHEN nort AND da THEN 'dom traversal found close competing candidates' END,
          CASE WHEN nodt THEN 'selector-only mapping has weak confidence' END) AS warnings FROM j""",
}
