"""Shadow topology: roots joined with the stylesheets they adopt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as X

KEY = ("capture_id", "depth", "tag", "host_id", "host_classes")


def merge_sheets(roots: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every root, with the sheets of the adopted root that pairs with it.

    A key is the depth and the host's tag, id and classes (in order).  Open roots and adopted roots of one key pair in order, the first with the first; adopted roots
    left over become open roots with a warning.  Closed and unknown roots pair with nothing.
    """
    named = {"tag": F.lower(F.trim("tag")), "host_id": F.trim(F.coalesce("host_id", F.lit(""))), "host_classes": F.coalesce("host_classes", F.array().cast("array<string>"))}
    # Hosts without recorded classes have none.
    roots, sheets = (d if "host_classes" in d.columns else d.withColumn("host_classes", F.lit(None).cast("array<string>")) for d in (roots, sheets))
    roots, sheets = roots.withColumns(named), sheets.withColumns(named)
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("ordinal"))
    is_open = F.col("mode") == "open"
    left = roots.where(is_open).select(*KEY, "mode", place.alias("n"))
    right = sheets.select(*KEY, "sheets", place.alias("n"))
    pairs = left.join(right, [*KEY, "n"], "full_outer")
    merged = pairs.select(
        *KEY,
        F.coalesce("mode", F.lit("open")).alias("mode"),
        F.coalesce("sheets", F.lit(0)).cast("long").alias("sheets"),
        F.when(F.col("mode").isNull(), "adopted-stylesheets-host-unmapped").alias("warning"),
    )
    rest = roots.where(~is_open).select(*KEY, "mode", F.lit(0).cast("long").alias("sheets"), F.lit(None).cast("string").alias("warning"))
    return merged.unionByName(rest)


def diagnostics(merged: DataFrame) -> DataFrame:
    """Roots by mode, deepest root, roots with sheets and sheets of each capture."""
    mode = lambda m: F.count_if(F.col("mode") == m)
    return merged.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("roots"), mode("open").alias("open"), mode("closed").alias("closed"), mode("unknown").alias("unknown"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.count_if(F.col("sheets") > 0).alias("sheet_roots"), F.sum("sheets").alias("sheets"),
    )


def key_text() -> Column:
    """The key of a root as one string."""
    return F.concat_ws("|", F.col("depth").cast("string"), "tag", "host_id", F.array_join("host_classes", "."))


def ordered(merged: DataFrame) -> DataFrame:
    """Roots with their place in a capture: by depth, then by key as a dictionary orders it."""
    w = W.partitionBy("capture_id").orderBy("depth", F.collate(key_text(), "UNICODE"), "mode", "sheets")
    return merged.withColumn("place", F.row_number().over(w) - 1)


def topology_json(placed: DataFrame) -> DataFrame:
    """The shadow topology of each capture as JSON: mode, depth, host label and number of sheets of each root."""
    label = F.concat(
        "tag", F.when(F.col("host_id") != "", F.concat(F.lit("#"), "host_id")).otherwise(""), F.array_join(F.transform(F.slice("host_classes", 1, 2), lambda c: F.concat(F.lit("."), c)), "")
    )
    root = F.struct("place", F.struct("mode", "depth", label.alias("host"), F.col("sheets").alias("adoptedStyleSheetCount")).alias("r"))
    rows = placed.groupBy("capture_id").agg(F.array_sort(F.collect_list(root)).alias("roots"))
    return rows.select("capture_id", F.to_json(F.transform("roots", lambda x: x["r"])).alias("json"))


def sheet_rows(raw: DataFrame) -> DataFrame:
    """Adopted sheets as a page reports them: blank texts become null, false flags too, depth 1 if unknown."""
    flag = lambda c: F.nullif(F.coalesce(F.col(c), F.lit(False)), F.lit(False))
    return raw.select(
        "capture_id", F.coalesce("depth", F.lit(1)).alias("depth"), T.present(F.lower(F.col("tag"))).alias("tag"), T.present(F.col("host_id")).alias("host_id"),
        F.filter(F.transform(F.coalesce("host_classes", F.array().cast("array<string>")), T.trim), lambda c: c != "").alias("host_classes"),
        F.coalesce("idx", F.col("seq")).alias("idx"), T.present(F.col("href")).alias("href"), flag("disabled").alias("disabled"), T.present(F.col("media")).alias("media"),
    )


def _raw_sheets(s, d):
    p, k = F.col("capture_id"), F.col("ordinal")
    return X.shadow_sheets(s, d).select(
        "capture_id", F.when(p % 5 != 0, F.col("depth")).alias("depth"), F.when(k == 0, F.lit(" X-Card ")).otherwise(" ").alias("tag"), F.concat(F.lit(" "), "host_id").alias("host_id"),
        F.when(p % 7 != 0, F.array(F.lit(" a "), F.lit(""), F.concat(F.lit("c"), k.cast("string")))).alias("host_classes"), F.when(p % 3 == 0, k + 7).alias("idx"), k.alias("seq"),
        F.when(p % 2 == 0, F.concat(F.lit("/s"), k.cast("string"), F.lit(".css "))).otherwise("").alias("href"), F.when(p % 4 > 0, p % 4 == 1).alias("disabled"), F.when(k == 1, " print").alias("media"),
    )


def _merged(s, d):
    return merge_sheets(X.shadow_roots(s, d), X.shadow_sheets(s, d))


QUERIES = {"shadow_merge": _merged, "shadow_diagnostics": lambda s, d: diagnostics(_merged(s, d)), "shadow_order": lambda s, d: ordered(_merged(s, d)).select("capture_id", "place", "depth", "host_id"),
           "shadow_json": lambda s, d: topology_json(ordered(_merged(s, d))), "adopted_sheet_rows": lambda s, d: sheet_rows(_raw_sheets(s, d))}

_SQL = f"""WITH {X.SHADOW_SQL}, {X.SHEETS_SQL},
l AS (SELECT capture_id, depth, tag, host_id, host_classes, mode, row_number() OVER (PARTITION BY capture_id, depth, tag, host_id, host_classes ORDER BY ordinal) AS n FROM fx_shadow WHERE mode = 'open'),
r AS (SELECT capture_id, depth, tag, host_id, host_classes, sheets, row_number() OVER (PARTITION BY capture_id, depth, tag, host_id, host_classes ORDER BY ordinal) AS n FROM fx_sheets),
merged AS (SELECT capture_id, depth, tag, host_id, host_classes, coalesce(mode, 'open') AS mode, coalesce(sheets, 0)::BIGINT AS sheets, CASE WHEN mode IS NULL THEN 'adopted-stylesheets-host-unmapped' END AS warning FROM l FULL JOIN r USING (capture_id, depth, tag, host_id, host_classes, n)
  UNION ALL SELECT capture_id, depth, tag, host_id, host_classes, mode, 0, NULL FROM fx_shadow WHERE mode <> 'open')
"""
_ORDER = _SQL + """, placed AS (SELECT *, (row_number() OVER (PARTITION BY capture_id ORDER BY depth, concat_ws('|', depth, tag, host_id, array_to_string(host_classes, '.')) COLLATE en, mode, sheets) - 1)::INT AS place FROM merged) """
ORACLE = {
    "shadow_merge": _SQL + "SELECT * FROM merged",
    "shadow_order": _ORDER + "SELECT capture_id, place, depth, host_id FROM placed",
    "shadow_json": _ORDER + """SELECT capture_id, '[' || string_agg('{"mode":"' || mode || '","depth":' || depth || ',"host":"' || tag || CASE WHEN host_id <> '' THEN '#' || host_id ELSE '' END || coalesce('.' || nullif(array_to_string(host_classes[1:2], '.'), ''), '')
      || '","adoptedStyleSheetCount":' || sheets || '}', ',' ORDER BY place) || ']' AS json FROM placed GROUP BY capture_id""",
    "adopted_sheet_rows": f"""WITH {X.SHEETS_SQL} SELECT capture_id, CASE WHEN capture_id % 5 <> 0 THEN depth ELSE 1 END AS depth, CASE WHEN ordinal = 0 THEN 'x-card' END AS tag, nullif(host_id, '') AS host_id, CASE WHEN capture_id % 7 <> 0 THEN ['a', 'c' || ordinal] ELSE []::VARCHAR[] END AS host_classes,
      CASE WHEN capture_id % 3 = 0 THEN ordinal + 7 ELSE ordinal END AS idx, CASE WHEN capture_id % 2 = 0 THEN '/s' || ordinal || '.css' END AS href, CASE WHEN capture_id % 4 = 1 THEN true END AS disabled, CASE WHEN ordinal = 1 THEN 'print' END AS media FROM fx_sheets""",
    "shadow_diagnostics": _SQL + """SELECT capture_id, count(*) AS roots, count(*) FILTER (mode = 'open') AS open, count(*) FILTER (mode = 'closed') AS closed, count(*) FILTER (mode = 'unknown') AS unknown, max(depth) AS max_depth,
      count(*) FILTER (sheets > 0) AS sheet_roots, sum(sheets)::BIGINT AS sheets FROM merged GROUP BY capture_id""",
}
