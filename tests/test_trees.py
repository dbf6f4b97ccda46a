"""Trees of pages: large and deep ones, misnested ones, against a plain stack."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vitrail.functions.arrays import CHUNK, let, scan
from vitrail.operators import htmltree as H

TOKEN = re.compile(r"<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+", re.S)


def brute(html):
    """(parent, depth, end, tag) of each node, by a list of open elements."""
    out, open_ = [], []

    def close(n):
        for i in open_[n:]:
            out[i][2] = len(out) - 1
        del open_[n:]

    for t in TOKEN.findall(html):
        if t.startswith("</"):
            name = t[2:-1].strip().lower()
            close(next((k for k in range(len(open_) - 1, -1, -1) if out[open_[k]][3] == name), 0))
        elif not t.startswith("<!--") and (t.startswith("<") or t.strip()):
            tag = t[1:-1].rstrip("/").split()[0].lower() if t.startswith("<") else None
            out.append([open_[-1] if open_ else None, len(open_) + 1, len(out), tag])
            if tag and not t.endswith("/>") and tag not in H.VOID:
                open_.append(len(out) - 1)
    close(0)
    return [tuple(x) for x in out]


def made(seed):
    dice = random.Random(seed)
    tags = ["div", "p", "b", "li", "x-y", "br", "i"]
    return "".join(dice.choice(["<{}>", "<{}>", "</{}>", "</{}>", "<{}/>", "text ", "<!-- {} -->"]).format(dice.choice(tags)) for _ in range(dice.choice([5, 40, 300])))


PAGES = [made(i) for i in range(40)] + [
    "", "</p>", "<a>", "x", "<b>" * 3 * CHUNK + "</i>" + "<b>" * 3 * CHUNK + "</b>" * 2, "<i>" + "<b>" * 5 * CHUNK + "</i><u>t", "<p>x" * 4 * CHUNK + "</div>y",
    "<div>" * (4 * CHUNK + 1) + "</div>" * (4 * CHUNK) + "z" + "</div>" + "w",
]


def test_parse_is_the_plain_stack(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)] + [(-1, None)], "page_id int, html string")
    for r in H.parsed(df, paths=True).collect():
        if r.capture_id == -1:
            assert r.nodes is None
            continue
        found = [(n.parent_idx, n.depth, n.end_idx, n.tag) for n in r.nodes]
        assert found == brute(PAGES[r.capture_id]), PAGES[r.capture_id][:200]
        for n in r.nodes:
            up, i = [], n.parent_idx
            while i is not None:
                up.append(i)
                i = found[i][0]
            assert n.path == up[::-1] and n.path_tags == [found[i][3] for i in n.path]


def test_marked_ancestors(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)], "page_id int, html string")
    for r in H.parsed(df, paths=True).select("nodes", H.under(F.col("nodes"), lambda n: n["tag"].isin("b", "li")).alias("inside")).collect():
        assert r.inside == [bool({"b", "li"} & set(n.path_tags)) for n in r.nodes]


@pytest.mark.parametrize(
    "html, n, depth, ends",
    [("<i>" * 50_000 + "deep" + "</i>" * 50_000, 50_001, 50_001, 50_001 * 50_000), ('<div class="k">t</div>' * 50_000, 100_000, 2, None), ("<div><p>a<b>" * 10_000 + "z", 40_001, 30_001, None)],
)
def test_large_pages_take_seconds(spark, html, n, depth, ends):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    began = time.time()
    got = H.nodes(df, paths=False).agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum("end_idx").alias("e")).first()
    assert (got.n, got.d) == (n, depth) and (ends is None or got.e == ends)
    assert time.time() - began < 180  # the square of the nodes would take hours


def test_scan_sums_up(spark):
    for n in (0, 1, CHUNK, CHUNK + 1, 5 * CHUNK * CHUNK + 3):
        df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("x") if n else F.array().cast("array<int>").alias("x"))
        total = lambda _, s, x: F.struct((s + x).alias("s"), (s + x).alias("o"))
        row = df.select(scan(F.col("x"), F.lit(0), total, "int").alias("o"), let(F.size("x"), lambda k: k + k).alias("k")).first()
        assert row.o == [i * (i + 1) // 2 for i in range(1, n + 1)] and row.k == 2 * n


def test_removed_and_anchors_of_nested_noise(spark):
    html = "<svg><defs><a href='no'>x</a><style>s</style></defs></svg><a href=\"/a\">o<b>k</b><a>in</a></a>t<script>1</script><noscript><template>y</template></noscript>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert {r.tag: r.removed for r in H.removed_tags(df).collect()} == {"defs": 1, "script": 1, "noscript": 1}
    assert H.anchor_html(df).first().html == '<a href="/a">ok<a>in</a></a>t'
