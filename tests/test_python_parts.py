"""The parts that need Python: keyframe blocks and pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrail.functions import css
from vitrail.operators import fallback, imagediff


def test_keyframe_blocks(spark):
    sheet = """a{} @keyframes x { from { content: "}" } /* } */ to { y: 1 } }
      @-webkit-keyframes 'y z' {a{b:c}} @keyframes open { from {"""
    got = css.keyframes_of(sheet)
    assert [(n, p) for n, _, p in got] == [("x", False), ("y z", True)]
    assert got[0][1].startswith('@keyframes x { from { content: "}" }') and got[1][1] == "@keyframes y z {a{b:c}}"
    assert css.keyframes_of(None) == [] and css.keyframes_of("@keyframes q { /* {") == []
    df = spark.createDataFrame([(sheet,), (None,)], "s string").select(css.parse_keyframes("s").alias("k"))
    assert [len(r.k) for r in df.collect()] == [2, 0]


def _plain_smoothed(image, other, light, x, y):
    """The slope detector for one pixel, as published."""
    h, w = light.shape

    def around(x, y):
        return [(u, v) for u in range(max(0, x - 1), min(w, x + 2)) for v in range(max(0, y - 1), min(h, y + 2)) if (u, v) != (x, y)]

    def border(x, y):
        return int(x in (0, w - 1) or y in (0, h - 1))

    def calm(p, x, y):
        return border(x, y) + sum((p[v, u] == p[y, x]).all() for u, v in around(x, y)) > 2

    steps = [(light[y, x] - light[v, u], u, v) for u, v in around(x, y)]
    if border(x, y) + sum(s == 0 for s, _, _ in steps) > 2:
        return False
    low, high = min(steps, key=lambda s: s[0]), max(steps, key=lambda s: s[0])
    if low[0] >= 0 or high[0] <= 0:
        return False
    return any(calm(image, u, v) and calm(other, u, v) for _, u, v in (low, high))


def test_smoothed_edges_do_not_count():
    rng = np.random.default_rng(2)
    found = 0
    for n in range(12):
        a = np.zeros((9, 11, 4), np.uint8)
        a[..., 3] = 255
        a[rng.integers(0, 9) :, :, :3] = 255
        b = np.roll(a, 1, 0)
        for image in (a, b):
            image[rng.integers(0, 9), :, :3] = rng.integers(0, 4) * 80
            image[rng.integers(0, 9), rng.integers(0, 11), :3] = rng.integers(0, 4, 3) * 80
        lights = [(255 + (x[..., :3] - 255.0) * (x[..., 3:] / 255)) @ imagediff._YIQ[0] for x in (a, b)]
        every = imagediff.compare(a, b, edges=True)["mismatch_pixels"]
        calm = imagediff._flat_around(a) & imagediff._flat_around(b)
        for x, other, light in ((a, b, lights[0]), (b, a, lights[1])):
            want = np.array([[_plain_smoothed(x, other, light, u, v) for u in range(11)] for v in range(9)])
            assert (imagediff.smoothed(x, light, calm) == want).all()
            found += want.sum()
        assert imagediff.compare(a, b)["mismatch_pixels"] <= every
    assert found > 20


def test_css_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(css.variable_names(F.lit("a{--x:1;b:var(--x) var(--y-2)}"))) == ["--x", "--y-2"]
    assert one(css.unprefixed(F.lit("@-moz-keyframes a"))) == "@keyframes a"
    assert len(one(css.font_faces(F.lit("@font-face{a:b} x{} @FONT-FACE {c:d}")))) == 2
    d = F.from_json(F.lit('[{"name":"a","value":"1","important":true},{"name":"b","value":"2","disabled":true}]'), "array<struct<name:string,value:string,important:boolean,disabled:boolean>>")
    assert one(css.block(F.array(F.lit(".x")), d)) == ".x {\n  a: 1 !important;\n}"


def test_pixels(spark):
    white, black = np.full((2, 2, 4), 255, np.uint8), np.full((2, 2, 4), 255, np.uint8)
    black[0, 0, :3] = 0
    assert imagediff.compare(white, white)["mismatch_pixels"] == 0
    assert imagediff.compare(white, black)["mismatch_ratio"] == 0.25
    wide = imagediff.compare(black[:1, :1], np.repeat(black[:1, :1], 2, 1))
    assert wide["mismatch_ratio"] == 0.5 and not wide["dimensions_match"]
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (7, 5, 4), np.uint8)
    assert (imagediff.decode(imagediff.encode(image)) == image).all()
    with pytest.raises(ValueError):
        imagediff.png_bytes("data:image/jpeg;base64,AA")
    df = spark.createDataFrame([(bytearray(imagediff.encode(white)), bytearray(imagediff.encode(black))), (None, None)], "before binary, after binary")
    assert [r.diff.mismatch_pixels if r.diff else None for r in imagediff.diff(df).collect()][0] == 1


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (2, 12)).astype(np.int32)
    up = np.zeros(12, np.int32)
    for row in want:
        left = np.concatenate((np.zeros(4, np.int32), row[:-4]))
        corner = np.concatenate((np.zeros(4, np.int32), up[:-4]))
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = {1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]
        assert (imagediff._unfiltered(kind, (row - guess) & 255, up, 4) == row).all()
        up = row


def test_attributes_and_styles(spark):
    m = F.create_map(*[F.lit(x) for kv in {"ID": "a", "onclick": "b", "aria-label": " c  d ", "data-x": "e"}.items() for x in kv])
    r = spark.range(1).select(fallback.exported_attributes(m).alias("a"), fallback.attribute_hints(m).alias("h"), fallback.written_pseudo(F.lit(' "" ')).alias("p")).first()
    assert set(r.a) == {"ID", "aria-label"} and [tuple(x) for x in r.h] == [("aria-label", "c d")] and not r.p
    computed = spark.createDataFrame([(1, "p", "color", "x"), (1, "p", "top", "auto"), (1, "p", "left", "1px")], "node_idx int, tag string, name string, value string")
    defaults = spark.createDataFrame([("p", "color", "x"), ("p", "top", "auto"), ("p", "left", "auto")], "tag string, name string, value string")
    assert {r.name for r in fallback.differing_styles(computed, defaults).collect()} == {"color", "left"}
