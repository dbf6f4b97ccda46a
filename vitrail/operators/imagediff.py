"""Pixel difference of screenshots: PNG decoding and comparison in numpy, in Arrow batches.

Both images are padded to their larger size with transparent black.  Two pixels differ if their YIQ
colour distance, blended on white by their alpha, passes ``threshold`` (0.1) of the largest possible.
Differing pixels that smooth an edge are left out (the published slope detector: a pixel between a
darker and a brighter neighbour, one of which lies in a flat area of both images).
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: FIXED VALUES: samples a pixel of each colour type; YIQ weights of red, green and blue.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_YIQ = np.array([[0.29889531, 0.58662247, 0.11448223], [0.59597799, -0.27417610, -0.32180189], [0.21147017, -0.52261711, 0.31114694]])
_LARGEST = 35215.0

RESULT = T.StructType(
    [
        T.StructField("mismatch_pixels", T.LongType()),
        T.StructField("mismatch_ratio", T.DoubleType()),
        T.StructField("dimensions_match", T.BooleanType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)


def png_bytes(value: bytes | str) -> bytes:
    """Bytes of an image, or of a base64 PNG data URL."""
    if isinstance(value, str):
        head = "data:image/png;base64,"
        if not value.startswith(head):
            raise ValueError("not a PNG data URL")
        return base64.b64decode(value[len(head) :])
    return bytes(value)


def decode(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG without interlacing, as height x width x RGBA."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, palette, alpha, head = 8, b"", None, None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in _SAMPLES:
        raise ValueError("8-bit PNGs without interlacing only")
    step = _SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    before = np.zeros(width * step, np.int32)
    for y in range(height):
        out[y] = before = _unfiltered(int(rows[y, 0]), rows[y, 1:].astype(np.int32), before.astype(np.int32), step)
    px = out.reshape(height, width, step)
    rgba = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        rgba[..., :3] = palette[px[..., 0]]
        if alpha is not None:
            rgba[..., 3] = np.append(alpha, np.full(256 - len(alpha), 255, np.uint8))[px[..., 0]]
    else:
        rgba[..., :3] = px[..., : 3 if step >= 3 else 1]
        if step in (2, 4):
            rgba[..., 3] = px[..., -1]
    return rgba


def _unfiltered(kind: int, row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return (row + up) & 255
    if kind == 1:
        return row.reshape(-1, step).cumsum(0).ravel() & 255
    out = np.zeros_like(row)
    for i in range(len(row)):
        a = int(out[i - step]) if i >= step else 0
        b, c = int(up[i]), int(up[i - step]) if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (row[i] + guess) & 255
    return out


def encode(rgba: np.ndarray) -> bytes:
    """A PNG of RGBA pixels (for reports and tests)."""
    h, w = rgba.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)), 1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Neighbours of a pixel, (down, right), column by column.
_AROUND = tuple((dy, dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)


def _shifted(x: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's neighbour that way, and where there is one."""
    h, w = x.shape[:2]
    out, ok = np.zeros_like(x), np.zeros((h, w), bool)
    to = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
    of = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
    out[to], ok[to] = x[of], True
    return out, ok


def _edges(h: int, w: int) -> np.ndarray:
    """1 for pixels at an image's border: what lies beyond counts as one equal neighbour."""
    out = np.ones((h, w), np.int64)
    out[1:-1, 1:-1] = 0
    return out


def _flat_around(rgba: np.ndarray) -> np.ndarray:
    """Pixels with over two equal neighbours."""
    n = _edges(*rgba.shape[:2])
    for way in _AROUND:
        near, ok = _shifted(rgba, *way)
        n += ok & (near == rgba).all(-1)
    return n > 2


def smoothed(rgba: np.ndarray, light: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Pixels of an image that smooth an edge; ``flat`` are the flat areas of both images."""
    h, w = light.shape
    same, low, high = _edges(h, w), np.zeros((h, w)), np.zeros((h, w))
    low_flat, high_flat = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for way in _AROUND:
        (near, ok), (calm, _) = _shifted(light, *way), _shifted(flat, *way)
        step = np.where(ok, light - near, 0)
        same += ok & (step == 0)
        down, up = ok & (step < low), ok & (step > high)
        low[down], low_flat[down] = step[down], calm[down]
        high[up], high_flat[up] = step[up], calm[up]
    return (same <= 2) & (low < 0) & (high > 0) & (low_flat | high_flat)


def compare(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, edges: bool = False) -> dict:
    """How many pixels differ; with ``edges`` those that smooth an edge count too."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])

    def padded(x: np.ndarray) -> np.ndarray:
        full = np.zeros((h, w, 4), np.uint8)
        full[: x.shape[0], : x.shape[1]] = x
        return full

    def shown(x: np.ndarray) -> np.ndarray:
        return 255 + (x[..., :3] - 255.0) * (x[..., 3:] / 255)

    full = padded(a), padded(b)
    y, i, q = np.moveaxis((shown(full[0]) - shown(full[1])) @ _YIQ.T, -1, 0)
    differ = 0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q > _LARGEST * threshold * threshold
    if differ.any() and not edges:
        calm = _flat_around(full[0]) & _flat_around(full[1])
        for x in full:
            differ &= ~smoothed(x, shown(x) @ _YIQ[0], calm)
    bad = int(differ.sum())
    ratio = min(1.0, bad / (w * h)) if w * h else 0.0
    return {"mismatch_pixels": bad, "mismatch_ratio": ratio, "dimensions_match": a.shape == b.shape, "width": w, "height": h}


@F.pandas_udf(RESULT)
def pixel_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Comparison of two columns of PNG bytes; null where either is missing."""
    none = {f.name: None for f in RESULT}
    rows = [none if a is None or b is None else compare(decode(png_bytes(a)), decode(png_bytes(b))) for a, b in zip(before, after)]
    return pd.DataFrame(rows, columns=[f.name for f in RESULT])


def diff(shots: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``shots`` with the comparison of each row's two images."""
    return shots.withColumn("diff", pixel_diff(F.col(before), F.col(after)))
