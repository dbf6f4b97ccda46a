"""Benchmark decontamination by winnowing.

Of every WIDTH consecutive K-grams the smallest hash is kept, in documents and in benchmark items
alike.  Two texts that share ``K + WIDTH - 1`` = 10 consecutive words have a window of WIDTH equal
K-grams in common and keep the same minimum of it, so each shared span of ten words or more has a
kept fingerprint in common.  Fingerprints of documents are looked up among those of the items, and
each hit is extended word by word on both sides; spans of under ten words are dropped.  An item of
fewer than ten words is one window of its own length, of which every position is kept (WIDTH 1).

The items' fingerprints go to the workers in blocks of ``block_chars`` characters of item text; a
worker loads one block at a time and holds each batch of documents against it, so a benchmark of any
size takes one pass over the documents, which are never shuffled.

Defined results: null or wordless documents have no words and no hits; wordless items never occur;
an item without an id counts as hit words but is not listed; rows with equal ids are separate rows;
equal item ids are listed once; an empty benchmark leaves every document clean; input columns named
n_words, hit_spans or hit_items are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

SPAN, K = 10, 4
WIDTH = SPAN - K + 1
BLOCK_CHARS = 4_000_000

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(C.ALNUM_TABLE).split()


def winnow(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions, and the K-gram hash of each."""
    at = C.whole(offsets, SPAN)
    h = C.grams(flat, K)
    if not len(at):
        return at, h[:0]
    best, arg = h[at], np.zeros(len(at), np.int64)
    for j in range(1, WIDTH):
        x = h[at + j]
        less = x < best
        best = np.where(less, x, best)
        arg[less] = j
    kept = np.zeros(len(h), bool)
    kept[at + arg] = True
    pos = np.flatnonzero(kept)
    return pos, h[pos]


class Index:
    """Fingerprints of benchmark items, sorted by hash, with the place of each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.flat, self.offsets, *_ = C.words([(t or "").encode() for _, t in items], C.ALNUM, lower=True)
        words = [self.flat[s:e] for s, e in zip(self.offsets, self.offsets[1:])]
        long = np.diff(self.offsets) >= SPAN
        pos, h = winnow(self.flat, self.offsets)
        order = np.argsort(h, kind="stable")
        self.hash, self.pos = h[order], pos[order]
        self.item = np.searchsorted(self.offsets, self.pos, "right") - 1
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in words if 0 < len(w) < SPAN}):
            own = np.array([i for i, w in enumerate(words) if len(w) == n and not long[i]])
            g = np.array([C.grams(words[i], n)[0] for i in own], np.uint64)
            o = np.argsort(g, kind="stable")
            self.short[n] = g[o], own[o]

    def hits(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of hit words, and (document, item) pairs, of a run of documents."""
        mark = np.zeros(len(flat) + 1, np.int32)
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        doc_of = lambda p: np.searchsorted(offsets, p, "right") - 1
        for p, i, q in self._pairs(*winnow(flat, offsets)):
            d = doc_of(p)
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for side, room_d, room_i, first in (
                (left, p - offsets[d], q - self.offsets[i], -1),
                (right, offsets[d + 1] - p - K, self.offsets[i + 1] - q - K, K),
            ):
                alive = np.ones(len(p), bool)
                for j in range(SPAN - K):
                    alive &= (room_d > j) & (room_i > j)
                    step = first - j if first < 0 else first + j
                    a = np.flatnonzero(alive)
                    alive[a] = flat[p[a] + step] == self.flat[q[a] + step]
                    side[alive] += 1
            same = np.ones(len(p), bool)
            for j in range(K):
                same &= flat[p + j] == self.flat[q + j]
            ok = same & (left + K + right >= SPAN)
            np.add.at(mark, (p - left)[ok], 1)
            np.add.at(mark, (p + K + right)[ok], -1)
            docs.append(d[ok])
            items.append(i[ok])
        for n, (g, own) in self.short.items():
            at = C.whole(offsets, n)
            h = C.grams(flat, n)[at]
            for p, at_g in _matches(at, h, g):
                np.add.at(mark, p, 1)
                np.add.at(mark, p + n, -1)
                docs.append(doc_of(p))
                items.append(own[at_g])
        both = np.unique(np.stack((np.concatenate(docs), np.concatenate(items)), 1), axis=0)
        return np.cumsum(mark[:-1]) > 0, both

    def _pairs(self, pos, h):
        for p, j in _matches(pos, h, self.hash):
            yield p, self.item[j], self.pos[j]


def _matches(pos: np.ndarray, h: np.ndarray, table: np.ndarray, block: int = 500_000):
    """Pairs (position, index into the sorted table) of equal hashes, in blocks of bounded size."""
    if not len(table) or not len(h):
        return
    lo = np.searchsorted(table, h)
    found = lo < len(table)
    found[found] = table[lo[found]] == h[found]
    pos, lo = pos[found], lo[found]
    n = np.searchsorted(table, h[found], "right") - lo
    ends = np.cumsum(n)
    s = 0
    while s < len(pos):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + block)))
        m = n[s:e]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(pos[s:e], m), np.repeat(lo[s:e], m) + inner
        s = e


def annotate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word ranges ``[start, end)``) and hit_items (sorted).

    ``keep`` names the input columns to hand through, all by default.
    """
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
    chars = items.agg(F.sum(F.length("t") + F.lit(16))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    key = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    share = docs.sparkSession.sparkContext.broadcast
    # One block at a time is collected and indexed here.
    indexes = [share(Index([tuple(r) for r in items.where(key == b).collect()])) for b in range(blocks)]
    return C.map_rows(docs, OUT, _worker(indexes), [text], keep)


def _worker(indexes):
    def loaded():
        for index in indexes:
            yield index.value
            if len(indexes) > 1:
                index.__dict__.pop("_value", None)  # a worker holds one block

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            runs = [(w.hash, w.offsets) for w in C.chunks(C.as_bytes(texts), C.ALNUM, lower=True)]
            n_words = [n for _, offsets in runs for n in np.diff(offsets).tolist()]
            spans, names = [[] for _ in n_words], [set() for _ in n_words]
            for ix in loaded():
                base = 0
                for flat, offsets in runs:
                    hit, both = ix.hits(flat, offsets)
                    for d, i in both.tolist():
                        if ix.ids[i] is not None:
                            names[base + d].add(ix.ids[i])
                    for d in np.unique(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1).tolist():
                        own = np.stack(C.runs(hit[offsets[d] : offsets[d + 1]]), 1).tolist()
                        spans[base + d] = _union(spans[base + d] + own)
                    base += len(offsets) - 1
            names = [sorted(x) for x in names]
            return [
                pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(names, pa.list_(pa.string())),
            ]

        return work

    return make


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = annotate(docs, items, keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def brute(docs: list[tuple], items: list[tuple]) -> dict:
    """The definition, word by word: for tests on small tables."""
    out = {}
    grams = []
    for i, t in items:
        w = words_of((t or "").encode())
        n = min(SPAN, len(w))
        grams.append((i, n, {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()))
    for d, t in docs:
        w = words_of((t or "").encode())
        hit, found = set(), set()
        for i, n, own in grams:
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in own:
                    hit.update(range(s, s + n))
                    found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


#: The same rows in DuckDB SQL: windows as text, joined.
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bx AS (SELECT item_id, least(len(w), {SPAN}) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b),
bg AS (SELECT item_id, n, string_agg(x, ' ') OVER o AS g, count(*) OVER o AS c FROM bx WINDOW o AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
items AS (SELECT DISTINCT item_id, n, g FROM bg WHERE c = n),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dx AS (SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d, (SELECT DISTINCT n FROM items)),
dg AS (SELECT doc_id, n, i, string_agg(x, ' ') OVER o AS g FROM dx WINDOW o AS (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN items USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, range({SPAN}) AS t(j) WHERE j < n GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""
