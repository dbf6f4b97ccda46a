"""Substring de-duplication with prefix-partitioned suffix trees over words.

Every word position with WINDOW words from it on is a suffix.  Suffixes are split into groups by
prefixes of variable length: a suffix's prefix ends with the least (by hash) of the runs of GRAMS[0]
words in its window, and all prefixes that end in one such run belong to one group.  Equal windows
have equal prefixes, so they always meet; neighbouring suffixes mostly have prefixes that end at the
same place, so their text travels to the group once.  Runs of words that would make a group larger
than memory give way to longer ones, at last to whole windows; they are found by counting a fixed
share of all suffixes in hashed slots.  Groups fall into parts by hash.

A part gets the words themselves and builds its subtrees from the root down: suffixes are sorted by
their next words, those that differ from all others leave as leaves, those that agree go on together,
which makes the internal nodes of that depth.  What agrees in WINDOW words is a node deep enough: its
leaves are the places of one repeated window.  The leaf that is first in document order stays, every
later one is a repeat, and adjacent repeats make a maximal repeated span.  Only words are compared in
the end, byte by byte; hashes route and sort.

Documents are dealt once, in batches that are ranges of doc_id, so "earlier" means an earlier batch,
or an earlier place in the own batch.  A batch sends the text of its distinct windows (compressed) and
gets one bit a window back: is it in an earlier batch?  However many documents share a passage, a
part sees it once a batch.

Defined results: null texts have no words; documents of under WINDOW words lose nothing; rows of
equal doc_id are ordered by text, null ids and texts first; kept words are joined by one space;
doc_id must be a whole number or its text; an input column that has the name of an output column is
dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C
from ._pieces import same_spans

WINDOW = 20
#: Words of the runs that prefixes end with; the last is the whole window.
GRAMS = (4, 8, WINDOW)
#: Characters in a batch, suffixes in a part; at least so many of each, for all cores.
BATCH_CHARS, PART_SUFFIXES, LEAST = 5_000_000, 450_000, 64
#: Slots a part in which suffixes are counted; one of COUNTED suffixes is.
SLOTS, COUNTED = 64, 16

DIGEST = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)
KEPT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("kept_text", T.StringType()),
    ]
)


def least_runs(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For each window the least hash among its runs of k words."""
    if not len(at):
        return np.zeros(0, np.uint64)
    h = C.grams(flat, k)
    span, best = WINDOW - k + 1, h
    done = 1
    while done < span:  # minima of ever wider stretches
        step = min(done, span - done)
        best = np.minimum(best[: len(best) - step], best[step:])
        done += step
    return best[at]


class Plan:
    """Number of parts, and for each length of runs the slots with too many suffixes."""

    def __init__(self, parts: int, slots: int, hot: list[np.ndarray]):
        self.parts, self.slots, self.hot = parts, slots, hot

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.slots)).astype(np.int64)

    def route(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The part of every suffix."""
        out, todo = np.empty(len(at), np.int64), np.arange(len(at))
        for n, k in enumerate(GRAMS):
            if not len(todo):
                break
            h = least_runs(flat, at[todo], k)
            out[todo] = (C.scramble(h) % np.uint64(self.parts)).astype(np.int64)
            if n + 1 < len(GRAMS):
                todo = todo[np.isin(self.slot(h), self.hot[n])]
        return out


def plan(docs: DataFrame, text: str, chars: int) -> Plan:
    """Counts one of COUNTED suffixes of all documents; only overfull slots come to the driver."""
    parts = max(LEAST, -(-chars // (6 * PART_SUFFIXES)))
    slots = SLOTS * parts
    empty = Plan(parts, slots, [np.zeros(0, np.int64)] * (len(GRAMS) - 1))

    def run(batches):
        total = [np.zeros(0, np.int64)] * 2
        for b in batches:
            for flat, offsets, *_ in C.chunks(C.as_bytes(b[0])):
                at = C.whole(offsets, WINDOW)[::COUNTED]
                for n, k in enumerate(GRAMS[:-1]):
                    slot, count = np.unique(empty.slot(least_runs(flat, at, k)) + n * slots, return_counts=True)
                    slot, of = np.unique(np.concatenate((total[0], slot)), return_inverse=True)
                    total = [slot, np.bincount(of, np.concatenate((total[1], count))).astype(np.int64)]
        # A slot that is overfull in all holds far more than its share in the tasks too.
        mean = np.bincount(total[0] // slots, total[1], len(GRAMS)) / slots
        much = total[1] > np.maximum(1, 4 * mean[total[0] // slots])
        yield pa.RecordBatch.from_arrays([pa.array(x[much]) for x in total], ["slot", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(C.tidied(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    full = rows.where(F.col("n") * COUNTED * 4 > PART_SUFFIXES).select("slot").collect()  # each holds a quarter of a part
    at = np.array(sorted(r.slot for r in full), np.int64)
    return Plan(parts, slots, [at[at // slots == n] % slots for n in range(len(GRAMS) - 1)])


class Batch:
    """One batch's texts in document order, its distinct windows, and the text each part gets of them."""

    def __init__(self, ids: pa.Array, texts: pa.Array, plan: Plan):
        raw = list(C.as_bytes(texts))
        keys = [(i is not None, i or 0, t) for i, t in zip(ids.to_pylist(), raw)]
        self.order = sorted(range(len(raw)), key=keys.__getitem__)
        self.raw = [raw[i] for i in self.order]
        self.words = w = C.words(self.raw)
        self.offsets, self.at = w.offsets, C.whole(w.offsets, WINDOW)
        h = C.grams(w.hash, WINDOW)[self.at]
        while True:
            _, self.first, self.of = np.unique(h, return_index=True, return_inverse=True)
            other = self._different()
            if not len(other):
                break
            h[other] = C.scramble(h[other] + other.astype(np.uint64) + np.uint64(1))  # equal by hash only
        own = plan.route(w.hash, self.at[self.first])
        # Distinct windows by part, inside a part by place.
        self.by_part = np.lexsort((self.first, own))
        self.parts, starts = np.unique(own[self.by_part], return_index=True)
        self.bounds = np.append(starts, len(own))

    def _different(self) -> np.ndarray:
        """Windows whose words are not those of the first window with their hash."""
        again = np.flatnonzero(self.first[self.of] != np.arange(len(self.of)))
        a, b, w = self.at[again], self.at[self.first[self.of[again]]], self.words
        same = np.ones(len(again), bool)
        size = w.ends - w.starts
        for j in range(WINDOW):
            same &= size[a + j] == size[b + j]
        for j in range(WINDOW):
            at = np.flatnonzero(same)
            same[at] = same_spans(w.raw, w.starts[a[at] + j], w.raw, w.starts[b[at] + j], size[a[at] + j])
        return again[~same]

    def texts(self):
        """For each part the text of its windows: neighbouring windows share a line."""
        w = self.words
        inside = np.zeros(len(w.raw), np.int8)
        inside[w.starts], inside[w.ends] = 1, -1
        keep = np.cumsum(inside, dtype=np.int8) > 0
        keep[w.ends] = True
        plain = w.raw.copy()
        plain[w.ends] = 32
        line = plain[keep].tobytes()  # all words, a space after each
        begin = np.cumsum(np.append(0, w.ends - w.starts + 1))
        place = self.at[self.first[self.by_part]]
        pack = zstandard.ZstdCompressor(level=3).compress
        for s, e in zip(self.bounds.tolist(), self.bounds[1:].tolist()):
            p = place[s:e]
            cut = np.flatnonzero(np.diff(p) != 1) + 1  # no two texts have neighbouring windows
            a = begin[p[np.append(0, cut)]].tolist()
            b = begin[p[np.append(cut, len(p)) - 1] + WINDOW].tolist()
            yield pack(b"\n".join([line[x : y - 1] for x, y in zip(a, b)]))

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """Mask of the words that lie in a repeated window."""
        seen = np.zeros(len(self.first), bool)
        for p, s, e in zip(self.parts.tolist(), self.bounds, self.bounds[1:]):
            got = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(e - s), bitorder="little")
            seen[self.by_part[s:e]] = got.view(bool)
        again = seen[self.of]
        again |= self.first[self.of] != np.arange(len(self.of))
        mark = np.zeros(int(self.offsets[-1]) + 1, np.int32)
        hit = self.at[again]
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + WINDOW, -1)
        return np.cumsum(mark[:-1]) > 0


def word_numbers(w: C.Words) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    _, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
    size, head = w.ends - w.starts, first[of]
    same = size == size[head]
    at = np.flatnonzero(same & (size > 8))  # up to eight bytes, equal hash and size mean equal bytes
    same[at] = same_spans(w.raw, w.starts[at], w.raw, w.starts[head[at]], size[at])
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        of[i] = own.setdefault(w.raw[w.starts[i] : w.ends[i]].tobytes(), len(first) + len(own))
    return of


def deep_nodes(numbers: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix ``at`` its node of ``depth`` in the tree of them all; -1 for leaves above it.

    The tree is built level by level: as many words a level as fit one sort key.
    """
    bits = max(1, int(numbers.max(initial=0)).bit_length())
    width = min(depth, 63 // bits)
    key = np.zeros(max(0, len(numbers) - width + 1), np.int64)
    for j in range(width):
        key = (key << bits) | numbers[j : len(numbers) - width + 1 + j]
    node, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for d in [*range(0, depth - width, width), depth - width]:
        if not len(live):
            break
        k = key[at[live] + d]
        order = np.argsort(k) if d == 0 else np.lexsort((k, node[live]))
        k, own, sorted_ = k[order], node[live[order]], live[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (own[1:] != own[:-1])
        name = np.cumsum(new) - 1
        inner = np.bincount(name, minlength=1)[name] > 1  # a child with one suffix is a leaf
        node[sorted_] = np.where(inner, name, -1)
        live = np.sort(sorted_[inner])
    return node


def later_leaves(node: np.ndarray) -> np.ndarray:
    """Mask of the suffixes at deep nodes that are not their node's first."""
    out = np.zeros(len(node), bool)
    at = np.flatnonzero(node >= 0)
    out[at] = True
    out[at[np.unique(node[at], return_index=True)[1]]] = False
    return out


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_spans and kept_text (or only a digest of the kept words).

    ``keep`` names the input columns to hand through, all by default; one that has the name of an
    output column is dropped.
    """
    out = DIGEST if digest else KEPT
    names = {f.name for f in out}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    n = len(keep)
    chars = docs.agg(F.sum(F.length(f"`{text}`"))).first()[0] or 0
    batches = max(LEAST, -(-chars // BATCH_CHARS))
    cuts = docs.agg(
        F.percentile_approx(F.col(f"`{doc_id}`").cast("long"), [i / batches for i in range(1, batches)], F.lit(min(2_000_000, 50 * batches)))
    ).first()[0]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((np.array(sorted(set(cuts or [])), np.int64), plan(docs, text, chars)))

    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{doc_id}`").cast("long").alias("i"),
        F.col(f"`{text}`").alias("t"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])

    def deal(parts_in):
        cuts = shared.value[0]
        for b in parts_in:
            ids = b["i"].fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            where = pa.array(np.searchsorted(cuts, ids, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, where], schema.names)

    dealt = rows.mapInArrow(deal, schema)

    def send(table: pa.Table) -> pa.Table:
        batch = Batch(table["i"].combine_chunks(), table["t"].combine_chunks(), shared.value[1])
        blobs = list(batch.texts())
        C.tidy()
        return pa.table(
            [pa.array(batch.parts, pa.int32()), pa.array([table["batch"][0].as_py()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())],
            ["part", "batch", "lines"],
        )

    def answer(table: pa.Table) -> pa.Table:
        """One part: build its subtrees and flag all leaves of deep nodes but each node's first."""
        order = np.argsort(table["batch"].to_numpy(), kind="stable")
        unpack = zstandard.ZstdDecompressor().decompress
        lines, sizes = [], []
        for i in order.tolist():
            own = unpack(table["lines"][i].as_py()).split(b"\n")
            lines += own
            sizes.append(len(own))
        got = [(table["batch"][i].as_py(), None) for i in order.tolist()]
        w = C.words(lines)
        lines.clear()
        at = C.whole(w.offsets, WINDOW)
        later = later_leaves(deep_nodes(word_numbers(w), at))
        ends = np.searchsorted(at, w.offsets[np.cumsum([0, *sizes])])
        bits = [np.packbits(later[s:e], bitorder="little").tobytes() for s, e in zip(ends, ends[1:])]
        del w, at
        C.tidy()
        return pa.table(
            [pa.array([b for b, _ in got], pa.int32()), pa.array([table["part"][0].as_py()] * len(got), pa.int32()), pa.array(bits, pa.binary())],
            ["batch", "part", "bits"],
        )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow_out], names=arrow_out.names)
        batch = Batch(table["i"].combine_chunks(), table["t"].combine_chunks(), shared.value[1])
        mask = batch.repeated(dict(zip(answers["part"].to_pylist(), answers["bits"].to_pylist())))
        n_words, n_removed, spans, kept = [], [], [], []
        for t, s, e in zip(batch.raw, batch.offsets.tolist(), batch.offsets[1:].tolist()):
            w, own = t.split(), mask[s:e]
            gone = int(own.sum())
            n_words.append(e - s)
            n_removed.append(gone)
            left = b" ".join([x for x, g in zip(w, own.tolist()) if not g] if gone else w)
            if digest:
                kept.append(hashlib.sha256(left).hexdigest())
            else:
                kept.append(left.decode("utf-8", "replace"))
                spans.append(np.stack(C.runs(own), 1).tolist() if gone else [])
        order = pa.array(batch.order)
        del batch, mask
        C.tidy()
        cols = [table.column(j).combine_chunks().take(order) for j in range(n)]
        cols += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        cols += [] if digest else [pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        return pa.table([*cols, pa.array(kept, pa.string())], names=arrow_out.names)

    result = T.StructType([docs.schema[c] for c in keep] + list(out.fields))
    arrow_out = to_arrow_schema(result)
    sent = dealt.groupBy("batch").applyInArrow(send, "part int, batch int, lines binary")
    bits = sent.groupBy("part").applyInArrow(answer, "batch int, part int, bits binary")
    return dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(finish, result)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedupe(docs, keep=["doc_id"], digest=True)


def brute(docs: list[tuple], window: int = WINDOW) -> dict:
    """The definition, window by window, for tests on small tables."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


#: The same rows in DuckDB SQL: windows as text, the first of each text in document order stays.
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER o AS n, string_agg(x, ' ') OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g WHERE n = {WINDOW}) WHERE k > 1),
h AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range({WINDOW}) AS t(j)),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM x ANTI JOIN h USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
