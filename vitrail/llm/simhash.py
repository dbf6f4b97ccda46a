"""SimHash near-duplicates: pivot distance tables prune, exact distances decide.

Fingerprint: 64 bits, of XXH64 (seed 42) over 3-word shingles with repeats; a bit is set if more than
half of the shingles set it.  Documents of one fingerprint count as one node from here on, so copies
are never paired.

Linking at up to RADIUS = 2 differing bits, without all pairs:

1. Routing.  Of four 16-bit bands two at least are equal in any two fingerprints that differ in two
   bits, so each fingerprint is sent to the six keys made of two bands; every link's ends meet at
   one of them.  (Pivot distances alone cannot route: one such distance of random fingerprints
   agrees within 2 in a third of all pairs, so tables keyed by them would be sent everywhere.)
2. Pruning.  Inside a key a table holds each fingerprint's Hamming distances to PIVOTS fixed
   reference fingerprints.  By the triangle inequality a pair whose distances to any pivot differ by
   over RADIUS cannot link; the largest difference over all pivots discards almost all pairs.
3. Verifying.  Survivors are compared by XOR and bit count.

A key with over LARGE members is split again inside its task by narrower bands of the other bits,
which loses no link either.  Each key reports a spanning forest of its links, not the links.
Components grow from these by alternating large and small stars, one written table a round.

Defined results: null or wordless texts have fingerprint zero, linked like any other; texts of under
three words are one shingle; equal doc_ids are separate rows; a null doc_id never is a component's
smallest unless all its members' are null; input columns named fingerprint or component_id are replaced.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from . import nearsets

SHINGLE, SEED, RADIUS, BANDS = 3, 42, 2, 4
PIVOTS, LARGE, BLOCK = 16, 4_000, 1_000

OUT = T.StructType([T.StructField("fingerprint", T.LongType())])

_PIVOT = np.random.default_rng(2024).integers(0, 2**64, PIVOTS, np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Shingles of the lower-cased words; ``bytes.lower`` lowers A-Z only."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[s:e] for s, e in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    own = shingles(text, size)
    if not own:
        return 0
    counts = np.zeros(64, np.int64)
    for s in range(0, len(own), 50_000):
        part = own[s : s + 50_000]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for t in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            counts += bits[t : t + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0])


def annotate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint, its 64 bits as a signed long."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.fromiter((fingerprint(t, shingle) for t in C.as_bytes(texts)), np.uint64, len(texts)).view(np.int64))]

        return work

    return C.map_rows(docs, OUT, make, [text], keep)


def _key_masks() -> list[int]:
    width = 64 // BANDS
    band = [((1 << width) - 1) << (width * i) for i in range(BANDS)]
    return [sum(m) for m in combinations(band, BANDS - RADIUS)]


class Forest:
    """Union-find over positions; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances to each pivot, one row a pivot."""
    return np.bitwise_count(fps[None, :] ^ _PIVOT[:, None]).astype(np.int8)


def _verified(fps, table, a, b):
    """The pairs (a, b) that link: pruned pivot by pivot, then compared."""
    for row in table:
        near = np.abs(row[a] - row[b]) <= RADIUS
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
    return a[near], b[near]


def link_group(fps: np.ndarray, at: np.ndarray, free: int, forest: Forest) -> None:
    """Join the links among distinct fingerprints ``fps[at]``, which agree in all bits but ``free``."""
    if len(at) > LARGE:
        bits = [i for i in range(64) if free >> i & 1]
        parts = np.array_split(np.array(bits), RADIUS + 1)
        if len(bits) > RADIUS + 1:
            # Two differing bits leave one part of the free bits equal.
            for p in parts:
                mask = np.uint64(sum(1 << int(i) for i in p))
                key = fps[at] & mask
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for g in np.split(order, cuts):
                    if len(g) > 1:
                        link_group(fps, at[np.sort(g)], free & ~int(mask), forest)
            return
    own = fps[at]
    table = pivot_table(own)
    order = np.argsort(table[0], kind="stable")
    own, table, at = own[order], table[:, order], at[order]
    first = table[0].astype(np.int64)
    n = len(own)
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK)
        # Sorted by the first pivot, partners of a block end where the difference passes RADIUS.
        hi = int(np.searchsorted(first, first[e - 1] + RADIUS, "right"))
        for t in range(s, hi, BLOCK):
            u = min(hi, t + BLOCK)
            near = np.abs(table[0][s:e, None] - table[0][None, t:u]) <= RADIUS
            for row in table[1:4]:
                near &= np.abs(row[s:e, None] - row[None, t:u]) <= RADIUS
            a, b = np.nonzero(near)
            ok = a + s < b + t
            a, b = _verified(own, table[4:], a[ok] + s, b[ok] + t)
            forest.join(at[a], at[b])


def links(nodes: DataFrame) -> DataFrame:
    """Spanning links (a < b as unsigned values' order of appearance) of distinct fingerprints ``fp``."""
    masks = _key_masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x).cast("long")).alias("v")) for i, x in enumerate(signed)])).alias("k")
    ).select("fp", F.col("k.m").alias("m"), F.col("k.v").alias("v"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "m", "v").sortWithinPartitions("m", "v", "fp")

    def run(batches):
        held: list[list[np.ndarray]] = []  # stretches of rows whose last key may go on

        def done():
            return _grouped(*(np.concatenate(c) for c in zip(*held)), masks)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("fp", "m", "v")]
            if held and (held[-1][1][-1], held[-1][2][-1]) != (cols[1][0], cols[2][0]):
                yield from done()
                held = []
            change = np.flatnonzero((np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            if len(change):
                held.append([c[: change[-1]] for c in cols])
                yield from done()
                held = [[c[change[-1] :] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield from done()

    return dealt.mapInArrow(run, "a long, b long")


def _grouped(fp, m, v, masks):
    if len(fp) < 2:
        return
    forest = Forest(len(fp))
    new = np.concatenate(([True], (np.diff(m) != 0) | (np.diff(v) != 0)))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    group = np.repeat(np.arange(len(start)), size)
    small = size <= 32
    table = None
    for d in range(1, int(size[small].max()) if small.any() else 0):
        a = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
        if len(a):
            table = pivot_table(fp) if table is None else table
            a, b = _verified(fp, table, a, a + d)
            forest.join(a, b)
    for g in np.flatnonzero(~small):
        s, n = int(start[g]), int(size[g])
        link_group(fp, np.arange(s, s + n), ((1 << 64) - 1) & ~masks[int(m[s])], forest)
    roots = np.array([forest.root(i) for i in range(len(fp))])
    child = np.flatnonzero(roots != np.arange(len(fp)))
    signed = fp.view(np.int64)
    if len(child):
        yield pa.RecordBatch.from_arrays([pa.array(signed[roots[child]]), pa.array(signed[child])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternating stars (Kiveris et al., 2014): large stars tie a node's greater neighbours to its
    least one, small stars its lesser ones; both only aggregate minima and join, and the number of
    edges never grows.  Ends when a round changes nothing.
    """
    e = C.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, C.materialise(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        C.discard(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def classes(fps: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``fps`` (doc_id, fingerprint) with component_id, the least doc_id that links reach."""
    fps = C.materialise(fps.drop(*[c for c in fps.columns if c.lower() == "component_id"]), "fingerprints")
    nodes = C.materialise(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(f"`{doc_id}`").alias("least")), "nodes")
    found = components(links(nodes.select("fp")))
    roots = nodes.join(found, nodes.fp == found.node).select("fp", "root", "least")
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select("fp", "component")
    per_fp = C.materialise(
        nodes.join(linked, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component", "least").alias("component_id")), "classes"
    )
    return fps.join(per_fp, "fingerprint")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, stays) of groups of near copies: word shingles of five, similarity 0.8 (``nearsets``)."""
    return nearsets.classes(docs, components, text, doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(annotate(docs, keep=["doc_id"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def brute(docs: list[tuple]) -> dict:
    """All pairs of distinct fingerprints, for tests on small tables."""
    fps = {}
    for d, t in docs:
        h = [xxhash.xxh64_intdigest(s, SEED) for s in shingles((t or "").encode())]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    own = np.array([fps[i] for i in ids], np.uint64)
    forest = Forest(len(ids))
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(own ^ own[i]) <= RADIUS)
        forest.join(np.full(len(near), i), near)
    return {d: (f"{fps[d]:016x}", ids[forest.root(i)]) for i, d in enumerate(ids)}
