"""Byte-level BPE over padded numpy matrices.

The matches of the split pattern are byte strings; distinct ones are put into matrices by length
(widths 4, 8, 16, ... of symbols, padded).  In each round every row finds its leftmost pair of least
rank, merges it, closes the gap, and looks up the two pairs that changed in a hash table of all
mergeable pairs; rows without a mergeable pair leave the matrix.  Rows of over LONG bytes would cost
the square of their length, so a heap merges those, in the same order of pairs.

Defined results: null is an empty text, an empty text has no ids, special tokens are ordinary text;
repeated rows are encoded each; an input column that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as C
from ._pieces import PieceTable, batches

LONG = 1024
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id (= rank) of their union."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << self.bits, NONE)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]] = key[put]
            self.vals[slot[put]] = merged[put]
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def _key(a, b):
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge or an id is padding (negative)."""
        out = np.full(len(a), NONE)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = self._key(a[todo], b[todo])
        slot = self._slot(key)
        while len(todo):
            k = self.keys[slot]
            hit = k == key
            out[todo[hit]] = self.vals[slot[hit]]
            go = ~hit & (k != np.uint64(2**64 - 1))
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int32)
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], i)
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        self.pairs = PairTable(*np.array(pairs or [(0, 0, 0)], np.int32)[: len(pairs)].T)
        self.table = PieceTable(self._pieces)
        del pairs
        C.tidy()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [self.split(p) for p in pieces]
        ids = self.encode_matches([m.encode("utf-8", "replace") for m in {m for c in cut for m in c}])
        return [b"".join([ids[m.encode("utf-8", "replace")] for m in c]) for c in cut]

    def encode_matches(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian 32-bit) of each distinct match."""
        out, by_width = {}, {}
        for w in words:
            if (i := self.ranks.get(w)) is not None:
                out[w] = i.to_bytes(4, "little")
            elif len(w) > LONG:
                out[w] = np.array(self._long(w), "<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(w)
        for width, rows in by_width.items():
            step = max(1, 500_000 // width)
            for s in range(0, len(rows), step):
                out.update(self._matrix(rows[s : s + step], width))
        return out

    def _matrix(self, rows: list[bytes], width: int) -> dict[bytes, bytes]:
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(-1, width)
        length = np.array([len(r) for r in rows])
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], np.int32(-1))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        at, out = np.arange(len(rows)), {}
        while True:
            j = rank.argmin(1)
            best = rank[np.arange(len(rank)), j]
            done = best == NONE
            if done.any():
                last = ids[done].astype("<u4")
                for r, x, n in zip(at[done].tolist(), last, length[done].tolist()):
                    out[rows[r]] = x[:n].tobytes()
                go = ~done
                at, ids, rank, length, j, best = at[go], ids[go], rank[go], length[go], j[go], best[go]
            if not len(at):
                return out
            n = int(length.max())  # columns beyond it are padding in every row left
            ids, rank = ids[:, :n], rank[:, : n - 1]
            r, col = np.arange(len(at)), np.arange(n)
            ids[r, j] = best
            closed = np.full_like(ids, -1)
            closed[:, :-1] = np.where(col[:-1] > j[:, None], ids[:, 1:], ids[:, :-1])
            ids, length = closed, length - 1
            moved = np.full_like(rank, NONE)
            moved[:, :-1] = np.where(col[: n - 2] > j[:, None], rank[:, 1:], rank[:, :-1])
            rank = moved
            has = j < n - 1
            rank[r[has], j[has]] = self.pairs.get(ids[r, j], ids[r, np.minimum(j + 1, n - 1)])[has]
            end = length - 1 <= j  # the merged symbol is now the last of its row
            rank[r[end], np.minimum(j[end], n - 2)] = NONE
            has = j > 0
            rank[r[has], j[has] - 1] = self.pairs.get(ids[r[has], j[has] - 1], ids[r[has], j[has]])

    def _long(self, word: bytes) -> list[int]:
        """The same merges for one long row: a heap of (rank, place) over a linked list."""
        ranks = self.ranks
        n = len(word)
        end, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (k := ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (k, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if dead[i] or end[i] >= n or end[end[i]] != e:
                continue
            dead[end[i]] = True
            end[i] = e
            if e < n:
                before[e] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        return self.table.ids([t.encode() if isinstance(t, str) else t for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(read_ranks(path), pattern)


IDS = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
DIGEST = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)
ROUND_TRIP = T.StructType([*DIGEST.fields[:1], T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with token_ids."""

    def make():
        own = codec(path, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            parts = [x.astype(np.int32) for b in batches(texts) for x in own.encode(b)]
            ends = np.cumsum([0, *map(len, parts)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))]

        return work

    return C.map_rows(docs, IDS, make, [text], keep)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the bytes that token_ids stand for (null ids: no bytes)."""

    def make():
        own = codec(path, pattern)
        return lambda x: [pa.array([own.decode(np.array(i.as_py() or [], np.int64)) for i in x], pa.binary())]

    return C.map_rows(docs, T.StructType([T.StructField("decoded", T.BinaryType())]), make, [ids], keep)


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens and either digests of ids and decoded bytes, or the decoded text.

    Encodes and decodes in one task, so ids need not leave the worker.
    """

    def make():
        own = codec(path, pattern)
        names = {i: b"%d" % i for i in own.bytes_of}

        def work(texts: pa.Array) -> list[pa.Array]:
            n, a, b = [], [], []
            for part in batches(texts):
                for ids in own.encode(part):
                    n.append(len(ids))
                    back = own.decode(ids)
                    if decoded_text:
                        b.append(back.decode("utf-8", "replace"))
                        continue
                    b.append(hashlib.sha256(back).hexdigest())
                    a.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids.tolist()))).hexdigest())
            cols = [pa.array(b, pa.string())] if decoded_text else [pa.array(a, pa.string()), pa.array(b, pa.string())]
            return [pa.array(n, pa.int64()), *cols]

        return work

    return C.map_rows(docs, ROUND_TRIP if decoded_text else DIGEST, make, [text], keep)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, *vocabulary(), keep=["doc_id"])
