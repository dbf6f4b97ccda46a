"""Best-fit packing of documents into sequences of at most ``size`` tokens.

Documents are tokenized, ended with an end id, and only longer ones are cut, into pieces of ``size``
tokens.  Packing is planned on the histogram of piece lengths (``size`` counts at most), by best-fit
decreasing over counts: the plan fills whole runs of equal sequences at once, and states for each run
which ranks within a length take which slots.  A piece then takes its slot by its rank among all pieces
of its length, so every piece is placed by a look-up and none travels to a place where others are
gathered.

Ranks are made in two steps, whatever the number of pieces of one length: each task counts up within a
length while it tokenizes, and the sums of the tasks before it are added by a join on (task, length).
The plan has few rows: a run is filled at most log2(size) times before it is full, and a length opens
or splits at most three.

Defined results: null texts are empty (only the end id); rows of one doc_id, null ids too, are separate
documents, numbered apart; an added token inside a text becomes its id, as the library gives it; an
empty table gives no rows; columns other than doc_id and text are not part of the result.  Which of the
pieces of one length take which slots follows the order of the input files; any order packs as well.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _common as C
from ._pieces import PieceTable, batches
from .tokenfile import Encoder

SIZE, END = 4096, 1
#: At this many matches the cache of their ids is emptied.
CACHE_MATCHES = 200_000

#: Below this character every lower case is one character, and every text is in normal form C.
_PLAIN = "İ"

#: Kinds of bytes: white space, letters, digits, marks; an apostrophe (it may begin a match that goes on in
#: letters) and other bytes (0) hold together with what stands beside them.
_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[39] = 0


class WordTable(PieceTable):
    """Pieces for tokenizers that lower-case, drop white space and match letters, digits and marks apart.

    ASCII and Latin-1 letters (U+00C0 to U+00FF) are lower-cased here.  Texts are cut at ASCII white space,
    which belongs to no piece, and wherever letters, digits and marks meet.
    """

    def _read(self, blob: bytes) -> np.ndarray:
        raw = C._LOWER[np.frombuffer(blob + bytes(8), np.uint8)]
        two = np.flatnonzero(raw == 0xC3) + 1
        upper = two[(raw[two] >= 0x80) & (raw[two] <= 0x9E) & (raw[two] != 0x97)]
        raw[upper] += 0x20
        return raw

    def _spans(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KINDS[raw[:-8]]
        two = np.flatnonzero(raw[:-9] == 0xC3)
        two = two[(raw[two + 1] != 0x97) & (raw[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = _LETTER
        a, b = kind[:-1], kind[1:]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = (a != b) & ((a != 0) & (b != 0) | (a == _SPACE) | (b == _SPACE))
        edge[1:-1] |= (a == _DIGIT) & (b == _DIGIT)
        edge[ends] = True
        at = np.flatnonzero(edge)
        word = kind[at[:-1]] != _SPACE
        return at[:-1][word], at[1:][word]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    """The tokenizer of a file, one a worker process, over a table of pieces.

    Words of plain letters go straight to the library's model, everything else through its normalizer
    and pre-tokenizer first.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {}
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.lstrip or token.rstrip or token.single_word or token.normalized:
            raise ValueError("added tokens that hang on what stands beside them are not supported")
        added[token.content.encode()] = i
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    whole = lambda t: [m for m, _ in split(normal(t))]
    # The table's cuts hold for such tokenizers only.
    probe = " It's 12  a.m.,(x1-y)...\n\n  Über\t日本!!é…. "
    cuts = WordTable(lambda pieces: [], 1)
    raw = cuts._read(probe.encode())
    if [m for s, e in zip(*cuts._spans(raw, np.array([len(raw) - 8]))) for m in whole(raw[s:e].tobytes().decode())] != whole(probe):
        raise ValueError("pieces are independent only if letters are lowered, white space is dropped, and digits and marks stand apart")
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # distinct words never hit the model's own cache
    # How the pre-tokenizer writes plain letters.
    table = {c: "".join(whole(chr(c))) for c in range(0xAA, 0x130) if chr(c).isalpha() and chr(c).islower()}
    matches: dict[str, bytes] = {}

    def merged(match: str) -> bytes:
        if (ids := matches.get(match)) is None:
            ids = matches[match] = array("I", [t.id for t in merge(match)]).tobytes()
        return ids

    def one(piece: str) -> bytes:
        if piece.isascii() and (piece.isalpha() or len(piece) == 1):
            return array("I", [t.id for t in merge(piece)]).tobytes()
        if piece.isalpha() and max(piece) < _PLAIN:
            return array("I", [t.id for t in merge(piece.lower().translate(table))]).tobytes()
        return b"".join([merged(m) for m in whole(piece)])

    def encode(pieces: list[str]) -> list[bytes]:
        if len(matches) > CACHE_MATCHES:
            matches.clear()
        return [one(p) for p in pieces]

    return Encoder(WordTable(encode), added)


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("place", T.LongType()),
    ]
)
IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType()))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str, doc_id: str, ids: bool) -> DataFrame:
    """One row a piece, with the task that made it and its place among that task's pieces of its length."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*PIECE.fields, IDS]) if ids else PIECE
    end = np.array([end_id], np.uint32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = _encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for whole in parts:
            step = max(1, whole.num_rows * C.SLICE_BYTES // max(1, whole.nbytes))
            for s in range(0, whole.num_rows, step):
                b, done = whole.slice(s, step), 0
                for part in batches(b["text"]):
                    found = [np.concatenate((x, end)) for x in own.ids(part)]
                    total = np.array([len(x) for x in found], np.int64)
                    many = -(-total // size)
                    of = np.repeat(np.arange(len(found)), many)
                    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                    start = number * size
                    length = np.minimum(total[of] - start, size)
                    cuts = [found[i][a : a + n] for i, a, n in zip(of.tolist(), start.tolist(), length.tolist())]
                    columns = [
                        b["doc_id"].slice(done, len(part)).take(pa.array(of)),
                        pa.array(number.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                        pa.array(np.full(len(of), task, np.int32)),
                        pa.array(_places(length, seen)),
                    ]
                    if ids:
                        columns.append(pa.array([x.view(np.int32) for x in cuts], pa.list_(pa.int32())))
                    done += len(part)
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(C.tidied(run), schema)


def _places(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of earlier pieces of the same length; ``seen`` counts on from call to call."""
    order = np.argsort(length, kind="stable")
    ranked = length[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(ranked)))
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(ranked)) - np.repeat(first, n) + seen[ranked]
    seen[ranked[first]] += n
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first rank, first sequence, offset, pieces a sequence): pieces of that length from that
    rank on fill the sequences from the first on, so many each, from that offset on.
    """
    rows = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, how many)
    frees: list[int] = []
    opened = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                bisect.insort(frees, free)
            room[free].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(frees, length)
            if at < len(frees):  # the tightest sequences that have room; a piece put in leaves them the tightest
                free = frees[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], frees[at]
            else:
                free, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = free // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, size - free, each))
                put(free - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left < each and left:
                rows.append((length, rank, first, size - free, left))
                put(free - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(free, first, n)
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = END, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``ids`` also token_ids of each piece."""
    cut = C.materialise(pieces(docs, tokenizer, end_id, size, text, doc_id, ids), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("before")).drop("task", "before")
    rows = np.array(plan(counts, size), np.int64).reshape(-1, 5)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(rows[order])
    kept = [c for c in ranked.columns if c != "place"]
    schema = T.StructType([ranked.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        begin = np.searchsorted(rows[:, 0], np.arange(size + 2))
        for b in parts:
            length, rank = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "place"))
            at = _last(rows[:, 1], begin[length], begin[length + 1], rank)
            _, since, first, offset, each = rows[at].T
            sequence, slot = np.divmod(rank - since, each)
            yield pa.RecordBatch.from_arrays([b[c] for c in kept] + [pa.array(first + sequence), pa.array(offset + slot * length)], schema.names)

    placed = ranked.mapInArrow(run, schema)
    return placed.select(*[c for c in (*(f.name for f in PIECE), "sequence_id", "offset", IDS.name) if c in placed.columns])


def _last(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of the last start that is at most x, in each own range [lo, hi), whose first start is."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(hi - lo > 1)):
        mid = (lo[open_] + hi[open_]) // 2
        ok = starts[mid] <= x[open_]
        lo[open_[ok]], hi[open_[~ok]] = mid[ok], mid[~ok]
    return lo


def sequences(packed: DataFrame) -> DataFrame:
    """Packed sequences, from ``pack(..., ids=True)``: sequence_id, token_ids, and the pieces in them.

    A group holds at most ``size`` tokens.
    """
    part = F.struct("offset", "doc_id", "piece", "length", "token_ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten("parts.token_ids").alias("token_ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, P.path("word_bpe_49k.json"))
