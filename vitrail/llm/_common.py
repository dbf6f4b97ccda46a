"""What the training-data operators share: shared-folder tables, Arrow maps, word arrays.

Words are handled as bytes.  ``bytes.split()`` cuts at exactly U+0020 and U+0009-U+000D, which is
the word pattern ``[^\\x20\\x09-\\x0D]+``; ``str.split()`` would also cut at other Unicode spaces.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A worker's word cache is emptied at this many entries, so memory stays bounded on any corpus.
CACHE_WORDS = 200_000
#: Texts are joined into runs of about this many bytes before numpy works on them.
CHUNK_BYTES = 2_000_000

#: Bytes of a batch that Python works on at once, and of those that Spark sends it for tables written here.
SLICE_BYTES = 8_000_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that is no letter, digit or non-ASCII byte into a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder is set, once per session.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"vitrail-{spark.sparkContext.applicationId}")
    return f"file://{own}"


def write(df: DataFrame, path: str) -> None:
    """Write ``df``; Spark sends Python no more than a slice at once, so neither side holds large batches."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_BYTES)
    conf.set(_BATCH_BYTES, SLICE_BYTES)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH_BYTES, before)


def send_slices(spark: SparkSession) -> None:
    """From now on in this session Spark sends Python no more than a slice at once, whoever writes the table."""
    spark.conf.set(_BATCH_BYTES, SLICE_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        if getattr(t, "folder", None):
            delete(t.sparkSession, t.folder)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give freed memory back: workers live on from stage to stage, and so would what they once held."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidied(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over the batches of a task that tidies up after its last one."""

    def run(batches):
        yield from task(batches)
        tidy()

    return run


def map_rows(
    docs: DataFrame,
    out: T.StructType,
    fn: Callable[[list[pa.Array]], list[pa.Array]] | Callable,
    columns: list[str],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed in Python to ``docs``, batch by batch and without a shuffle.

    ``fn`` is a factory: called once per task, it returns a function from the Arrow arrays of
    ``columns`` to the arrays of ``out``.  ``keep`` names the input columns to hand through (all by
    default).  An input column that has the name of an output column is dropped.
    """
    names = {f.name.lower() for f in out}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    used = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
    )
    n = len(keep)
    schema = T.StructType([docs.schema[c] for c in keep] + list(out.fields))
    titles = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                yield pa.RecordBatch.from_arrays(b.columns[:n] + work(*b.columns[n:]), titles)

    return used.mapInArrow(tidied(run), schema)


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    elif pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    for x in texts:
        yield x.as_py() or b""


_MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are part of a word: all but ASCII space, or letters, digits and non-ASCII bytes.
NO_SPACE, ALNUM = np.ones(256, bool), np.zeros(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM[sorted(_KEEP)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the lowest k bytes; 0 stands for all eight.
_BYTES = np.array([2**64 - 1] + [2 ** (8 * k) - 1 for k in range(1, 8)], np.uint64)
#: Words over so many bytes are hashed one by one.
LONG_WORD = 256


def hash_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``raw``, which ends with eight spare bytes; no span is empty.

    Eight bytes a step are mixed in, all spans at once.  Spans of one length of up to eight bytes never
    collide; there is no algebra by which longer ones could be made to.
    """
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = scramble((sizes.astype(np.uint64) * _MIX) ^ (eight[starts] & _BYTES[np.where(sizes < 8, sizes, 0)]))
    at, k = np.flatnonzero(sizes > 8), 8
    long = sizes[at] > LONG_WORD
    for i in at[long].tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    at = at[~long]
    while len(at):
        rest = sizes[at] - k
        h[at] = scramble((h[at] * _MIX) ^ (eight[starts[at] + k] & _BYTES[np.where(rest < 8, rest, 0)]))
        at, k = at[rest > 8], k + 8
    return h


class Words(NamedTuple):
    """Words of a run of texts: hashes, offsets of the texts, and each word's bytes in ``raw``."""

    hash: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray


def words(texts: list[bytes], part_of_word: np.ndarray = NO_SPACE, lower: bool = False) -> Words:
    blob = b" ".join(texts) + b" "
    raw = np.frombuffer(blob + bytes(8), np.uint8)
    if lower:
        raw = _LOWER[raw]
    inside = np.append(part_of_word[raw[: len(blob)]], False)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(hash_spans(raw, starts, ends - starts), np.searchsorted(starts, begin), starts, ends, raw)


def chunks(texts: Iterable[bytes], part_of_word: np.ndarray = NO_SPACE, lower: bool = False) -> Iterator[Words]:
    """Words of runs of texts of about CHUNK_BYTES bytes."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= CHUNK_BYTES:
            yield words(run, part_of_word, lower)
            run, n = [], 0
    if run:
        yield words(run, part_of_word, lower)


class WordHashes(dict):
    """Words to 64-bit values computed when first asked for; subclasses say what value."""

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(flat: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hash of the k words from each position (the last k-1 positions are cut off)."""
    n = max(0, len(flat) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _MIX + flat[j : j + n]
    return scramble(h)


def whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k words lie in one document, ascending."""
    lengths = np.diff(offsets)
    ok = np.repeat(offsets[1:] - k, lengths) >= np.arange(offsets[-1])
    return np.flatnonzero(ok)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
