"""Token ids on disk: one zstandard frame a document, a shared dictionary, an offset index.

File format (a Parquet table in the shared folder, written and read by Spark, so that it works on
any store Spark knows).  One row is one shard of consecutive documents:

    bucket, shard     place of the shard; (bucket, shard) ascending is document order
    dictionary_hash   XXH64 of the shared dictionary; 0 means frames without a dictionary
    least, greatest   least and greatest id of the shard's documents (null ids aside), to find one by
    doc_ids           ids of the documents, ascending, null first; equal ids by their bytes
    n_tokens          tokens of each document, the end id included
    offsets           n + 1 byte offsets of the frames in ``frames``
    frames            the zstandard frames, one after the other

A frame holds a document's ids as little-endian unsigned 32-bit integers.  The dictionary is trained
on the id arrays of at most SAMPLE_DOCS documents (those of least hash; of each a window of at most
SAMPLE_CHARS characters that begins at a hashed place), and lies beside the shards; a reader checks
its hash.  One document is read by its offsets,
without the rest of its shard being decompressed.

Ascending order comes from ranges of doc_id found on ids alone (``approx_percentile``), so the text
itself is encoded once, before the shuffle, and only compressed frames are shuffled.

Defined results: null texts are empty (only the end id); equal doc_ids keep all their rows; an added
token inside a text ("<|endoftext|>") becomes its id, as in the library by default, or with
``plain_added`` ordinary text, as with the library's ``encode_special_tokens``.  doc_id must be a
whole number (or its text); columns other than doc_id and text are not part of the file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _common as C
from . import _sample as S
from ._pieces import PieceTable, batches

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 20_000, 64_000
LEVEL = 3
#: A bucket (one task of the sort) has about so many documents, a shard about so many bytes.
BUCKET_DOCS, SHARD_BYTES = 4_000, 2_000_000
MIN_BUCKETS, MAX_BUCKETS = 64, 50_000  # the driver holds one cut and one total a bucket

FRAME = T.StructType([T.StructField("frame", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
SHARD = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("dictionary_hash", T.LongType()),
        T.StructField("least", T.LongType()),
        T.StructField("greatest", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("frames", T.BinaryType()),
    ]
)


#: At this many matches the cache of their ids is emptied.
CACHE_MATCHES = 200_000

#: FIXED VALUE: the split pattern of byte-level pre-tokenizers, checked against the tokenizer's own.
_MATCHES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall

#: Marks that the pre-tokenizer writes as themselves and that match alone after a letter.
_MARKS = frozenset('.,;:!?")')


class Encoder:
    """Texts to ids: cut at added tokens, which become their ids, the rest by a table of pieces."""

    def __init__(self, table: PieceTable, added: dict[bytes, int]):
        self.table, self.added = table, added
        longest = sorted(added, key=len, reverse=True)
        self.cut = regex.compile(b"|".join(map(regex.escape, longest))) if added else None

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not marked:
            return self.table.ids(texts)
        # A text with added tokens stands as its stretches between them, one after the other.
        stretches = {i: self.cut.split(texts[i]) for i in marked}
        tokens = {i: [np.array([self.added[m]], np.uint32) for m in self.cut.findall(texts[i])] for i in marked}
        flat = [x for i, t in enumerate(texts) for x in stretches.get(i, (t,))]
        got = iter(self.table.ids(flat))
        out = []
        for i in range(len(texts)):
            parts = [next(got)]
            for token in tokens.get(i, ()):
                parts += (token, next(got))
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
        return out


@lru_cache(4)
def _encoder(path: str, plain_added: bool = False) -> Encoder:
    """The tokenizer of a file, one a worker process, over a table of pieces.

    Pieces are split into matches here, and the library's model merges each distinct match.  That
    gives the ids of ``Tokenizer.encode`` (without special tokens) in half of its time, as no offsets,
    masks and strings of tokens are made.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.pre_tokenizer.add_prefix_space:
        raise ValueError("pieces are independent for byte-level tokenizers without a normalizer and an added space only")
    added = {}
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.lstrip or token.rstrip or token.single_word:
            raise ValueError("added tokens that hang on what stands beside them are not supported")
        if not (plain_added and token.special):
            added[token.content.encode()] = i
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # distinct matches never hit the model's own cache
    # How the pre-tokenizer writes each byte; printable ASCII other than a space stays itself.
    table = {c: split(chr(c))[0][0] for c in range(33)} | {127: split(chr(127))[0][0]}
    for c in [*range(0x80, 0x100), *(x << 6 for x in range(3, 32)), *(x << 12 | 0x800 for x in range(16)), *(x << 18 | 0x10000 for x in range(4))]:
        if not 0xD800 <= c < 0xE000:
            table.update(zip(chr(c).encode(), "".join(m for m, _ in split(chr(c)))))
    matches: dict[str, bytes] = {}
    probe = " It's 12 a.m.,\n\n  über\t日本!"
    if ["".join(table.get(c, chr(c)) for c in m.encode()) for m in _MATCHES(probe)] != [m for m, _ in split(probe)]:
        raise ValueError("the tokenizer splits texts by another pattern")

    def merged(match: str) -> bytes:
        if match.isascii() and match.isprintable():
            mapped = match.replace(" ", table[32])
        else:
            mapped = match.encode().decode("latin-1").translate(table)
        return array("I", [t.id for t in merge(mapped)]).tobytes()

    def encode(pieces: list[str]) -> list[bytes]:
        if len(matches) > CACHE_MATCHES:
            matches.clear()
        out = []
        for p in pieces:
            mark = b""
            if p[-1] in _MARKS:
                # Letters and one mark are two matches.
                if (mark := matches.get(p[-1])) is None:
                    mark = matches[p[-1]] = merged(p[-1])
                if p[1:-1].isalpha() and p[0] == " ":
                    out.append(merged(p[:-1]) + mark)
                    continue
            if p[0] == " " and p[1:].isalpha():
                out.append(merged(p))
                continue
            parts = []
            for m in _MATCHES(p):
                if (ids := matches.get(m)) is None:
                    ids = matches[m] = merged(m)
                parts.append(ids)
            out.append(b"".join(parts))
        return out

    return Encoder(PieceTable(encode), added)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def train_dictionary(docs: DataFrame, tokenizer: str, text: str, doc_id: str, plain_added: bool = False) -> bytes:
    """A zstandard dictionary from a bounded sample; empty if there is too little to train on."""
    ids = S.by_label(docs.where(F.length(f"`{text}`") > 0).withColumn("_all", F.lit(1)), "_all", doc_id, SAMPLE_DOCS)
    sample = docs.join(F.broadcast(ids.select(F.col("id").alias(doc_id))), doc_id, "left_semi")
    sample = sample.where(F.length(f"`{text}`") > 0).groupBy(doc_id).agg(F.min(S.window(text, doc_id, SAMPLE_CHARS)).alias("t"))
    rows = sorted(sample.select("t").collect())  # at most SAMPLE_DOCS
    samples = [x.tobytes() for x in _encoder(tokenizer, plain_added).ids([r.t.encode() for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 20 else b""
    except zstandard.ZstdError:  # too few different bytes
        return b""


def write(
    docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text", doc_id: str = "doc_id", plain_added: bool = False
) -> None:
    """Encode ``docs`` and write shards and dictionary below ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, "text", "doc_id", plain_added)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-n // BUCKET_DOCS)))
    cuts = docs.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(min(2_000_000, 50 * buckets)))
    ).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)
    end = np.array([end_id], "<u4").tobytes()
    shared = spark.sparkContext.broadcast((dictionary, cuts))

    def make():
        dictionary, cuts = shared.value
        own = _encoder(tokenizer, plain_added)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if zdict:
            zdict.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict).compress

        def work(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
            frames, sizes = [], []
            for part in batches(texts):
                for ids_of in own.ids(part):
                    frames.append(pack(ids_of.tobytes() + end))
                    sizes.append(len(ids_of) + 1)
            where = np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            return [pa.array(frames, pa.binary()), pa.array(sizes, pa.int64()), pa.array(where.astype(np.int32))]

        return work

    out = T.StructType([*FRAME.fields, T.StructField("bucket", T.IntegerType())])
    frames = C.map_rows(docs, out, make, ["text", "doc_id"], ["doc_id"])
    ordered = frames.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")
    h = _signed(xxhash.xxh64_intdigest(dictionary)) if dictionary else 0
    ordered.mapInArrow(_shards(h), SHARD).write.parquet(f"{path}/shards")


def _shards(dictionary_hash: int):
    def run(parts):
        bucket, shard, rows, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).tolist()
            row = {
                "bucket": bucket,
                "shard": shard,
                "dictionary_hash": dictionary_hash,
                "least": min((r[0] for r in rows if r[0] is not None), default=None),
                "greatest": max((r[0] for r in rows if r[0] is not None), default=None),
                "doc_ids": [r[0] for r in rows],
                "n_tokens": [r[2] for r in rows],
                "offsets": offsets,
                "frames": b"".join([r[1] for r in rows]),
            }
            return pa.RecordBatch.from_pylist([row], ARROW_SHARD)

        for b in parts:
            for i, f, n, k in zip(*(c for c in (b["doc_id"], b["frame"], b["n_tokens"], b["bucket"]))):
                k = k.as_py()
                if rows and (k != bucket or size >= SHARD_BYTES):
                    yield flush()
                    shard, rows, size = (shard + 1 if k == bucket else 0), [], 0
                bucket = k
                rows.append((i.as_py(), f.as_py(), n.as_py()))
                size += len(rows[-1][1])
        if rows:
            yield flush()

    return run


ARROW_SHARD = pa.schema(
    [
        ("bucket", pa.int32()),
        ("shard", pa.int32()),
        ("dictionary_hash", pa.int64()),
        ("least", pa.int64()),
        ("greatest", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("frames", pa.binary()),
    ]
)


def _opener(dictionary: bytes, expected: int):
    if expected != (_signed(xxhash.xxh64_intdigest(dictionary)) if dictionary else 0):
        raise ValueError("the shard was written with another dictionary")
    zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=zdict).decompress


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (tokens before it), n_tokens, ids_crc32, token_ids.

    A document's start needs the tokens of all buckets before its own: one row a bucket is summed
    up, and each shard's place in its bucket likewise.  ``ids=False`` leaves token_ids out.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    shards = spark.read.parquet(f"{path}/shards")
    sizes = shards.select("bucket", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    start, before = 0, {}
    for b, n in sorted((r.bucket, r.n) for r in totals):
        before[b] = start
        start += n
    shared = spark.sparkContext.broadcast((dictionary, before))
    # Shards of one bucket are rows of one file in ascending order, but files may be split: each
    # shard gets the tokens of its bucket's earlier shards from this small window.
    w = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("inside"))
    placed = shards.join(F.broadcast(places), ["bucket", "shard"]) if _small(sizes) else shards.join(places, ["bucket", "shard"])
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(parts):
        dictionary, before = shared.value
        unpack = None
        for b in parts:
            for row in b.to_pylist():
                unpack = unpack or _opener(dictionary, row["dictionary_hash"])
                o, n = row["offsets"], row["n_tokens"]
                raw = [unpack(row["frames"][s:e]) for s, e in zip(o, o[1:])]
                if [len(r) // 4 for r in raw] != n:
                    raise ValueError("a frame does not hold the ids that its index names")
                starts = before[row["bucket"]] + row["inside"] + np.cumsum([0, *n[:-1]])
                cols = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                ]
                if ids:
                    cols.append(pa.array([np.frombuffer(r, "<i4") for r in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return placed.mapInArrow(run, schema)


#: Up to so many shards their places are broadcast (under 2 MB); beyond it Spark joins by shuffle.
BROADCAST_SHARDS = 50_000


def _small(sizes: DataFrame) -> bool:
    return sizes.count() <= BROADCAST_SHARDS


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (or of all with that id), by the offset index.

    Shards are left out by their least and greatest id, and of the others only the document's own
    frames come here.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    own = F.lit(doc_id).cast("long")
    shards = spark.read.parquet(f"{path}/shards").where(F.col("least") <= own).where(F.col("greatest") >= own)
    places = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get(F.col("doc_ids"), i) == own)
    cut = lambda i: F.substring(F.col("frames"), F.get(F.col("offsets"), i).cast("int") + 1, (F.get(F.col("offsets"), i + 1) - F.get(F.col("offsets"), i)).cast("int"))
    rows = shards.select("bucket", "shard", "dictionary_hash", F.transform(places, cut).alias("own")).where(F.size("own") > 0).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r.bucket, r.shard)):
        unpack = _opener(dictionary, r.dictionary_hash)
        out += [np.frombuffer(unpack(bytes(f)), "<u4") for f in r.own]
    return out


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{C.shared_dir(spark)}/tokenfile-{uuid.uuid4().hex}"
    write(docs, P.path("byte_bpe_50k.json"), 2, path)
    return read(spark, path, ids=False)
