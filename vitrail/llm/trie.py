"""Prefix trie of conversations: who shares which first turns, and what sharing saves.

A path is a conversation as a sequence of turns (role, text); each distinct sequence of first d turns is
a node.  Turns are known by the first 128 bits of a SHA-256 over role and text, and a node by the xor of
its turns' digests, each mixed with its depth (128 bits), so a path's keys are a running xor that can be
cut anywhere.  Texts themselves never travel.

1. Turns are range-partitioned and sorted by (conversation, turn, ...) into parts, so that even one
   conversation of a third of all rows is spread; a part's keys go on from the xor of the parts before.
2. Every task folds its share of the paths into a partial trie: a table of nodes with the smallest
   member, the number of members and blocks of end lists.
3. The tables are merged in a tree, FAN parts at a time, keyed by node: members are summed, the smallest
   is kept.  Blocks of end lists are merged in order of their ids and digested as a stream, because a
   third of all conversations may end in one node.
4. Bottom-up rollup.  The nodes of which one conversation is the smallest member are the lower end of its
   path, a chain.  Sums run up each chain (in parts), and what the whole chain has is added to the nodes
   above it, by the same partial tables and tree merges.  No loop runs over depths, so depth is no limit.

Defined results: rows without a conversation id are left out; a null role or text is empty; turns of one
number (or none, which come first) follow by role, then text (as far as their first 64 characters tell),
then digest, and equal rows are separate turns; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _common as C

#: Base conversations are those divisible by FAMILY; others begin with up to HEAD turns of theirs.
FAMILY, HEAD = 5, 8
#: Rows of a part, parts at least, tables merged at once, nodes and ids that a task holds, ids a block.
PART_ROWS, MIN_PARTS, FAN, HELD, BLOCK = 200_000, 24, 64, 100_000, 50_000
TIE_CHARS = 64

_U = np.uint64
_SALT_A, _SALT_B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def head_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the base of its family."""
    return zlib.crc32(str(conv_id).encode()) % (HEAD + 1)


def _mixed(digests: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Two words a turn from the two words of its digest and its depth."""
    d = depths.astype(np.uint64)
    a = C.scramble(C.scramble(digests[:, 0] + d * _SALT_A) ^ digests[:, 1])
    b = C.scramble(C.scramble(digests[:, 1] + d * _SALT_B) ^ (digests[:, 0] * _SALT_A))
    return np.stack((a, b), 1)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, bytes: places ascend in the order of turns and name the part (place >> 33)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.substring(role, 1, TIE_CHARS).alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("text"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = max(MIN_PARTS, -(-conversations.count() // PART_ROWS))
    order = ["conv_id", "turn", "role", "text", "digest", "row"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return C.materialise(rows.select("conv_id", F.monotonically_increasing_id().alias("place"), "digest", "bytes"), "turns")


def _part(place: str = "place") -> Column:
    return F.shiftright(place, 33).cast("int")


def segments(rows: DataFrame) -> DataFrame:
    """A row for each conversation in each part: its turns before, whether it ends here, the base's first turns."""
    own = rows.groupBy("conv_id", _part().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    by = W.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.select("*", before.alias("before"), F.count(F.lit(1)).over(by).alias("cuts"), (F.max("part").over(by) == F.col("part")).alias("ends"))
    # Ranked with a limit, which Spark applies before the shuffle.
    ranked = rows.where(F.col("conv_id") % FAMILY == 0).select("*", F.row_number().over(by.orderBy("place")).alias("k")).where(F.col("k") <= HEAD)
    heads = ranked.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "digest", "bytes"))).alias("head"))
    return own.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left").drop("base")


def _carried(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Xor of the tail turns in earlier parts, for conversations that lie in several parts.

    ``cut`` has two rows a part at most (the first and the last conversation of it).
    """
    asked = F.broadcast(cut.where("cuts > 1").select("conv_id", "part", "first", "before", F.coalesce(F.size("head"), F.lit(0)).alias("heads")))
    found = rows.select("*", _part().alias("part")).join(asked, ["conv_id", "part"])
    found = found.select("conv_id", "part", "heads", (F.col("before") + F.col("place") - F.col("first") + 1).alias("k"), "digest")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            conv, part, heads, k = (b[c].to_numpy(zero_copy_only=False) for c in ("conv_id", "part", "heads", "k"))
            h = np.array([head_turns(c) for c in conv.tolist()], np.int64)
            tail = k > h
            mixed = _mixed(_words(b["digest"].to_pylist()), np.minimum(h, np.maximum(heads, 0)) + k - h)
            mixed[~tail] = 0
            both, of = np.unique(np.stack((conv, part), 1), axis=0, return_inverse=True)
            total = np.zeros((len(both), 2), np.uint64)
            np.bitwise_xor.at(total, of.ravel(), mixed)
            total = total.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32)), pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy())], schema.names)

    total = found.mapInArrow(run, schema).groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return total.select("conv_id", "part", F.bit_xor("a").over(earlier).alias("a"), F.bit_xor("b").over(earlier).alias("b"))


PATHS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("depth", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("ends", T.BooleanType()),
    ]
)
ROOT = bytes(16)


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that each rebuilt conversation passes, a row each from the root on; and the segments."""
    cut = C.materialise(segments(rows), "segments")
    carried = _carried(rows, cut)
    lead = cut.join(F.broadcast(carried), ["conv_id", "part"], "left")  # two rows a part at most
    lead = lead.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), "first", "before", "ends", "head", "a", "b", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    tail = rows.select("conv_id", _part().alias("part"), "place", "digest", "bytes")
    both = lead.unionByName(tail, allowMissingColumns=True)
    dealt = both.repartition(F.col("part")).sortWithinPartitions("part", "conv_id", "place")
    return C.materialise(dealt.mapInArrow(C.tidied(_walk), PATHS), "paths"), cut


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each segment led by its description, to nodes."""
    now: dict = {}

    def lead(r: dict) -> list[tuple]:
        conv, h = r["conv_id"], head_turns(r["conv_id"])
        head = (r["head"] or [])[:h]
        keys, a, b = [ROOT], _U(0), _U(0)
        if head:
            for x in np.bitwise_xor.accumulate(_mixed(_words([t["digest"] for t in head]), np.arange(1, len(head) + 1))):
                keys.append(x.tobytes())
            a, b = np.frombuffer(keys[-1], np.uint64)
        if r["a"] is not None:
            a, b = (x ^ _U(y % 2**64) for x, y in ((a, r["a"]), (b, r["b"])))
        now.update(conv=conv, h=h, skip=len(head) - h, k=r["before"], ab=np.array([a, b], np.uint64), part=r["part"], ends=r["ends"])
        if r["before"]:
            return []
        sizes = [0, *(t["bytes"] for t in head)]
        return [(conv, r["part"], d, keys[d], keys[d - 1] if d else None, sizes[d], False) for d in range(len(keys))]

    def closed() -> list[tuple]:
        # The end is a row of its own, so that a segment need not know which of its nodes is the last.
        if not now or not now["ends"]:
            return []
        depth = now["skip"] + max(now["k"], now["h"])
        return [(now["conv"], now["part"], depth, now["ab"].tobytes(), None, 0, True)]

    for b in batches:
        out: list[tuple] = []
        place = b["place"].to_numpy(zero_copy_only=False)
        leads = np.flatnonzero(place < 0)
        at = 0
        for i in [*leads.tolist(), len(place)]:
            if i > at:
                out += _steps(b.slice(at, i - at), now)
            if i < len(place):
                out += closed()
                out += lead(b.slice(i, 1).to_pylist()[0])
            at = i + 1
        yield _table(out, PATHS)
    yield _table(closed(), PATHS)


def _steps(b: pa.RecordBatch, now: dict) -> list[tuple]:
    """Nodes of turns that follow each other in one segment."""
    skipped = max(0, min(b.num_rows, now["h"] - now["k"]))
    now["k"] += skipped
    b = b.slice(skipped)
    if not b.num_rows:
        return []
    depths = now["skip"] + now["k"] + 1 + np.arange(b.num_rows)
    mixed = _mixed(_words(b["digest"].to_pylist()), depths)
    mixed[0] ^= now["ab"]
    run = np.bitwise_xor.accumulate(mixed)
    keys = [now["ab"].tobytes(), *(x.tobytes() for x in run)]
    now["ab"], now["k"] = run[-1].copy(), now["k"] + b.num_rows
    return [(now["conv"], now["part"], d, k, p, n, False) for d, k, p, n in zip(depths.tolist(), keys[1:], keys, b["bytes"].to_pylist())]


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], schema.names)


NODES = T.StructType([*(PATHS[c] for c in ("key", "depth", "parent", "bytes", "conv_id", "part")), T.StructField("n", T.LongType())])
SUMS = T.StructType([PATHS["key"], PATHS["part"], T.StructField("leaves", T.LongType()), T.StructField("saved", T.LongType())])
BLOCKS = T.StructType([PATHS["key"], T.StructField("first", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths to a table of their nodes, as large as a task may hold, then the next."""
    held: dict[bytes, list] = {}
    for b in batches:
        for conv, part, depth, key, parent, size in zip(*(b[c].to_pylist() for c in ("conv_id", "part", "depth", "key", "parent", "bytes"))):
            node = held.get(key)
            if node is None:
                held[key] = [key, depth, parent, size, conv, part, 1]
            else:
                node[6] += 1
                if (conv, part) < (node[4], node[5]):
                    node[4:6] = conv, part
        if len(held) > HELD:
            yield _table(list(held.values()), NODES)
            held = {}
    yield _table(list(held.values()), NODES)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What chains bring to the nodes above them, added up."""
    held: dict[bytes, list] = {}
    for b in batches:
        for key, part, leaves, saved in zip(*(b[c].to_pylist() for c in SUMS.names)):
            node = held.get(key)
            if node is None:
                held[key] = [key, part, leaves, saved]
            else:
                node[2] += leaves
                node[3] += saved
        if len(held) > HELD:
            yield _table(list(held.values()), SUMS)
            held = {}
    yield _table(list(held.values()), SUMS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends in one part of a node, which lie before or after those in any other part, as ascending blocks."""
    held: dict[tuple, list[int]] = {}
    n = 0

    def out() -> pa.RecordBatch:
        return _table([(k, min(v), sorted(v)) for (k, _), v in held.items()], BLOCKS)

    for b in batches:
        for conv, part, key in zip(*(b[c].to_pylist() for c in ("conv_id", "part", "key"))):
            held.setdefault((key, part), []).append(conv)
            n += 1
            if n >= BLOCK:
                yield out()
                held, n = {}, 0
    yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from blocks in order; one block is held at a time."""
    key, state = None, None
    for b in batches:
        done = []
        for k, ids in zip(b["key"], b["ids"]):
            text = ",".join(map(str, ids.values.to_pylist())).encode()
            if (k := k.as_py()) != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        yield _digest_table(done)
    yield _digest_table([(key, state.hexdigest())] if state else [])


def _digest_table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def merged(tables: DataFrame, parts: int, *sums: Column) -> DataFrame:
    """Partial tables to one row a key: tables of FAN neighbouring parts at a time, round after round."""
    tables = tables.withColumnRenamed("part", "group")
    while True:
        parts = -(-parts // FAN)
        tables = tables.withColumn("group", F.floor(F.col("group") / FAN)).groupBy("key", "group").agg(*sums)
        if parts <= 1:
            return tables.drop("group")


def ends(walked: DataFrame) -> DataFrame:
    """End lists as blocks (key, first, ids), ascending and disjoint within a key."""
    return walked.where("ends").select("conv_id", "part", "key").mapInArrow(_blocks, BLOCKS)


def nodes(walked: DataFrame, parts: int) -> DataFrame:
    """key, parent, depth, bytes, n, n_children, and the smallest member with the part in which it came by."""
    tables = walked.where("not ends").drop("ends").mapInArrow(C.tidied(_partial_tries), NODES)
    tables = tables.withColumn("owner", F.struct("conv_id", "part")).drop("conv_id")
    found = merged(tables, parts, F.min("owner").alias("owner"), F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("depth", "parent", "bytes")))
    found = found.select("*", "owner.*").drop("owner")
    children = found.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    found = found.join(children, "key", "left")
    return C.materialise(found.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")


def rolled_up(found: DataFrame, walked: DataFrame, cut: DataFrame, parts: int) -> DataFrame:
    """``found`` with top (of its chain), n_leaves and saved_tokens of the subtrees."""
    found = found.withColumn("weight", (F.col("n") - 1) * F.col("bytes"))
    conv = W.partitionBy("conv_id")
    links = found.groupBy("conv_id", "part").agg(F.sum("weight").alias("w"), F.sum((F.col("n_children") == 0).cast("long")).alias("l"), F.min("depth").alias("top"))
    below = F.coalesce(F.sum("w").over(conv.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    links = links.select("conv_id", "part", below.alias("below"), *(f.over(conv).alias(c) for f, c in ((F.sum("w"), "saved"), (F.sum("l"), "leaves"), (F.min("top"), "top"))))
    links = C.materialise(links, "chains")
    # Sums up a chain: within the part, and what its lower parts have.
    up = W.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    own = found.select("*", F.sum("weight").over(up).alias("inside"))
    own = own.join(links.select("conv_id", "part", "below", F.col("leaves").alias("own_leaves"), "top"), ["conv_id", "part"])
    # The whole chain counts for the nodes of its conversation's path above it, in whatever part they came by.
    chain = links.where("top > 0 and (saved > 0 or leaves > 0)").groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("saved", "leaves", "top")))
    asked = cut.select("conv_id", "part").join(chain, "conv_id")
    above = walked.where("not ends").select("conv_id", "part", "depth", "key").join(asked, ["conv_id", "part"]).where("depth < top")
    brought = merged(above.select(*SUMS.names).mapInArrow(C.tidied(_partial_sums), SUMS), parts, F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = own.join(brought, "key", "left")
    none = F.lit(0).cast("long")
    return out.select(
        *("key", "parent", "depth", "conv_id", "n", "n_children", "top"),
        (F.col("own_leaves") + F.coalesce("leaves", none)).alias("n_leaves"),
        (F.col("inside") + F.col("below") + F.coalesce("saved", none)).alias("saved_tokens"),
    )


def with_parents(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the smallest member of each one's parent.

    Inside a chain it is the same; tops of chains look it up.  Nodes with a thousandth of all children are
    1,000 at most and broadcast; under the others few rows meet.
    """
    inside = rows.where("depth = 0 or depth > top").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    tops = rows.where("depth > 0 and depth = top")
    parents = found.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") >= max(1, found.count() // 1000)
    few, many = parents.where(~many).drop("n_children"), F.broadcast(parents.where(many).drop("n_children"))
    return inside.unionByName(tops.join(many, "parent")).unionByName(tops.join(many, "parent", "left_anti").join(few, "parent"))


def build(conversations: DataFrame) -> DataFrame:
    """The trie's nodes: key, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = turns(conversations)
    parts = 1 + (rows.agg(F.max(_part())).first()[0] or 0)
    walked, cut = paths(rows)
    found = nodes(walked, parts)
    digests = ends(walked).repartition(F.col("key")).sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")
    rolled = C.materialise(rolled_up(found, walked, cut, parts).join(digests, "key", "left"), "rolled")
    out = with_parents(rolled, found).select(
        *("key", "parent", "depth", "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    C.discard(rows, walked, cut)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    nodes = build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same rows in DuckDB SQL: CRC-32 bit by bit, nodes known by the digests of all their turns.
_KEY = "string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)"
_BITS = "(CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[i // 8 + 1])) ELSE a END)"
SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c::VARCHAR AS s FROM t GROUP BY c),
h AS (
  SELECT c, n, xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(s))), lambda a, i:
    CASE WHEN {_BITS} % 2 = 1 THEN xor({_BITS} // 2, 3988292384) ELSE {_BITS} // 2 END), 4294967295) % {HEAD + 1} AS h
  FROM n),
b AS (SELECT h.c, h.h, least(h.h, coalesce(n.n, 0)) AS b FROM h LEFT JOIN n ON n.c = h.c - h.c % {FAMILY}),
r AS (
  SELECT b.c, t.k AS d, role, text FROM b JOIN t ON t.c = b.c - b.c % {FAMILY} AND t.k <= b.h
  UNION ALL SELECT b.c, b.b + t.k - b.h, role, text FROM b JOIN t ON t.c = b.c AND t.k > b.h),
p AS (SELECT c, d, {_KEY} AS key, octet_length(encode(text)) AS bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM n),
x AS (SELECT key, d, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM p GROUP BY key, d),
kids AS (SELECT left(key, (d - 1) * 64) AS key, d - 1 AS d, count(*) AS n FROM x WHERE d > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(kids.n, 0) AS n_children, unnest(range(0, x.d + 1)) AS lv FROM x LEFT JOIN kids ON kids.key = x.key AND kids.d = x.d),
sums AS (SELECT left(key, lv * 64) AS key, lv AS d, count(*) FILTER (n_children = 0) AS leaves, sum((n - 1) * bytes) AS saved FROM y GROUP BY ALL),
last AS (SELECT p.c, p.d, p.key FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1),
ends AS (SELECT key, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last GROUP BY key, d)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM x JOIN sums ON sums.key = x.key AND sums.d = x.d LEFT JOIN kids ON kids.key = x.key AND kids.d = x.d
LEFT JOIN ends ON ends.key = x.key AND ends.d = x.d LEFT JOIN x AS up ON x.d > 0 AND up.key = left(x.key, (x.d - 1) * 64) AND up.d = x.d - 1"""
