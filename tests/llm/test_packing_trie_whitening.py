"""Packing, prefix trie and whitening: against brute force, and on odd, empty, tied and repeated rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vitrail.llm import packing, trie, whitening

WORDS = P.path("word_bpe_49k.json")
SLOW = Tokenizer.from_file(WORDS)
ODD_TEXTS = [
    None, "", " \t\n ", "a-b_c(d)e'f.g's", "ÄÖÜ×÷Ã—…. x''s 'S don't'll", "9½3²x⁵ 12٣", "ß́ é̀ É. é ́", "<|ENDOFTEXT|><|endoftext|x",
    "it's<|endoftext|>x<|startoftext|>y", "ÀÉÎ ŒUVRE İstanbul ǅ ΣΑΣ Σ", "日本語 のテ 😀 a b c\x85d\x0be", "ª º µ ẞ ſ K Å ŉ Ŀ ﬁ", "﻿abc \x1cdef\x1fgh\x00",
    "word " * 9000, "x" * 30_000, "ünï" * 5000, "same", "same",
]


def ids_of(text):
    return np.array([*SLOW.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


# 11. Best-fit packing


def test_word_table_gives_the_library_s_ids():
    texts = [t or "" for t in ODD_TEXTS]
    found = packing._encoder(WORDS).ids([t.encode() for t in texts])
    assert [x.tolist() for x in found] == [ids_of(t)[:-1].tolist() for t in texts]


def naive_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(size - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    dice = random.Random(seed)
    size = dice.choice([7, 50, 4096])
    lengths = [dice.choice([dice.randint(1, size), dice.randint(1, max(1, size // 9)), size]) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    taken = defaultdict(list)
    rows = sorted(packing.plan(counts, size))
    for (length, rank, first, offset, each), after in zip(rows, [*rows[1:], (0, 0, 0, 0, 0)]):
        for r in range(rank, after[1] if after[0] == length else counts[length]):
            taken[first + (r - rank) // each].append((offset + (r - rank) % each * length, length))
    assert sum(map(len, taken.values())) == len(lengths)
    for slots in taken.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= size
    assert len(taken) == naive_best_fit(lengths, size)


def check_packed(rows, texts, size):
    """``rows`` hold every piece of ``texts`` once, gapless within sequences."""
    expected = []
    for d, t in texts:
        x = ids_of(t)
        expected += [(d, i, s, len(x[s : s + size]), zlib.crc32(x[s : s + size].astype("<u4").tobytes())) for i, s in enumerate(range(0, len(x), size))]
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(expected, key=order)
    end = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id]
        end[r.sequence_id] += r.length
    assert max(end.values()) <= size
    assert len(end) == naive_best_fit([r.length for r in rows], size)


def test_packing_of_odd_rows(spark):
    texts = [*enumerate(ODD_TEXTS), (3, "same"), (3, "same"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, length int, Piece int").repartition(3)
    packed = packing.pack(docs, WORDS, ids=True).cache()
    rows = packed.collect()
    check_packed(rows, texts, 4096)
    for s in packing.sequences(packed).collect():
        inside = sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert s.token_ids == [t for r in inside for t in r.token_ids]
        assert [(p.doc_id, p.piece, p.offset, p.length) for p in s.pieces] == [(r.doc_id, r.piece, r.offset, r.length) for r in inside]
    for r in rows:
        assert zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32
    check_packed(packing.pack(docs, WORDS, size=64).collect(), texts, 64)
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_packing_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_packed(packing.query(spark, sf).collect(), [tuple(r) for r in docs], 4096)


# 12. Prefix trie


def brute_trie(rows):
    """Node by node: the rebuilt conversations as tuples of turns."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if rebuilt[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


TURNS = "conv_id long, turn long, role string, text string, Depth string, key int"


def made(seed):
    dice = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 2**62 + 3]:
        n = dice.choice([1, 2, 3, 6, 9, 12])
        for k in range(n):
            rows.append((c, dice.choice([k, k, k, None, 3]), dice.choice(["user", "user", "assistant", None, ""]), dice.choice(["yes", "é" * 70, None, "no\n"]), "clash", 1))
    rows += [(11, k, "user", f"turn {k % 7}", "clash", 1) for k in range(300)]  # one long conversation
    rows += [(c, k, "user", "the same", "clash", 1) for c in range(100, 160) for k in range(12)]  # many equal ones
    rows += [(13, 5, "user", "again", "clash", 1)] * 5 + [(None, 1, "user", "nobody's", "clash", 1)]
    dice.shuffle(rows)
    return rows


def plain(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("limits", [(), (("PART_ROWS", 40), ("MIN_PARTS", 2), ("FAN", 3), ("HELD", 20), ("BLOCK", 7))])
def test_trie_of_odd_rows(spark, monkeypatch, limits):
    for name, value in limits:  # conversations over several parts, tables over several rounds, lists over several blocks
        monkeypatch.setattr(trie, name, value)
    rows = made(len(limits))
    assert plain(trie.build(spark.createDataFrame(rows, TURNS).repartition(5))) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.build(spark.createDataFrame([], TURNS)).collect() == []
    assert len(trie.build(spark.createDataFrame([(3, None, None, None, "", 1)], TURNS)).collect()) == len(brute_trie([(3, None, None, None)]))


def test_trie_query_matches_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = plain(trie.query(spark, sf))
    assert found == sorted(map(str, c.sql(trie.SQL).select(*names).fetchall()))
    assert found == brute_trie([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])


# 13. Embedding whitening


def brute_whitening(vectors, k):
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    cov = centred.T @ centred / len(fit)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (x - fit.mean(0)) @ u / np.sqrt(e), e / np.trace(cov), ((len(fit) * x - fit.sum(0)) ** 2).sum(1), len(fit)


def same_up_to_signs(a, b, tolerance=1e-7):
    assert a.shape == b.shape
    signs = np.sign((a * b).sum(0))
    assert np.abs(a * signs - b).max() < tolerance


def test_whitening_query(spark, sf):
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    w, explained, deviation, n = brute_whitening(list(given.values()), 4)
    rows = sorted(whitening.query(spark, sf).collect(), key=lambda r: (list(given).index(r.vec_id), r.component))
    assert [r.component for r in rows] == [1, 2, 3, 4] * len(given) and {r.n for r in rows} == {n}
    same_up_to_signs(np.array([r.whitened for r in rows]).reshape(-1, 4), w)
    assert np.allclose([r.explained for r in rows[:4]], explained, rtol=1e-9)
    assert [r.deviation for r in rows[::4]] == deviation.tolist()
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    dice = np.random.default_rng(3)
    good = [[float(v) for v in dice.normal(size=6) * [5, 3, 2, 1, 0.5, 0]] for _ in range(60)]
    good += [good[0]] * 40  # copies fit once
    bad = [None, [], [None] * 6, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0], [float("inf")] * 6, [1.0] * 5, [1.0] * 7]
    rows = [(i, v, 1.0, "clash") for i, v in enumerate(good)] + [(1000 + i, v, 1.0, "clash") for i, v in enumerate(bad)] + [(None, good[1], 1.0, "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Whitened double, x string").repartition(4)
    found, model = whitening.whiten(df, k=5)
    found = found.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted([(False, i) for i in range(len(good))] + [(True, 0)])
    w, explained, deviation, n = brute_whitening(good, 5)
    by_id = {r.vec_id: r for r in found}
    same_up_to_signs(np.array([by_id[i].whitened for i in range(len(good))]), w)
    assert [int(by_id[i].deviation) for i in range(len(good))] == deviation.tolist()
    assert model.n == n and np.allclose(model.explained, explained) and model.identity_error < 1e-9
    assert set(found[0].asDict()) == {"vec_id", "x", "deviation", "whitened"}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None]])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found, model = whitening.whiten(df)
    assert all(r.whitened == [] for r in found.collect()) and found.count() == sum(v is not None for v in vectors)


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [1e15 * (i + 1), float(i % 3)]) for i in range(9)]
    found, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[int(v * 256) for v in e] for _, e in rows]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in found.collect()} == {i: sum((9 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}


@pytest.mark.parametrize("spectrum", [[9, 8, 7, 6] + [1] * 40, [5, 5, 5, 5, 5, 1], [3, 0, 0, 0, 0, 0, 0, 0], list(range(1, 60)), [1, 1e-6, 1e-9], [1.0001, 1.0, 0.9999, 0.9998] + [0.5] * 30])
def test_lanczos(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    a = q * np.array(spectrum, float) @ q.T
    values, vectors, steps = whitening.lanczos(lambda b: a @ b, d, 4)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:4], atol=1e-13 * max(spectrum))
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * max(spectrum)
    assert np.allclose(vectors.T @ vectors, np.eye(min(4, d)), atol=1e-13) and steps <= -(-d // min(4, d))


def test_lanczos_breaks_down_and_goes_on():
    # The first block spans an invariant space that misses the largest eigenvector's copies.
    a = np.diag([7.0, 7, 7, 7, 7, 7, 2, 1])
    values, vectors, _ = whitening.lanczos(lambda b: a @ b, 8, 3)
    assert np.allclose(values, 7) and np.allclose(a @ vectors, 7 * vectors)
