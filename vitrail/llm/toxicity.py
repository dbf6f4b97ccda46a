"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of three hashed ones: of the word, and of its first 5 and first 7
characters (for inflected and compounded forms), of BUCKETS in all.  Filters over 1, 2 and 3 consecutive words, a rectifier and
max pooling over the whole text give the features of a logistic output.  Trained in numpy with
Adagrad: the gradient of a pooled feature flows to the one place that had the maximum.  The first
embedding channel starts as the word's log-odds in the training sample, less two standard errors
(0 if that changes its sign).  Buckets seen in under MIN_SEEN training texts share one embedding of
zero, which is never trained: what is rare in the sample tells nothing about other texts.

Scores are calibrated: a logistic of the network's output is fitted on all of the sample, each part of
it (of FOLDS) by a network that did not see it.  Each language's threshold is the score from which a held-back text of that
language is likelier toxic than not (``thresholds``, used by ``flagged``); languages with under
MIN_LANG held-back rows share the common one.  ``predicted`` uses 0.7 for all.

Fitting reads a bounded sample of labelled rows: SAMPLE_DOCS a label value, those of least hash, with
their whole texts; scoring reads whole texts, long ones in pieces whose maxima are pooled.  The
language is no input of the network.

Defined results: null and empty texts score as a text without words; with no labelled row, or only
one label value, every text scores the base rate; repeated rows are scored each, and of labelled rows
with one id the least text teaches; input columns named score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from . import _sample as S

BUCKETS, DIM, FILTERS, WIDTHS, MIN_SEEN = 1 << 18, 8, 12, (1, 2, 3), 5
SAMPLE_DOCS, EPOCHS, BATCH, RATE = 3_000, 6, 32, 0.03
#: Words whose feature maps are held at once.
PIECE = 100_000
MIN_LANG, CUT, FOLDS = 40, 0.7, 3
PREFIXES = (5, 7)
WAYS = 1 + len(PREFIXES)

OUT = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
)

_STRIP = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x27 or 0x2A <= c < 0x30 or c in b"()':;?=<>[]\\^_`{|}~\x7f" else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lowered, ASCII punctuation dropped."""
    return text.translate(_STRIP).split()


class _Buckets(C.WordHashes):
    """Word to the buckets of itself and of its prefixes (BUCKETS: it has no such prefix), 20 bits each."""

    def __missing__(self, word: bytes) -> int:
        letters = word.decode("utf-8", "replace")
        packed = xxhash.xxh32_intdigest(b"w" + word) % BUCKETS
        for j, n in enumerate(PREFIXES, 1):
            packed |= (xxhash.xxh32_intdigest(letters[:n].encode()) % BUCKETS if len(letters) >= n else BUCKETS) << 20 * j
        self[word] = packed
        return packed

    def of(self, words: list[bytes]) -> np.ndarray:
        packed = super().of(words)
        return np.stack([((packed >> np.uint64(20 * j)) & np.uint64(0xFFFFF)).astype(np.int32) for j in range(WAYS)], 1)


class Network:
    """Embeddings ``e``, filters ``w[k]`` (k x DIM, FILTERS) with biases ``b[k]``, output ``o``, ``c``."""

    def __init__(self, rng: np.random.Generator, odds: np.ndarray, known: np.ndarray):
        self.e = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.e[:-1, 0] = odds
        self.row = np.append(np.where(known, np.arange(BUCKETS, dtype=np.int32), np.int32(BUCKETS)), np.int32(BUCKETS))
        self.e[-1] = 0  # rare words, and what stands around a text
        self.w = {k: rng.normal(0, 0.3 / k, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.w[k][::DIM, : FILTERS // 2] = 0.5 / k
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.o = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.c = np.float32(0)
        self.a, self.s = 1.0, 0.0  # calibration: logistic(a * z + s)

    def features(self, flat: np.ndarray, offsets: np.ndarray, places: bool = False, blind: np.ndarray | None = None):
        """Pooled features of the documents of a flat run; with ``places`` where each maximum was.

        No window begins at the words of ``blind`` (which stand for what follows a piece of a text).
        """
        n = len(offsets) - 1
        gap = max(WIDTHS) - 1
        # Each document is set apart by padding: no window that begins in it reaches the next one.
        starts = offsets[:-1] + gap * np.arange(n)
        ids = np.full((len(flat) + gap * n + gap, WAYS), BUCKETS, np.int32)
        own = np.arange(len(flat)) + gap * np.repeat(np.arange(n), np.diff(offsets))
        ids[own] = self.row[flat]
        x = self.e[ids[:, 0]]
        for j in range(1, WAYS):
            x += self.e[ids[:, j]]
        out, where = [], []
        total = len(ids) - gap
        padding = np.ones(total, bool)
        padding[own] = False
        if blind is not None:
            padding[own[blind]] = True
        for k in WIDTHS:
            h = x[:total] @ self.w[k][:DIM]
            for j in range(1, k):
                h += x[j : total + j] @ self.w[k][j * DIM : (j + 1) * DIM]
            h += self.b[k]
            np.maximum(h, 0, out=h)
            h[padding] = 0  # windows begin at words
            out.append(np.maximum.reduceat(h, starts))
            if places:
                where.append(np.stack([starts[d] + h[starts[d] : (starts[d + 1] if d + 1 < n else total)].argmax(0) for d in range(n)]))
        return np.concatenate(out, 1), ids, where

    def logits(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        if not len(size) or size.max() <= 2 * PIECE:
            return self.features(flat, offsets)[0] @ self.o + self.c
        return np.array([self._long(flat[s:e]) for s, e in zip(offsets, offsets[1:])])

    def _long(self, flat: np.ndarray) -> float:
        """Logit of one text of any length: features are maxima, so pieces are pooled by their maxima."""
        gap, best = max(WIDTHS) - 1, None
        for s in range(0, max(1, len(flat)), PIECE):
            own = flat[s : s + PIECE + gap]
            after = np.arange(PIECE, len(own))  # windows that begin here belong to the next piece
            f = self.features(own, np.array([0, len(own)]), blind=after)[0][0]
            best = f if best is None else np.maximum(best, f)
        return best @ self.o + self.c

    def _steps(self, flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the mean weighted loss: parameter, gradient, rows of the embedding it is for.

        The gradient of a pooled feature flows to the one place that had its maximum.  One width comes
        after the other, so that who takes a step for each trains a width on what the last one changed.
        """
        f, ids, where = self.features(flat, offsets, places=True)
        z = f @ self.o + self.c
        d = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
        df = d[:, None] * self.o * (f > 0)
        yield "o", f.T @ d, None
        yield "c", d.sum(), None
        for n, k in enumerate(WIDTHS):
            g = df[:, n * FILTERS : (n + 1) * FILTERS]
            gw = np.zeros_like(self.w[k])
            at, ge = [], []
            for j in range(k):
                w_j = slice(j * DIM, (j + 1) * DIM)
                own = ids[where[n] + j]  # (document, filter, way)
                gw[w_j] = np.einsum("nfd,nf->df", self.e[own].sum(2), g)
                at.append(own.reshape(-1, WAYS))
                ge.append((g[:, :, None] * self.w[k][w_j].T[None]).reshape(-1, DIM))
            at, ge = np.concatenate(at), np.concatenate(ge)
            yield ("w", k), gw, None
            yield ("b", k), g.sum(0), None
            for j in range(WAYS):
                inside = at[:, j] < BUCKETS
                yield "e", ge[inside], at[inside, j]

    def gradients(self, flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """The same, added up in the shape of each parameter."""
        out = {"e": np.zeros_like(self.e)}
        for key, grad, at in self._steps(flat, offsets, y, weight):
            if at is None:
                out[key] = grad
            else:
                np.add.at(out["e"], at, grad)
        return out

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(flat, offsets).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.s, -30, 30)))


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros((0, WAYS), np.int32)]), np.cumsum([0, *map(len, texts)])


def distinct(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """One row of each group of near copies with one label (a word set like that of a kept row).

    Copies of one mislabelled text would otherwise teach all of its words.  Four minima of hashed
    words, eight times, find likely copies; word sets decide.
    """
    rng = np.random.default_rng(7)
    odd = (rng.integers(1, 2**62, 32, np.uint64) << np.uint64(1)) | np.uint64(1)
    kept: list[int] = []
    by_key: dict[tuple, int] = {}
    sets = [np.unique(r[:, 0]) for r in rows]
    for i, s in enumerate(sets):
        if len(s):
            h = C.scramble(s.astype(np.uint64)[None] * odd[:, None]).min(1).reshape(8, 4)
            keys = [(int(y[i]), k, *x) for k, x in enumerate(h.tolist())]
        else:
            keys = [(int(y[i]), "empty")]
        for j in {by_key[k] for k in keys if k in by_key}:
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if both >= 0.6 * (len(s) + len(sets[j]) - both):
                break
        else:
            kept.append(i)
            for k in keys:
                by_key.setdefault(k, i)
    return kept


def train(texts: list[str], y: np.ndarray, seed: int = 1) -> tuple[Network, np.ndarray, np.ndarray]:
    """A network of all rows (near copies once), calibrated on each row by networks that did not see it.

    Also returns the indices of the rows it learnt from, and their calibrated held-back scores.
    """
    rng = np.random.default_rng(seed)
    cache = _Buckets()
    rows = [cache.of(words_of(t.encode())) for t in texts]
    order = rng.permutation(np.array(distinct(rows, y), np.int64))
    net = _fitted(rows, y, order, rng)
    z = np.zeros(len(order))
    for fold in range(FOLDS):
        held = np.arange(len(order)) % FOLDS == fold
        if held.any() and len(set(y[order[~held]].tolist())) == 2:
            z[held] = _fitted(rows, y, order[~held], rng).logits(*_flat([rows[i] for i in order[held]]))
    net.a, net.s = _calibrate(z, y[order])
    return net, order, 1 / (1 + np.exp(-np.clip(net.a * z + net.s, -30, 30)))


def _fitted(rows: list[np.ndarray], y: np.ndarray, fit: np.ndarray, rng: np.random.Generator) -> Network:
    """A network trained on the rows ``fit``."""
    seen = np.zeros((2, BUCKETS))
    for i in fit:
        seen[y[i], np.setdiff1d(rows[i], BUCKETS)] += 1
    n1, n0 = max(1, y[fit].sum()), max(1, (1 - y[fit]).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    error = 2 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - error, 0)
    known = seen.sum(0) >= MIN_SEEN
    net = Network(rng, np.clip(np.where(known, odds, 0), -4, 4).astype(np.float32), known)
    grow: dict = {}

    def step(key, param, grad, at=None):
        g2 = grow.setdefault(key, np.full(param.shape, 1e-3, np.float32))
        if at is None:
            g2 += grad**2
            param -= RATE * grad / np.sqrt(g2)
        else:
            u, inv = np.unique(at, return_inverse=True)
            g = np.zeros((len(u), DIM), np.float32)
            np.add.at(g, inv, grad)
            g2[u] += g**2
            param[u] -= RATE * g / np.sqrt(g2[u])

    weight = np.where(y == 1, len(fit) / (2 * n1), len(fit) / (2 * n0)).astype(np.float32)
    for _ in range(EPOCHS):
        for s in range(0, len(fit), BATCH):
            rows_at = fit[s : s + BATCH]
            flat, offsets = _flat([rows[i] for i in rows_at])
            for key, grad, at in net._steps(flat, offsets, y[rows_at], weight[rows_at]):
                if key == "c":
                    net.c -= RATE * grad
                elif key == "o":
                    step(key, net.o, grad + 1e-4 * net.o)
                elif key == "e":
                    step(key, net.e, grad, at)
                else:
                    step(key, getattr(net, key[0])[key[1]], grad)
        fit = rng.permutation(fit)
    return net


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on z by Newton steps, with a slight prior that keeps the slope finite."""
    m, sd = z.mean(), z.std() + 1e-6
    x = np.stack(((z - m) / sd, np.ones(len(z))), 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (p - y) + 0.05 * t
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        t -= np.linalg.solve(h, g)
    a = max(t[0], 1e-3) / sd
    return float(a), float(t[1] - a * m)


class Model:
    def __init__(self, net: Network | None, base: float, thresholds: dict[str, float]):
        self.net, self.base, self.thresholds = net, base, thresholds


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model from ``labels`` (doc_id, label) and the texts of a bounded sample of them.

    The sample is drawn from the labels alone; its ids, under 2 x SAMPLE_DOCS rows, are broadcast,
    so no text is shuffled.
    """
    labels = labels.where(F.col(f"`{label}`").isin(0, 1))
    ids = S.by_label(labels, label, doc_id, SAMPLE_DOCS)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    # At most SAMPLE_DOCS ids a label value, broadcast; of rows with one id the least text.
    rows = rows.where(F.length("t") > 0).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("t", "l")).alias("x")).select("id", "label", "x.*")
    found = sorted({r.id: r for r in rows.orderBy("id", "label").collect()}.values(), key=lambda r: r.id)
    counts = dict(labels.groupBy(f"`{label}`").count().collect())
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    y = np.array([r.label for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(None, base, {})
    net, held, z = train([r.t for r in found], y)
    C.tidy()
    langs = np.array([found[i].l or "" for i in held])
    thresholds = {"": _threshold(z, y[held])}
    for k in set(langs.tolist()) - {""}:
        if (langs == k).sum() >= MIN_LANG:
            thresholds[k] = _threshold(z[langs == k], y[held][langs == k])
    return Model(net, base, thresholds)


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors, halfway between its two neighbours."""
    order = np.argsort(score)
    s, y = score[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    k = int(wrong.argmin())
    lo, hi = (s[k - 1] if k else 0.0), (s[k] if k < len(s) else 1.0)
    return float((lo + hi) / 2)


def annotate(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, cache = shared.value, _Buckets()

        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for run in _runs(cache.of(words_of(t)) for t in C.as_bytes(texts)):
                out.append(m.net.score(*_flat(run)) if m.net else np.full(len(run), m.base))
            score = np.concatenate([*out, np.zeros(0)])
            return [pa.array(score), pa.array((score >= CUT).astype(np.int32))]

        return work

    return C.map_rows(docs, OUT, make, [text], keep)


def _runs(texts, words: int = PIECE):
    """Runs of documents of about so many words."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= words:
            yield run
            run, n = [], 0
    if run:
        yield run


def flag(scored: DataFrame, model: Model, lang: str = "lang") -> DataFrame:
    """``scored`` with ``flagged``: score at or over the threshold of the row's language."""
    common = F.lit(model.thresholds.get("", CUT))
    table = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv]) if model.thresholds else None
    cut = common if table is None else F.coalesce(F.try_element_at(table, F.coalesce(F.col(f"`{lang}`"), F.lit(""))), common)
    return scored.withColumn("flagged", F.col("score") >= cut)


def fit_tables(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the table ``labels``, from its rows whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.where(S.fold("doc_id", 3) != 1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_tables(spark, docs, sf_dir)
    found = annotate(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (S.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
