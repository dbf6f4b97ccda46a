"""Language-model scoring with a log-bilinear model.

Model.  The prediction for a place is ``q = sum_j C_j r(w_-j) + d`` over the CONTEXT words before it.
Symbols are the most frequent training tokens (``vocabulary_size``, growing with the root of the
corpus), the end of a text, and CLASSES classes that all other words share by shape (final mark,
ASCII or not, long or short).  Words are factored: the vocabulary is cut into bins by frequency, a
bin or class k has the logit ``q . u(k) + a(k)``, a word s among its bin's words ``q . v(s) + b(s)``.
A rare word has the probability of its class times its smoothed share
``(c + 0.1) / (n + 0.1 (v + 1))`` of the class's training tokens n and distinct words v, unseen
words being one more word of each class; so every text has a proper probability.

Training (numpy, noise-contrastive estimation).  Texts are dealt by hash into units of
``UNIT_CHARS_A_WORD x vocabulary`` characters, so that a unit's model stays small beside its text and
their number grows with the root of the corpus.  A unit is trained in a fixed order, batch by batch:
positives against NOISE samples a batch from the unigram distribution, of words and of bins, by
matrix products.  Units start from the same parameters; each row of their results is averaged by how
often it was moved, in a tree of shuffles; ROUNDS such rounds.  No text is left out and none is
collected.  Seeds and order hang on the texts alone, so scores do not depend on how rows are
partitioned (but for the last digits of float sums).

Scoring.  Logits are normalised over bins and classes, one matrix product for the distinct contexts
of a run of tokens, and over the words of each token's bin, one product a bin; so the work grows with
the root of the vocabulary.

Counts.  Base scores need the count of every word of every text.  Texts are dealt in batches by hash;
a batch sends its distinct words' hashes with their training counts to parts, which add them up and
answer with totals; a part sees a word once a batch, so frequent words make no hot key.  With the
answers each text is written once as symbols; training and scoring read those, not texts.

Words are compared by 64-bit hash (of bytes, A-Z lowered).  Defined results: null and empty texts
are one end token; without training tokens the model is the base model; repeated rows are scored each
(and learnt from each); a null doc_id is training data; an input column that has the name of an
output column is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C
from ._sample import fold

#: The least vocabulary; it grows with the root of the corpus.
VOCABULARY, CONTEXT, DIM, NOISE = 1000, 2, 24, 100
BATCH, RATE, START, ROUNDS = 4096, 0.1, 1e-6, 2
#: Characters of a training unit for each word of the vocabulary; steps a round at least, if texts allow.
UNIT_CHARS_A_WORD, STEPS = 4000, 1600
#: Tokens worked on at once, when training and when scoring; models added up in one task.
RUN_TOKENS, SCORE_TOKENS, FAN = 400_000, 1_600_000, 32
#: Numbers of a logit matrix when scoring, its rows when training: they stay in the processor's cache.
BLOCK, ROWS = 65_536, 512
ALPHA = 0.1
#: Characters in a batch; parts of the word space; at least so many batches.
BATCH_CHARS, LEAST = 4_000_000, 64

CLASSES = 12
END = np.uint64(0xE0D0_0000_0000_0000 | 15)  # the end token's "hash"; 15 is no class

OUT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


#: Class of a word by its last byte: 1 ends a sentence, 2 a part of one.
_FINAL = np.zeros(256, np.uint64)
_FINAL[list(b".!?")], _FINAL[list(b",;:")] = 1, 2


class Tokens:
    """Some texts as numbers of their distinct tokens: ``hashes`` (ascending), and ``numbers`` with
    ``offsets`` of the texts, each with its end token."""

    def __init__(self, texts: list[bytes]):
        parts, offsets, n = [], [np.zeros(1, np.int64)], 0
        for w in C.chunks(texts, lower=True):
            foreign = np.cumsum(w.raw >= 128, dtype=np.int32)
            plain = (foreign[w.ends - 1] == foreign[w.starts]) & (w.raw[w.starts] < 128)
            shape = _FINAL[w.raw[w.ends - 1]] + np.where(plain, np.uint64(0), np.uint64(3)) + np.where(w.ends - w.starts > 6, np.uint64(6), np.uint64(0))
            size = np.diff(w.offsets)
            flat = np.full(len(w.hash) + len(size), END)
            flat[np.arange(len(w.hash)) + np.repeat(np.arange(len(size)), size)] = (w.hash & ~np.uint64(15)) | shape
            parts.append(flat)
            offsets.append(n + np.cumsum(size + 1))
            n += len(flat)
        self.offsets = np.concatenate(offsets)
        flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
        first, self.numbers = _distinct(flat)
        self.hashes = flat[first]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct 64-bit keys, ascending, and of each key its number among them.

    Keys are sorted as numbers with their places in the low bits, which is much faster than
    ``argsort``; only where keys differ in those bits alone does the order have to be found again.
    """
    bits = np.uint64(len(keys).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = np.arange(len(keys), dtype=np.uint64)
    order |= keys & ~low
    order.sort()
    order &= low
    order = order.view(np.int64)
    own = keys.take(order)
    if (own[1:] < own[:-1]).any():
        order = np.argsort(keys, kind="stable")
        own = keys.take(order)
    new = np.ones(len(keys), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _symbols(flat: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Symbol of each token: vocabulary place, else VOCABULARY size + class; the end is in it."""
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    rare = vocabulary[at] != flat if len(vocabulary) else np.ones(len(flat), bool)
    return np.where(rare, len(vocabulary) + (flat & np.uint64(15)).astype(np.int64), at).astype(np.int32)


class Model:
    """Parameters of the log-bilinear model over S symbols; symbol S stands before a text.

    The vocabulary is cut into bins of about equal sums of root counts, frequent words first, so
    frequent words are almost alone in theirs.  A symbol has the probability of its bin (or shape
    class) times, for a word, its probability among the bin's words.  The last column of ``v`` and
    ``u`` is the bias.
    """

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray):
        """``vocabulary``: sorted hashes, the end's among them; ``counts``: tokens of each symbol."""
        rng = np.random.default_rng(5)
        self.vocabulary, s, n = vocabulary, len(counts), len(vocabulary)
        self.members = np.argsort(-counts[:n], kind="stable")
        mass = np.cumsum(np.sqrt(counts[self.members] + 1.0))
        want = max(64, int(2 * n**0.5))
        _, self.first, of = np.unique((mass / mass[-1] * want).astype(np.int64), return_index=True, return_inverse=True)
        bins = len(self.first)
        self.first = np.append(self.first, n)
        self.outer = np.append(np.empty(n, np.int32), bins + np.arange(s - n, dtype=np.int32))
        self.outer[self.members] = of
        self.place = np.zeros(s, np.int32)
        self.place[self.members] = np.arange(n) - self.first[of]
        self.r = rng.normal(0, 0.1, (s + 1, DIM)).astype(np.float32)
        self.c = np.stack([np.eye(DIM, dtype=np.float32) * 0.5 for _ in range(CONTEXT)])
        self.d = np.zeros(DIM, np.float32)
        self.unigram = (counts + 1.0) / (counts.sum() + s)
        self.outer_unigram = np.bincount(self.outer, self.unigram)
        self.v, self.u = (
            np.concatenate((rng.normal(0, 0.01, (len(p), DIM)), np.log(p)[:, None]), 1).astype(np.float32) for p in (self.unigram, self.outer_unigram)
        )

    def params(self) -> list[np.ndarray]:
        return [self.r, self.c, self.d, self.v, self.u]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p[...] = vector[at : at + p.size].reshape(p.shape)
            at += p.size

    def before(self, ctx: np.ndarray) -> np.ndarray:
        """The vectors of the words before each token, side by side."""
        return self.r.take(ctx, axis=0).reshape(len(ctx), CONTEXT * DIM)

    def predict(self, before: np.ndarray) -> np.ndarray:
        """The predicted vector from the vectors of the words before, and a last column of ones."""
        c = np.zeros((CONTEXT * DIM, DIM + 1), np.float32)
        c[:, :DIM] = self.c.reshape(CONTEXT * DIM, DIM)
        q = before @ c
        q += np.append(self.d, np.float32(1))
        return q

    def log_probability(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, normalised over bins and inside its bin."""
        s = len(self.v)
        key = np.zeros(len(ctx), np.uint64)
        for j in range(CONTEXT):
            key *= np.uint64(s + 1)
            key += ctx[:, j].astype(np.uint64)
        first, of = _distinct(key << np.uint64(max(0, 64 - ((s + 1) ** CONTEXT).bit_length())))
        z, q = np.empty(len(first), np.float32), np.empty((len(first), DIM + 1), np.float32)
        step = BLOCK // DIM
        for a in range(0, len(first), step):
            q[a : a + step] = self.predict(self.before(ctx.take(first[a : a + step], axis=0)))
        step, u = max(1, BLOCK // len(self.u)), np.ascontiguousarray(self.u.T)
        for a in range(0, len(first), step):
            z[a : a + step] = _log_sum(q[a : a + step] @ u)
        outer = self.outer.take(target)
        out = np.empty(len(ctx))
        order = np.argsort(_narrow(outer, len(self.u)), kind="stable")
        ends = np.searchsorted(outer[order], np.arange(len(self.u) + 1))
        for k in np.flatnonzero(np.diff(ends) > 0):
            words = k < len(self.first) - 1 and self.first[k + 1] > self.first[k] + 1
            v = np.ascontiguousarray(self.v[self.members[self.first[k] : self.first[k + 1]]].T) if words else self.u[k, :, None]
            step = max(1, BLOCK // max(DIM, v.shape[1]))
            for a in range(ends[k], ends[k + 1], step):
                rows = order[a : min(a + step, ends[k + 1])]
                at = of.take(rows)
                own = q.take(at, axis=0)
                got = own @ self.u[k] - z.take(at)
                if words:
                    x = own @ v
                    got += x.take(np.arange(0, x.size, x.shape[1]) + self.place.take(target.take(rows)))  # read before _log_sum overwrites x
                    got -= _log_sum(x)
                out[rows] = got
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; ``x`` is overwritten."""
    with np.errstate(over="ignore"):
        total = np.exp(x) @ np.ones(x.shape[1], x.dtype)
    if 1e-30 < total.min() and total.max() < np.inf:  # sums that overflow or vanish are done again below
        return np.log(total)
    m = x.max(1)
    x -= m[:, None]
    np.exp(x, out=x)
    return m + np.log(x.sum(1))


def _narrow(at: np.ndarray, below: int) -> np.ndarray:
    """In 16 bits where they suffice: numpy then sorts by radix."""
    return at.astype(np.uint16) if below <= 1 << 16 else at


def contexts(symbols: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT symbols before each token of a flat run (``start`` before a text)."""
    n = len(symbols)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.full((n, CONTEXT), start, np.int32)
    for j in range(CONTEXT):
        ok = np.flatnonzero(place > j)
        out[ok, j] = symbols[ok - j - 1]
    return out


class Trainer:
    """Noise-contrastive steps with Adagrad, on words and on bins."""

    def __init__(self, model: Model, seed: int, rate: float = RATE):
        self.m, self.rng, self.seen, self.rate = model, np.random.default_rng(seed), 0, rate
        self.g2 = [np.full(p.shape, START, np.float32) for p in model.params()]
        #: How often each row of a parameter was moved: its weight in the average.
        self.moved = [np.zeros(1 if n in (1, 2) else len(p), np.float32) for n, p in enumerate(model.params())]
        self.noise = [(np.cumsum(p), np.log(NOISE * p).astype(np.float32)) for p in (model.unigram, model.outer_unigram)]

    def _step(self, n: int, grad: np.ndarray, groups: tuple | None = None) -> None:
        p, g2 = self.m.params()[n], self.g2[n]
        if groups is None:
            g2 += grad * grad
            p -= self.rate * grad / np.sqrt(g2)
            self.moved[n] += 1
        else:
            u, times = groups[2:]
            g = _sums(grad, *groups)
            own = g2.take(u, axis=0)
            own += g * g
            g2[u] = own
            np.sqrt(own, out=own)
            g *= self.rate
            g /= own
            p[u] = p.take(u, axis=0) - g
            self.moved[n][u] += times

    def _contrast(self, q: np.ndarray, targets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One step of the vectors and biases of both levels, words and bins; the gradient of ``q``.

        The loss of a logit x (less the log of its expected noise count) has the derivative
        sigma(x) - 1 for the data and sigma(x) for each noise symbol.  A symbol drawn more than once
        is worked on once, and its gradient counts as often as it was drawn.
        """
        n, levels = len(q), self.m.params()[3:]
        share = np.float32(1 / n)
        draws = [
            np.unique(np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE)), len(v) - 1), return_counts=True)
            for (cumulative, _), v in zip(self.noise, levels)
        ]
        of_noise = np.concatenate([v.take(k, axis=0) for v, (k, _) in zip(levels, draws)])
        against = np.negative(of_noise.T, order="C")
        against[DIM] += np.concatenate([log_kp.take(k) for (_, log_kp), (k, _) in zip(self.noise, draws)])
        weight = np.concatenate([drawn for _, drawn in draws])[:, None] * share
        of_noise *= weight
        to_noise, dq = np.zeros_like(of_noise), np.empty((n, DIM + 1), np.float32)
        with np.errstate(over="ignore"):  # sigma is 0 there
            for a in range(0, n, ROWS):
                own = q[a : a + ROWS]
                x = _sigma(own @ against)
                to_noise += x.T @ own
                np.matmul(x, of_noise, out=dq[a : a + ROWS])
        to_noise *= weight
        at = 0
        for level, (v, target, (k, drawn), (_, log_kp)) in enumerate(zip(levels, targets, draws, self.noise)):
            of_target = v.take(target, axis=0)
            pos = np.einsum("nd,nd->n", q, of_target) - log_kp.take(target)
            gp = ((np.tanh(pos / 2) - 1) * (share / 2))[:, None]
            grad = np.empty((n + len(k), DIM + 1), np.float32)
            np.multiply(q, gp, out=grad[:n])
            grad[n:] = to_noise[at : at + len(k)]
            self._step(3 + level, grad, _groups(np.concatenate((target, k)), len(v)))
            self.moved[3 + level][k] += drawn - 1
            at += len(k)
            of_target *= gp
            dq += of_target
        return dq[:, :DIM]

    def batch(self, ctx: np.ndarray, target: np.ndarray) -> None:
        """One step on the tokens ``target`` of a run, in order, with their ``contexts``."""
        m, n = self.m, len(target)
        before = m.before(ctx)
        q = m.predict(before)
        dq = self._contrast(q, (target, m.outer.take(target)))
        self._step(2, dq.sum(0))
        # The words before the tokens are the run itself, so gradients are first added up by place.
        start = len(m.r) - 1
        dr = np.zeros((n + CONTEXT, DIM), np.float32)  # the last row is for ``start``
        every = dq @ m.c.reshape(CONTEXT * DIM, DIM).T
        for j in range(CONTEXT):
            g = every[:, j * DIM : (j + 1) * DIM]
            first = np.flatnonzero(ctx[:, j] == start)
            dr[-1] += g[first].sum(0)
            g[first] = 0
            dr[CONTEXT - 1 - j : CONTEXT - 1 - j + n] += g
        at = np.concatenate((ctx[0, ::-1], target[:-1], [start]))
        self._step(0, dr, _groups(at, len(m.r)))
        self._step(1, (dq.T @ before).T.reshape(CONTEXT, DIM, DIM))
        self.seen += n

    def weights(self) -> np.ndarray:
        """Weight of every number of the model's vector."""
        return np.concatenate([np.repeat(w, p.size // len(w)) for w, p in zip(self.moved, self.m.params())])


def _sigma(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place of ``x``; faster than tanh."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray, _, times: np.ndarray) -> np.ndarray:
    """Sums of the rows of each of the ``_groups``.

    ``reduceat`` costs a call a group and column, so rows alone in their group are only taken, and
    columns are added two at a time, as parts of complex numbers.
    """
    out, width = rows.take(order.take(first), axis=0), rows.shape[1]
    several = times > 1
    if several.any():
        at, size = order[np.repeat(several, times)], times[several]
        own = np.zeros((len(at), width + width % 2), rows.dtype)
        own[:, :width] = rows.take(at, axis=0)
        sums = np.add.reduceat(own.view(np.result_type(rows, np.complex64)), np.cumsum(size) - size, axis=0)
        out[several] = sums.view(rows.dtype)[:, :width]
    return out


def _groups(at: np.ndarray, below: int) -> tuple:
    """Order by place, starts of equal places, the places, and how often each occurs."""
    order = np.argsort(_narrow(at, below), kind="stable")
    own = at.take(order)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return order, first, own.take(first), np.diff(np.append(first, len(at)))


def _trained(doc_id: str):
    return fold(doc_id, 10) != 0


def _texts_of(symbols: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in symbols]


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])


def train(rows: DataFrame, model: Model, kind: str, units: int, step: int) -> Model:
    """Rounds of training over ``rows`` (unit, key, symbols), ``step`` tokens a step."""
    dealt = rows.repartition(units, "unit").sortWithinPartitions("unit", "key")
    size, cut = len(model.vector()), 4096
    kind_of = "at long, unit long, w binary, x binary"
    for n_round in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared, rate=RATE / (1 + n_round)):
            from copy import deepcopy

            t, unit, texts, n = None, None, [], 0

            def learn() -> None:
                nonlocal texts, n
                if texts:
                    sym, offsets = _flat(texts)
                    ctx = contexts(sym, offsets, len(t.m.v))
                    for s in range(0, len(sym), step):
                        t.batch(ctx[s : s + step], sym[s : s + step])
                    texts, n = [], 0

            def result():
                w = t.weights()
                x = t.m.vector() * w
                for i in range(0, size, cut):
                    if w[i : i + cut].any():
                        sums = [pa.array([y[i : i + cut].astype(np.float64).tobytes()], pa.binary()) for y in (w, x)]
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([unit], pa.int64()), *sums], ["at", "unit", "w", "x"])

            for b in batches:
                for u, own in zip(b["unit"].to_pylist(), _texts_of(b["symbols"], kind)):
                    if u != unit:
                        if t:
                            learn()
                            yield from result()
                        t, unit = Trainer(deepcopy(shared.value), 1 + u, rate), u
                    texts.append(own)
                    n += len(own)
                    if n >= RUN_TOKENS:
                        learn()
            if t:
                learn()
                yield from result()

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("unit")
            sums = [sum(np.frombuffer(y.as_buffer()) for y in table[c]) for c in ("w", "x")]
            return pa.table(
                [table["at"][:1], pa.array([table["unit"][0].as_py() // FAN], pa.int64()), *[pa.array([y.tobytes()], pa.binary()) for y in sums]], ["at", "unit", "w", "x"]
            )

        got, left = dealt.mapInArrow(run, kind_of), units
        while left > 1:
            got = got.groupBy("at", F.floor(F.col("unit") / FAN).alias("g")).applyInArrow(lambda k, t: add(t), kind_of)
            left = -(-left // FAN)
        vector = model.vector()
        for at, _, w, x in got.collect():  # one model in all
            w, x = np.frombuffer(bytes(w)), np.frombuffer(bytes(x))
            own = vector[at : at + len(w)]
            own[w > 0] = x[w > 0] / w[w > 0]
        model.load(vector)
        shared.unpersist()
    return model


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    names = {f.name for f in OUT}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    n = len(keep)
    sc = docs.sparkSession.sparkContext
    chars = docs.agg(F.sum(F.length(f"`{text}`"))).first()[0] or 0
    batches = max(LEAST, -(-chars // BATCH_CHARS))
    parts = batches
    size = vocabulary_size(chars)
    units = max(1, -(-chars // (UNIT_CHARS_A_WORD * size)))
    # Words fall into parts by hash: of the most frequent ones, more than this in a part is out of the question.
    most = min(size, int(size / parts + 8 * (size / parts) ** 0.5 + 16))
    key = F.xxhash64(f"`{doc_id}`", f"`{text}`")
    dealt = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{text}`").alias("t"),
        _trained(doc_id).alias("train"),
        key.alias("key"),
        F.pmod(key, F.lit(batches)).cast("int").alias("batch"),
    )

    def words(table: pa.Table):
        """The batch's tokens, and its distinct hashes by part."""
        tokens = Tokens(list(C.as_bytes(table["t"].combine_chunks())))
        every = tokens.hashes
        own = (C.scramble(every >> np.uint64(4)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(own, kind="stable")
        which, starts = np.unique(own[order], return_index=True)
        return tokens, every, order, which, np.append(starts, len(own))

    def send(table: pa.Table) -> pa.Table:
        tokens, every, order, which, bounds = words(table)
        use = np.repeat(np.array(table["train"].to_pylist(), bool), np.diff(tokens.offsets))
        count = np.bincount(tokens.numbers[use], minlength=len(every))
        h, c = every[order], count[order]
        cut = list(zip(bounds, bounds[1:]))
        return pa.table(
            [
                pa.array(which, pa.int32()),
                pa.array([table["batch"][0].as_py()] * len(which), pa.int32()),
                pa.array([h[s:e].tobytes() for s, e in cut], pa.binary()),
                pa.array([c[s:e].astype("<u4").tobytes() for s, e in cut], pa.binary()),
            ],
            ["part", "batch", "words", "counts"],
        )

    def answer(table: pa.Table) -> pa.Table:
        """One part of the word space: totals for every batch, and the part's statistics.

        The statistics row (batch -1) holds for each class tokens and distinct words of training,
        and the part's most frequent words.
        """
        got = list(zip(table["batch"].to_pylist(), table["words"].to_pylist(), table["counts"].to_pylist()))
        h = np.concatenate([np.frombuffer(w, np.uint64) for _, w, _ in got])
        c = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in got]).astype(np.int64)
        distinct, of = np.unique(h, return_inverse=True)
        total = np.bincount(of, c).astype(np.int64)
        each, ends = total[of], np.cumsum([0, *(len(w) // 8 for _, w, _ in got)])
        top = np.argsort(-total, kind="stable")[:most]
        top = top[total[top] > 0]
        kind = np.minimum((distinct & np.uint64(15)).astype(np.int64), CLASSES)
        stats = np.concatenate(
            (np.bincount(kind, total, CLASSES + 1).astype(np.int64), np.bincount(kind[total > 0], minlength=CLASSES + 1), distinct[top].view(np.int64), total[top])
        )
        p = table["part"][0].as_py()
        return pa.table(
            [
                pa.array([b for b, _, _ in got] + [-1], pa.int32()),
                pa.array([p] * (len(got) + 1), pa.int32()),
                pa.array([each[s:e].astype("<i8").tobytes() for s, e in zip(ends, ends[1:])] + [stats.tobytes()], pa.binary()),
            ],
            ["batch", "part", "totals"],
        )

    sent = dealt.groupBy("batch").applyInArrow(send, "part int, batch int, words binary, counts binary")
    answers = C.materialise(sent.groupBy("part").applyInArrow(answer, "batch int, part int, totals binary"), "counts")
    shared, model = _statistics(sc, answers, size)
    known, tokens_in_all = sc.broadcast(model.vocabulary), shared.value[0]
    kind = "<u2" if len(model.v) < 1 << 16 else "<u4"
    parts_of = [docs.schema[c] for c in keep]
    symbols = T.StructType(
        [T.StructField(f"k{i}", f.dataType, f.nullable) for i, f in enumerate(parts_of)]
        + [
            T.StructField("train", T.BooleanType()),
            T.StructField("unit", T.IntegerType()),
            T.StructField("key", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("share", T.DoubleType()),
            T.StructField("symbols", T.BinaryType()),
        ]
    )
    arrow_symbols = to_arrow_schema(symbols)

    def encode(table: pa.Table, got: pa.Table) -> pa.Table:
        """Texts as symbols, with what the counts say of each: known tokens, base score, shares of classes."""
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow_symbols], names=arrow_symbols.names)
        total, distinct, class_tokens, class_words = shared.value
        vocabulary = known.value
        tokens, every, order, which, bounds = words(table)
        answered = dict(zip(got["part"].to_pylist(), got["totals"].to_pylist()))
        count = np.zeros(len(every), np.int64)
        for p, s, e in zip(which.tolist(), bounds, bounds[1:]):
            count[order[s:e]] = np.frombuffer(answered[p], "<i8")
        base = np.log10((count + ALPHA) / (total + ALPHA * (distinct + 1)))
        symbol = _symbols(every, vocabulary)
        shape = np.minimum((every & np.uint64(15)).astype(np.int64), CLASSES)
        share = np.where(symbol < len(vocabulary), 0.0, np.log10((count + ALPHA) / (class_tokens[shape] + ALPHA * (class_words[shape] + 1))))
        at, begin = tokens.numbers, tokens.offsets[:-1]
        sums = [np.add.reduceat(x[at].astype(np.float64), begin) for x in (count > 0, base, share)]
        coded = symbol.astype(kind)[at]
        unit = np.array(table["batch"].to_pylist(), np.int64) % units
        cols = [table.column(j).combine_chunks() for j in range(n)]
        cols += [table["train"].combine_chunks(), pa.array(unit.astype(np.int32)), table["key"].combine_chunks()]
        cols += [pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        cols.append(pa.array([coded[s:e].tobytes() for s, e in zip(tokens.offsets.tolist(), tokens.offsets[1:].tolist())], pa.binary()))
        return pa.table(cols, names=arrow_symbols.names)

    answered = answers.where("batch >= 0").groupBy("batch")
    coded = C.materialise(dealt.groupBy("batch").cogroup(answered).applyInArrow(encode, symbols), "symbols")
    C.discard(answers)
    if tokens_in_all:
        step = max(128, min(BATCH, tokens_in_all // STEPS))
        model = train(coded.where("train").select("unit", "key", "symbols"), model, kind, units, step)
    trained = sc.broadcast(model)
    result = T.StructType(parts_of + list(OUT.fields))
    titles = [f.name for f in result]

    def finish(table: pa.RecordBatch, m: Model) -> pa.RecordBatch:
        texts = _texts_of(table["symbols"], kind)
        base, share = (table[c].to_numpy(zero_copy_only=False) for c in ("base", "share"))
        own = base
        if tokens_in_all:
            sums, s, n_tokens = [], 0, np.cumsum([len(t) for t in texts])
            while s < len(texts):
                e = max(s + 1, int(np.searchsorted(n_tokens, (n_tokens[s - 1] if s else 0) + SCORE_TOKENS, "right")))
                sym, offsets = _flat(texts[s:e])
                p = m.log_probability(contexts(sym, offsets, len(m.v)), sym)
                sums.append(np.add.reduceat(p, offsets[:-1]))
                s = e
            own = np.concatenate(sums) / np.log(10) + share
        cols = table.columns[:n] + [pa.array([len(t) for t in texts], pa.int64()), table["n_known"]]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(texts), tokens_in_all, np.int64)), table["base"], pa.array(own)], titles)

    def run(batches):
        m = trained.value
        for b in batches:
            if b.num_rows:
                yield finish(b, m)

    return coded.select(*[f"k{i}" for i in range(n)], "n_known", "base", "share", "symbols").mapInArrow(run, result)


def vocabulary_size(chars: int) -> int:
    """Words with a vector of their own in a corpus of so many characters."""
    return max(VOCABULARY, int(0.75 * chars**0.5))


def _statistics(sc, answers: DataFrame, size: int):
    """Broadcast totals, and an untrained model over the ``size`` most frequent words.

    One row a part comes to the driver: its class sums, and its share of the most frequent words,
    of which those of all parts are kept as rows arrive.
    """
    k = CLASSES + 1
    tokens, words = np.zeros(k, np.int64), np.zeros(k, np.int64)
    h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def best(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, -c))[:size]
        return h[order], c[order]

    for r in answers.where("batch = -1").select("totals").toLocalIterator():
        x = np.frombuffer(bytes(r.totals), np.int64)
        tokens, words, rest = tokens + x[:k], words + x[k : 2 * k], x[2 * k :]
        half = len(rest) // 2
        h, c = np.append(h, rest[:half].view(np.uint64)), np.append(c, rest[half:])
        if len(h) > 4 * size:
            h, c = best(h, c)
    h, c = best(h, c)
    h, c = np.append(h[h != END], END), np.append(c[h != END], tokens[CLASSES])
    order = np.argsort(h)
    vocabulary, count = h[order], c[order]
    kind = np.minimum((vocabulary & np.uint64(15)).astype(np.int64), CLASSES)
    class_tokens = tokens - np.bincount(kind, count, k).astype(np.int64)
    class_words = words - np.bincount(kind[count > 0], minlength=k)
    symbols = np.concatenate((count, class_tokens[:CLASSES]))
    shared = sc.broadcast((int(tokens.sum()), int(words.sum()), class_tokens, class_words))
    return shared, Model(vocabulary, symbols)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, keep=["doc_id"])
    return found.select("doc_id", (~_trained("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute(docs: list[tuple]) -> dict:
    """Base columns by the definition, for tests on small tables."""
    import zlib
    from collections import Counter
    from math import log10

    own = {d: [w.lower() for w in (t or "").encode().split()] + [None] for d, t in docs}
    count: Counter = Counter()
    for d, w in own.items():
        if zlib.crc32(str(d).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return {
        d: (len(w), sum(count[x] > 0 for x in w), n, sum(log10((count[x] + ALPHA) / (n + ALPHA * (v + 1))) for x in w)) for d, w in own.items()
    }
