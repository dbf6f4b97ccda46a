"""A training step of op3: the gradient of every draw, at the cost of the distinct ones."""

import numpy as np
from vitrail.llm import lm


def _trainer():
    counts = np.array([900.0, 500, 90, 40, 30, 20, 10, 5, 3, 2] + [7] * lm.CLASSES)
    return lm.Trainer(lm.Model(np.arange(10, dtype=np.uint64), counts), 3)


def test_noise_drawn_again_is_worked_on_once_and_counts_each_time(monkeypatch):
    t, rng = _trainer(), np.random.default_rng(1)
    q = rng.normal(size=(700, lm.DIM + 1)).astype(np.float32)
    q[:, lm.DIM] = 1
    target = rng.integers(0, 22, 700)
    targets = (target, t.m.outer.take(target))
    # The draws one by one, by the definition of the loss.
    draws, again = [], np.random.default_rng(3)
    for cumulative, _ in t.noise:
        draws.append(np.minimum(np.searchsorted(cumulative, again.random(lm.NOISE)), len(cumulative) - 1))
    want_dq, want = np.zeros((700, lm.DIM + 1)), []
    for v, k, own, (_, log_kp) in zip(t.m.params()[3:], draws, targets, t.noise):
        v, moved, grad = v.astype(float), np.zeros(len(v)), np.zeros(v.shape)
        for at, minus in [*((np.full(700, i), 0) for i in k), (own, 1)]:
            g = (1 / (1 + np.exp(-((q * v[at]).sum(1) - log_kp[at]))) - minus) / 700
            want_dq += g[:, None] * v[at]
            np.add.at(grad, at, g[:, None] * q)
        np.add.at(moved, np.concatenate((k, own)), 1)
        used = moved > 0
        v[used] -= t.rate * grad[used] / np.sqrt(lm.START + grad[used] ** 2)
        want.append((v, moved))
    widths, sigma = [], lm._sigma
    monkeypatch.setattr(lm, "_sigma", lambda x: widths.append(x.shape[1]) or sigma(x))
    dq = t._contrast(q, targets)
    assert set(widths) == {sum(len(np.unique(k)) for k in draws)} and max(widths) < lm.NOISE
    assert np.allclose(dq, want_dq[:, : lm.DIM], atol=1e-6)
    for (v, moved), got, n in zip(want, t.m.params()[3:], t.moved[3:]):
        assert np.allclose(got, v, atol=2e-4) and np.array_equal(n, moved)


def test_sums_of_groups():
    rng = np.random.default_rng(2)
    rows, at = rng.normal(size=(500, 6)).astype(np.float32), rng.integers(0, 300, 500) ** 2 // 300
    groups = lm._groups(at, 300)
    want = np.zeros((300, 6))
    np.add.at(want, at, rows)
    assert np.allclose(lm._sums(rows, *groups), want[groups[2]], atol=1e-5)
    alone = lm._groups(np.arange(5), 300)
    assert np.array_equal(lm._sums(rows[:5], *alone), rows[:5])


def test_sigma_of_large_numbers():
    with np.errstate(over="ignore"):
        assert lm._sigma(np.array([0, 200, -200], np.float32)).tolist() == [0.5, 0, 1]


def test_distinct_keys_by_a_sort_with_places_in_the_low_bits(monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = np.uint64(7 << 40) + np.arange(9, dtype=np.uint64)  # these differ in the low bits alone
    for keys, again in ((rng.choice(words, 5000), 0), (rng.choice(near, 5000), 1), (words[:1], 0), (words[:0], 0)):
        want, number = np.unique(keys, return_inverse=True)
        calls, argsort = [], np.argsort
        monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or argsort(*a, **k))
        first, got = lm._distinct(keys)
        monkeypatch.setattr(np, "argsort", argsort)
        assert len(calls) == again
        assert np.array_equal(keys[first], want) and np.array_equal(got, number)


def test_log_sums_that_overflow_or_vanish():
    for rows in ([[0, 1, 2]], [[100, 100, 1]], [[-200, -201, -300]], [[0, 1, 2], [200, -200, 0], [-90, -90, -90]]):
        x = np.array(rows, np.float32)
        want = [np.logaddexp.reduce(r.astype(float)) for r in x]
        assert np.allclose(lm._log_sum(x), want, rtol=1e-6, atol=1e-5)
