import itertools

import numpy as np
import pytest

from tessera.llm import crf


@pytest.mark.parametrize("seed", range(10))
def test_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    k, lengths = 3, rng.integers(1, 7, 5)
    emit, trans, init = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    marginals, pairs, first = crf.forward_backward(emit, crf.starts_of(lengths), trans, init, pairs=True)
    at, all_pairs, all_first = 0, np.zeros((k, k)), np.zeros(k)
    for n in lengths:
        z, m, p, f = 0.0, np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        for y in itertools.product(range(k), repeat=int(n)):
            s = np.exp(init[y[0]] + sum(emit[at + i, c] for i, c in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += s
            f[y[0]] += s
            for i, c in enumerate(y):
                m[i, c] += s
            for a, b in zip(y, y[1:]):
                p[a, b] += s
        assert np.allclose(m / z, marginals[at : at + n])
        all_pairs, all_first, at = all_pairs + p / z, all_first + f / z, at + n
    assert np.allclose(pairs, all_pairs) and np.allclose(first, all_first)


def test_long_and_extreme():
    n = 5000
    emit = np.zeros((n, 2))
    emit[::2, 0] = 500
    m = crf.forward_backward(emit, crf.starts_of(np.array([n])), np.array([[0.0, -50], [-50, 0]]), np.zeros(2))
    assert np.isfinite(m).all() and (m[:, 0] > 0.99).all()
    assert crf.forward_backward(np.zeros((0, 2)), np.zeros(0, bool), np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)


def test_training_learns_transitions():
    rng = np.random.default_rng(1)
    gold = np.concatenate([np.repeat(rng.integers(0, 2), 20) for _ in range(200)])
    types = np.where(rng.random(len(gold)) < 0.7, gold, 1 - gold)
    starts = crf.starts_of(np.full(100, 40))
    w, trans, init = crf.train(types, np.array([0, 1]), np.array([1, 1]), 4, gold, starts, 2, rounds=60)
    emit = np.stack([w[0], w[1]])[types]
    m = crf.forward_backward(emit, starts, trans, init)
    assert (m.argmax(1) == gold).mean() > 0.9 > 0.8 > (types == gold).mean()


@pytest.mark.parametrize("seed", range(5))
def test_best_paths(seed):
    rng = np.random.default_rng(seed)
    k, lengths = 3, rng.integers(1, 7, 6)
    emit, trans, init = rng.normal(size=(6, 6, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got = crf.best_paths(emit, lengths, trans, init)
    for r, n in enumerate(lengths):
        score = lambda y: init[y[0]] + sum(emit[r, i, c] for i, c in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(got[r, :n]) == max(itertools.product(range(k), repeat=int(n)), key=score) and not got[r, n:].any()


@pytest.mark.parametrize("lengths", [[700], [127, 1, 128, 129, 300], [5] * 100])
def test_across_block_borders(lengths):
    """Against the plain recursion in logarithms."""
    rng = np.random.default_rng(3)
    k, n = 4, sum(lengths)
    emit, trans, init = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    got, pairs, first = crf.forward_backward(emit, crf.starts_of(np.array(lengths)), trans, init, pairs=True)
    at, all_pairs, all_first = 0, np.zeros((k, k)), np.zeros(k)
    for m in lengths:
        e = emit[at : at + m]
        a, b = np.empty((m, k)), np.zeros((m, k))
        a[0] = init + e[0]
        for i in range(1, m):
            a[i] = np.logaddexp.reduce(a[i - 1][:, None] + trans, axis=0) + e[i]
        for i in range(m - 2, -1, -1):
            b[i] = np.logaddexp.reduce(trans + e[i + 1] + b[i + 1], axis=1)
        z = np.logaddexp.reduce(a[-1])
        assert np.allclose(np.exp(a + b - z), got[at : at + m])
        all_first += np.exp(a[0] + b[0] - z)
        for i in range(1, m):
            all_pairs += np.exp(a[i - 1][:, None] + trans + e[i] + b[i] - z)
        at += m
    assert np.allclose(pairs, all_pairs) and np.allclose(first, all_first)
