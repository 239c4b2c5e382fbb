"""Linear-chain conditional random fields over many sequences at once.

All sequences of a batch lie end to end in one array. Forward-backward runs in blocks of equal length: each block's
transfer matrix first, a short pass over the blocks next, then messages inside all blocks together. Cost is linear in
the number of positions, whether they belong to many short sequences or one very long one, and nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 128
#: Positions and features that training takes at once: bounds its memory, changes nothing else.
SLICE = 1 << 16


def _scaled(x: np.ndarray) -> np.ndarray:
    x /= x.max(axis=tuple(range(1, x.ndim)), keepdims=True)
    return x


def forward_backward(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, init: np.ndarray, pairs: bool = False):
    """Marginals (positions x labels) and, on request, the summed pairwise marginals and first-position marginals.

    emit: log potentials; starts: True where a sequence begins (position 0 must); trans, init: log potentials.
    """
    n, k = emit.shape
    if not n:
        return (emit.astype("f8"), np.zeros((k, k)), np.zeros(k)) if pairs else emit.astype("f8")
    blocks = -(-n // BLOCK)
    psi = np.ones((blocks * BLOCK, k))
    psi[:n] = np.exp(emit - emit.max(1, keepdims=True))
    psi = np.maximum(psi, 1e-30).reshape(blocks, BLOCK, k)
    flag = np.ones(blocks * BLOCK, bool)
    flag[:n] = starts
    flag = flag.reshape(blocks, BLOCK)
    a, pi = np.exp(trans - trans.max()), np.exp(init - init.max())
    transfer = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        step = transfer @ a
        if flag[:, t].any():
            at = flag[:, t]
            step[at] = transfer[at].sum(2, keepdims=True) * pi
        transfer = _scaled(step * psi[:, None, t])
    into, back = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.ones(k)
    for b in range(blocks):
        into[b] = v
        v = v @ transfer[b]
        v = v / v.max()
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        back[b] = v
        v = transfer[b] @ v
        v = v / v.max()
    alpha, beta = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
    v = into
    for t in range(BLOCK):
        alpha[:, t] = v = _scaled(np.where(flag[:, t, None], pi, v @ a) * psi[:, t])
    v = back
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = v
        v = _scaled(np.where(flag[:, t, None], 1.0, (v * psi[:, t]) @ a.T))
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    marginals = alpha * beta
    marginals /= marginals.sum(1, keepdims=True)
    if not pairs:
        return marginals
    starts = np.asarray(starts, bool)
    at = np.flatnonzero(~starts)
    total = np.zeros((k, k))
    for s in range(0, len(at), 1 << 14):
        i = at[s : s + (1 << 14)]
        xi = alpha[i - 1][:, :, None] * a * (psi.reshape(-1, k)[i] * beta[i])[:, None, :]
        total += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
    return marginals, total, marginals[starts].sum(0)


def forward_backward_padded(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, init: np.ndarray, pairs: bool = False):
    """The same for sequences of like length in rows (rows x positions x labels); marginals past a length are 0."""
    n, t, k = emit.shape
    psi = np.exp(np.maximum(emit - emit.max(2, keepdims=True), -60)).astype(np.float64)
    a, pi = np.exp(trans - trans.max()), np.exp(init - init.max())
    alpha, beta = np.empty((t, n, k)), np.ones((t, n, k))
    for i in range(t):
        v = psi[:, i] * ((alpha[i - 1] @ a) if i else pi)
        alpha[i] = v / v.max(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        v = (beta[i + 1] * psi[:, i + 1]) @ a.T
        beta[i] = np.where((i + 1 < lengths)[:, None], v / v.max(1, keepdims=True), 1.0)
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    m *= (np.arange(t)[:, None] < lengths)[:, :, None]
    m = m.transpose(1, 0, 2)
    if not pairs:
        return m
    total = np.zeros((k, k))
    for i in range(1, t):
        xi = alpha[i - 1][:, :, None] * a * (psi[:, i] * beta[i])[:, None, :]
        total += (xi / xi.sum((1, 2), keepdims=True))[i < lengths].sum(0)
    return m, total, m[:, 0].sum(0)


def best_paths(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, init: np.ndarray) -> np.ndarray:
    """The likeliest labels (rows x positions) of sequences in rows, by Viterbi; 0 past a length."""
    n, t, k = emit.shape
    back, v = np.zeros((t, n, k), np.int8), init + emit[:, 0].astype(np.float64)
    every, to = np.arange(n), trans.T.astype(np.float64)
    for i in range(1, t):
        x = v[:, None, :] + to
        back[i] = x.argmax(2)
        v = np.where((i < lengths)[:, None], x.max(2) + emit[:, i], v)
    out, at = np.zeros((n, t), np.int64), v.argmax(1)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        out[inside, i] = at[inside]
        at = np.where(inside, back[i][every, at], at)
    return out


class Adam:
    """Gradient ascent with per-weight step sizes."""

    def __init__(self, shape, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(shape), np.zeros(shape), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of the (non-empty) sequences begins."""
    out = np.zeros(int(lengths.sum()), bool)
    if len(out):
        out[np.concatenate([[0], np.cumsum(lengths[lengths > 0])[:-1]])] = True
    return out


def train(types: np.ndarray, index: np.ndarray, counts: np.ndarray, width: int, gold: np.ndarray, starts: np.ndarray, labels: int, rounds: int = 30, rate: float = 0.1, l2: float = 1e-6):
    """Weights (width x labels), transitions and initial potentials by the likelihood's gradient.

    types: each position's type; a type has counts[type] > 0 features, their weights' rows end to end in index.
    """
    first_of = np.concatenate([[0], np.cumsum(counts)])
    scale = 1 / np.sqrt(counts)
    w, trans, init = np.zeros((width, labels)), np.zeros((labels, labels)), np.zeros(labels)
    steps = [Adam(w.shape, rate), Adam(trans.shape, rate), Adam(init.shape, rate)]
    n = len(types)
    heads = np.append(np.flatnonzero(starts), n)
    parts = [(int(a), int(b)) for a, b in _slices(heads)]  # whole sequences
    kinds = list(_slices(first_of, of=np.arange(len(first_of))))  # whole types
    inner = np.flatnonzero(~starts)
    seen_pairs = np.bincount(gold[inner - 1].astype(np.int64) * labels + gold[inner], minlength=labels * labels).reshape(labels, labels)
    seen_first = np.bincount(gold[starts], minlength=labels)
    emit, per_type = np.empty((len(counts), labels)), np.empty((len(counts), labels))
    for _ in range(rounds):
        for a, b in kinds:
            emit[a:b] = np.add.reduceat(w[index[first_of[a] : first_of[b]]], first_of[a:b] - first_of[a], axis=0) * scale[a:b, None]
        per_type[:], pairs, first = 0, 0, 0
        for a, b in parts:
            diff, own_pairs, own_first = forward_backward(emit[types[a:b]], starts[a:b], trans, init, pairs=True)
            diff *= -1
            diff[np.arange(b - a), gold[a:b]] += 1
            for k in range(labels):
                per_type[:, k] += np.bincount(types[a:b], diff[:, k], len(counts))
            pairs, first = pairs + own_pairs, first + own_first
        per_type *= scale[:, None]
        g = np.zeros((width, labels))
        for a, b in kinds:
            for k in range(labels):
                g[:, k] += np.bincount(index[first_of[a] : first_of[b]], np.repeat(per_type[a:b, k], counts[a:b]), width)
        w += steps[0].step(g / n - l2 * w)
        trans += steps[1].step((seen_pairs - pairs) / n)
        init += steps[2].step((seen_first - first) / max(1, int(starts.sum())))
    return w, trans, init


def _slices(edges: np.ndarray, of: np.ndarray | None = None, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of about `size` between edges, or of the numbers at these places."""
    of, s = edges if of is None else of, 0
    while s < len(edges) - 1:
        e = max(s + 1, int(np.searchsorted(edges, edges[s] + size, side="right")) - 1)
        yield of[s], of[e]
        s = e
