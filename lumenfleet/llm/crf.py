"""A linear-chain conditional random field in numpy: training by gradient, Viterbi and forward-backward over padded batches.

Every chain starts and ends beside label 0 ("outside"), so a stretch that can only be 0 separates what stands on its two sides.
"""

from __future__ import annotations

import numpy as np


def padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, steps): where the tokens of chains, one after another, go in an array of chains by steps."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return rows, steps


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability of each label at each token by forward-backward; with pairs, also the expected moves and the log partition sums.

    emissions: tokens by labels, chain after chain; moves[a, b]: score of label b behind a.
    """
    n, k = len(lengths), emissions.shape[1]
    rows, steps = padded(lengths)
    longest = int(lengths.max(initial=0))
    e = np.zeros((longest, n, k))
    e[steps, rows] = emissions
    forward, backward = np.empty_like(e), np.empty_like(e)
    live = np.arange(longest)[:, None] < lengths[None, :]
    for t in range(longest):
        forward[t] = e[t] + (moves[0][None, :] if t == 0 else _sum_exp(forward[t - 1][:, :, None] + moves[None], 1))
    last = np.broadcast_to(moves[:, 0], (n, k))
    for t in range(longest - 1, -1, -1):
        if t == longest - 1:
            backward[t] = last
        else:
            after = _sum_exp(moves[None] + (e[t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(live[t + 1][:, None], after, last)
    z = _sum_exp(forward[0] + backward[0], 1) if longest else np.zeros(n)
    p = np.exp(forward[steps, rows] + backward[steps, rows] - z[rows][:, None])
    if not pairs:
        return p
    expected = np.zeros((k, k))
    expected[0] += np.exp(forward[0] + backward[0] - z[:, None]).sum(0)
    end = np.exp(forward[lengths - 1, np.arange(n)] + last - z[:, None])
    expected[:, 0] += end.sum(0)
    for t in range(longest - 1):
        on = live[t + 1]
        expected += np.exp(forward[t][on][:, :, None] + moves[None] + (e[t + 1] + backward[t + 1])[on][:, None, :] - z[on][:, None, None]).sum(0)
    return p, expected, z


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label of each token, chain after chain."""
    n, k = len(lengths), emissions.shape[1]
    if not n:
        return np.zeros(0, np.int64)
    rows, steps = padded(lengths)
    longest = int(lengths.max())
    e = np.zeros((longest, n, k))
    e[steps, rows] = emissions
    best, back = e[0] + moves[0], np.zeros((longest, n, k), np.int64)
    scores = np.empty_like(e)
    scores[0] = best
    for t in range(1, longest):
        through = scores[t - 1][:, :, None] + moves[None]
        back[t] = through.argmax(1)
        scores[t] = through.max(1) + e[t]
    label = np.zeros((longest, n), np.int64)
    at = np.arange(n)
    for t in range(longest - 1, -1, -1):
        ends = lengths - 1 == t
        now = (scores[t] + moves[:, 0]).argmax(1)
        label[t] = now if t == longest - 1 else np.where(ends, now, back[t + 1][at, label[t + 1]])
    return label[steps, rows]


#: Cells (steps x chains x labels) of a rectangle at most; tokens of a chain that go at once, and tokens of context on both sides of them.
CELLS, LONGEST, AROUND = 1 << 20, 2048, 64


def in_rectangles(run, emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """run (viterbi or marginals) over chains of any lengths in bounded memory: chains of like length go together, as many as a rectangle holds.
    A chain of more than LONGEST tokens goes in windows, each decided with AROUND tokens of context on both sides; shorter ones are
    decided as run does."""
    lengths = np.asarray(lengths, np.int64)
    begins = np.cumsum(lengths) - lengths
    # (first token, tokens, tokens of context before, tokens that count): one for each usual chain
    pieces = [np.column_stack([begins, lengths, np.zeros_like(lengths), lengths])[(lengths <= LONGEST) & (lengths > 0)]]
    for begin, n in zip(begins[lengths > LONGEST], lengths[lengths > LONGEST], strict=True):
        at = np.arange(0, n, LONGEST)
        low, high = np.maximum(at - AROUND, 0), np.minimum(at + LONGEST + AROUND, n)
        pieces.append(np.column_stack([begin + low, high - low, at - low, np.minimum(at + LONGEST, n) - at]))
    pieces = np.concatenate(pieces)
    pieces = pieces[np.argsort(pieces[:, 1], kind="stable")]
    out, at = None, 0
    while at < len(pieces):
        most = max(1, CELLS // (int(pieces[at, 1]) * emissions.shape[1]))
        some = pieces[at : at + most]
        fits = np.arange(1, len(some) + 1) * some[:, 1] * emissions.shape[1] <= CELLS
        some = some[: max(1, int(fits.sum()))]  # sizes grow, so the fits come first
        at += len(some)
        rows, steps = padded(some[:, 1])
        found = run(emissions[some[rows, 0] + steps], some[:, 1], moves)
        out = np.zeros((int(lengths.sum()), *found.shape[1:]), found.dtype) if out is None else out
        counts = (steps >= some[rows, 2]) & (steps < some[rows, 2] + some[rows, 3])
        out[(some[rows, 0] + steps)[counts]] = found[counts]
    return run(emissions, lengths, moves) if out is None else out


def train(features: list[np.ndarray], n_features: int, labels: np.ndarray, lengths: np.ndarray, n_labels: int, steps: int = 200, l2: float = 0.01, rate: float = 0.3, forbid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by labels) and moves by Adam on the penalized log likelihood.

    features: the feature numbers of each token; forbid: moves that can't be, kept at -1e4.
    """
    tokens = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    weights, moves = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    bad = np.zeros_like(moves, bool) if forbid is None else forbid
    moves[bad] = -1e4
    truth = np.zeros((len(labels), n_labels))
    truth[np.arange(len(labels)), labels] = 1
    seen = np.zeros_like(moves)
    at = np.cumsum(lengths) - lengths
    for a, n in zip(at, lengths, strict=True):
        path = [0, *labels[a : a + n], 0]
        np.add.at(seen, (path[:-1], path[1:]), 1)
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    scale = 1 / max(1, len(labels))
    for step in range(1, steps + 1):
        e = np.zeros((len(labels), n_labels))
        np.add.at(e, tokens, weights[flat])
        p, expected, _ = marginals(e, lengths, moves, pairs=True)
        g_w = np.zeros_like(weights)
        np.add.at(g_w, flat, (truth - p)[tokens])
        grads = [g_w * scale - l2 * scale * weights, np.where(bad, 0, (seen - expected) * scale - l2 * scale * np.where(bad, 0, moves))]
        for x, g, m, v in ((weights, grads[0], state[0], state[1]), (moves, grads[1], state[2], state[3])):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, moves
