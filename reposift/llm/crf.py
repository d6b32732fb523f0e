"""Linear-chain conditional random field with two states over sets of features, trained and decoded in NumPy."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np


class Crf(NamedTuple):
    """``weights``: what each feature adds to state 1 against state 0; ``steps[a, b]``: weight of going from a to b."""

    weights: dict[str, float]
    steps: np.ndarray

    def viterbi(self, scores: Sequence[float]) -> list[int]:
        """The best states of a sequence whose blocks score ``scores`` for state 1 (and 0 for state 0); ties go to 0."""
        (a00, a01), (a10, a11) = self.steps.tolist()
        none, one, back = 0.0, 0.0, []
        for i, score in enumerate(scores):
            if i:
                from0, from1 = (none + a00, one + a10), (none + a01, one + a11)
                back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
                none, one = max(from0), max(from1) + score
            else:
                one = score
        states = [int(one > none)] if scores else []
        for choice in reversed(back):
            states.append(choice[states[-1]])
        return states[::-1]


def _expected(unary: np.ndarray, steps: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of state 1 at each place, expected steps, and the log of all sequences' total, over a padded batch."""
    many, longest = unary.shape
    inside = np.arange(longest)[None, :] < lengths[:, None]
    scores = np.stack([np.zeros_like(unary), unary], axis=2)
    forward = np.empty_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, longest):
        forward[:, t] = np.logaddexp(*np.moveaxis(forward[:, t - 1, :, None] + steps, 1, 0)) + scores[:, t]
    backward = np.zeros_like(scores)
    for t in range(longest - 2, -1, -1):
        more = steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(more[..., 0], more[..., 1]), 0.0)
    total = np.logaddexp(*forward[np.arange(many), lengths - 1].T)
    one = np.where(inside, np.exp(forward[..., 1] + backward[..., 1] - total[:, None]), 0.0)
    moves = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            log = forward[:, :-1, a] + steps[a, b] + scores[:, 1:, b] + backward[:, 1:, b] - total[:, None]
            moves[a, b] = np.exp(np.where(inside[:, 1:], log, -np.inf)).sum()
    return one, moves, float(total.sum())


def train(pages: list[tuple[list[Sequence[str]], list[int]]], rounds: int = 200, rate: float = 0.15, ridge: float = 0.0003, least: int = 3) -> Crf:
    """Most likely weights under a ridge by Adam on all pages at once; the same pages give the same weights.

    ``pages`` are (features of each block, state of each block).  Features that
    fewer than ``least`` blocks have get no weight.
    """
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for blocks, _ in pages:
        for block in blocks:
            for feature in block:
                seen[feature] = seen.get(feature, 0) + 1
    known = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    lengths = np.array([len(b) for b, _ in pages])
    shape = len(pages), int(lengths.max())
    cell, feature, truth = [], [], np.zeros(shape)
    for p, (blocks, states) in enumerate(pages):
        truth[p, : len(states)] = states
        for t, block in enumerate(blocks):
            own = [known[f] for f in block if f in known]
            cell += [p * shape[1] + t] * len(own)
            feature += own
    cell, feature = np.array(cell), np.array(feature)
    moved = np.zeros((2, 2))
    for _, states in pages:
        np.add.at(moved, (states[:-1], states[1:]), 1)
    size = len(known)
    values, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, rounds + 1):
        unary = np.bincount(cell, values[feature], shape[0] * shape[1]).reshape(shape)
        one, moves, _ = _expected(unary, values[size:].reshape(2, 2), lengths)
        slope = np.r_[np.bincount(feature, (one - truth).ravel()[cell], size), (moves - moved).ravel()] / len(pages) + ridge * values
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Crf({f: float(values[i]) for f, i in known.items()}, values[size:].reshape(2, 2).copy())
