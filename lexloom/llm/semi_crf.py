"""A semi-Markov conditional random field over candidate segments.

A lattice is a list of candidates (start, end, kind); its paths are all choices of candidates that do not overlap. The score of
a path is the sum of its segments' scores, and a segment's score is the product of the weights of its kind with features of
the whole span. Places outside segments score nothing. Candidates are of bounded length, so the number of
edges, and the time of the sums and of the best path, is linear in the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

Candidate = tuple[int, int, int]


def components(candidates: Sequence[Candidate]) -> list[list[int]]:
    """Groups of candidates (by number) that touch each other through overlaps; independent of one another."""
    order = sorted(range(len(candidates)), key=lambda i: candidates[i])
    groups, reach = [], -1
    for i in order:
        start, end, _ = candidates[i]
        if groups and start < reach:
            groups[-1].append(i)
        else:
            groups.append([i])
        reach = max(reach, end)
    return groups


def _nodes(candidates: Sequence[Candidate]) -> dict[int, int]:
    return {at: i for i, at in enumerate(sorted({p for c in candidates for p in c[:2]}))}


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def marginals(candidates: Sequence[Candidate], scores: Sequence[float]) -> tuple[float, list[float]]:
    """The logarithm of the sum over all paths, and the probability of each candidate."""
    node = _nodes(candidates)
    into: list[list[int]] = [[] for _ in node]
    for i, (_, end, _) in enumerate(candidates):
        into[node[end]].append(i)
    ahead = [0.0] * len(node)
    for n in range(len(node)):
        total = ahead[n - 1] if n else 0.0
        for i in into[n]:
            total = _log_add(total, ahead[node[candidates[i][0]]] + scores[i])
        ahead[n] = total
    behind = [-math.inf] * len(node)
    if node:
        behind[-1] = 0.0
    for n in range(len(node) - 1, -1, -1):
        if n:
            behind[n - 1] = _log_add(behind[n - 1], behind[n])
        for i in into[n]:
            start = node[candidates[i][0]]
            behind[start] = _log_add(behind[start], behind[n] + scores[i])
    total = ahead[-1] if node else 0.0
    chance = [
        math.exp(min(0.0, ahead[node[start]] + score + behind[node[end]] - total))
        for (start, end, _), score in zip(candidates, scores)
    ]
    return total, chance


def best_path(candidates: Sequence[Candidate], scores: Sequence[float]) -> list[int]:
    """The candidates of the best path, in order; nothing is chosen where that is as good."""
    node = _nodes(candidates)
    into: list[list[int]] = [[] for _ in node]
    for i, (_, end, _) in enumerate(candidates):
        into[node[end]].append(i)
    best, back = [0.0] * len(node), [-1] * len(node)
    for n in range(len(node)):
        best[n] = best[n - 1] if n else 0.0
        for i in into[n]:
            here = best[node[candidates[i][0]]] + scores[i]
            if here > best[n]:
                best[n], back[n] = here, i
    chosen, n = [], len(node) - 1
    while n >= 0:
        if back[n] < 0:
            n -= 1
        else:
            chosen.append(back[n])
            n = node[candidates[back[n]][0]]
    return chosen[::-1]


class SemiCrf:
    """Weights of each kind over the features of a span."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, candidates: Sequence[Candidate], features: np.ndarray) -> list[float]:
        kinds = np.fromiter((c[2] for c in candidates), np.int64, len(candidates))
        return np.einsum("ij,ij->i", features, self.weights[kinds]).tolist()

    def decode(self, candidates: Sequence[Candidate], features: np.ndarray, least: float) -> list[int]:
        """Candidates of the best path whose own probability is at least ``least``."""
        if not candidates:
            return []
        scores, out = self.scores(candidates, features), []
        for group in components(candidates):
            mine, score = [candidates[i] for i in group], [scores[i] for i in group]
            chosen = best_path(mine, score)
            if chosen:
                _, chance = marginals(mine, score)
                out += [group[i] for i in chosen if chance[i] >= least]
        return out


def log_likelihood(
    weights: np.ndarray, lattices: list[tuple[list[Candidate], list[int]]], features: np.ndarray, kinds: np.ndarray, penalty: float
) -> tuple[float, np.ndarray]:
    """Penalised log likelihood of the given paths and its gradient.

    ``lattices`` lists candidates and the numbers of those on the true path; ``features`` and ``kinds`` are of all candidates of
    all lattices, in order.
    """
    scores = np.einsum("ij,ij->i", features, weights[kinds])
    value, pull, at = -0.5 * penalty * float((weights**2).sum()), np.zeros(len(kinds)), 0
    for candidates, truth in lattices:
        mine = scores[at : at + len(candidates)].tolist()
        total, chance = marginals(candidates, mine)
        value += sum(mine[i] for i in truth) - total
        pull[at : at + len(candidates)] = -np.array(chance)
        for i in truth:
            pull[at + i] += 1
        at += len(candidates)
    gradient = -penalty * weights
    for kind in range(len(weights)):
        mine = kinds == kind
        gradient[kind] += pull[mine] @ features[mine]
    return value, gradient


def fit(
    lattices: list[tuple[list[Candidate], list[int]]],
    features: np.ndarray,
    n_kinds: int,
    penalty: float = 0.1,
    rounds: int = 50,
    rate: float = 0.25,
) -> SemiCrf:
    """The weights that make the given paths likeliest, by whole-batch steps with a momentum for each weight."""
    kinds = np.array([c[2] for candidates, _ in lattices for c in candidates], np.int64)
    weights = np.zeros((n_kinds, features.shape[1]))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        _, gradient = log_likelihood(weights, lattices, features, kinds, penalty)
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return SemiCrf(weights)
