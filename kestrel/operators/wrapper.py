"""Wrapper searches over column subsets, for any scorer.

``score_many`` takes a list of subsets and returns their scores (higher is
better); a model scorer fits the candidates of a step concurrently.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

Scorer = Callable[[list[list[str]]], list[float]]


def forward(cols: Sequence[str], score_many: Scorer, k: int, tol: float | None = None) -> list[tuple[int, str, float]]:
    """Add the column that scores best until ``k`` are chosen or the gain is
    below ``tol``; ties go to the earlier column.  Rows: step, column, score."""
    chosen: list[str] = []
    steps: list[tuple[int, str, float]] = []
    while len(chosen) < min(k, len(cols)):
        left = [c for c in cols if c not in chosen]
        scores = score_many([chosen + [c] for c in left])
        best = max(range(len(left)), key=lambda i: (scores[i], -i))
        if tol is not None and steps and scores[best] - steps[-1][2] < tol:
            break
        chosen.append(left[best])
        steps.append((len(chosen), left[best], float(scores[best])))
    return steps


def backward(cols: Sequence[str], score_many: Scorer, k: int, tol: float | None = None):
    """Drop the column whose removal scores best until ``k`` are left or the
    score falls by more than ``tol``; ties drop the later column.  Returns the
    kept columns and rows (number left, column, score)."""
    kept, steps = list(cols), []
    last = score_many([kept])[0]
    while len(kept) > k:
        scores = score_many([[x for x in kept if x != c] for c in kept])
        worst = max(range(len(kept)), key=lambda i: (scores[i], i))
        if tol is not None and last - scores[worst] > tol:
            break
        last = scores[worst]
        steps.append((len(kept) - 1, kept.pop(worst), float(last)))
    return kept, steps


def exhaustive(cols: Sequence[str], score_many: Scorer, min_k: int, max_k: int, at_once: int = 64):
    """Score every subset of ``min_k`` to ``max_k`` columns, ``at_once`` in a call.  Yields (columns, score)."""
    every = (list(s) for n in range(min_k, max_k + 1) for s in itertools.combinations(cols, n))
    while part := list(itertools.islice(every, at_once)):
        yield from zip(part, score_many(part))


def n_subsets(n: int, min_k: int, max_k: int) -> int:
    return sum(math.comb(n, k) for k in range(min_k, max_k + 1))


def subset_at(n: int, min_k: int, number: int) -> list[int]:
    """Positions of subset ``number`` in the order of size, then of positions."""
    k = min_k
    while number >= math.comb(n, k):
        number -= math.comb(n, k)
        k += 1
    out, start = [], 0
    while k:
        below = math.comb(n - start - 1, k - 1)
        if number < below:
            out.append(start)
            k -= 1
        else:
            number -= below
        start += 1
    return out
