"""A bidirectional FM-index over the words of one block, and its two searches with one error.

The text is ``$word$word$...$``.  Suffix ranks of the text and of its reverse
are held by two Burrows-Wheeler transforms in wavelet matrices.  A pattern is
a pair of equally long suffix-rank intervals, one in either; adding a
character on the left narrows the first and places the second by the number
of smaller characters, adding one on the right does the reverse.

All steps work on arrays of intervals, one entry for each state of a search.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starting places of the suffixes of ``text`` in order (its last entry is smaller than all others)."""
    n, base = len(text), int(text.max()) + 1
    packed, reach, room = np.zeros(n, np.int64), 0, 1
    while room * base < 2 ** 62 and reach < n:
        packed[: n - reach] = packed[: n - reach] * base + text[reach:]
        packed[n - reach:] *= base
        room, reach = room * base, reach + 1
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    while rank.max() + 1 < n:                                    # prefix doubling
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class Wavelet:
    """Counts of characters in stretches of a Burrows-Wheeler transform."""

    def __init__(self, bwt: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        now = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = now >> level & 1
            self.zeros_before.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        counts = np.bincount(bwt, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])     # suffixes that begin with a smaller character
        code = np.arange(size)
        at = np.zeros(size, np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            zero = self.zeros_before[k][at]
            at = np.where(code >> level & 1, self.zeros[k] + at - zero, zero)
        self.base = at

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after adding ``code`` on this side: ``(lo, size, other)``; size 0 where nothing matches."""
        a, b, less = lo.copy(), lo + size, np.zeros(len(lo), np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            za, zb = self.zeros_before[k][a].astype(np.int64), self.zeros_before[k][b].astype(np.int64)
            one = (code >> level & 1).astype(bool)
            less += np.where(one, zb - za, 0)
            a = np.where(one, self.zeros[k] + a - za, za)
            b = np.where(one, self.zeros[k] + b - zb, zb)
        return self.first[code] + a - self.base[code], b - a, other + less

    def branches(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray):
        """All characters that can be added: ``(state, code, lo, size, other)``."""
        state, code = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        a, b, less = lo.copy(), lo + size, np.zeros(len(lo), np.int64)
        for k in range(self.bits):
            za, zb = self.zeros_before[k][a].astype(np.int64), self.zeros_before[k][b].astype(np.int64)
            low, high = zb > za, (b - a) > (zb - za)
            state, code, less, a, b = (
                np.concatenate([state[low], state[high]]), np.concatenate([code[low] * 2, code[high] * 2 + 1]),
                np.concatenate([less[low], (less + zb - za)[high]]),
                np.concatenate([za[low], self.zeros[k] + (a - za)[high]]), np.concatenate([zb[low], self.zeros[k] + (b - zb)[high]]))
        return state, code, self.first[code] + a - self.base[code], b - a, other[state] + less


class States(NamedTuple):
    """States of a search: query, next place in its pattern, errors made, and both intervals."""

    query: np.ndarray
    at: np.ndarray
    wrong: np.ndarray
    lo: np.ndarray
    size: np.ndarray
    other: np.ndarray

    def take(self, which: np.ndarray) -> "States":
        return States(*[x[which] for x in self])


def _joined(parts: list[States]) -> States:
    return States(*[np.concatenate(x) for x in zip(*parts)])


class BidirectionalIndex:
    """Index over distinct words; ``END`` is the code of what no word holds, 1 the delimiter."""

    END, DELIMITER, LETTERS = 0, 1, 2

    def __init__(self, words: list[str]):
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.full(len(points) + len(words) + 2, self.DELIMITER, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]            # the delimiter before each word
        inside = np.ones(len(text), bool)
        inside[self.starts] = inside[-2:] = False
        text[inside] = np.searchsorted(self.alphabet, points) + self.LETTERS
        text[-1] = self.END
        size = len(self.alphabet) + self.LETTERS
        self.order = suffix_order(text)
        self.left = Wavelet(text[self.order - 1], size)                           # adds on the left
        mirrored = np.concatenate([text[-2::-1], [self.END]])
        self.right = Wavelet(mirrored[suffix_order(mirrored) - 1], size)
        self.length = len(text)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words' letters one after the other (-1: in no indexed word), and where each word begins."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == points[known]
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return np.where(known, at + self.LETTERS, -1), begins

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, indexed word)`` pairs that differ by one edit, one half of the query being exact.

        Side 0 matches the first half from the delimiter on and goes on to the
        right with one error; side 1 matches the second half up to the
        delimiter and goes on to the left.  The half of ``m`` code points is
        ``m // 2`` long at the front.  Each pair is returned once.
        """
        codes, begins = self.codes(words if side == 0 else [w[::-1] for w in words])
        sizes = np.diff(begins)
        exact = sizes // 2 if side == 0 else sizes - sizes // 2
        wave = self.right if side == 0 else self.left

        def pattern(query: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Code at a place of the pattern; the delimiter past its end."""
            inside = at < sizes[query]
            found = np.full(len(query), self.DELIMITER, np.int64)
            found[inside] = codes[(begins[query] + at)[inside]]
            return found

        def follow(s: States, code: np.ndarray) -> States:
            may = code >= 0
            s, code = s.take(may), code[may]
            lo, size, other = wave.extend(s.lo, s.size, s.other, code)
            on = size > 0
            return States(s.query[on], s.at[on] + 1, s.wrong[on], lo[on], size[on], other[on])

        n = len(words)
        zero = np.zeros(n, np.int64)
        begin = States(np.arange(n), zero - 1, zero, zero, zero + self.length, zero)
        now = follow(begin, np.full(n, self.DELIMITER, np.int64))
        found: list[States] = []
        while len(now.query):
            code = pattern(now.query, now.at)
            halfway = now.at < exact[now.query]                       # still in the exact half
            ended = now.at >= sizes[now.query]
            parts = []
            # The pattern's own character; a finished word needs its one error.
            plain = ~ended | (now.wrong == 1)
            stepped = follow(now.take(plain), code[plain])
            last = stepped.at > sizes[stepped.query]
            found.append(stepped.take(last))
            parts.append(stepped.take(~last))
            free = ~halfway & (now.wrong == 0)
            if free.any():
                s, own = now.take(free), code[free]
                # One character of the query less; of a run of equal ones the last.
                inside = s.at < sizes[s.query]
                drop = inside & (pattern(s.query, s.at + 1) != own)
                left_out = s.take(drop)
                parts.append(left_out._replace(at=left_out.at + 1, wrong=left_out.wrong + 1))
                # Another character instead, or one more (not the one that follows: that one comes after it).
                state, c, lo, size, other = wave.branches(s.lo, s.size, s.other)
                letter = (c >= self.LETTERS) & (c != own[state])
                state, lo, size, other = state[letter], lo[letter], size[letter], other[letter]
                more = States(s.query[state], s.at[state], np.ones(len(state), np.int64), lo, size, other)
                parts.append(more)
                swap = inside[state]
                swapped = more.take(swap)
                parts.append(swapped._replace(at=swapped.at + 1))
            now = _joined(parts)
        done = _joined(found) if found else begin.take(zero[:0])
        # The interval in the text's own suffix order holds the delimiter before the word.
        rank = done.other if side == 0 else done.lo
        which = np.searchsorted(self.starts, self.order[rank])
        return done.query, which
