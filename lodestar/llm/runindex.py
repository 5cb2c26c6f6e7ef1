"""A run-length index of a text: its run-compressed Burrows-Wheeler transform with suffix-array samples at run ends.

Within a run of the transform the longest common prefixes with the neighbouring suffixes follow from the sample of an
earlier text position, one less for each step. So the samples at run ends, streamed in text order, give the matching
statistics of every position against all other suffixes. Repetitive texts have few runs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling from 7 symbols; only suffixes that still tie are sorted again."""
    n = len(t)
    padded = np.concatenate((t.astype(np.int64) + 1, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    # a rank is the place of the first of its ties
    place = np.arange(n)
    new = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    h = 7
    while True:
        r = rank[sa]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] = same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        who = sa[at]
        later = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = r[at] * (n + 1) + later
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        sa[at] = who
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, eight bytes at a time."""
    n = len(t)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((t, np.zeros(8, np.uint8))), 8)
    out, live, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        inside = np.maximum(x, y) < n
        same = np.zeros((len(live), 8), bool)
        ok = np.flatnonzero(inside)
        same[ok] = words[x[ok]] == words[y[ok]]
        room = np.clip(n - np.maximum(x, y), 0, 8)
        length = np.minimum(np.where(same.all(axis=1), 8, np.argmin(same, axis=1)), room)
        out[live] += length
        live, step = live[length == 8], step + 8
    return out


class RunIndex:
    """Runs of the transform: ``symbols`` and ``lengths``, with the suffix-array samples ``first`` and ``last`` of each."""

    def __init__(self, t: np.ndarray):
        self.t = t
        sa = suffix_array(t)
        before = np.where(sa > 0, t[sa - 1].astype(np.int64), -1)  # -1: the text's end
        cut = np.flatnonzero(before[1:] != before[:-1]) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
        self.symbols, self.lengths = before[begin], end - begin
        self.first, self.last = sa[begin], sa[end - 1]

    def matches(self) -> np.ndarray:
        """For each position the length of the longest match that starts at another position as well."""
        common = _common(self.t, self.last[:-1], self.first[1:])
        up = self._streamed(self.first, np.concatenate(([0], common)))
        down = self._streamed(self.last, np.concatenate((common, [0])))
        return np.maximum(up, down)

    def _streamed(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        value, here = np.zeros(len(self.t), np.int64), np.zeros(len(self.t), np.int64)
        value[at], here[at] = length, at
        here = np.maximum.accumulate(here)
        return value[here] - (np.arange(len(self.t)) - here)
