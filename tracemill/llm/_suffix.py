"""Suffix arrays over token numbers, many documents at a time."""

from __future__ import annotations

import numpy as np


def suffix_array(key: np.ndarray, end: np.ndarray, deepest: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4 ... tokens.

    key: a number for each token, of any order; end: where each token's
    document ends.  A suffix stops there and sorts before its extensions.
    Only suffixes that are still tied are sorted again.  deepest: stop once the
    order by so many tokens is known.
    """
    n = len(key)
    if n == 0:
        return np.zeros(0, np.int64), []
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    levels = [rank.astype(np.int32 if n < 1 << 31 else np.int64)]
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    k = 1
    while len(slots) and (deepest is None or k < deepest):
        at = sa[slots]
        beyond = at + k
        second = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[slots] = at
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        fresh[1:] = both[1:] != both[:-1]
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        levels.append(rank.astype(levels[0].dtype))
        still = ~fresh
        still[:-1] |= ~fresh[1:]
        slots = slots[still]
        k *= 2
    return sa, levels


def adjacent_lcp(sa: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array (the first has 0)."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[pair - 1].copy(), sa[pair].copy()
    enda, endb = end[a], end[b]
    got = np.zeros(len(pair), np.int64)
    for step in reversed(range(len(levels))):
        size = 1 << step
        for _ in range(2 if step == len(levels) - 1 else 1):
            fits = (a + size <= enda) & (b + size <= endb)
            same = fits & (levels[step][np.minimum(a, n - 1)] == levels[step][np.minimum(b, n - 1)])
            a += same * size
            b += same * size
            got += same * size
    lcp[pair] = got
    return lcp
