"""Suffix arrays of many short byte strings by induced sorting, in numpy."""

from __future__ import annotations

import numpy as np

from mailrank.llm.common import ranges

SYMBOLS_A_WORD = 6  # of ten bits each, in an int64


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), False for larger ones (L); the last is S."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32)))
    step = np.append(step, 1)
    at = np.where(step != 0, np.arange(n), n - 1)
    # Equal neighbours take the type of the next difference to the right.
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def name_substrings(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost S place to the next one, equal ones alike."""
    n = len(s)
    symbols = 2 * s.astype(np.int64) + small + 1
    ends = np.append(lms[1:], n - 1) + 1  # one past the last symbol
    rank = np.zeros(len(lms), np.int64)
    active = np.arange(len(lms))
    offset = 0
    while len(active):
        at = lms[active, None] + offset + np.arange(SYMBOLS_A_WORD)
        inside = at < ends[active, None]
        words = np.where(inside, symbols[np.minimum(at, n - 1)], 0)
        key = np.zeros(len(active), np.int64)
        for k in range(SYMBOLS_A_WORD):
            key = (key << 10) | words[:, k]
        order = np.lexsort((key, rank[active]))
        a, k = rank[active][order], key[order]
        new = np.concatenate([[False], (np.diff(a) != 0) | (np.diff(k) != 0)])
        fresh = np.concatenate([[True], np.diff(a) != 0])
        # Ranks are the place of the first of a class; a class splits at its own place.
        place = np.arange(len(order))
        group = np.maximum.accumulate(np.where(new | fresh, place, 0))
        base = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[active[order]] = a + group - base
        size = np.bincount(np.cumsum(new | fresh) - 1)
        crowd = size[np.cumsum(new | fresh) - 1] > 1
        still = active[order][crowd]
        offset += SYMBOLS_A_WORD
        active = still[lms[still] + offset < ends[still]]
        # Those that end here while others of their class go on cannot be: ends differ in type.
    return rank


def sort_reduced(rank: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of the names: names of twice the length again and again, until all
    differ or ``most`` names are compared."""
    n = len(rank)
    span = 1
    order = np.argsort(rank, kind="stable")
    while span < most and n and np.any(np.diff(rank[order]) == 0):
        after = np.zeros(n, np.int64)
        after[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(k) != 0]), np.arange(n), 0))
        span *= 2
    return order


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the sorted leftmost S ones; a bucket of one symbol at a time."""

    def deal(found: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
        c = s[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        for at, part in zip([0, *cuts.tolist()], np.split(found, cuts)):
            buckets[int(c[at])].append(part)

    def before(x: np.ndarray, want: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[small[x] == want]

    none = np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    rest: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    if len(lms):
        deal(lms, seeds)
    # Nothing induces the end of the text; it is the smallest of all.
    rest[int(s[-1])].append(np.array([len(s) - 1]))
    done_large = [none] * symbols
    for c in range(symbols):
        wave = np.concatenate(large[c]) if large[c] else none
        all_waves = []
        while len(wave):
            all_waves.append(wave)
            up = before(wave, False)
            same = s[up] == c
            if (~same).any():
                deal(up[~same], large)
            wave = up[same]
        done_large[c] = np.concatenate(all_waves) if all_waves else none
        if seeds[c]:
            up = before(np.concatenate(seeds[c]), False)
            if len(up):
                deal(up, large)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        wave = np.concatenate(rest[c]) if rest[c] else none
        all_waves = []
        while len(wave):
            all_waves.append(wave)
            up = before(wave, True)
            same = s[up] == c
            if (~same).any():
                deal(up[~same], rest)
            wave = up[same]
        down = done_large[c][::-1]
        if len(down):
            up = before(down, True)
            if len(up):
                deal(up, rest)
        found = np.concatenate(all_waves) if all_waves else none
        out.append(found)
        out.append(down)
    return np.concatenate(out)[::-1]


def suffix_array(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings, a separator (1) before each and an end (0) after all, bytes from 2 on; and its
    suffixes sorted by at least their first ``depth`` bytes (wholly, where the text is no longer)."""
    n = np.diff(off)
    s = np.zeros(len(data) + len(n) + 1, np.int16)
    at = np.arange(len(data)) + np.repeat(np.arange(len(n)), n) + 1
    s[at] = data.astype(np.int16) + 2
    s[off[:-1] + np.arange(len(n))] = 1
    small = classify(s)
    lms = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]]))
    rank = name_substrings(s, small, lms)
    order = sort_reduced(rank, max(1, -(-depth // 2) + 1))
    return s, induce(s, small, lms[order], 258)


def common_prefix_reaches(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By place in the text: whether its suffix shares ``length`` bytes, none a separator, with the
    suffix before it in ``order`` (the permuted common prefixes, cut at ``length``)."""
    n = len(s)
    out = np.zeros(n, bool)
    breaks = np.concatenate([[0], np.cumsum(s < 2)])
    whole = np.zeros(n, bool)
    last = n - length
    if last < 0:
        return out
    whole[: last + 1] = breaks[length : n + 1] == breaks[: n - length + 1]
    a, b = order[:-1], order[1:]
    both = whole[a] & whole[b]
    a, b = a[both], b[both]
    narrow = (s - 2).astype(np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(narrow, 8)
    packed = np.ascontiguousarray(words).view(np.uint64).ravel() if length >= 8 else None
    steps = list(range(0, length - 7, 8)) + ([length - 8] if length % 8 else [])
    for k in steps:
        same = packed[a + k] == packed[b + k]
        a, b = a[same], b[same]
    out[b] = True
    return out


def repeated_windows(data: np.ndarray, off: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes that also occur at a smaller ``start``: string and place in it.

    ``start`` holds, for each string, a number that grows with its place in the corpus, with
    room for places inside it.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, order = suffix_array(data, off, length)
    same = common_prefix_reaches(s, order, length)[order]
    group = np.cumsum(~same)
    crowd = np.bincount(group)[group] > 1
    at, group = order[crowd], group[crowd]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(off[:-1] + np.arange(len(off) - 1) + 1, at, side="right") - 1
    inside = at - (off[owner] + owner + 1)
    where = start[owner] + inside
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    first = np.minimum.reduceat(where, heads)
    later = where > np.repeat(first, np.diff(np.append(heads, len(group))))
    return owner[later], inside[later]
