"""Suffix arrays by induced sorting, and permuted common prefixes.

Symbols are numbers; the last is 0 and stands nowhere else. Suffixes are classified as smaller or larger than the next one; the
leftmost smaller ones' substrings are sorted by induction and named, the names are sorted recursively, and the whole array is induced from them.

The first level works bucket by bucket with array operations: an alphabet of at most `small` symbols, and beyond it marks that
stand between smaller symbols. The suffixes of a bucket induce those before them in the order they stand, all at once; what they induce in
their own bucket (equal symbols in a row) follows in rounds. A mark's suffix is always larger and both its neighbours are no marks, so all
buckets of marks are one step. The names of deeper levels, at most half as many at each, are sorted one by one.
"""

from __future__ import annotations

import numpy as np


def _classified(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last is)."""
    n = len(t)
    turn = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # the last of each row of equal symbols
    smaller = np.append(t[turn[:-1]] < t[turn[:-1] + 1], True)
    return np.repeat(smaller, np.diff(np.append(-1, turn)))


def _induce(t: np.ndarray, sym: np.ndarray, seeds: np.ndarray, small: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Larger and smaller suffixes of each bucket in their order, induced from seeds. sym: symbols, all marks as `small`."""
    present = np.flatnonzero(np.bincount(sym, minlength=small + 1)).tolist()
    none = np.zeros(0, seeds.dtype)
    own: list[list[np.ndarray]] = [[] for _ in range(small + 1)]

    def give(into: list[list[np.ndarray]], rows: np.ndarray) -> None:
        at = sym[rows]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for s, part in zip(at[np.append(0, cuts)].tolist() if len(at) else [], np.split(rows, cuts)):
            into[s].append(part)

    give(own, seeds)
    seeded = [np.concatenate(x) if x else none for x in own]
    larger: list[list[np.ndarray]] = [[] for _ in range(small + 1)]
    for c in present:
        got = larger[c]
        last = np.concatenate(got) if got else none
        rounds = [last]
        while len(last) and c < small:
            last = last[last > 0] - 1
            last = last[sym[last] == c]
            rounds.append(last)
        larger[c] = rounds
        if c < small:
            before = np.concatenate((*rounds, seeded[c]))
            before = before[before > 0] - 1
            give(larger, before[sym[before] > c])
    done = [np.concatenate(x) if x else none for x in larger]
    marks = done[small]
    done[small] = marks = marks[np.argsort(t[marks], kind="stable")]
    smaller: list[list[np.ndarray]] = [[] for _ in range(small)]  # from the bucket's end on
    marks = marks[::-1]
    give(smaller, marks[marks > 0] - 1)
    for c in reversed([c for c in present if c < small]):
        got = smaller[c]
        last = np.concatenate(got) if got else none
        rounds = [last]
        while len(last):
            last = last[last > 0] - 1
            last = last[sym[last] == c]
            rounds.append(last)
        smaller[c] = rounds
        before = np.concatenate((*rounds, done[c][::-1]))
        before = before[before > 0] - 1
        give(smaller, before[sym[before] < c])
    below = [np.concatenate(x)[::-1] if x else none for x in smaller]
    below[0] = np.array([len(t) - 1], seeds.dtype)  # the end, which nothing induces
    return done, [*below, none], present


def _names(t: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rising numbers of the leftmost smaller substrings in sorted order, equal for equal ones. at: their places, rising."""
    length = np.diff(np.append(at, len(t) - 1)) + 1
    size = length[np.searchsorted(at, order)]
    a, b = order[:-1], order[1:]
    alike = size[:-1] == size[1:]
    live, k = np.flatnonzero(alike), 0
    while len(live):
        same = t[a[live] + k] == t[b[live] + k]
        alike[live[~same]] = False
        k += 1
        live = live[same & (size[live] > k)]
    return np.cumsum(np.append(0, ~alike))


def suffix_array(t: np.ndarray, small: int) -> np.ndarray:
    """Places of the suffixes of t in rising order. t[-1] = 0; symbols from `small` on have smaller ones beside them."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    smaller = _classified(t)
    sym = np.minimum(t, small).astype(np.uint16)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    _, below, present = _induce(t, sym, seeds, small)
    order = np.concatenate([below[c] for c in present])
    order = order[(order > 0) & smaller[order] & ~smaller[order - 1]]
    names = _names(t, order, seeds)
    if names[-1] + 1 < len(names):
        text = np.empty(len(seeds), np.int64)
        text[np.searchsorted(seeds, order)] = names
        order = seeds[np.array(induced_order(text.tolist(), int(names[-1]) + 1))]
    done, below, present = _induce(t, sym, order, small)
    return np.concatenate([x for c in present for x in (done[c], below[c])])


def induced_order(s: list[int], kinds: int) -> list[int]:
    """Suffix array of a list of numbers below kinds whose last is 0 and stands nowhere else."""
    n = len(s)
    if n == 1:
        return [0]
    smaller = bytearray(n)
    smaller[n - 1] = 1
    follow = 0
    for i in range(n - 2, -1, -1):
        x = s[i]
        if x < follow or x == follow and smaller[i + 1]:
            smaller[i] = 1
        follow = x
    counts = [0] * kinds
    for x in s:
        counts[x] += 1
    heads, total = [0] * kinds, 0
    for c, many in enumerate(counts):
        heads[c] = total
        total += many
    seeds = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = [h + c for h, c in zip(heads, counts)]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads[:]
        for i in sa:
            if i > 0 and not smaller[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = [h + c for h, c in zip(heads, counts)]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and smaller[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    order = [i for i in induce(seeds) if i > 0 and smaller[i] and not smaller[i - 1]]
    end = dict(zip(seeds, [*seeds[1:], n - 1]))
    named, name, last = {}, -1, None
    for i in order:
        part = s[i : end[i] + 1]
        if part != last:
            name, last = name + 1, part
        named[i] = name
    if name + 1 < len(order):
        below = induced_order([named[i] for i in seeds], name + 1)
        order = [seeds[k] for k in below]
    return induce(order)


def common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, above) by place: the common prefix of each suffix with the one above it in the array, counted up to the first symbol
    that is `stop` or less, and the place of that one (-1 for the first).

    Where the symbols before both are equal too, the prefix is one shorter than that of the place before; only the others are compared.
    """
    n = len(t)
    above = np.full(n, -1, np.int64)
    above[sa[1:]] = sa[:-1]
    begins = np.ones(n, bool)
    begins[1:] = (above[1:] <= 0) | (t[:-1] <= stop) | (t[:-1] != t[np.maximum(above[1:], 1) - 1])
    at = np.flatnonzero(begins & (above >= 0))
    with_ = above[at]
    found = np.zeros(n, np.int64)
    live, k = np.arange(len(at)), 0
    while len(live):
        x = t[at[live] + k]
        live = live[(x == t[with_[live] + k]) & (x > stop)]
        k += 1
        found[at[live]] = k
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    return np.maximum(found[first] - (np.arange(n) - first), 0), above
