"""Periodic runs of words by Lyndon arrays on ordered alphabets (Ellert and Fischer's linear-time way).

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, times * q) that no
neighbouring word extends keeping period q. A word is dropped if a run contains it after that run's first q words.

Words are compared as symbols of an ordered alphabet: their ranks by sorting, without hashes. For either order of the alphabet
one pass from left to right finds each suffix's next smaller suffix, that is the longest Lyndon word that begins there,
with the common extension of the two suffixes. A comparison starts from what earlier ones prove: along the chain of previous
smaller suffixes an extension either follows from the last two or goes on where they end; and inside the stretch that was
matched farthest to the right, an extension is that of the same pair one match further left. So every comparison that finds
equal words moves the right border of what was matched, and all take time linear in the number of words. Every run begins a
Lyndon word of its period's length, in one of the orders, within its first q words: its right end is that word's extension. Its left
end is less than a period away and is sought in doubling blocks, once a run.

Runs of at least three periods are dense in repeats: all but the last q words of one stand at most q words before their
next occurrence. Stretches where no scale (q up to 1, 2, 4, ...) has enough such words in a row hold no run and are left out before
the Lyndon arrays are computed; this leaves the result as it is for any text.

Null, empty and wordless texts have no runs and an empty collapsed text. Texts of any length are worked on whole, one row in one
place, so repeated rows give equal results; a map without a shuffle. Other columns pass by untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, small_batches, text_bytes, unpacked, words_of

LEAST, TIMES = 24, 3
#: Columns of eight bytes by which words are ranked before the rest is compared as bytes.
COLUMNS = 8
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _column(raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes of each word from `at`, as one number each; ended by zeros."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        place = at + k
        out |= np.where(place < ends, raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _classes(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (the last counts most), for each place of it the place where its equals begin, and how many they are."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
    heads = np.flatnonzero(new)
    many = np.diff(np.append(heads, len(order)))
    return order, np.repeat(heads, many), np.repeat(many, many)


def word_ranks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: equal for equal words, and in one order for all (first bytes, then length, then the other bytes)."""
    length = ends - starts
    order, head, many = _classes((length, _column(raw, starts, ends)))
    ranks, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    ranks[order], size[order] = head, many
    for k in range(1, COLUMNS + 1):
        tied = np.flatnonzero((size > 1) & (length > 8 * k))
        if not len(tied):
            return ranks
        if k < COLUMNS:
            order, head, many = _classes((_column(raw, starts[tied] + 8 * k, ends[tied]), ranks[tied]))
        else:
            words = [raw[a:b].tobytes() for a, b in zip((starts[tied] + 8 * k).tolist(), ends[tied].tolist())]
            rest = np.empty(len(tied), np.int64)
            last, number = None, -1
            for i in sorted(range(len(tied)), key=words.__getitem__):
                number += words[i] != last
                rest[i], last = number, words[i]
            order, head, many = _classes((rest, ranks[tied]))
        old = ranks[tied[order]]
        first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(old)), 0))
        ranks[tied[order]], size[tied[order]] = old + head - first, many
    return ranks


def lyndon_array(a: list[int], n: int) -> tuple[list[int], list[int]]:
    """For each suffix of a[:n] the place of the next smaller one and their common extension. a[n] is less than all others."""
    after, extent = [n] * n, [0] * n  # next smaller suffix, and how far both agree
    before, agree = [-1] * n, [0] * n  # previous smaller suffix, likewise
    border = shift = left = 0  # a[left : border - shift] = a[left + shift : border]: the match that reaches farthest
    for r in range(1, n):
        i, v, w = r - 1, 0, 0
        while True:
            if w == v:
                if r + v < border and i - shift >= left:
                    m, q = i - shift, r - shift  # the same pair, one match further left
                    known = extent[m] if after[m] == q else agree[q] if before[q] == m else v
                    if known > v:
                        v = known if r + known < border else border - r
                x, y = a[i + v], a[r + v]
                if x == y:
                    v += 1
                    while a[i + v] == a[r + v]:
                        v += 1
                    x, y = a[i + v], a[r + v]
                    if r + v > border:
                        border, shift, left = r + v, r - i, i
                if x < y:
                    before[r], agree[r] = i, v
                    break
            elif w < v:
                before[r], agree[r] = i, w
                break
            after[i], extent[i] = r, v
            w, i = agree[i], before[i]
            if i < 0:
                break
    return after, extent


def _left(x: np.ndarray, i: int, period: int) -> int:
    """How many words before i agree with those a period later; fewer than period."""
    found, block, most = 0, 16, min(i, period - 1)
    while found < most:
        size = min(block, most - found)
        stop = i - found
        differ = np.flatnonzero(x[stop - size : stop] != x[stop - size + period : stop + period])
        if len(differ):
            return found + size - 1 - int(differ[-1])
        found, block = found + size, 2 * block
    return found


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of ranks, by start, then period. times: 3 or more."""
    n = len(x)
    if n < least:
        return []
    found: dict[tuple[int, int], int] = {}
    for order in (x, int(x.max()) - x):
        after, extent = (np.array(c) for c in lyndon_array([*order.tolist(), -1], n))
        at = np.arange(n)
        for i in np.flatnonzero(extent > after - at).tolist():
            key = (int(after[i]) - i, int(after[i] + extent[i]))
            if i < found.get(key, n):
                found[key] = i
    runs = set()
    for (period, end), i in found.items():
        start = i - _left(x, i, period)
        if end - start >= max(least, times * period):
            runs.add((start, end - start, period))
    return sorted(runs)


def dense_stretches(ranks: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of words, each within one text, that hold every run (and may hold none)."""
    n = len(ranks)
    if n < least:
        return []
    order = np.argsort(ranks, kind="stable")
    same = (ranks[order[1:]] == ranks[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    gap = np.full(n, n + 1, np.int64)  # words to the next occurrence in the text
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.bincount(doc).max())
    edges, scale = np.zeros(n + 1, np.int64), 1
    while True:
        near = np.concatenate(([False], gap <= scale, [False]))
        turn = np.flatnonzero(near[1:] != near[:-1])
        a, b = turn[0::2], turn[1::2]
        low = scale // 2 + 1  # periods of this scale are low to scale
        enough = b - a >= max(least - scale, (times - 1) * low)
        np.add.at(edges, a[enough], 1)
        np.add.at(edges, np.minimum(b[enough] + scale, n), -1)
        if times * scale > longest:
            break
        scale *= 2
    inside = np.concatenate(([False], np.cumsum(edges[:n]) > 0, [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    out = []
    for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist()):
        cuts = (np.flatnonzero(doc[a + 1 : b] != doc[a : b - 1]) + a + 1).tolist()
        out += [(s, e) for s, e in zip([a, *cuts], [*cuts, b]) if e - s >= least]
    return out


def text_runs(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Each text's runs, by start, then period, and its kept words joined by one space."""
    raw, starts, ends, first = words_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    ranks = word_ranks(raw, starts, ends)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    gone = np.zeros(len(starts), bool)
    for a, b in dense_stretches(ranks, doc, least, times):
        d = int(doc[a])
        for start, length, period in runs_of(ranks[a:b], least, times):
            runs[d].append((start + a - int(first[d]), length, period))
            gone[a + start + period : a + start + length] = True
    # the kept words' bytes, and the byte after each of them as its space
    stay = ~gone
    step = np.zeros(len(raw) + 1, np.int8)
    step[starts[stay]] = 1
    step[ends[stay] + 1] -= 1
    spaced = raw.copy()
    spaced[ends] = 32
    out = spaced[np.cumsum(step[:-1], dtype=np.int8) > 0].tobytes()
    size = np.concatenate(([0], np.cumsum((ends - starts + 1) * stay)))[first].tolist()
    return runs, [out[a : max(a, b - 1)] for a, b in zip(size[:-1], size[1:])]


def find_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns named in keep (doc_id), then runs (an array of start, length and period by start, then period) and
    collapsed (the text without the words that repeat a run's first period, joined by one space)."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(kept(keep), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            runs, texts = text_runs(text_bytes(batch.column("text")), least, times)
            flat = [r for own in runs for r in own]
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("_keep"), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["_keep", "runs", "collapsed"])

    found = source.mapInArrow(run, f"_keep {source.schema['_keep'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    return unpacked(found, keep, "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))
