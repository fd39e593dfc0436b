"""Substring dedup by recompression.

A word that lies in a window of `window` consecutive words whose sequence also starts earlier (in a
smaller doc_id, or earlier in the same document) is removed; windows are judged on the input.

Recompression gives equal word sequences equal interior symbols: each round names maximal runs of one
symbol, then pairs of a left and a right symbol (each symbol's side follows from its name). Names are
64-bit mixes of what they stand for, so every task of every Spark stage gives equal content the same name and
a naming round needs no dictionary exchange; what is exchanged is which names are met twice.

* Revealing symbols: a cut at a sequence's border spoils a bounded number of words a round, so `rounds_for(window)`
  says how many rounds leave every window a whole, equally named stretch; within any such stretch the same
  symbol (the least of the stretch) becomes an anchor, named with the words around it that every window holding the
  stretch also holds. Runs of two or three may pair to symbols so long that none lies whole in a stretch; then the
  window itself is an anchor.
* Verifying symbols: a window's popped sequence. In each of LEVELS rounds the runs at its two ends and end symbols
  that might pair beyond it are popped, the rest goes up a level; what is left at the top stands for
  itself. Two windows are equal if and only if their popped sequences are, wherever they stand.

1. Each task names its texts and deals its anchors by name; a task keeps one anchor of a name and marks
   the others as repeated itself, so no name meets in one place more often than there are tasks' chunks.
2. Names met twice mark their anchors as repeated; marks go back by document.
3. Only windows that hold a repeated anchor are named by their popped sequences (96 bits) and dealt by that name,
   again one a chunk; all but the first of equal windows are marked.
4. Marks go back by document and the covered words go.

Between the steps travel packed arrays, one row for each chunk and bucket; a task settles its buckets one at a time.

A row is known by its doc_id and its text's hash. Rows under one doc_id with other texts are documents of their own
that stand next to each other, in the order of those hashes; so are rows without a doc_id, which come first. Rows with
equal doc_id and text are one document, and each gives the same result. Null and empty texts have no words; texts
of any length are worked on whole; extra columns stay out of the exchanges. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, mix64, shuffle_partitions, small_batches, text_bytes, word_hashes, words_of

WINDOW = 20
#: Runs of so many symbols are anchors by their symbol alone, for a window may cut them anywhere.
LONG_RUN = 4
#: Rounds of naming that a window's popped sequence goes through; any number is exact, more leave fewer symbols at the top.
LEVELS = 3
PARTS = 16
#: Anchors or windows that a task holds before it deals them.
HELD = 500_000
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_FIRST, _SECOND = Powers(0xC6A4A7935BD1E995), Powers(0x9FB21C651E98DF25)
NO_ID = -(1 << 63)


def rounds_for(window: int) -> tuple[int, int, int]:
    """(rounds, lost, stretch): as many rounds as leave every window a stretch of the longest symbol's length, the words
    lost on either side of it, and its length in words."""
    rounds, lost, span = 0, 0, 1
    while window - 2 * (lost + 2 * (LONG_RUN - 1) * span) >= 2 * (LONG_RUN - 1) * span:
        lost, span, rounds = lost + 2 * (LONG_RUN - 1) * span, 2 * (LONG_RUN - 1) * span, rounds + 1
    return rounds, lost, window - 2 * lost


def anchors(names: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor names, first words, and the first and last window start that holds each, by word number of the chunk.

    names, doc: hash and text number of each word. Every window's own stretch has an anchor with `lost` words of
    the window on either side; those words join the anchor's name, so that common words alone name nothing. A window
    without one is its own anchor, unless it holds a long run of words.
    """
    rounds, lost, stretch = rounds_for(window)
    hashes = names
    n = len(names)
    start, end, own = np.arange(n), np.arange(1, n + 1), doc
    runs: list[tuple[np.ndarray, ...]] = []
    covered = np.zeros(n + 1, np.int32)  # steps of the number of long runs of words that a window holds
    for r in range(rounds):
        if not len(names):
            break
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(names)))
        last = head + length - 1
        long = length >= LONG_RUN
        if long.any():
            a, b = head[long], last[long]
            run = (mix64(names[a] ^ _SALT[0]), start[a], end[a + LONG_RUN - 1] - window, start[b - LONG_RUN + 1])
            within = end[b] - start[a] > window  # a run that holds equal windows itself counts twice
            runs += [run, tuple(x[within] for x in run)]
            if r == 0:
                low, high = np.maximum(run[2], 0), run[3]
                np.add.at(covered, low[low <= high], 1)
                np.add.at(covered, high[low <= high] + 1, -1)
        named = np.where(length > 1, mix64(names[head] + length.astype(np.uint64) * _SALT[1]), names[head])
        start, end, own = start[head], end[last], own[head]
        right = (mix64(named ^ (_SALT[2] + np.uint64(r))) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(named), bool)
        joins[:-1] = ~right[:-1] & right[1:] & (own[1:] == own[:-1])
        at = np.flatnonzero(joins)
        named[at] = mix64(named[at] * _SALT[3] + named[at + 1])
        end = end.copy()
        end[at] = end[at + 1]
        stay = np.ones(len(named), bool)
        stay[at + 1] = False
        names, start, end, own = named[stay], start[stay], end[stay], own[stay]
    key = np.full(n + stretch, np.iinfo(np.uint64).max, np.uint64)
    close = np.full(n + stretch, n + 10 * stretch, np.int64)
    key[start] = mix64(names ^ _SALT[4])
    close[start] = end
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    bound = np.arange(n) + stretch
    for o in range(stretch):
        np.minimum(least, np.where(close[o : n + o] <= bound, key[o : n + o], least), out=least)
    chosen = np.zeros(n + stretch, bool)
    reached = np.zeros(n, bool)
    for o in range(stretch):
        reached |= close[o : n + o] <= bound
    for o in range(stretch):
        chosen[o : n + o] |= (key[o : n + o] == least) & (close[o : n + o] <= bound)
    bare = np.flatnonzero(~reached[lost : n + lost - window + 1]) if n >= window else np.zeros(0, np.int64)
    bare = bare[(doc[bare] == doc[bare + window - 1]) & (np.cumsum(covered)[bare] <= 0)]
    picked = chosen[start]
    names, start, end = names[picked], start[picked], end[picked]
    whole = (start >= lost) & (end + lost <= n)
    whole[whole] = (doc[start[whole] - lost] == doc[start[whole]]) & (doc[end[whole] + lost - 1] == doc[start[whole]])
    names, start, end = names[whole], start[whole], end[whole]
    up, down = _FIRST.get(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    around = (total[end + lost] - total[start - lost]) * down[start - lost]
    found = (mix64(names * _SALT[3] + around), start, end + lost - window, start - lost)
    own_name = mix64(mix64((total[bare + window] - total[bare]) * down[bare]) ^ _SALT[2])
    parts = [found, (own_name, bare, bare, bare), *runs]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _runs(names: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each symbol begins a run of equal symbols of one text."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (own[1:] != own[:-1])
    return new


def popped_names(words: np.ndarray, own: np.ndarray, at: np.ndarray, window: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits that name the popped sequence of each window of words[at : at + window]; own: text number of each word.

    `low` and `high` bound what is left of each window, in symbols of the current level; two running products on
    each side take in what was popped there.
    """
    salts = (_SALT[1], _SALT[4])
    factors = (np.uint64(_FIRST.mult), np.uint64(_SECOND.mult))
    sides = [[np.zeros(len(at), np.uint64) for _ in range(2)] for _ in range(2)]  # left and right, two products each
    names, low, high = words, at.astype(np.int64), at.astype(np.int64) + window

    def pop(side: int, live: np.ndarray, symbol: np.ndarray, many: np.ndarray | int) -> None:
        for k in range(2):
            value = seen[k][symbol] + np.asarray(many, np.uint64) * salts[k]
            sides[side][k] = np.where(live, sides[side][k] * factors[k] + value, sides[side][k])

    for r in range(levels):
        if not len(names):
            break
        new = _runs(names, own)
        head = np.flatnonzero(new)
        run, stop = np.cumsum(new) - 1, np.append(head[1:], len(names))
        seen = (names, mix64(names ^ _SALT[0]))
        live = low < high
        first = np.minimum(low, len(names) - 1)
        to = np.where(live, np.minimum(stop[run[first]], high), low)
        pop(0, live, first, to - low)
        low = to
        live = low < high
        last = np.maximum(high - 1, 0)
        to = np.where(live, np.maximum(head[run[last]], low), high)
        pop(1, live, last, high - to)
        high = to
        live = low < high
        low, high = np.where(live, run[np.minimum(low, len(names) - 1)], 0), np.where(live, run[np.maximum(high - 1, 0)] + 1, 0)
        length = stop - head
        named, own = np.where(length > 1, mix64(names[head] + length.astype(np.uint64) * _SALT[1]), names[head]), own[head]
        right = (mix64(named ^ (_SALT[2] + np.uint64(r))) & np.uint64(1)).astype(bool)
        seen = (named, mix64(named ^ _SALT[0]))
        first = np.minimum(low, len(named) - 1)
        go = live & right[first]
        pop(0, go, first, 1)
        low = low + go
        last = np.maximum(high - 1, 0)
        go = (low < high) & ~right[last]
        pop(1, go, last, 1)
        high = high - go
        joins = np.zeros(len(named), bool)
        joins[:-1] = ~right[:-1] & right[1:] & (own[1:] == own[:-1])
        pair = np.flatnonzero(joins)
        named[pair] = mix64(named[pair] * _SALT[3] + named[pair + 1])
        stay = np.ones(len(named), bool)
        stay[pair + 1] = False
        up = np.cumsum(stay) - 1
        live = low < high
        low, high = np.where(live, up[np.minimum(low, len(named) - 1)], 0), np.where(live, up[np.maximum(high - 1, 0)] + 1, 0)
        names, own = named[stay], own[stay]
    out = []
    for k, powers in enumerate((_FIRST, _SECOND)):
        value = names if k == 0 else mix64(names ^ _SALT[0])
        forth, back = powers.get(len(value) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * forth[: len(value)], dtype=np.uint64)))
        top = (total[high] - total[low]) * back[low]
        out.append(mix64(mix64(mix64(sides[0][k]) + top) * _SALT[3] + sides[1][k]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


class Chunk:
    """Words of some texts. keys: doc_id (made unsigned) and text hash of each, as rows of two numbers."""

    def __init__(self, keys: list[bytes], texts: list[bytes]):
        self.keys = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
        self.raw, self.starts, self.ends, self.first = words_of(texts)
        self.hashes = word_hashes(self.raw, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def anchors(self, window: int) -> tuple[np.ndarray, ...]:
        """Anchors of texts with a window at least: names, word numbers, window starts from and to (clipped to the text)."""
        name, word, low, high = anchors(self.hashes, self.doc, window)
        d = self.doc[word]
        low, high = np.maximum(low, self.first[d]), np.minimum(high, self.first[d + 1] - window)
        ok = low <= high
        return name[ok], word[ok], low[ok], high[ok]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in rising order, and the place among them of each key."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[order[new]], place


def _document_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys[:, 0] * _SALT[3] + keys[:, 1]) % np.uint64(buckets)).astype(np.int64)


def _packed(doc: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """The keys of the documents of a rising array of places in keys, and how often each stands in it."""
    at, counts = np.unique(doc, return_counts=True)
    return keys[at].astype("<u8").tobytes(), counts.astype("<u4").tobytes()


_FIELDS = "bucket int, direct boolean, ids binary, counts binary, h binary, g binary, place binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), *((c, pa.binary()) for c in ("ids", "counts", "h", "g", "place"))])


def _deal(keys: np.ndarray, doc: np.ndarray, h: np.ndarray, g: np.ndarray | None, place: np.ndarray, repeats: tuple[np.ndarray, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, arrays): what is dealt by hash, and the repeats that the task has settled itself. Both rise by document and place."""
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for part in np.split(order, cuts) if len(order) else []:
        name = h[part].astype("<u8") if g is not None else h[part].astype("<u4")
        rows.append((int(bucket[part[0]]), False, *_packed(doc[part], keys), name.tobytes(), g[part].astype("<u4").tobytes() if g is not None else b"", place[part].astype("<u4").tobytes()))
    if len(repeats[0]):
        # any bucket will do for these; in PARTS rows by document, so that no bucket gets all of a task's
        part = _document_bucket(keys, 1 << 20)[repeats[0]] * PARTS >> 20
        for k in np.unique(part):
            of, at = repeats[0][part == k], repeats[1][part == k]
            anywhere = int(mix64(keys[of[:1], 1])[0] % np.uint64(buckets))
            rows.append((anywhere, True, *_packed(of, keys), b"", b"", at.astype("<u4").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _firsts(h: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, keeping the given order among equals, and for each place of it the place where its equals begin."""
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if g is not None:
        new[1:] |= g[order][1:] != g[order][:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _dealt(parts: Iterator[tuple[np.ndarray, ...]], exact: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Deal (keys, doc, place, h[, g]) of chunks, HELD entries or a little more at a time.

    Of entries with one name only the first goes on; the others are repeats already. Of anchors the first is one too.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        keys, codes = _ranked(np.concatenate([p[0] for p in held]))
        base = np.cumsum([0, *(len(p[0]) for p in held)])
        doc = codes[np.concatenate([p[1] + b for p, b in zip(held, base)])]
        place, h, *rest = (np.concatenate([p[k] for p in held]) for k in range(2, 5 if exact else 4))
        order = np.lexsort((place, doc))
        doc, place, h, *rest = (c[order] for c in (doc, place, h, *rest))
        g = rest[0] if exact else None
        order, begin = _firsts(h, g)
        head = begin == np.arange(len(order))
        if exact:  # equal rows: one document at one place is the same window
            repeat = np.sort(order[(doc[order] != doc[order[begin]]) | (place[order] != place[order[begin]])])
        else:
            many = np.diff(np.append(np.flatnonzero(head), len(order)))
            repeat = np.sort(order[np.repeat(many > 1, many)])
        once = np.sort(order[head])
        return _deal(keys, doc[once], h[once], g[once] if exact else None, place[once], (doc[repeat], place[repeat]), buckets)

    for part in parts:
        held.append(part)
        if sum(len(p[1]) for p in held) >= HELD:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in chunks(batches):
            chunk = Chunk(batch.column("_k").to_pylist(), text_bytes(batch.column("text")))
            name, word, _, _ = chunk.anchors(window)
            doc = chunk.doc[word]
            yield chunk.keys, doc, word - chunk.first[doc], name

    yield from _dealt(parts(), False, buckets)


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in chunks(batches):
            chunk = Chunk(batch.column("_k").to_pylist(), text_bytes(batch.column("text")))
            _, word, low, high = chunk.anchors(window)
            marked = np.zeros(len(chunk.hashes), bool)
            for k, mark in enumerate(batch.column("mark").to_pylist()):
                marked[np.frombuffer(mark, "<u4").astype(np.int64) + chunk.first[k]] = True
            hit = marked[word]
            edges = np.zeros(len(chunk.hashes) + 1, np.int32)
            np.add.at(edges, low[hit], 1)
            np.add.at(edges, high[hit] + 1, -1)
            start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            h, g = popped_names(chunk.hashes, chunk.doc, start, window)
            doc = chunk.doc[start]
            yield chunk.keys, doc, start - chunk.first[doc], h, g

    yield from _dealt(parts(), True, buckets)


def _documents(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, doc): the different documents of packed rows in rising order, and for each entry the place of its document."""
    keys, codes = _ranked(np.concatenate([np.frombuffer(r["ids"], "<u8").reshape(-1, 2) for r in rows]))
    return keys, np.repeat(codes, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]))


def _bucket_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """The rows of one bucket after the other, of batches sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][name] != row[name]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _settle(batches: Iterator[pa.RecordBatch], exact: bool, targets: int) -> Iterator[pa.RecordBatch]:
    """Rows for buckets of documents, from dealt rows sorted by bucket: the places of all anchors of a repeated name,
    or of all but the first of equal windows. One row for each bucket, however many documents it has."""

    def give(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        bucket = _document_bucket(keys, 1 << 20)[doc] * targets >> 20
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        rows = [(int(bucket[part[0]]), *_packed(doc[part], keys), place[part].astype("<u4").tobytes()) for part in parts]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["to", "ids", "counts", "place"])

    for rows in _bucket_rows(batches, "bucket"):
        for row in (r for r in rows if r["direct"]):
            yield give(*_documents([row]), np.frombuffer(row["place"], "<u4"))
        rows = [r for r in rows if not r["direct"]]
        if not rows:
            continue
        keys, doc = _documents(rows)
        place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows])
        if exact:
            h, g = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("h", "<u8"), ("g", "<u4")))
            by_place = np.lexsort((place, doc))
            h, g, doc, place = h[by_place], g[by_place], doc[by_place], place[by_place]
            order, begin = _firsts(h, g)
            hit = order[(doc[order] != doc[order[begin]]) | (place[order] != place[order[begin]])]
        else:
            order, begin = _firsts(np.concatenate([np.frombuffer(r["h"], "<u4") for r in rows]))
            many = np.bincount(begin, minlength=len(begin))
            hit = order[many[begin] > 1]
        yield give(keys, doc[hit], place[hit])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_d, mark): one row for each document, from rows sorted by bucket of documents."""
    for rows in _bucket_rows(batches, "to"):
        keys, doc = _documents(rows)
        place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows])
        order = np.argsort(doc, kind="stable")
        data, ids = place[order].astype("<u4").tobytes(), keys.astype(">u8").tobytes()
        ends = np.cumsum(np.bincount(doc, minlength=len(keys))) * 4
        marks = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([ids[16 * k : 16 * k + 16] for k in range(len(keys))], pa.binary()), pa.array(marks, pa.binary())], names=["_d", "mark"])


def _marks(rows: DataFrame, exact: bool, partitions: int) -> DataFrame:
    dealt = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    settled = dealt.mapInArrow(lambda batches: _settle(batches, exact, partitions), "to int, ids binary, counts binary, place binary")
    return settled.repartition(partitions, "to").sortWithinPartitions("to").mapInArrow(_gather, "_d binary, mark binary")


def row_key() -> Column:
    """16 bytes that know a row by doc_id and text and sort by doc_id, null ones first. Never null, and known not to be: an inner
    join would else filter its side, and then a left join of the same rows could not read the same exchange."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).bitwiseXOR(F.lit(NO_ID))
    hexed = [F.lpad(F.hex(x), 16, "0") for x in (number, F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull()))]
    return F.coalesce(F.unhex(F.concat(*hexed)), F.lit(b""))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_d, mark): for each document's key, packed starts of the windows whose sequence starts earlier. docs: _k, text and what else
    the rows have that the marks are joined with in the end; with the same columns both joins read one exchange of the texts."""
    partitions = buckets = shuffle_partitions(docs.sparkSession)
    anchor_rows = docs.select("_k", "text").mapInArrow(lambda batches: _anchor_rows(batches, window, buckets), _FIELDS)
    marks = _marks(anchor_rows, False, partitions)
    marked = docs.join(marks, docs["_k"] == marks["_d"]).drop("_d")
    window_rows = marked.mapInArrow(lambda batches: _window_rows(batches, window, buckets), _FIELDS)
    return _marks(window_rows, True, partitions)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, _keep][, kept]) of every row.

    _keep: a struct of the columns named in keep. kept: the text itself where nothing was removed (null where it is
    null), else the kept words joined by one space.
    """
    small_batches(docs.sparkSession)
    others = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep")] if keep else []
    source = docs.select(row_key().alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    found = repeated_windows(source, window)
    joined = source.join(found, source["_k"] == found["_d"], "left").drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = text_bytes(batch.column("text"))
            raw, starts, ends, first = words_of(texts)
            edges = np.zeros(len(starts) + 1 + window, np.int32)
            for k, mark in enumerate(batch.column("mark").to_pylist()):
                if mark:
                    at = np.frombuffer(mark, "<u4").astype(np.int64) + first[k]
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
            gone = np.cumsum(edges)[: len(starts)] > 0
            data, begin, end, valid = raw.tobytes(), starts.tolist(), ends.tolist(), batch.column("text").is_valid().to_pylist()
            rows = []
            for k in range(len(texts)):
                a, b = int(first[k]), int(first[k + 1])
                stay = (np.flatnonzero(~gone[a:b]) + a).tolist()
                kept = b" ".join([data[begin[i] : end[i]] for i in stay])
                rows.append((b - a, b - a - len(stay), hashlib.sha256(kept).hexdigest(), None if not valid[k] else texts[k] if len(stay) == b - a else kept))
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([r[2] for r in rows], pa.string())}
            if keep:
                columns["_keep"] = batch.column("_keep")
            if with_text:
                columns["kept"] = pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kept_type = f", _keep {source.schema['_keep'].dataType.simpleString()}" if keep else ""
    return joined.drop("_k").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + kept_type + ", kept string" * with_text)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words removed from the texts (kept words joined by one space); other texts and columns as they are."""
    found = remove_repeats(docs, window, [c for c in docs.columns if c != "text"], with_text=True)
    return found.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"_keep.`{c}`").alias(c) for c in docs.columns])
