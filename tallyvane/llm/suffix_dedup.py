"""Suffix-array dedup of bytes: every byte of a string of `window` bytes that also starts anywhere else goes.

Texts are UTF-8 bytes; matches never cross documents, may overlap, and are judged on the input. Shards of candidate text get suffix
arrays by induced sorting and permuted common prefixes (suffix_array.py); a string repeats if its common prefix with a neighbour in the
array is as long as the window.

* Cells. A window belongs to its anchor, the first of its least grams of GRAM bytes, and to the stretch of CELL bytes that its
  distance from the anchor falls in: a cell. So equal windows have equal cells. Windows of a cell share all but CELL - 1 bytes:
  the core, at one distance from the anchor. Cells of which no other core is equal hold no repeated window.
* Shards. Cells with a repeated core are dealt by it, as what stands left of it, the core as one mark (96 bits of its bytes), and
  what stands right of it. In the shard's text the windows are the strings of CELL symbols that hold a mark, so nothing is sent or
  sorted that all windows of a cell share.
* Folding. Equal cells are one row with its documents, in the task that finds them and again in the shard; windows of cells
  that stand twice are repeated. Cells of a core that stands more than HOT times, and in more than one in FEW of a bucket's
  cells, are dealt as single windows, so that one common passage with ever other words around it fills no task.

1. Each task names the cores of its texts and deals the names; of a name it keeps one and marks the others itself.
2. Names met twice mark their cells; marks go back by document.
3. Marked cells are dealt to shards, sorted, and the repeated windows go back by document as ranges.
4. The covered bytes go.

Rows are known by doc_id and text for the way back; each row is a document of its own, so rows that repeat another remove
each other, whatever their ids, null ones too. Null and empty texts and those shorter than the window stay as they
are; texts of any length are worked on whole. An empty table gives an empty result; extra columns stay out of the exchanges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, Powers, chunks, materialise, mix64, shuffle_partitions, small_batches, text_bytes, unpacked, word_hashes
from .common import kept as kept_columns
from .recompress import _bucket_rows, _document_bucket, _documents, _firsts, _packed, _ranked, row_key
from .suffix_array import common_prefixes, suffix_array

WINDOW, CELL, GRAM = 400, 64, 16
#: Cells that a task holds before it deals them: by name, and with their bytes.
NAMED, DEALT = 500_000, 100_000
#: Symbols of one suffix array, but for cells of one core.
SHARD = 400_000
HOT, FEW = 4096, 64
#: Symbols: the end, what stands between cells, the bytes, then marks.
BETWEEN, FIRST, MARK = 1, 2, 258
_FIRST, _SECOND = Powers(0xC6A4A7935BD1E995), Powers(0x9FB21C651E98DF25)
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


class Texts:
    """Bytes of some texts one after the other, with their cells: first and last window, and the core's first byte."""

    def __init__(self, texts: list[bytes], window: int, cell: int = CELL):
        self.window, self.cell = window, min(cell, window)
        data = b"".join(texts)
        self.raw = np.frombuffer(data, np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        n, gram = len(data), min(GRAM, window)
        count = n - window + 1
        self.first = self.last = self.core = self.doc = np.zeros(0, np.int64)
        if count <= 0:
            return
        # 16 bytes from each place, as two numbers
        eight = np.ndarray(n - gram + 1, "<u8", data + bytes(16), 0, (1,))
        more = np.ndarray(n - gram + 1, "<u8", data + bytes(16), 8, (1,))
        if gram < 16:
            keep = [np.uint64((1 << 8 * max(0, min(8, gram - 8 * k))) - 1) for k in (0, 1)]
            eight, more = eight & keep[0], more & keep[1]
        key = eight * np.uint64(0x9E3779B97F4A7C15) ^ (more + _SALT) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key &= np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(n - gram + 1, dtype=np.uint64)
        span, width = 1, window - gram + 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        anchor = (np.minimum(key[:count], key[width - span : width - span + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(count)
        distance = (anchor - start) // self.cell
        valid = np.zeros(count + 1, np.int8)
        long = np.diff(self.bounds) >= window
        valid[self.bounds[:-1][long]] += 1
        valid[self.bounds[1:][long] - window + 1] -= 1
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (distance[1:] != distance[:-1]) | ~valid[:-1]
        end = valid.copy()
        end[:-1] &= new[1:] | ~valid[1:]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
        self.core = anchor[self.first] - self.cell * distance[self.first]
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        codes = _BYTE_CODE[self.raw]
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * p.get(n + 1)[0][:n], dtype=np.uint64))) for p in (_FIRST, _SECOND)]

    def named(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that name the bytes of each stretch."""
        size = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return tuple(mix64((s[end] - s[start]) * p.get(len(self.raw) + 1)[1][start] + size) for s, p in zip(self.sums, (_FIRST, _SECOND)))  # type: ignore[return-value]

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        return self.named(self.core, self.core + self.window - self.cell + 1)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of one number and then bytes."""
    columns = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(len(columns))], names=columns)


def _schema(names: str) -> str:
    return ", ".join(f"{c} {'binary' if k else 'int'}" for k, c in enumerate(names.split()))


def _packs(bucket: np.ndarray, keys: np.ndarray, doc: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A row for each bucket: its documents and the columns. What is given rises by document."""
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return [(int(bucket[part[0]]), *_packed(doc[part], keys), *(c[part].tobytes() for c in columns)) for part in parts]


def _ranges(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, many: np.ndarray, targets: int) -> pa.RecordBatch:
    """Rows for buckets of documents: ranges of places, each its first and their number."""
    order = np.lexsort((start, doc))
    doc, start, many = doc[order], start[order], many[order]
    return _table(_packs(_document_bucket(keys, 1 << 20)[doc] * targets >> 20, keys, doc, [start.astype("<u4"), many.astype("<u4")]), BACK)


BACK = "to ids counts start many"
NAMES = "bucket ids counts h start many"
CELLS = "bucket ids counts h g start left right bytes"


class _Held:
    """Entries of chunks of texts: their rows' keys as one list of documents."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.columns: list[list[np.ndarray]] = []
        self.size = self.base = 0

    def add(self, keys: np.ndarray, doc: np.ndarray, columns: list[np.ndarray]) -> None:
        self.keys.append(keys)
        self.doc.append(doc + self.base)
        self.columns.append(columns)
        self.base += len(keys)
        self.size += len(doc)

    def take(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys, codes = _ranked(np.concatenate(self.keys))
        doc = codes[np.concatenate(self.doc)]
        columns = [np.concatenate(c) for c in zip(*self.columns)]
        self.__init__()  # type: ignore[misc]
        return keys, doc, columns


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_k").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def _name_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The names of cores: to their bucket the first of each name with their number, to the documents all of a name met twice here."""
    held = _Held()

    def flush() -> pa.RecordBatch:
        keys, doc, (h, start) = held.take()
        order = np.lexsort((start, doc))
        doc, h, start = doc[order], h[order], start[order]
        order, begin = _firsts(h)
        head = np.flatnonzero(begin == np.arange(len(order)))
        many = np.diff(np.append(head, len(order)))
        again = np.sort(order[np.repeat(many > 1, many)])
        of = np.argsort(order[head], kind="stable")
        once, many = order[head][of], many[of]
        bucket = ((h[once] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        rows = _packs(bucket, keys, doc[once], [h[once].astype("<u4"), start[once].astype("<u4"), many.astype("<u4")])
        # those go past a bucket of their documents' to the documents, with no name
        rows += [(r[0], r[1], r[2], b"", r[3], b"") for r in _packs(_document_bucket(keys, buckets)[doc[again]], keys, doc[again], [start[again].astype("<u4")])]
        return _table(rows, NAMES)

    for batch in chunks(batches):
        texts = Texts(text_bytes(batch.column("text")), window)
        if len(texts.first):
            h, _ = texts.cores()
            held.add(_keys(batch), texts.doc, [h, texts.first - texts.bounds[texts.doc]])
        if held.size >= NAMED:
            yield flush()
    if held.size:
        yield flush()


def _settle_names(batches: Iterator[pa.RecordBatch], targets: int, many_cells: int) -> Iterator[pa.RecordBatch]:
    """Places of cells whose core's name was met twice, for buckets of documents; names of hot cores, to -1."""
    for rows in _bucket_rows(batches, "bucket"):
        for row in (r for r in rows if not r["h"]):
            keys, doc = _documents([row])
            start = np.frombuffer(row["start"], "<u4")
            yield _ranges(keys, doc, start, np.ones(len(start)), targets)
        rows = [r for r in rows if r["h"]]
        if not rows:
            continue
        keys, doc = _documents(rows)
        h, start, many = (np.concatenate([np.frombuffer(r[c], "<u4") for r in rows]) for c in ("h", "start", "many"))
        order, begin = _firsts(h)
        hit = order[np.bincount(begin, minlength=len(begin))[begin] > 1]
        yield _ranges(keys, doc[hit], start[hit], np.ones(len(hit)), targets)
        total = np.bincount(begin, weights=many[order], minlength=len(begin))
        hot = np.flatnonzero((total > many_cells) & (total * FEW > total.sum()))
        if len(hot):
            names = (np.uint64(rows[0]["bucket"]) << np.uint64(32)) | h[order[hot]].astype(np.uint64)
            yield _table([(-1, names.astype("<u8").tobytes(), b"", b"", b"")], BACK)


def _cell_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marked cells with their bytes, for the shards; equal ones once."""
    held = _Held()
    left_over: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        keys, doc, (h, g, e, start, left, right, many, at, data) = held.take()
        order, begin = _firsts(h ^ e, g)
        alike = np.bincount(begin, minlength=len(begin))[begin] > 1
        again = order[alike]
        left_over.append(_ranges(keys, doc[again], start[again], many[again], buckets))
        once = order[begin == np.arange(len(order))]
        once = once[np.lexsort((start[once], doc[once]))]
        bucket = ((h[once] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            own = once[part]
            taken = data[_spread(at[own], (left[own] + right[own]).astype(np.int64))].tobytes()
            rows.append((int(bucket[part[0]]), *_packed(doc[own], keys), h[own].astype("<u8").tobytes(), g[own].astype("<u4").tobytes(), start[own].astype("<u4").tobytes(), left[own].astype("<u2").tobytes(), right[own].astype("<u2").tobytes(), taken))
        return _table(rows, CELLS)

    def settled() -> Iterator[pa.RecordBatch]:
        yield flush()
        for batch in left_over:  # in a row without names, by bucket of documents
            empty = pa.array([b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], empty, empty, *batch.columns[3:], empty, empty], names=CELLS.split())
        left_over.clear()

    for batch in chunks(batches):
        texts = Texts(text_bytes(batch.column("text")), window)
        if len(texts.first):
            marked = np.zeros(len(texts.raw) + 1, bool)
            for k, mark in enumerate(batch.column("mark").to_pylist()):
                marked[np.frombuffer(mark, "<u4").astype(np.int64) + texts.bounds[k]] = True
            own = np.flatnonzero(marked[texts.first])
            h, g = (x[own] for x in texts.cores())
            first, last, core, doc = texts.first[own], texts.last[own], texts.core[own], texts.doc[own]
            ends, window_of = core + window - texts.cell + 1, last + window
            if len(hot):
                name = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
                single = np.isin(name, hot)
                some = np.flatnonzero(single)
                size = last[some] - first[some] + 1
                each = _spread(first[some], size)
                by_window = texts.named(each, each + window)
                plain = np.flatnonzero(~single)
                h, g = (np.concatenate((x[plain], y ^ _SALT)) for x, y in zip((h, g), by_window))
                doc = np.concatenate((doc[plain], np.repeat(doc[some], size)))
                first, last, core = (np.concatenate((x[plain], each)) for x in (first, last, core))
                ends, window_of = np.concatenate((ends[plain], each + window)), np.concatenate((window_of[plain], each + window))
            if len(first):
                left, right = core - first, window_of - ends
                e = texts.named(first, window_of)[1] + (left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)) * _SALT
                stretch = np.stack((first, ends), 1).ravel(), np.stack((left, right), 1).ravel()
                at = np.cumsum(left + right) - left - right
                data = texts.raw[_spread(*stretch)]
                before = sum(len(c[-1]) for c in held.columns)
                held.add(_keys(batch), doc, [h, (g >> np.uint64(32)).astype(np.uint32), e, first - texts.bounds[doc], left.astype(np.uint16), right.astype(np.uint16), last - first + 1, at + before, data])
        if held.size >= DEALT:
            yield from settled()
    if held.size:
        yield from settled()


def repeated_starts(h: np.ndarray, g: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first): for each cell whether each of its windows is repeated among all of them, one cell after the other, and where each
    cell's first is. Cells with equal cores, beside others; left, right: bytes beside the core, data: those bytes."""
    size = (left + right).astype(np.int64)
    ends = np.cumsum(size)
    many = np.where(size > 0, size - cell + 2, 1)
    first = np.cumsum(many) - many
    content = word_hashes(data, ends - size, ends) + left.astype(np.uint64) * _SALT if len(data) else np.zeros(len(h), np.uint64)
    order = np.lexsort((content, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
    head = order[new]
    equals = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.zeros(int(many.sum()), bool)
    core = np.ones(len(head), bool)
    core[1:] = (h[head[1:]] != h[head[:-1]]) | (g[head[1:]] != g[head[:-1]])
    mark = np.cumsum(core) - 1 + MARK
    ours = np.flatnonzero(size[head] > 0)  # single windows are one mark, and equal ones one cell
    whole = equals > 1
    if len(ours):
        own, marks = head[ours], mark[ours]
        length = size[own] + 2
        at = np.cumsum(length) - length
        text = np.full(int(length.sum()) + 1, BETWEEN, np.int32)
        text[-1] = 0
        place = at + left[own]
        text[_spread(at, left[own].astype(np.int64))] = data[_spread((ends - size)[own], left[own].astype(np.int64))].astype(np.int32) + FIRST
        text[place] = marks
        text[_spread(place + 1, right[own].astype(np.int64))] = data[_spread((ends - size)[own] + left[own], right[own].astype(np.int64))].astype(np.int32) + FIRST
        prefix, above = common_prefixes(text, suffix_array(text, MARK), BETWEEN)
        long = np.flatnonzero(prefix >= cell)
        hit = np.zeros(len(text), bool)
        hit[long] = hit[above[long]] = True
        out[_spread(first[own], many[own])] = hit[_spread(at, many[own])]
    own = head[whole]
    out[_spread(first[own], many[own])] = True
    # all equals of a cell have its windows
    rest = order[~new]
    model = np.repeat(head, equals)[~new]
    out[_spread(first[rest], many[rest])] = out[_spread(first[model], many[model])]
    return out, first


def _settle_cells(batches: Iterator[pa.RecordBatch], cell: int, targets: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows for buckets of documents, from the shards of one bucket after the other."""
    for rows in _bucket_rows(batches, "bucket"):
        for row in (r for r in rows if not r["h"]):
            keys, doc = _documents([row])
            yield _ranges(keys, doc, *(np.frombuffer(row[c], "<u4") for c in ("start", "left")), targets)
        rows = [r for r in rows if r["h"]]
        if not rows:
            continue
        keys, doc = _documents(rows)
        h, g, start, left, right, data = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("h", "<u8"), ("g", "<u4"), ("start", "<u4"), ("left", "<u2"), ("right", "<u2"), ("bytes", np.uint8)))
        size = left.astype(np.int64) + right
        begin = np.cumsum(size) - size
        shards = -(-int((size + 2).sum()) // SHARD)
        shard = h % np.uint64(shards)
        for k in range(shards):
            own = np.flatnonzero(shard == k)
            if not len(own):
                continue
            hit, first = repeated_starts(h[own], g[own], left[own], right[own], data[_spread(begin[own], size[own])], cell)
            edge = np.zeros(len(hit) + 1, bool)
            edge[first] = True
            turn = hit.copy()
            turn[1:] &= ~hit[:-1] | edge[1:-1]
            stop = hit.copy()
            stop[:-1] &= ~hit[1:] | edge[1:-1]
            a, b = np.flatnonzero(turn), np.flatnonzero(stop)
            of = np.searchsorted(first, a, side="right") - 1
            yield _ranges(keys, doc[own[of]], start[own[of]] + (a - first[of]), b - a + 1, targets)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_d, mark, many): one row for each document, from rows sorted by bucket of documents."""
    for rows in _bucket_rows(batches, "to"):
        keys, doc = _documents(rows)
        start, many = (np.concatenate([np.frombuffer(r[c], "<u4") for r in rows]) for c in ("start", "many"))
        order = np.argsort(doc, kind="stable")
        ends = np.cumsum(np.bincount(doc, minlength=len(keys))).tolist()
        ids, columns = keys.astype(">u8").tobytes(), [c[order].astype("<u4").tobytes() for c in (start, many)]
        cut = [[c[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in ([ids[16 * k : 16 * k + 16] for k in range(len(keys))], *cut)], names=["_d", "mark", "many"])


def _by_document(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "to").sortWithinPartitions("to").mapInArrow(_gather, "_d binary, mark binary, many binary")


def _by_bucket(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")


def repeated_strings(docs: DataFrame, window: int, old: list[str], many_cells: int = HOT) -> DataFrame:
    """(_d, mark, many): for each row's key the ranges of windows that start elsewhere too. docs: _k, text and what else the rows have that
    these are joined with in the end; with the same columns both joins read one exchange of the texts. old: gets a table's path."""
    partitions = buckets = shuffle_partitions(docs.sparkSession)
    cell = min(CELL, window)
    named = _by_bucket(docs.select("_k", "text").mapInArrow(lambda batches: _name_rows(batches, window, buckets), _schema(NAMES)), partitions)
    settled = materialise(named.mapInArrow(lambda batches: _settle_names(batches, partitions, many_cells), _schema(BACK)), "suffix-names", old)
    hot_rows = settled.filter("to = -1").select("ids").toArrow()["ids"].to_pylist()  # FEW names for each bucket at most
    hot = np.frombuffer(b"".join(hot_rows), "<u8")
    marks = _by_document(settled.filter("to >= 0"), partitions).drop("many")
    marked = docs.join(marks, docs["_k"] == marks["_d"]).drop("_d")
    cells = _by_bucket(marked.mapInArrow(lambda batches: _cell_rows(batches, window, buckets, hot), _schema(CELLS)), partitions)
    return _by_document(cells.mapInArrow(lambda batches: _settle_cells(batches, cell, partitions), _schema(BACK)), partitions)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, with_spans: bool = False, many_cells: int = HOT) -> DataFrame:
    """The columns named in keep (doc_id), then n_bytes, n_removed, n_spans, kept_sha256[, spans, kept] of every row.

    spans: the removed stretches of bytes (start, and end after the last); kept: the remaining bytes. many_cells: how many cells of one
    core are dealt as single windows; the result is the same for any number.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(row_key().alias("_k"), F.col("text").cast("string").alias("text"), kept_columns(keep))
    old: list[str] = []
    found = repeated_strings(source, window, old, many_cells)
    joined = source.join(found, source["_k"] == found["_d"], "left").drop("_d", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = text_bytes(batch.column("text"))
            bounds = np.cumsum([0, *map(len, texts)])
            raw = np.frombuffer(b"".join(texts), np.uint8)
            edges = np.zeros(len(raw) + 1, np.int32)
            for k, (mark, many) in enumerate(zip(batch.column("mark").to_pylist(), batch.column("many").to_pylist())):
                if mark:
                    at = np.frombuffer(mark, "<u4").astype(np.int64) + bounds[k]
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + np.frombuffer(many, "<u4") + (window - 1), -1)
            gone = np.cumsum(edges[:-1]) > 0
            turn = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
            # a removed stretch ends with its text
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(raw))]
            inner = np.unique(inner[gone[inner - 1] & gone[inner]])
            begins, ends = np.union1d(np.flatnonzero(turn[:-1] > 0), inner), np.union1d(np.flatnonzero(turn < 0), inner)
            stay = raw[~gone].tobytes()
            size = np.concatenate(([0], np.cumsum(~gone)))[bounds].tolist()
            parts = [stay[a:b] for a, b in zip(size[:-1], size[1:])]
            n = np.diff(bounds)
            spans = np.searchsorted(begins, bounds)
            columns = {"_keep": batch.column("_keep"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(size), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts])}
            if with_spans:
                of = np.repeat(bounds[:-1], np.diff(spans))
                columns["spans"] = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.StructArray.from_arrays([pa.array(begins - of, pa.int64()), pa.array(ends - of, pa.int64())], ["start", "end"]))
                columns["kept"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    more = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_spans
    schema = f"_keep {source.schema['_keep'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: bigint, end: bigint>>, kept binary" * with_spans
    return unpacked(joined.mapInArrow(run, schema), keep, *more)
