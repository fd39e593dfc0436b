"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on whole batches without a regex: each code point becomes a class, each class
is a transition function over eight states, and an associative scan of those functions (within
blocks, then across blocks by doubling, then within blocks again) gives the state at every code
point and so the piece boundaries. Pieces are merged by rank, with a bounded cache of pieces.

Null and empty texts have no tokens; a text of any length is worked on whole. Extra columns of the
input are left out; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, small_batches, text_bytes

# Code point classes. APOS2 and APOS3 are apostrophes that open a contraction of two or three code points.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOS2, APOS3, END = range(8)
# States: the kind of run that the last code point belongs to; HOLD1 and HOLD2 have so many code points of a contraction to come.
IN_OTHER, IN_LETTER, IN_NUMBER, AFTER_SPACE, FREE, HOLD1, HOLD2 = range(7)
STATES, BLOCK = 8, 128
CACHE_PIECES = 400_000


def _transitions() -> np.ndarray:
    t = np.zeros((8, STATES), np.uint8)
    for state in range(STATES):
        for cls in range(8):
            if cls == END:
                to = FREE
            elif state == HOLD2:
                to = HOLD1
            elif state == HOLD1:
                to = FREE
            elif cls in (APOS2, APOS3):
                to = IN_OTHER if state in (IN_OTHER, AFTER_SPACE) else HOLD1 if cls == APOS2 else HOLD2
            else:
                to = {OTHER: IN_OTHER, LETTER: IN_LETTER, NUMBER: IN_NUMBER, SPACE: AFTER_SPACE, WHITE: FREE}[cls]
            t[cls, state] = to
    return t


def _starts_piece() -> np.ndarray:
    """[class, state before]: whether a code point that is not white space starts a piece."""
    t = np.ones((8, STATES), bool)
    t[:, HOLD1] = t[:, HOLD2] = False
    for cls, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (APOS2, IN_OTHER), (APOS3, IN_OTHER)):
        t[cls, run] = t[cls, AFTER_SPACE] = False
    t[END] = True
    return t


_NEXT, _STARTS = _transitions().ravel(), _starts_piece().ravel()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, from Unicode general categories and the White_Space property."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        found = kind.get(unicodedata.category(chr(cp))[0])
        if found:
            table[cp] = found
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    table[0x20] = SPACE
    return table


def _classes(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    cls = class_table()[cps]
    cls[ends] = END
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        padded = np.concatenate((cps, np.zeros(2, cps.dtype)))
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cls[at[short]], cls[at[long]] = APOS2, APOS3
    return cls


def scan_states(cls: np.ndarray) -> np.ndarray:
    """State before each code point, by an associative scan over the classes' transition functions."""
    n = len(cls)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[:n] = cls
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.uint16) * np.uint16(STATES)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:  # every block's composed function, all blocks at once
        whole = _NEXT[column[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive scan of the composed functions across blocks, by doubling
        later = whole.copy()
        later[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole, step = later, step * 2
    state = np.full(blocks, FREE, np.uint8)
    state[1:] = whole[:-1, FREE]
    before = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        before[k] = state
        state = _NEXT[column + state]
    return before.T.reshape(-1)[:n]


def piece_starts(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of code points that start a piece; `ends` marks the code point that closes each text."""
    cls = _classes(cps, ends)
    starts = _STARTS[cls.astype(np.uint16) * np.uint16(STATES) + scan_states(cls)]
    white = (cls == SPACE) | (cls == WHITE)
    last = np.zeros(len(cls), bool)
    last[:-1] = ~white[1:] & (cls[1:] != END)
    first = np.ones(len(cls), bool)
    first[1:] = ~white[:-1]
    starts[white] = (first | last)[white]
    return starts


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < 1 << 30:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked parts: long pieces stay near linear."""
    n = len(piece)
    end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := back[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Ranks of one vocabulary, a bounded cache of merged pieces, and the joined bytes of all tokens for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def _piece(self, piece: bytes) -> bytes:
        known = self.ranks.get(piece)
        ids = [known] if known is not None else (_merge_short if len(piece) < 64 else _merge_long)(piece, self.ranks)
        packed = np.array(ids, "<u4").tobytes()
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        if len(piece) < 64:
            self.cache[piece] = packed
        return packed

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        chars = [t.decode("utf-8", "replace") for t in texts]
        joined = "\n".join(chars) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(c) + 1 for c in chars]) - 1
        at = np.flatnonzero(piece_starts(cps, ends))
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        offsets = np.cumsum(width) - width
        raw, places = joined.encode("utf-8"), offsets[at].tolist()
        cache, packed = self.cache, []
        get, add = cache.get, packed.append
        for i, j in zip(places, [*places[1:], len(raw)]):
            piece = raw[i:j]
            add(get(piece) or self._piece(piece))
        out, first = [], 0
        for close in np.searchsorted(at, ends).tolist():  # the closing newline is a piece of its own
            out.append(b"".join(packed[first:close]))
            first = close + 1
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.joined[where].tobytes()


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One tokenizer for each Python worker and vocabulary file."""
    return ByteBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each text; a narrow map without a shuffle."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in chunks(batches, limit=2_000_000):
            packed = bpe.encode(text_bytes(batch.column("text")))
            rows = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
            }
            if with_ids:
                rows["ids"] = pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(rows)

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded) with the bytes of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
