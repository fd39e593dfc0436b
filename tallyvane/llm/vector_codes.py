"""Vector code compression: product quantisation with integer codebooks and Exponion search.

Components become integers floor(scale * x); vectors are cut in `parts` equal consecutive parts, and each part has a codebook of
at most `entries` entries. A codebook starts as that part of the vectors with the smallest vec_ids and is refined in rounds: every part
goes to its nearest entry (squared distance, ties to the lower index), then each entry becomes the floored mean of its parts; an
entry without parts stays. At last parts are assigned once more.

The search starts at the entry that the part had before (entry 0 at first), at distance u. An entry that is as near as
that one lies within 2u of it, by the triangle inequality; so that entry's neighbours are scanned in rising distance only as far
as four times the squared distance u reaches. All distances are exact integers. Parts are searched by groups of one
previous entry and alike radius, so that a group is a few array operations.

Each round is a map over the vectors, with the codes so far beside them in a table in the shared folder; tasks send sums and counts by
entry, which Spark adds up, so what reaches the driver and goes out again is the codebooks alone: parts x entries rows.

Null vectors and vectors with null or non-finite components take no part; shorter vectors, and lengths that `parts` does not
divide, count as ended by zeros. Rows without a vec_id are coded like others and come last among the first entries; rows that
repeat a vec_id stand beside each other by their components; fewer vectors than entries give smaller codebooks. Components
must lie within +-LARGEST once scaled, so that squared distances stay exact; others raise an error. An empty table gives an
empty result. Extra columns are left aside but for those named in keep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise, remove
from .topk import _matrix, _usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 28
#: Vectors that a task searches at a time.
BLOCK = 16384


class Codebooks:
    """books: parts x entries x components, whole numbers. Neighbour lists are made once for all searches."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.int64)
        apart = ((self.books[:, :, None, :] - self.books[:, None, :, :]) ** 2).sum(axis=3)
        self.near = np.argsort(apart, axis=2, kind="stable")  # of each entry, itself and its neighbours by distance, then index
        self.apart = np.take_along_axis(apart, self.near, axis=2)

    def assign(self, part: int, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry to each row of x. before: the entry to start from."""
        book, many = self.books[part], len(self.books[part])
        entry = np.empty(len(x), np.int64)
        away = ((x - book[before]) ** 2).sum(axis=1)
        reach = np.empty(len(x), np.int64)
        order = np.argsort(before, kind="stable")
        cuts = np.searchsorted(before[order], np.arange(many + 1))
        for e in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[e] : cuts[e + 1]]
            reach[rows] = np.searchsorted(self.apart[part, e], 4 * away[rows], side="right")
            tier = np.searchsorted((4, 8, 16, 32), reach[rows], side="left")
            for t in np.flatnonzero(np.bincount(tier)).tolist():
                own = rows[tier == t]
                near = self.near[part, e, : min(4 << t, many)]
                d = np.zeros((len(own), len(near)), np.int64)
                for c in range(book.shape[1]):
                    d += (x[own, c, None] - book[near, c]) ** 2
                d[np.arange(len(near)) >= reach[own, None]] = np.iinfo(np.int64).max  # beyond the radius
                least = d.min(axis=1)
                entry[own] = np.where(d == least[:, None], near, many).min(axis=1)
                away[own] = least
        return entry, away

    def encode(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error) of vectors; before: their codes so far, both vectors x parts."""
        codes, error = np.empty_like(before), np.zeros(len(x), np.int64)
        size = self.books.shape[2]
        for part in range(len(self.books)):
            codes[:, part], away = self.assign(part, x[:, part * size : (part + 1) * size], before[:, part].astype(np.int64))
            error += away
        return codes, error

    def sha256(self) -> str:
        """Of all entries' components by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            yield rows, _matrix(rows.column("v"), dim).astype(np.int64)


def _coded(rows: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """rows with their codes (and error) by the books; rows may have codes already."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, has_codes = len(books), "codes" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        for batch, x in _blocks(batches, dim):
            before = np.zeros((len(x), parts), np.uint16)
            if has_codes:
                before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").reshape(-1, parts)
            codes, error = own.encode(x, before)
            data = codes.astype("<u2").tobytes()
            columns = [data[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("_keep"), batch.column("v"), pa.array(columns, pa.binary()), pa.array(error)], names=["_keep", "v", "codes", "error"])

    return rows.mapInArrow(run, f"_keep {rows.schema['_keep'].dataType.simpleString()}, v array<bigint>, codes binary, error long")


def _means(coded: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """The books with each entry that has parts at their floored mean. Tasks send parts x entries rows at most."""
    parts, many, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * many, size), np.int64), np.zeros(parts * many, np.int64)
        for batch, x in _blocks(batches, dim):
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").reshape(-1, parts)
            at = (codes.astype(np.int64) + np.arange(parts) * many).ravel()
            counts += np.bincount(at, minlength=len(counts))
            np.add.at(sums, at, x.reshape(-1, size))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    schema = "entry int, n long, sums array<long>"
    added = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(size)]
    total = coded.select("v", "codes").mapInArrow(run, schema).groupBy("entry").agg(F.sum("n").alias("n"), *added).toArrow()
    out = books.reshape(-1, size).copy()
    n = total["n"].to_numpy()
    for c in range(size):
        out[total["entry"].to_numpy(), c] = total[f"s{c}"].to_numpy() // n
    return out.reshape(books.shape)


def compress(vectors: DataFrame, keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """((the columns named in keep, codes, error), codebooks): codes are two bytes a part, least byte first. None without any vector."""
    spark, old = vectors.sparkSession, []
    keep = ["vec_id"] if keep is None else keep
    doubles = F.col("embedding").cast("array<double>")
    ints = F.transform(doubles, lambda x: F.floor(x * scale).cast("long"))
    rows = materialise(vectors.filter(_usable(doubles)).select(F.col("vec_id").cast("long").alias("_id"), ints.alias("v"), kept(keep)), "codes-vectors", old)
    longest, largest = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    columns = [F.col(f"_keep.`{c}`").alias(c) for c in keep]
    if longest is None:
        return rows.select(*columns, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), None
    if (largest or 0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} once scaled")
    dim = max(1, -(-longest // parts)) * parts
    first = rows.select("_id", "v").orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).toArrow()
    books = np.ascontiguousarray(_matrix(first["v"].combine_chunks(), dim).astype(np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2))
    coded = rows.select("_keep", "v")
    for k in range(rounds):
        coded = materialise(_coded(coded, books, dim), f"codes-{k}", old)
        books = _means(coded, books, dim)
        remove(spark, old[:-1])
        old = old[-1:]
    found = materialise(_coded(coded, books, dim).select(*columns, "codes", "error"), "codes")
    remove(spark, old)
    return found, Codebooks(books)
