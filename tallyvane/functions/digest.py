"""Centroid compression of weighted values (A5-A7), in numpy for Arrow batches.

Values are merged greedily in order while a centroid stays within one unit of the arcsine scale
k(q) = compression * (asin(2q - 1) + pi / 2) / pi. A bin of few values keeps each value as its own centroid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

COMPRESSION, EXACT_VALUES, ACCURACY = 32, 40, 32
#: Compression of what is compressed once more.
FINE = 100
CENTROIDS = "array<struct<mean:double,count:bigint>>"


def compress(means: np.ndarray, counts: np.ndarray, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted weighted values. Their count, sum, least and greatest stay within the values'."""
    if not 20 <= compression <= 1000:
        raise ValueError("compression must be from 20 to 1000")
    total = counts.sum()
    if len(means) <= 1 or total <= 0:
        return means, counts
    scale = lambda q: compression * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2) / np.pi
    ends = np.cumsum(counts)
    k_ends = scale(ends / total)
    starts, first, done = [], 0, 0
    while first < len(means):  # each centroid takes all values that end within one unit of its start
        starts.append(first)
        k0 = scale(done / total)
        first = max(first + 1, int(np.searchsorted(k_ends, k0 + 1, side="right")))
        done = ends[first - 1]
    weight = np.add.reduceat(counts, starts)
    return np.add.reduceat(means * counts, starts) / weight, weight


def run_length(means: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent equal means as one; equal means apart stay apart."""
    if not len(means):
        return means, counts
    starts = np.flatnonzero(np.append(True, means[1:] != means[:-1]))
    return means[starts], np.add.reduceat(counts, starts)


def recompress(means: np.ndarray, counts: np.ndarray, accuracy: int = ACCURACY) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent equal centroids merged, then compressed if more than twice the accuracy are left."""
    means, counts = run_length(means, counts)
    if len(means) > 2 * accuracy:
        order = np.argsort(means, kind="stable")
        means, counts = compress(means[order], counts[order], accuracy)
    return means, counts


def run_length_column(centroids: Column) -> Column:
    """A6 as a column: centroids (mean, count) with adjacent equal means merged."""
    empty = F.array().cast(CENTROIDS)
    last = lambda acc: F.element_at(acc, -1)
    merged = lambda acc, c: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(c["mean"].alias("mean"), (last(acc)["count"] + c["count"]).alias("count"))))
    step = lambda acc, c: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["mean"] == c["mean"]), merged(acc, c)).otherwise(F.concat(acc, F.array(c)))
    return F.aggregate(centroids.cast(CENTROIDS), empty, step)


def _longer(column: Column, most: int, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Column:
    """Centroids, of which arrays of more than `most` are changed; only those are sent to Python."""

    @F.pandas_udf(CENTROIDS)
    def changed(lists: pd.Series) -> pd.Series:
        def one(items):
            if items is None:
                return None
            means, counts = change(np.array([x["mean"] for x in items], float), np.array([x["count"] for x in items], np.int64))
            return [{"mean": float(m), "count": int(c)} for m, c in zip(means, counts)]

        return lists.map(one)

    return F.coalesce(changed(F.when(F.size(column) > most, column)), column)


def recompress_column(rows: DataFrame, column: str = "centroids", accuracy: int = ACCURACY) -> DataFrame:
    """Only rows with more than twice the accuracy in centroids go through Python."""
    rows = rows.withColumn(column, run_length_column(F.col(column)))
    return rows.withColumn(column, _longer(F.col(column), 2 * accuracy, lambda means, counts: recompress(means, counts, accuracy)))


def absorb(means: np.ndarray, counts: np.ndarray, more_means: np.ndarray, more_counts: np.ndarray, most: int = 4 * FINE, compression: int = FINE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted centroids with others taken in: counted by value while they are `most` at most, compressed beyond that."""
    means, at = np.unique(np.concatenate([means, more_means]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([counts, more_counts]), len(means)).astype(np.int64)
    return compress(means, counts, compression) if len(means) > most else (means, counts)


#: Rows that a task gathers before it digests them, and the parts that a bin's digests are merged in first.
HELD_ROWS, PARTS = 262_144, 1000


def _digested(table: pa.Table, by: list[str], most: int, compression: int) -> pa.Table:
    """Rows with equal keys and means as one; the rows of keys that have more than `most` means as their centroids."""
    group = np.zeros(table.num_rows, np.int64)
    for name in by:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    mean, count = table["mean"].to_numpy(), table["count"].to_numpy()
    order = np.lexsort((mean, group))
    group, mean = group[order], mean[order]
    starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (mean[1:] != mean[:-1]))[: len(order)])
    group, mean, count, row = group[starts], mean[starts], np.add.reduceat(count[order], starts), order[starts]
    sizes = np.bincount(group)
    small = sizes[group] <= most
    means, counts, rows = [mean[small]], [count[small]], [row[small]]
    ends = np.cumsum(sizes)
    for g in np.flatnonzero(sizes > most):
        a, b = ends[g] - sizes[g], ends[g]
        m, c = compress(mean[a:b], count[a:b], compression)
        means.append(m), counts.append(c), rows.append(np.full(len(m), row[a]))
    kept = table.take(pa.array(np.concatenate(rows)))
    for name, values in (("mean", means), ("count", counts)):
        kept = kept.set_column(kept.schema.get_field_index(name), table.schema.field(name), pa.array(np.concatenate(values), table.schema.field(name).type))
    return kept


def _task_digests(batches: Iterator[pa.RecordBatch], by: list[str], most: int, compression: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, digested by key; it holds HELD_ROWS rows and a batch at most and lets go of keys that fill half of that."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_ROWS:
            held = _digested(pa.Table.from_batches(held), by, most, compression).combine_chunks().to_batches()
            if sum(b.num_rows for b in held) > HELD_ROWS // 2:
                yield from held
                held = []
    if held:
        yield from _digested(pa.Table.from_batches(held), by, most, compression).combine_chunks().to_batches()


def recompress_bins(values: DataFrame, keys: list[str], value: str = "value", count: str = "count", accuracy: int = ACCURACY) -> DataFrame:
    """A6, A7 of all values of a bin: (keys, centroids). Equal values are counted and large bins digested before any
    array is built, so an array has no more than a digest's centroids."""
    return recompress_column(digest_bins(values, keys, FINE, value, count), accuracy=accuracy)


def digest_bins(values: DataFrame, keys: list[str], compression: int = COMPRESSION, value: str = "value", count: str = "count") -> DataFrame:
    """A5: (keys, centroids) of weighted values, in one pass over them.

    Each task digests its own rows of a bin; digests are merged by bin and one of PARTS parts of the tasks, and then by bin. So what
    is shuffled and gathered for a bin follows the number of tasks, never its values. A bin of EXACT_VALUES distinct values or
    fewer keeps them all with their counts. Null keys are keys; values that are null or not finite, and counts that are null or 0 or less, are left out.
    """
    kinds = {f.name: f.dataType for f in values.schema}
    own = [f"_k{n}" for n in range(len(keys))]
    # keys of types that are no plain values are told apart by their text
    texts = {f"_t{n}": F.to_json(F.struct(k)) for n, k in enumerate(keys) if not isinstance(kinds[k], AtomicType)}
    by = [*(o for o, k in zip(own, keys) if isinstance(kinds[k], AtomicType)), *texts]
    rows = values.select(*[F.col(k).alias(o) for o, k in zip(own, keys)], *[c.alias(t) for t, c in texts.items()], F.col(value).cast("double").alias("mean"), F.col(count).cast("bigint").alias("count"))
    rows = rows.filter((F.abs("mean") < float("inf")) & (F.col("count") > 0))
    fine = max(FINE, compression)
    dealt = rows.mapInArrow(lambda batches: _task_digests(batches, by, EXACT_VALUES, fine), rows.schema).withColumn("_part", F.spark_partition_id() % PARTS)

    def merged(rows: DataFrame, to: list[str], compression: int) -> DataFrame:
        counted = rows.repartition(*to).groupBy(*to, "mean").agg(F.sum("count").alias("count"))
        arrays = counted.groupBy(*to).agg(F.array_sort(F.collect_list(F.struct("mean", "count"))).alias("centroids"))
        return arrays.withColumn("centroids", _longer(F.col("centroids"), EXACT_VALUES, lambda means, counts: compress(means, counts, compression)))

    parts = merged(dealt, [*own, "_part"], fine).select(*own, F.inline("centroids"))
    return merged(parts, own, compression).select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "centroids")
