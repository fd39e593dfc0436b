"""Ordering, limits, batches and routing.

Batches are numbered along a window; give `by` a sender's number (a hash or remainder of the order) beside
the entity, so that a common entity is many windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def byte_batches(rows: DataFrame, payload: str, cap_bytes: int, by: list[str], order: list[str]) -> DataFrame:
    """K3: rows with batch: a log batch ends before it would pass cap_bytes and the next starts anew; a longer payload is a batch of its own.

    A fold over each key's rows in order: a task streams its sorted rows in Arrow batches and jumps from one batch's end to the next, so
    Python's steps follow the batches. Rows without a payload have no bytes.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    dealt = rows.withColumns({"_first": first, "_size": F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")})

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = filled = 0
        for part in parts:
            sizes, starts = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_size", "_first"))
            total = np.cumsum(sizes)
            keys = [*np.flatnonzero(starts).tolist(), len(sizes)]
            numbers, at, nth = np.empty(len(sizes), np.int64), 0, 0
            while at < len(sizes):
                if at == keys[nth]:
                    number, filled, nth = 0, 0, nth + 1
                elif filled + sizes[at] > cap_bytes:
                    number, filled = number + 1, 0
                before = total[at] - sizes[at]
                fits = int(np.searchsorted(total, before + cap_bytes - filled, "right"))
                end = min(max(fits, at + 1), keys[nth])
                numbers[at:end] = number
                filled += total[end - 1] - before
                at = end
            yield part.drop_columns(["_first", "_size"]).append_column("batch", pa.array(numbers))

    return dealt.mapInArrow(fold, StructType([*rows.schema.fields, StructField("batch", LongType())]))


def batch_limit(buffered: Column, rate: Column, batch_size: Column) -> Column:
    """K3: how many items a flush may send."""
    return F.least(buffered, rate, batch_size)


def dispatch_limit(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """K4: the first rows of a flush; the others wait."""
    return rows.orderBy(*order).limit(limit)


def item_batches(rows: DataFrame, batch_size: int, by: list[str], order: list[str]) -> DataFrame:
    """R2: rows with batch, batch_size rows each."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch_size).cast("long"))


def split_batches(batches: DataFrame, max_items: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows of refused batches with part: each batch is cut by a stride of half its rows, max_items at most."""
    sized = batches.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    stride = F.least(F.lit(max_items), F.ceil(F.col("_n") / 2))
    return sized.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / stride).cast("long")).drop("_n")


def round_robin(rows: DataFrame, n: int) -> DataFrame:
    """K5: evenly over n sender partitions."""
    return rows.repartition(n)
