"""Streaming forms: delta counters and bins released by arrival time, idle series.

Bins are keyed by event time but released a fixed time after their first sample arrived, so late samples are never
dropped: they make another emission of the same bin, and consumers add emissions up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.digest import COMPRESSION, EXACT_VALUES, FINE, absorb, compress
from ..operators.rules import RuleFile, apply_rules


def _wait_until(state: GroupState, due_ms: int) -> None:
    """A key's timer at its first due time; Spark drops timers with each batch that has rows of the key, so each sets it again."""
    state.setTimeoutDuration(max(1, due_ms - state.getCurrentProcessingTimeMs()))


def streaming_delta_sums(points: DataFrame, interval_ms: int = 30_000) -> DataFrame:
    """A1: (source, metric, tag_text, value) sums that are not zero, interval_ms after a key's first sample since its last
    emission. points: source, metric, tag_text, value; tag_text is the canonical text of the tags."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, due = state.get if state.exists else (0.0, state.getCurrentProcessingTimeMs() + interval_ms)
        if state.hasTimedOut:
            state.remove()
            if total:
                yield pd.DataFrame([(*key, total)], columns=["source", "metric", "tag_text", "value"])
            return
        state.update((total + sum(float(b["value"].sum()) for b in batches), due))
        _wait_until(state, due)

    schema = "source string, metric string, tag_text string, value double"
    return points.groupBy("source", "metric", "tag_text").applyInPandasWithState(update, schema, "total double, due_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def streaming_bins(values: DataFrame, ttl_ms: int = 70_000, most: int = 4 * FINE) -> DataFrame:
    """(metric, source, tag_text, bin_start_ms, mean, count): centroids of bins ttl_ms after their first sample
    arrived. Rows may be values with counts or centroids of other digests.

    A bin's state is its digest: distinct values with their counts up to `most` of them, and beyond that centroids that take new
    rows in, so its size is bounded however many values come. Bins of EXACT_VALUES distinct values or fewer are given as they are,
    others compressed as in a batch. Means that are null or not finite and counts of 0 or less are left out.
    """
    columns = ["metric", "source", "tag_text", "bin_start_ms"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, weights, due = state.get if state.exists else ([], [], state.getCurrentProcessingTimeMs() + ttl_ms)
        means, counts = np.array(held, float), np.array(weights, np.int64)
        if state.hasTimedOut:
            state.remove()
            if len(means) > EXACT_VALUES:
                means, counts = compress(means, counts, COMPRESSION)
            if len(means):
                yield pd.DataFrame({**{c: [k] * len(means) for c, k in zip(columns, key)}, "mean": means, "count": counts})
            return
        for batch in batches:
            batch = batch[np.isfinite(batch["mean"].to_numpy(float)) & (batch["count"] > 0)]
            means, counts = absorb(means, counts, batch["mean"].to_numpy(float), batch["count"].to_numpy(np.int64), most)
        state.update((means.tolist(), counts.tolist(), due))
        _wait_until(state, due)

    schema = "metric string, source string, tag_text string, bin_start_ms long, mean double, count long"
    return values.groupBy(*columns).applyInPandasWithState(update, schema, "means array<double>, counts array<long>, due_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def streaming_counters(rows: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Running totals of non-delta counters by series; a series that is idle for idle_ms starts again from zero."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = (state.get[0] if state.exists else 0) + sum(int(b["n"].sum()) for b in batches)
        state.update((total,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, total)], columns=["metric", "source", "tag_text", "value"])

    schema = "metric string, source string, tag_text string, value long"
    return rows.groupBy("metric", "source", "tag_text").applyInPandasWithState(update, schema, "total long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def with_reloaded_rules(path: str, port: str, kind: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies the port's current rules and hands the batch on."""
    rules = RuleFile(path)

    def each(batch: DataFrame, epoch: int) -> None:
        sink(apply_rules(batch, rules.for_port(port), kind), epoch)

    return each
