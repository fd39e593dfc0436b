"""Keyed aggregation: delta counters, distributions, roll-ups, span metrics, heartbeats, source tags, limits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.digest import COMPRESSION, digest_bins

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
GRANULARITIES = {"MINUTE": MINUTE, "HOUR": HOUR, "DAY": DAY}
DELTA_PREFIXES = ("∆", "Δ")


def granularity_of(duration_ms: Column) -> Column:
    return F.when(duration_ms <= MINUTE, F.lit("MINUTE")).when(duration_ms <= HOUR, F.lit("HOUR")).otherwise(F.lit("DAY"))


def bin_start(ts_ms: Column, duration_ms: int | Column) -> Column:
    return (F.floor(ts_ms / duration_ms) * duration_ms).cast("long")


def is_delta(metric: Column) -> Column:
    return F.substring(metric, 1, 1).isin(*DELTA_PREFIXES)


def delta_sums(points: DataFrame, interval_ms: int = 30_000, arrival: str = "ts_ms") -> DataFrame:
    """A1: sums of delta counters by lower-cased source, metric and tags for each interval of arrival, stamped with the
    interval's end; zero sums are left out, and metrics without a delta prefix don't count (rejected_points has them)."""
    end = bin_start(F.col(arrival), interval_ms) + interval_ms
    keyed = points.filter(is_delta(F.col("metric"))).select(F.trim(F.lower("source")).alias("source"), F.trim("metric").alias("metric"), T.canonical(F.col("tags")).alias("tags"), end.alias("flush_ms"), "value")
    return keyed.groupBy("source", "metric", "tags", "flush_ms").agg(F.sum("value").alias("value")).filter("value <> 0")


def rejected_points(points: DataFrame) -> DataFrame:
    return points.filter(~is_delta(F.col("metric"))).withColumn("reason", F.lit("not a delta counter"))


def value_bins(points: DataFrame, duration_ms: int = MINUTE) -> DataFrame:
    """A2: exact distributions: the count of each value of a bin (source, metric, tags, bin_start_ms, mean)."""
    keyed = points.select("metric", "source", T.canonical(F.col("tags")).alias("tags"), bin_start(F.col("ts_ms"), duration_ms).alias("bin_start_ms"), F.lit(duration_ms).alias("duration_ms"), F.col("value").alias("mean"))
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("count"))


BIN_KEYS = ["metric", "source", "tags", "bin_start_ms", "duration_ms"]


def explode_centroids(histograms: DataFrame) -> DataFrame:
    """(keys, mean, count) of distributions; counts of 0 or less and non-finite means are left out."""
    rows = histograms.select("metric", "source", "tags", "bin_start_ms", "duration_ms", F.explode("centroids").alias("c"))
    finite = ~F.isnan("c.mean") & (F.abs("c.mean") != F.lit(float("inf")))
    return rows.filter((F.col("c.count") > 0) & finite).select("metric", "source", "tags", "bin_start_ms", "duration_ms", F.col("c.mean").cast("double").alias("mean"), F.col("c.count").cast("long").alias("count"))


def merge_histograms(rows: DataFrame, duration_ms: int | None = None) -> DataFrame:
    """A3, A4, A10: centroid rows merged into bins of duration_ms (or of their own). Coarser ones into finer bins are
    left out: rollup_rejects has them."""
    if duration_ms is not None:
        fits = rows.filter(F.col("duration_ms") <= duration_ms)
        rows = fits.withColumn("bin_start_ms", bin_start(F.col("bin_start_ms"), duration_ms)).withColumn("duration_ms", F.lit(duration_ms))
    return rows.groupBy(*BIN_KEYS, "mean").agg(F.sum("count").alias("count"))


def rollup_rejects(rows: DataFrame, duration_ms: int) -> DataFrame:
    return rows.filter(F.col("duration_ms") > duration_ms).withColumn("reason", F.lit("attempting to send coarser granularity distribution"))


def roll_up(points: DataFrame) -> DataFrame:
    """A4: minute, hour and day bins at once; the finest counts are made first and feed the coarser ones."""
    minutes = value_bins(points, MINUTE)
    wide = minutes.withColumn("duration_ms", F.explode(F.array(*[F.lit(d) for d in GRANULARITIES.values()])))
    wide = wide.withColumn("bin_start_ms", bin_start(F.col("bin_start_ms"), F.col("duration_ms")))
    return wide.groupBy(*BIN_KEYS, "mean").agg(F.sum("count").alias("count"))


def distributions(rows: DataFrame, compression: int = COMPRESSION) -> DataFrame:
    """A5: (keys, centroids) of counted values or centroid rows."""
    return digest_bins(rows, BIN_KEYS, compression, "mean", "count")


def run_length_rows(rows: DataFrame, keys: list[str], order: list[str], value: str = "mean", count: str = "count") -> DataFrame:
    """A6 over rows: neighbours in order with equal values as one row with their summed count and first position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_new", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island", value).agg(F.sum(count).alias(count)).withColumnRenamed("_island", "island")


def ripe(bins: DataFrame, first_arrival_ms: str, now_ms: Column, ttl_ms: dict[str, int] | None = None) -> DataFrame:
    """Bins whose time to live since their first sample's arrival is over."""
    ttl = ttl_ms or {"MINUTE": 70_000, "HOUR": 4_200_000, "DAY": 18_000_000}
    due = F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])[granularity_of(F.col("duration_ms"))]
    return bins.filter(F.col(first_arrival_ms) + due < now_ms)


SPAN_DIMENSIONS = ("application", "service", "cluster", "shard", "component")


def _dimensions(spans: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    defaults = {"cluster": "none", "shard": "none", "component": "none"}
    columns = {k: F.coalesce(T.first_value(F.col("annotations"), k), F.lit(defaults[k])) if k in defaults else T.first_value(F.col("annotations"), k) for k in (*SPAN_DIMENSIONS, *custom)}
    return spans.withColumns(columns).withColumn("minute_ms", bin_start(F.col("start_ms"), MINUTE))


def red_metrics(spans: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Invocations, errors and total duration (microseconds) by minute, source, operation and dimensions; spans
    without application or service are left out."""
    rows = _dimensions(spans, custom).filter(F.col("application").isNotNull() & F.col("service").isNotNull())
    error = T.first_value(F.col("annotations"), "error") == "true"
    keys = ["minute_ms", "source", F.col("name").alias("operation"), *SPAN_DIMENSIONS, *custom]
    return rows.groupBy(*keys).agg(F.count("*").alias("invocations"), F.count_if(F.coalesce(error, F.lit(False))).alias("errors"), (F.sum("duration_ms") * 1000).alias("duration_micros"))


def duration_bins(spans: DataFrame) -> DataFrame:
    """Minute distributions of span durations in microseconds, as counted values."""
    rows = _dimensions(spans).filter(F.col("application").isNotNull() & F.col("service").isNotNull())
    return rows.groupBy("minute_ms", "source", F.col("name").alias("operation"), *SPAN_DIMENSIONS, (F.col("duration_ms") * 1000).alias("mean")).agg(F.count("*").alias("count"))


def heartbeats(spans: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (minute, dimensions, source)."""
    return _dimensions(spans, custom).select("minute_ms", "source", *SPAN_DIMENSIONS, *custom).distinct()


def source_tag_state(changes: DataFrame) -> DataFrame:
    """(source, tag) after changes (source, seq, action, tag): SAVE replaces all tags of the source by that change's,
    ADD appends, DELETE removes. Without a fold by source: a tag stands if its last change after the source's last SAVE
    is not a DELETE."""
    saves = changes.filter("action = 'SAVE'").groupBy("source").agg(F.max("seq").alias("_saved"))
    since = changes.groupBy("source", "tag").agg(F.max(F.struct("seq", "action")).alias("_last"))
    out = since.join(saves, "source", "left").filter("(_saved IS NULL OR _last.seq >= _saved) AND _last.action <> 'DELETE'")
    return out.select("source", "tag")


#: What a limit is above the mean, and the rate before any limit: a setting that stands for none.
LEAST_LIMIT, UNLIMITED = 10, 10_000_000.0


def _held(batches: Iterator[pd.DataFrame], by: list[str], change: float, start: float) -> Iterator[pd.DataFrame]:
    """applied and held of suggested limits, which come by key and second. Between two changes the rows are compared at once."""
    key: tuple | None = None
    rate = start
    for batch in batches:
        limits, applied, held = batch["rate_limit"].to_numpy(), np.zeros(len(batch), bool), np.empty(len(batch))
        keys = list(zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in by)))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and keys[a] != key:
                key, rate = keys[a], start
            while a < b:
                far = np.flatnonzero(np.abs(limits[a:b] - rate) > change * rate)
                stop = a + int(far[0]) if len(far) else b
                held[a:stop] = rate
                if stop < b:
                    rate = held[stop] = limits[stop]
                    applied[stop] = True
                a = stop + 1
        yield batch.assign(applied=applied, held=held)


def traffic_limits(rows: DataFrame, ts: str, by: list[str], history: int = 600, least: int = 60, headroom: float = 1.15, change: float = 0.05, start: float = UNLIMITED) -> DataFrame:
    """(by, second, n, rate_limit, applied, held): LEAST_LIMIT + headroom times the mean count of the last `history` seconds, quiet ones
    from the first traffic on as zeros, once `least` are known; it is applied if it is off the rate that is held by more than `change` of that.

    Suggestions change only while the history fills, with a second's traffic, and when that leaves the history; there is a row for
    those seconds up to the key's last traffic, and none else. So rows follow seconds with traffic, however long the quiet
    between. The held rate is carried over a key's seconds in their order, one row at a time in memory.
    """
    seconds = rows.withColumn("second", F.unix_seconds(F.col(ts).cast("timestamp"))).filter("second IS NOT NULL").groupBy(*by, "second").agg(F.count("*").alias("n"))
    bounds = seconds.groupBy(*by).agg(F.min("second").alias("_first"), F.max("second").alias("_last"))
    fills = bounds.select(*by, F.explode(F.sequence("_first", F.least(F.col("_first") + history - 1, "_last"))).alias("second"), F.lit(0).cast("long").alias("n"))
    leaves = seconds.select(*by, (F.col("second") + history).alias("second"), F.lit(0).cast("long").alias("n"))
    known = seconds.unionByName(fills).unionByName(leaves).groupBy(*by, "second").agg(F.sum("n").alias("n"))
    own = [bounds[c].eqNullSafe(known[c]) for c in by]
    inside = known.join(bounds, reduce(lambda a, b: a & b, own), "inner").select(*[known[c] for c in by], "second", "n", "_first", "_last")
    inside = inside.filter("second <= _last")
    total = F.sum("n").over(Window.partitionBy(*by).orderBy("second").rangeBetween(1 - history, 0))
    size = F.least(F.col("second") - F.col("_first") + 1, F.lit(history))
    limits = inside.withColumn("rate_limit", LEAST_LIMIT + total / size * headroom).filter(size >= least).select(*by, "second", "n", "rate_limit")
    dealt = limits.repartition(*by).sortWithinPartitions(*by, "second")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in limits.schema) + ", applied boolean, held double"
    return dealt.mapInPandas(lambda batches: _held(batches, by, change, start), schema)
