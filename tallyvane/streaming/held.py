"""Tables that foreachBatch functions carry from one micro-batch to the next.

What is carried is a plain table in a folder that driver and executors share, and every step is a join or an aggregation of columns:
a host or a series that has a third of all rows is cut or pre-aggregated like any other, and nothing is held in a Python worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import host_tags_as_of

Each = Callable[[DataFrame, int], None]
Clock = Callable[[], int]
#: Before any time a row may have.
LONG_AGO = -(1 << 62)
#: Fixed value: how long a host's tags count after they came.
TAGS_LAST_MS = 6 * 3_600_000


def clock_ms() -> int:
    return int(time.time() * 1000)


class HeldTable:
    """Two folders in turn: batch n reads what batch n - 1 wrote and writes the other one, so a batch that is tried again reads the
    same rows and replaces what it wrote. The first batch of a query has none, whatever an earlier query left there."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path.rstrip("/"), schema

    def before(self, spark: SparkSession, epoch: int) -> DataFrame:
        return self._of(spark, epoch - 1) if epoch else spark.createDataFrame([], self.schema)

    def after(self, rows: DataFrame, epoch: int) -> DataFrame:
        """The rows as they were written."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{epoch % 2}")
        return self._of(rows.sparkSession, epoch)

    def _of(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/{epoch % 2}")


def with_host_tags(path: str, sink: Each, ts: str = "ts_ms", expiry_ms: int | None = TAGS_LAST_MS, now: Clock = clock_ms) -> Each:
    """E3 on a stream: a foreachBatch function for samples and intake in one stream, told apart by system_tags, which samples lack.

    Samples go to the sink with the last tags of their host under their own: those that came in an earlier batch, however late the
    sample's own time is, or the latest of the same batch that are not newer than the sample. Hosts without intake for expiry_ms
    are forgotten; null: never. Of equally old intake of a batch the greatest tags count. Rows without source or time have no tags.
    """
    held = HeldTable(path, f"source string, {ts} long, system_tags map<string,string>, seen_ms long")

    def each(batch: DataFrame, epoch: int) -> None:
        at = now()
        known = held.before(batch.sparkSession, epoch)
        if expiry_ms is not None:
            known = known.filter(F.col("seen_ms") > at - expiry_ms)
        came = batch.filter(F.col("system_tags").isNotNull() & F.col("source").isNotNull() & F.col(ts).isNotNull()).select("source", ts, "system_tags", F.lit(at).cast("long").alias("seen_ms"))
        # what was known is older than all of the batch
        marks = known.withColumn(ts, F.lit(LONG_AGO).cast("long")).unionByName(came)
        entries = F.array_sort(F.map_entries("system_tags"))
        latest = marks.groupBy("source", ts).agg(F.max(F.struct(entries.alias("e"), "seen_ms")).alias("_m")).groupBy("source").agg(F.max(F.struct(ts, "_m")).alias("_l"))
        held.after(latest.select("source", F.col(f"_l.{ts}").alias(ts), F.map_from_entries("_l._m.e").alias("system_tags"), F.col("_l._m.seen_ms").alias("seen_ms")), epoch)
        one = marks.groupBy("source", ts).agg(F.max(entries).alias("_e")).select("source", ts, F.map_from_entries("_e").alias("system_tags"))
        samples = batch.filter("system_tags IS NULL").drop("system_tags")
        whole = F.col("source").isNotNull() & F.col(ts).isNotNull()
        tagged = host_tags_as_of(samples.filter(whole), one, ts)
        sink(tagged.select(*samples.columns).unionByName(samples.filter(~whole)), epoch)

    return each


SERIES = ["matcher", "kind", "metric", "source", "tag_text"]


def with_live_series(path: str, matchers: Callable[[], list[str]], sink: Each, idle_ms: int = 3_600_000, now: Clock = clock_ms) -> Each:
    """L4, L5, L8 on a stream: a foreachBatch function that hands on every live series (SERIES, value, seen_ms) at each batch, which is a flush.

    Rows have SERIES (kind: counter or gauge), value, ts_ms and seq. A counter's value is its total, a gauge's its latest by ts_ms and
    seq, and both are given again at each flush until nothing has come for idle_ms; then, or when matchers() no longer names
    their matcher, they are gone and would start anew. Name a matcher by all it is configured with, so that a changed one is another.
    Values that are null or not finite count for nothing. A stream that is to flush while nothing comes needs a clock: a `rate` source
    with null values joined to it by union.
    """
    held = HeldTable(path, "matcher string, kind string, metric string, source string, tag_text string, value double, seen_ms long")

    def each(batch: DataFrame, epoch: int) -> None:
        at = now()
        configured = F.col("matcher").isin(matchers())
        value = F.col("value").cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        came = batch.filter(configured & finite).select(*SERIES, value.alias("value"), F.lit(at).cast("long").alias("seen_ms"), F.struct(F.lit(1).alias("new"), "ts_ms", "seq").alias("_order"))
        zero = F.lit(0).cast("long")
        known = held.before(batch.sparkSession, epoch).filter(configured & (F.col("seen_ms") > at - idle_ms))
        known = known.withColumn("_order", F.struct(F.lit(0).alias("new"), zero.cast(batch.schema["ts_ms"].dataType).alias("ts_ms"), zero.cast(batch.schema["seq"].dataType).alias("seq")))
        total = F.when(F.col("kind") == "counter", F.sum("value")).otherwise(F.max_by("value", "_order"))
        live = known.unionByName(came).groupBy(*SERIES).agg(total.alias("value"), F.max("seen_ms").alias("seen_ms"))
        sink(held.after(live, epoch), epoch)

    return each
