"""Enrichment: lookups, as-of tags, sampling policies, tenants, span logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from .lines import decode_spans


def fill_source(rows: DataFrame, hosts: DataFrame, address: str, tag_keys: tuple[str, ...] = ("source", "host")) -> DataFrame:
    """Source from the first non-blank of the tag keys, else the name of the sender's address in hosts (address, host),
    else the address. hosts may be large: Spark broadcasts it only below its size threshold."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    known = hosts.select(F.col("address").alias("_address"), F.col("host").alias("_host"))
    out = rows.join(known, rows[address] == F.col("_address"), "left")
    return out.withColumn("source", F.coalesce(*[filled(F.col("tags")[k]) for k in tag_keys], "_host", F.col(address))).drop("_address", "_host")


def host_tags_as_of(samples: DataFrame, host_tags: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Samples with their host's latest earlier (or equally old) system tags under their own. Both have source and ts.

    One exchange by source: both sides stand in one stream and the last tags seen are carried on. A hot source is
    cut by hour: each hour starts with the last tags of the hours before it, which a small table of (source, hour) has.
    """
    hour = F.floor(F.col(ts) / 3_600_000)
    marks = host_tags.select("source", F.col(ts), F.col("system_tags").alias("_tags"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in samples.schema) + ">").alias("_row"))
    rows = samples.select("source", F.col(ts), F.lit(None).cast(host_tags.schema["system_tags"].dataType).alias("_tags"), F.lit(1).alias("_kind"), F.struct(*samples.columns).alias("_row"))
    both = marks.unionByName(rows).withColumn("_hour", hour)
    last = marks.withColumn("_hour", hour).groupBy("source", "_hour").agg(F.max(F.struct(F.col(ts).alias("t"), F.map_entries("_tags").alias("e"))).alias("_last"))
    hours = both.select("source", "_hour").distinct().join(last, ["source", "_hour"], "left")
    before = Window.partitionBy("source").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(F.col("source").alias("_s"), F.col("_hour").alias("_h"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = both.join(carried, (both.source == carried["_s"]) & (both["_hour"] == carried["_h"]))
    within = Window.partitionBy("source", "_hour").orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.coalesce(F.last("_tags", ignorenulls=True).over(within), F.map_from_entries("_carry.e"))
    out = joined.withColumn("_seen", seen).filter("_kind = 1").select("_row.*", "_seen")
    return out.withColumn("tags", F.when(F.col("_seen").isNull(), F.col("tags")).otherwise(T.merge(F.col("_seen"), F.col("tags")))).drop("_seen")


def best_policy(policies: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """(policy id, percent) of the matching policy with the greatest percent above 0, the first of equals."""
    ranked = [F.when(match & F.lit(percent > 0), F.struct(F.lit(percent).alias("percent"), F.lit(-i).alias("order"), F.lit(name).alias("id"))) for i, (name, match, percent) in enumerate(policies)]
    best = ranked[0] if len(ranked) == 1 else F.greatest(*ranked)
    return best["id"], best["percent"]


def multicast(rows: DataFrame, tenants: DataFrame, tag: str = "multicastingTenantName", central: str = "central") -> DataFrame:
    """E5: every row for the central tenant with the tag, and one more without it for each configured tenant it names."""
    named = rows.withColumn("tenant", F.explode(F.array_distinct(F.transform(F.split(F.col("tags")[tag], ","), F.trim))))
    known = tenants.select(F.col("tenant").alias("_t")).filter(F.col("_t") != central).distinct()
    copies = named.join(known, named.tenant == known["_t"], "left_semi").withColumn("tags", T.drop(F.col("tags"), [tag]))
    return rows.withColumn("tenant", F.lit(central)).unionByName(copies)


def span_logs_with_decision(logs: DataFrame, sampled: Callable[[DataFrame], DataFrame], ruled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Span logs (span: the embedded span line) whose span stays, each decided by its own line and so without a shuffle.

    The line is decoded, changed by `ruled` (which may set a status and a reason) and decided by `sampled` (which adds
    keep and policy). The log's span text then names the policy, or NONE. Logs without an embedded line are reported as they
    are; one whose line can't be decoded, or that a rule took out, stays with the error.
    """
    held = logs.select(F.struct(*logs.columns).alias("_log"), F.col("span").alias("_line"))
    spans = decode_spans(held, "_line").withColumnRenamed("error", "_error")
    spans = spans.withColumns({"status": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    out = sampled(ruled(spans) if ruled else spans)
    given = F.col("_line").isNotNull()
    error = F.when(given, F.coalesce("_error", F.when(F.col("status").isNotNull(), F.coalesce("reason", "status"))))
    label = F.concat(F.lit("_sampledByPolicy="), F.coalesce("policy", F.lit("NONE")))
    stays = out.withColumn("_why", error).filter(~given | F.col("_why").isNotNull() | F.coalesce("keep", F.lit(False)))
    columns = [F.col(f"_log.`{c}`").alias(c) for c in logs.columns if c != "span"]
    return stays.select(*columns, F.when(given & F.col("_why").isNull(), label).otherwise(F.col("_line")).alias("span"), F.col("_why").alias("error"))


def first_by_precedence(tags: Column, keys: list[str], default: Column) -> Column:
    """K2."""
    return F.coalesce(*[tags[k] for k in keys], default)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
