"""Validation and reject accounting (V1-V8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRIC_CHARS = r"^[∆Δ]?~?[-a-zA-Z0-9_./,]+$"
TAG_KEY_CHARS = r"^[-a-zA-Z0-9_.]+$"


def with_status(rows: DataFrame, rejected: Column, blocked: Column | None = None) -> DataFrame:
    """V2: rows with status (rejected, blocked or accepted) and reason; rejected is the reason or null."""
    status = F.when(rejected.isNotNull(), F.lit("rejected"))
    if blocked is not None:
        status = status.when(blocked, F.lit("blocked"))
    return rows.withColumn("status", status.otherwise(F.lit("accepted"))).withColumn("reason", rejected)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the dead letters with their reasons."""
    return rows.filter("status = 'accepted'"), rows.filter("status <> 'accepted'")


def point_error(metric: Column, source: Column, tags: Column, max_metric: int = 256, max_source: int = 1024, max_tag: int = 254) -> Column:
    """V1: why a point is not valid, or null."""
    long_tag = F.exists(F.map_entries(tags), lambda e: F.char_length(e["key"]) + F.char_length(e["value"]) > max_tag)
    bad_key = ~F.forall(F.map_keys(tags), lambda k: k.rlike(TAG_KEY_CHARS))
    return (
        F.when(source.isNull() | (source == ""), F.lit("WF-406: source is empty"))
        .when(F.char_length(source) > max_source, F.lit("WF-407: source is too long"))
        .when(F.char_length(metric) > max_metric, F.lit("WF-408: metric is too long"))
        .when(~F.coalesce(metric.rlike(METRIC_CHARS), F.lit(False)), F.lit("WF-400: illegal character in metric"))
        .when(F.coalesce(bad_key, F.lit(False)), F.lit("WF-401: illegal character in tag key"))
        .when(F.coalesce(long_tag, F.lit(False)), F.lit("WF-411: tag is too long"))
    )


def annotations_error(name: Column, source: Column, annotations: Column, what: str, max_name: int = 1024, max_source: int = 1024, max_value: int = 1024) -> Column:
    """V1 of spans and logs (what: the name's meaning, such as `span name` or `message`): why it is not valid, or null."""
    some = F.coalesce(annotations, F.array())
    return (
        F.when(source.isNull() | (source == ""), F.lit("WF-406: source is empty"))
        .when(F.char_length(source) > max_source, F.lit("WF-407: source is too long"))
        .when(name.isNull() | (name == ""), F.lit(f"{what} is empty"))
        .when(F.char_length(name) > max_name, F.lit(f"{what} is too long"))
        .when(F.exists(some, lambda a: ~F.coalesce(a["key"].rlike(TAG_KEY_CHARS), F.lit(False))), F.lit("illegal character in annotation key"))
        .when(F.exists(some, lambda a: F.char_length(a["value"]) > max_value), F.lit("annotation is too long"))
    )


def status_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V3: received, blocked and rejected; a reject counts as blocked too."""
    blocked, rejected = F.count_if(F.col("status") != "accepted"), F.count_if(F.col("status") == "rejected")
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("received"), blocked.alias("blocked"), rejected.alias("rejected"))


def span_window(spans: DataFrame, now_ms: Column, delay_minutes: int = 0, ahead_hours: int = 24) -> DataFrame:
    """V4: reject spans that ended too long ago or start too far ahead; `*` in names becomes `-`."""
    late = (F.col("start_ms") + F.col("duration_ms") < now_ms - delay_minutes * 60_000) if delay_minutes else F.lit(False)
    reason = F.when(late, F.lit("span outside of acceptable time window")).when(F.col("start_ms") > now_ms + ahead_hours * 3_600_000, F.lit("span outside of acceptable time window"))
    return with_status(spans.withColumn("name", F.replace("name", F.lit("*"), F.lit("-"))), reason)


def key_error(keys: Column) -> Column:
    """V5: the reason where a key of an event or source tag has other than letters, digits, - _ and dots."""
    return F.when(~F.forall(keys, lambda k: k.rlike(TAG_KEY_CHARS)), F.lit("WF-401: illegal character in key"))


def feature_gate(rows: DataFrame, enabled: dict[str, bool], entity: str = "entity") -> DataFrame:
    """V6: rows of entities that are switched off are blocked with the reason."""
    off = [k for k, v in enabled.items() if not v]
    return with_status(rows, F.when(F.col(entity).isin(*off), F.concat(F.col(entity), F.lit(" is not enabled"))))


def size_distributions(points: DataFrame, now_ms: Column, by: list[str], exact: bool = False) -> DataFrame:
    """V7: lag, tag count, name length and total tag length of records. Quantiles are approximate (bounded state) unless exact."""
    quantile = (lambda m, q: F.percentile(m, q)) if exact else (lambda m, q: F.percentile_approx(m, q, 10_000).cast("double"))
    tag_length = F.aggregate(F.map_entries("tags"), F.lit(0), lambda s, e: s + F.char_length(e["key"]) + F.char_length(e["value"]))
    measures = {"lag_ms": now_ms - F.col("ts_ms"), "tag_count": F.size(F.map_keys("tags")), "name_length": F.char_length("metric"), "tag_length": tag_length}
    aggregates = [x for k, m in measures.items() for x in (F.min(m).alias(f"{k}_min"), F.max(m).alias(f"{k}_max"), quantile(m, 0.5).alias(f"{k}_p50"), quantile(m, 0.95).alias(f"{k}_p95"))]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *aggregates)


def received_rates(rows: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """V8: each second's count, the mean rates over the minute and the five minutes up to it, and the greatest second of the minute."""
    seconds = rows.withColumn("second", F.unix_seconds(F.col(ts).cast("timestamp"))).groupBy(*by, "second").agg(F.count("*").alias("n"))
    over = lambda n: Window.partitionBy(*by).orderBy("second").rangeBetween(1 - n, 0)
    return seconds.select(*by, "second", "n", (F.sum("n").over(over(60)) / 60).alias("rate_1m"), (F.sum("n").over(over(300)) / 300).alias("rate_5m"), F.max("n").over(over(60)).alias("burst_1m"))


def any_error(*errors: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), errors)
