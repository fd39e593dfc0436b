"""Deterministic span sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from .enrich import best_policy


def is_debug(annotations: Column) -> Column:
    """T1."""
    return F.exists(annotations, lambda a: (a["key"] == "debug") & (a["value"] == "true"))


def bucket(trace_id: Column) -> Column:
    """0..99 from the trace's low bits; abs of the least long stays negative, so its remainder is taken first."""
    return F.abs(T.low_bits(trace_id) % 100)


def sampled_by_rate(trace_id: Column, rate: float) -> Column:
    """A share of the traces; rates outside [0, 1) don't sample."""
    return F.lit(True) if not 0 <= rate < 1 else F.abs(T.low_bits(trace_id) % 1_000_000) < int(rate * 1_000_000)


def sample_spans(spans: DataFrame, policies: list[tuple[str, Column, int]], rate: float = 1.0, min_duration_ms: int = 0) -> DataFrame:
    """spans with keep and policy, and `_sampledByPolicy` among the annotations of those a policy kept.

    Debug spans stay. A span that a policy of p percent matches stays if its bucket is at most p (so p percent keeps
    p + 1 of 100 buckets, as the wire contract has it). Others stay by rate or, where set, by a longer duration.
    """
    policy, percent = best_policy(policies) if policies else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    debug = is_debug(F.col("annotations"))
    fallback = sampled_by_rate(F.col("trace_id"), rate)
    if min_duration_ms > 0:
        by_duration = F.col("duration_ms") > min_duration_ms
        fallback = by_duration if not 0 <= rate < 1 else fallback | by_duration
    matched = policy.isNotNull() & ~debug
    out = spans.withColumn("policy", F.when(matched, policy)).withColumn("keep", F.when(debug, F.lit(True)).when(matched, bucket(F.col("trace_id")) <= percent).otherwise(fallback))
    return out.withColumn("annotations", F.when(F.col("keep") & F.col("policy").isNotNull(), T.append(F.col("annotations"), "_sampledByPolicy", F.col("policy"))).otherwise(F.col("annotations")))
