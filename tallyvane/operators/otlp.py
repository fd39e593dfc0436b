"""OTLP metrics and traces, from JSON bodies or from what sources.protobuf reads of binary ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T

ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:struct<values:array<struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>>>,kvlistValue:string>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY}>>"
NUMBER_POINTS = f"array<struct<attributes:{ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string>>"
HISTOGRAM_POINTS = f"array<struct<attributes:{ATTRIBUTES},timeUnixNano:string,bucketCounts:array<string>,explicitBounds:array<double>>>"
EXPONENTIAL_POINTS = (
    f"array<struct<attributes:{ATTRIBUTES},timeUnixNano:string,scale:int,zeroCount:string,"
    "positive:struct<`offset`:int,bucketCounts:array<string>>,negative:struct<`offset`:int,bucketCounts:array<string>>>>"
)
SUMMARY_POINTS = f"array<struct<attributes:{ATTRIBUTES},timeUnixNano:string,`count`:string,`sum`:double,quantileValues:array<struct<quantile:double,value:double>>>>"
METRICS = (
    f"struct<resourceMetrics:array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeMetrics:array<struct<scope:struct<name:string,version:string>,"
    f"metrics:array<struct<name:string,gauge:struct<dataPoints:{NUMBER_POINTS}>,`sum`:struct<aggregationTemporality:int,dataPoints:{NUMBER_POINTS}>,"
    f"histogram:struct<aggregationTemporality:int,dataPoints:{HISTOGRAM_POINTS}>,exponentialHistogram:struct<aggregationTemporality:int,dataPoints:{EXPONENTIAL_POINTS}>,"
    f"summary:struct<dataPoints:{SUMMARY_POINTS}>>>>>>>>"
)
DELTA, CUMULATIVE = 1, 2
DELTA_PREFIX = "∆"
DURATIONS_MS = (60_000, 3_600_000, 86_400_000)
SOURCE_KEYS = ("source", "host.name", "hostname", "host.id")
UNSUPPORTED = "<Unsupported value type>"


def any_text(value: Column) -> Column:
    """An OTLP value as text: arrays as [a, b], bytes in base64, key-value lists as a marker."""
    scalar = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"))
    array = F.concat(F.lit("["), F.array_join(F.transform(value["arrayValue"]["values"], scalar), ", "), F.lit("]"))
    return F.coalesce(scalar(value), value["bytesValue"], array, F.when(value["kvlistValue"].isNotNull(), F.lit(UNSUPPORTED)))


def attribute_map(attributes: Column) -> Column:
    pairs = F.transform(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), any_text(a["value"]).alias("value")))
    return T.from_pairs(F.filter(pairs, lambda p: p["value"].isNotNull()))


def source_and_tags(attributes: Column, default_source: str) -> tuple[Column, Column]:
    """The source by precedence and the other attributes; a `source` that was not chosen becomes `_source`,
    `service.name` is `service` where there is none."""
    found = F.coalesce(*[attributes[k] for k in SOURCE_KEYS], F.lit(default_source))
    chosen = F.coalesce(*[F.when(attributes[k].isNotNull(), F.lit(k)) for k in SOURCE_KEYS], F.lit(""))
    rest = T.rename(T.once(chosen, lambda c: F.map_filter(attributes, lambda k, _: k != c)), "source", "_source")
    return found, T.rename(rest, "service.name", "service", lambda t: ~F.array_contains(F.map_keys(t), "service"))


METRIC_KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")


def _unread(body: str, held: Column, what: str) -> Column:
    """An error for a body that holds nothing and is no empty request. held: its list, null where there is none."""
    return F.when(held.isNull() & ~F.coalesce(F.col(body).rlike(r"^\s*\{\s*\}\s*$"), F.lit(False)), F.lit(f"not an OTLP {what} request"))


def decode_metrics(bodies: DataFrame, body: str = "body", default_source: str = "unknown", resource_attributes: bool = True) -> DataFrame:
    """One row for each metric: its name, kinds' points, and the resource's attributes (empty unless included). `_bad` is the error of a
    body that is no request, which has a row of its own, and of a metric of no known kind.

    The body is JSON, or a struct of METRICS with an error beside it, as sources.protobuf reads it.
    """
    if dict(bodies.dtypes)[body] == "string":
        read = T.settled(bodies, {"_q": F.from_json(body, METRICS)["resourceMetrics"]}).withColumn("_unread", _unread(body, F.col("_q"), "metrics"))
    else:
        read = bodies.withColumn("_q", F.col(body)["message"]["resourceMetrics"]).withColumn("_unread", F.col(body)["error"])
    out = read.withColumn("_r", F.explode_outer("_q")).withColumn("_s", F.explode_outer("_r.scopeMetrics")).withColumn("_m", F.explode_outer("_s.metrics"))
    resource = F.col("_resource")
    own = T.empty_tags() if not resource_attributes else resource
    unknown = F.col("_m").isNotNull() & F.coalesce(*[F.when(F.col(f"_m.{k}").isNotNull(), F.lit(False)) for k in METRIC_KINDS], F.lit(True))
    bad = F.coalesce(F.col("_unread"), F.when(unknown, F.lit("unsupported metric type")))
    out = T.settled(out.filter("_m IS NOT NULL OR _unread IS NOT NULL"), {"_resource": attribute_map(F.col("_r.resource.attributes"))}, [*bodies.columns, "_m", "_unread"])
    return out.select(*bodies.columns, F.col("_m.name").alias("name"), own.alias("resource"), F.coalesce(*[resource[k] for k in SOURCE_KEYS], F.lit(default_source)).alias("fallback_source"), "_m", bad.alias("_bad"))


def _points(metrics: DataFrame, kinds: Column, columns: list[str], errors: bool) -> DataFrame:
    """A row for each point of the kinds, an array of structs t and points that may hold nulls; for a kind without points one with
    a null point; and, with errors, for what is bad."""
    out = metrics.withColumn("_k", F.explode_outer(F.when(F.col("_bad").isNull(), F.filter(kinds, lambda x: x.isNotNull()))))
    out = out.filter(F.col("_k").isNotNull() | (F.col("_bad").isNotNull() if errors else F.lit(False))).withColumn("_t", F.col("_k.t")).withColumn("_p", F.explode_outer("_k.points"))
    attributes = T.merge(F.col("resource"), attribute_map(F.col("_p.attributes")))
    out = T.settled(out, {"_a": attributes})
    source, rest = source_and_tags(F.col("_a"), "")
    nanos = F.col("_p.timeUnixNano").try_cast("long")
    source = F.when(source == "", F.col("fallback_source")).otherwise(source)
    some = F.col("_p").isNotNull()
    return T.settled(out, {"source": F.when(some, source), "tags": F.when(some, rest).otherwise(T.empty_tags()), "ts_ms": T.whole(nanos, 1_000_000)}, [*columns, "_bad", "_t", "name", "_p"])


def _own(metrics: DataFrame) -> list[str]:
    return [c for c in metrics.columns if c not in ("name", "resource", "fallback_source", "_m", "_bad")]


def numbers(metrics: DataFrame, errors: bool = True) -> DataFrame:
    """Points of gauges and sums, in one pass; a delta sum gets the delta prefix, one of another temporality is an error. errors:
    whether bodies and metrics that nothing decodes come out with theirs (one of the decoders has to say so)."""
    own = _own(metrics)
    kind = lambda k, t: F.when(F.col(f"_m.{k}").isNotNull(), F.struct(t.alias("t"), F.coalesce(F.col(f"_m.{k}.dataPoints"), F.array().cast(NUMBER_POINTS)).alias("points")))
    p = _points(metrics, F.array(kind("gauge", F.lit(CUMULATIVE)), kind("sum", F.col("_m.sum.aggregationTemporality"))), own, errors)
    some = F.col("_p").isNotNull()
    name = F.when(some & (F.col("_t") == DELTA), F.concat(F.lit(DELTA_PREFIX), "name")).otherwise(F.col("name"))
    value = F.coalesce(F.col("_p.asDouble"), F.col("_p.asInt").try_cast("double"))
    error = F.coalesce(F.col("_bad"), F.when(~some, F.lit("no data points")).when(~F.coalesce(F.col("_t").isin(DELTA, CUMULATIVE), F.lit(False)), F.lit("unsupported temporality")))
    return p.select(*own, name.alias("metric"), "source", "ts_ms", value.alias("value"), "tags", error.alias("error"))


def _renamed(tags: Column, key: str) -> Column:
    return T.rename(tags, key, f"_{key}")


def summaries(metrics: DataFrame, errors: bool = True) -> DataFrame:
    """`_sum`, `_count` and one point for each quantile, tagged with it. errors: as of numbers()."""
    own = _own(metrics)
    kinds = F.array(F.when(F.col("_m.summary").isNotNull(), F.struct(F.lit(None).cast("int").alias("t"), F.col("_m.summary.dataPoints").alias("points"))))
    p = _points(metrics, kinds, own, errors).filter("_p IS NOT NULL OR _bad IS NOT NULL")
    row = lambda suffix, value, q: F.struct(F.lit(suffix).alias("suffix"), value.cast("double").alias("value"), q.cast("string").alias("q"))
    quantiles = F.transform(F.coalesce("_p.quantileValues", F.array().cast("array<struct<quantile:double,value:double>>")), lambda x: row("", F.coalesce(x["value"], F.lit(0.0)), F.coalesce(x["quantile"], F.lit(0.0))))
    rows = F.concat(F.array(row("_sum", F.coalesce("_p.sum", F.lit(0.0)), F.lit(None)), row("_count", F.coalesce(F.col("_p.count").try_cast("double"), F.lit(0.0)), F.lit(None))), quantiles)
    out = p.withColumn("_x", F.explode_outer(F.when(F.col("_p").isNotNull(), rows)))
    tags = T.put(_renamed(F.col("tags"), "quantile"), "quantile", F.col("_x.q"))
    return out.select(*own, F.concat("name", F.coalesce("_x.suffix", F.lit(""))).alias("metric"), "source", "ts_ms", F.col("_x.value").alias("value"), F.when(F.col("_x.q").isNull(), F.col("tags")).otherwise(tags).alias("tags"), F.col("_bad").alias("error"))


def exponential_buckets(scale: Column, zero: Column, positive: Column, negative: Column) -> tuple[Column, Column]:
    """(counts, bounds) of an exponential histogram, from the lowest bucket up. bounds has one entry more than counts:
    bucket i reaches from bounds[i] to bounds[i + 1]."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -scale))
    longs = lambda side: F.coalesce(side["bucketCounts"].cast("array<bigint>"), F.array().cast("array<bigint>"))
    side_of = lambda side: F.struct(base.alias("base"), F.size(longs(side)).alias("n"), F.coalesce(side["offset"], F.lit(0)).alias("low"))
    edges = lambda side: T.once(side_of(side), lambda s: F.transform(F.sequence(F.lit(0), s["n"]), lambda i: F.pow(s["base"], i + s["low"])))
    counts = F.concat(F.reverse(longs(negative)), F.array(F.coalesce(zero.cast("bigint"), F.lit(0).cast("bigint"))), longs(positive))
    bounds = F.concat(F.reverse(F.transform(edges(negative), lambda x: -x)), edges(positive))
    return counts, bounds


def explicit_error(counts: Column, bounds: Column) -> Column:
    """D21."""
    return F.when(F.size(F.coalesce(bounds, F.array().cast("array<double>"))) != F.size(counts) - 1, F.lit("explicit bounds must be one fewer than bucket counts"))


def cumulative_rows(counts: Column, uppers: Column) -> Column:
    """(le, value) of running bucket sums; le is text, the last one +Inf."""
    none = F.array().cast("array<bigint>")
    running = F.aggregate(counts, none, lambda sums, x: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("bigint")) + x))
    return F.transform(running, lambda v, i: F.struct(F.coalesce(F.get(uppers, i).cast("string"), F.lit("+Inf")).alias("le"), v.cast("double").alias("value")))


def explicit_centroids(counts: Column, bounds: Column) -> Column:
    """bounds' midpoints; the edge bound for the first and last bucket; 0.0 without bounds. Empty buckets go."""
    last = F.size(counts) - 1
    mean = lambda i: F.when(F.size(bounds) == 0, F.lit(0.0)).when(i == 0, F.get(bounds, F.lit(0))).when(i == last, F.get(bounds, last - 1)).otherwise((F.get(bounds, i - 1) + F.get(bounds, i)) / 2)
    return F.filter(F.transform(counts, lambda c, i: F.struct(mean(i).alias("mean"), c.cast("int").alias("count"))), lambda x: x["count"] > 0)


def bucket_centroids(counts: Column, bounds: Column) -> Column:
    """Midpoints of buckets that all have two bounds."""
    return F.filter(F.transform(counts, lambda c, i: F.struct(((F.get(bounds, i) + F.get(bounds, i + 1)) / 2).alias("mean"), c.cast("int").alias("count"))), lambda x: x["count"] > 0)


def _histograms(metrics: DataFrame, errors: bool) -> DataFrame:
    """Points of both kinds of histograms, the body read once."""
    own = _own(metrics)
    types = {"histogram": HISTOGRAM_POINTS.removeprefix("array<").removesuffix(">"), "exponentialHistogram": EXPONENTIAL_POINTS.removeprefix("array<").removesuffix(">")}
    one = lambda p, k: F.struct(p["attributes"].alias("attributes"), p["timeUnixNano"].alias("timeUnixNano"), *[(p if k == j else F.lit(None).cast(types[j])).alias(j) for j in types])
    kind = lambda k: F.when(F.col(f"_m.{k}").isNotNull(), F.struct(F.col(f"_m.{k}.aggregationTemporality").alias("t"), F.transform(f"_m.{k}.dataPoints", lambda p: one(p, k)).alias("points")))
    p = _points(metrics, F.array(*[kind(k) for k in types]), own, errors).filter("_p IS NOT NULL OR _bad IS NOT NULL")
    e, x = F.col("_p.histogram"), F.col("_p.exponentialHistogram")
    counts, bounds = exponential_buckets(F.coalesce(x["scale"], F.lit(0)), x["zeroCount"], x["positive"], x["negative"])
    p = T.settled(p, {"_explicit": e.isNotNull(), "_c": F.when(e.isNotNull(), e["bucketCounts"].cast("array<bigint>")).when(x.isNotNull(), counts), "_b": F.when(e.isNotNull(), F.coalesce(e["explicitBounds"], F.array().cast("array<double>"))).when(x.isNotNull(), bounds)})
    c, b, plain = F.col("_c"), F.col("_b"), F.col("_explicit")
    columns = {
        "counts": F.when(plain, c).otherwise(F.concat(c, F.array(F.lit(0).cast("bigint")))), "uppers": F.when(plain, b).otherwise(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))),
        "centroids": F.when(plain, explicit_centroids(c, b)).otherwise(bucket_centroids(c, b)), "error": F.coalesce("_bad", F.when(plain, explicit_error(c, b))),
    }
    return T.settled(p, columns, [*own, "_t", "name", "source", "tags", "ts_ms", "_bad"])


def histogram_points(metrics: DataFrame, errors: bool = True) -> DataFrame:
    """Points of cumulative histograms, tagged `le`; errors of histograms of no known temporality. errors: as of numbers()."""
    h = _histograms(metrics, errors).filter(~F.coalesce(F.col("_t") == DELTA, F.lit(False)))
    error = F.coalesce("error", F.when(~F.coalesce(F.col("_t") == CUMULATIVE, F.lit(False)), F.lit("unsupported temporality")))
    out = h.withColumn("error", error).withColumn("_x", F.explode_outer(F.when(error.isNull(), cumulative_rows(F.col("counts"), F.col("uppers")))))
    return out.select(*_own_of(h), F.col("name").alias("metric"), "source", "ts_ms", F.col("_x.value").alias("value"), T.put(_renamed(F.col("tags"), "le"), "le", F.col("_x.le")).alias("tags"), "error")


def _own_of(h: DataFrame) -> list[str]:
    return [c for c in h.columns if c not in ("_t", "name", "source", "tags", "ts_ms", "counts", "uppers", "centroids", "error", "_bad")]


def histogram_bins(metrics: DataFrame, errors: bool = True) -> DataFrame:
    """Each delta histogram as three, of a minute, an hour and a day. errors: as of numbers()."""
    h = _histograms(metrics, errors).filter(F.coalesce(F.col("_t") == DELTA, F.col("_bad").isNotNull()))
    out = h.withColumn("duration_ms", F.explode(F.when(F.col("_bad").isNull(), F.array(*[F.lit(d) for d in DURATIONS_MS])).otherwise(F.array(F.lit(None).cast("int")))))
    start = F.floor(F.col("ts_ms") / F.col("duration_ms")) * F.col("duration_ms")
    return out.select(*_own_of(h), F.col("name").alias("metric"), "source", start.cast("long").alias("bin_start_ms"), "duration_ms", F.when(F.col("error").isNull(), F.col("centroids")).alias("centroids"), "tags", "error")


# --- traces ------------------------------------------------------------------------------------------------------

EVENTS = f"array<struct<timeUnixNano:string,name:string,attributes:{ATTRIBUTES}>>"
SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},"
    f"droppedAttributesCount:bigint,droppedEventsCount:bigint,droppedLinksCount:bigint,events:{EVENTS},status:struct<code:int,message:string>>"
)
TRACES = f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{SPAN}>>>>>>"
#: Span kinds by their number.
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
#: Tags that every span has, with their defaults.
REQUIRED = {"service": "defaultService", "application": "defaultApplication", "cluster": "none", "shard": "none"}


def decode_spans(bodies: DataFrame, body: str = "body", default_source: str = "unknown") -> DataFrame:
    """Spans with annotations and span logs of OTLP trace requests, and a row with the error for a body that is none.
    Required tags are added by with_required_tags after the rules. The body is JSON, or a struct of TRACES with an error beside it."""
    if dict(bodies.dtypes)[body] == "string":
        read = T.settled(bodies, {"_q": F.from_json(body, TRACES)["resourceSpans"]}).withColumn("_unread", _unread(body, F.col("_q"), "trace"))
    else:
        read = bodies.withColumn("_q", F.col(body)["message"]["resourceSpans"]).withColumn("_unread", F.col(body)["error"])
    out = read.withColumn("_r", F.explode_outer("_q")).withColumn("_c", F.explode_outer("_r.scopeSpans")).withColumn("_s", F.explode_outer("_c.spans"))
    merged = T.merge(attribute_map(F.col("_r.resource.attributes")), attribute_map(F.col("_s.attributes")))
    out = T.settled(out.filter("_s IS NOT NULL OR _unread IS NOT NULL"), {"_a": merged})
    source, rest = source_and_tags(F.col("_a"), default_source)
    millis = lambda c: T.whole(F.col(c).try_cast("long"), 1_000_000)
    start, end = millis("_s.startTimeUnixNano"), millis("_s.endTimeUnixNano")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.coalesce("_s.kind", F.lit(0)))
    count = lambda c: F.when(F.col(c) > 0, F.col(c))
    more = [
        ("span.kind", kind), ("parent", F.when(F.length("_s.parentSpanId") > 0, T.uuid_of_hex(F.col("_s.parentSpanId")))), ("w3c.tracestate", F.when(F.length("_s.traceState") > 0, F.col("_s.traceState"))),
        ("otel.scope.name", F.when(F.length("_c.scope.name") > 0, F.col("_c.scope.name"))), ("otel.scope.version", F.when(F.length("_c.scope.version") > 0, F.col("_c.scope.version"))),
        ("otel.dropped_attributes_count", count("_s.droppedAttributesCount")), ("otel.dropped_events_count", count("_s.droppedEventsCount")), ("otel.dropped_links_count", count("_s.droppedLinksCount")),
        ("error", F.when(F.col("_s.status.code") == 2, F.lit("true"))), ("otel.status_description", F.when((F.col("_s.status.code") == 2) & (F.length("_s.status.message") > 0), F.col("_s.status.message"))),
        ("_spanLogs", F.when(F.size("_s.events") > 0, F.lit("true"))),
    ]
    annotations = F.concat(T.canonical(rest).cast(T.ANNOTATIONS), F.filter(F.array(*[T.annotation(k, v) for k, v in more]), lambda a: a["value"].isNotNull()))
    fields = lambda e: T.merge(attribute_map(e["attributes"]), F.create_map(F.lit("name"), e["name"]))
    logs = F.transform("_s.events", lambda e: F.struct(T.whole(e["timeUnixNano"].try_cast("long"), 1000).alias("ts_us"), fields(e).alias("fields")))
    return out.select(
        *bodies.columns, F.col("_s.name").alias("name"), source.alias("source"), T.uuid_of_hex(F.col("_s.spanId")).alias("span_id"), T.uuid_of_hex(F.col("_s.traceId")).alias("trace_id"),
        start.alias("start_ms"), F.when(end == 0, F.lit(0)).otherwise(end - start).cast("long").alias("duration_ms"), annotations.alias("annotations"), F.when(F.size("_s.events") > 0, logs).alias("logs"),
        F.col("_unread").alias("error"),
    )


def with_required_tags(spans: DataFrame) -> DataFrame:
    """Required tags where missing; of each required tag given more than once the first stays."""
    a = F.col("annotations")
    only_first = F.filter(a, lambda x, i: ~x["key"].isin(*REQUIRED) | ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["key"] == x["key"]))
    missing = F.filter(F.array(*[T.annotation(k, F.lit(v)) for k, v in REQUIRED.items()]), lambda d: ~F.exists(a, lambda x: x["key"] == d["key"]))
    return spans.withColumn("annotations", F.concat(only_first, missing))
