"""Decoders of text lines (formats of points, histograms, spans, span logs, events and source tags).

Every decoder is a projection: the input's columns stay, decoded columns are added, and `error` holds the
reason where a line can't be decoded. Quoted names may hold spaces and escaped quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T

TOKEN = r'"(?:[^"\\]|\\.)*"|[^\s"=]+'
VALUE = r'"(?:[^"\\]|\\.)*"|\S+'
PAIR = rf"({TOKEN})=({VALUE})"
MARK = "\x01"
SECOND = 1000
GRANULARITY_MS = {"!M": 60_000, "!H": 3_600_000, "!D": 86_400_000}


def unquote(token: Column) -> Column:
    inner = lambda t: F.regexp_replace(F.regexp_extract(t, r'^"(.*)"$', 1), r"\\(.)", "$1")
    return T.once(token, lambda t: F.when(t.startswith('"'), inner(t)).otherwise(t))


def pairs(text: Column) -> Column:
    """(key, value) structs of all `k=v` in the text, in order, quotes removed."""
    # a key without quotes has no `=`
    key = lambda p: F.when(p.startswith('"'), F.regexp_extract(p, PAIR, 1)).otherwise(F.substring_index(p, "=", 1))
    one = lambda k, p: F.struct(unquote(k).alias("key"), unquote(F.substr(p, F.char_length(k) + 2)).alias("value"))
    return F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), lambda p: T.once(key(p), lambda k: one(k, p)))


def _parts(lines: DataFrame, line: str, shape: str, groups: int, tags: int) -> DataFrame:
    """lines with the groups of the shape as _g1, _g2 ... (empty where the line has another shape) and the pairs of one of them as _pairs."""
    # one match for all groups, with a mark between them; lines that have the mark themselves are matched for each
    numbers = range(1, groups + 1)
    apart = F.split(F.regexp_replace(line, shape, MARK.join(f"${g}" for g in numbers)), MARK)
    each = F.array(*[F.regexp_extract(line, shape, g) for g in numbers])
    found = T.settled(lines, {"_g": F.when(F.col(line).contains(MARK), each).otherwise(apart)})
    out = found.select(*lines.columns, *[F.when(F.size("_g") == groups, F.get("_g", F.lit(g - 1))).otherwise(F.when(F.col(line).isNotNull(), F.lit(""))).alias(f"_g{g}") for g in numbers])
    return T.settled(out, {"_pairs": pairs(F.col(f"_g{tags}"))})


def detect_format(line: Column) -> Column:
    """Which decoder a line goes to."""
    return (
        F.when(F.length(line) < 2, F.lit("DEFAULT"))
        .when(line.startswith("@SourceTag") | line.startswith("@SourceDescription"), F.lit("SOURCE_TAG"))
        .when(line.startswith("@Event"), F.lit("EVENT"))
        .when(line.startswith("{") & line.endswith("}"), F.lit("SPAN_LOG"))
        .when(line.rlike(r"^![MHD] "), F.lit("HISTOGRAM"))
        .when(line.startswith("[") & line.endswith("]"), F.lit("LOGS_JSON_ARR"))
        .otherwise(F.lit("DEFAULT"))
    )


def dispatch(lines: DataFrame, line: str = "line", enabled: set[str] | None = None) -> DataFrame:
    """The format of each line and an error for lines no decoder takes. A line with an end-of-transmission mark is
    rejected (and, unlike a port that goes on with it, not decoded too)."""
    fmt = detect_format(F.col(line))
    out = lines.withColumn("format", fmt)
    error = F.when(F.col(line).contains("\x04"), F.lit("end of transmission inside a line"))
    if enabled is not None:
        error = error.when(~F.col("format").isin(*enabled), F.concat(F.lit("no decoder for "), F.col("format")))
    return out.withColumn("error", error)


def _source_of(tag_pairs: Column) -> Column:
    return F.coalesce(T.first_value(tag_pairs, "source"), T.first_value(tag_pairs, "host"))


def _rest(tag_pairs: Column) -> Column:
    return F.filter(tag_pairs, lambda p: ~p["key"].isin("source", "host"))


def decode_points(lines: DataFrame, line: str = "line", now_ms: Column | None = None) -> DataFrame:
    """D3: metric, source, ts_ms, value, tags of `metric value [ts] source=s k=v ...`."""
    shape = rf"^\s*({TOKEN})\s+(\S+)(?:\s+(\d+))?((?:\s+(?:{TOKEN})=(?:{VALUE}))*)\s*$"
    part = lambda g: F.col(f"_g{g}")
    stamp = F.when(part(3) != "", T.millis_by_digits(part(3))).otherwise(now_ms if now_ms is not None else F.unix_millis(F.current_timestamp()))
    columns = {"metric": unquote(part(1)), "source": _source_of(F.col("_pairs")), "ts_ms": stamp, "value": part(2).try_cast("double"), "tags": T.from_pairs(_rest(F.col("_pairs"))), "_other": part(1) == ""}
    out = T.settled(_parts(lines, line, shape, 4, 4), columns, lines.columns)
    error = F.when(F.col("_other"), F.lit("not a point line")).when(F.col("value").isNull(), F.lit("value is not a number")).when(F.col("source").isNull(), F.lit("no source"))
    return out.withColumn("error", error).drop("_other")


def encode_points(metric: Column, value: Column, ts_ms: Column, source: Column, tags: Column) -> Column:
    """The canonical point line: `"metric" value seconds source="s" "k"="v"`."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', r"\\$1"), F.lit('"'))
    rest = F.array_join(F.transform(T.canonical(tags), lambda e: F.concat(F.lit(" "), quote(e["key"]), F.lit("="), quote(e["value"]))), "")
    return F.concat(quote(metric), F.lit(" "), value.cast("string"), F.lit(" "), F.floor(ts_ms / SECOND).cast("string"), F.lit(" source="), quote(source), rest)


def decode_histograms(lines: DataFrame, line: str = "line") -> DataFrame:
    """Metric, source, bin_start_ms, duration_ms, centroids and tags of `!M ts #count mean ... metric source=s`."""
    shape = rf"^(![MHD])\s+(?:(\d+)\s+)?((?:#\d+\s+\S+\s+)+)({TOKEN})((?:\s+(?:{TOKEN})=(?:{VALUE}))*)\s*$"
    part = lambda g: F.col(f"_g{g}")
    found = lambda g: F.regexp_extract_all(part(3), F.lit(r"#(\d+)\s+(\S+)"), F.lit(g))
    centroids = F.zip_with(found(2), found(1), lambda m, c: F.struct(m.try_cast("double").alias("mean"), c.try_cast("int").alias("count")))
    duration = F.create_map(*[F.lit(x) for kv in GRANULARITY_MS.items() for x in kv])[part(1)]
    stamp = T.millis_by_digits(F.when(part(2) != "", part(2)))
    columns = {
        "metric": unquote(part(4)), "source": _source_of(F.col("_pairs")), "duration_ms": duration, "bin_start_ms": T.once(duration, lambda d: F.floor(stamp / d) * d), "centroids": centroids,
        "tags": T.from_pairs(_rest(F.col("_pairs"))), "_other": part(1) == "",
    }
    out = T.settled(_parts(lines, line, shape, 5, 5), columns, lines.columns)
    bad = F.exists("centroids", lambda c: c["mean"].isNull() | c["count"].isNull())
    return out.withColumn("error", F.when(F.col("_other"), F.lit("not a histogram line")).when(bad, F.lit("bad centroid")).when(F.col("source").isNull(), F.lit("no source"))).drop("_other")


def decode_spans(lines: DataFrame, line: str = "line") -> DataFrame:
    """Name, source, ids, start_ms, duration_ms and annotations (repeated keys stay) of `name k=v ... start end`."""
    shape = rf"^\s*({TOKEN})((?:\s+(?:{TOKEN})=(?:{VALUE}))*)\s+(\d+)\s+(\d+)\s*$"
    part = lambda g: F.col(f"_g{g}")
    key = lambda k: T.first_value(F.col("_pairs"), k)
    columns = {
        "name": unquote(part(1)), "source": key("source"), "span_id": key("spanId"), "trace_id": key("traceId"), "start_ms": T.millis_by_digits(part(3)), "duration_ms": T.millis_by_digits(part(4)) - T.millis_by_digits(part(3)),
        "annotations": F.filter("_pairs", lambda p: ~p["key"].isin("source", "spanId", "traceId")), "_other": part(1) == "",
    }
    out = T.settled(_parts(lines, line, shape, 4, 2), columns, lines.columns)
    error = F.when(F.col("_other"), F.lit("not a span line")).when(F.col("source").isNull(), F.lit("no source"))
    return out.withColumn("error", error.when(F.col("span_id").isNull() | F.col("trace_id").isNull(), F.lit("no identifiers"))).drop("_other")


SPAN_LOG_SCHEMA = "spanId string, traceId string, spanSecondaryId string, logs array<struct<timestamp:bigint,fields:map<string,string>>>, span string"


def decode_span_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """span_id, trace_id, logs (microseconds) and the embedded span line of a span-log object."""
    j = F.from_json(line, SPAN_LOG_SCHEMA)
    logs = F.transform(F.col("_j.logs"), lambda x: F.struct(x["timestamp"].alias("ts_us"), x["fields"].alias("fields")))
    out = lines.withColumn("_j", j).select(*lines.columns, F.col("_j.spanId").alias("span_id"), F.col("_j.traceId").alias("trace_id"), F.col("_j.spanSecondaryId").alias("secondary_id"), logs.alias("logs"), F.col("_j.span").alias("span"))
    return out.withColumn("error", F.when(F.col("span_id").isNull() | F.col("trace_id").isNull() | F.col("logs").isNull(), F.lit("not a span log")))


def decode_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Events. hosts and tags are lists; an annotation key given once is an annotation, one given again a dimension."""
    shape = rf"^@Event\s+(\d+)(?:\s+(\d+))?\s+({TOKEN})((?:\s+(?:{TOKEN})=(?:{VALUE}))*)\s*$"
    part = lambda g: F.regexp_extract(line, shape, g)
    start = T.millis_by_digits(part(1))
    end = F.when(part(2) != "", T.millis_by_digits(part(2))).otherwise(start + 1)
    values = lambda k: F.transform(F.filter("_pairs", lambda p: p["key"] == k), lambda p: p["value"])
    rest = F.filter("_pairs", lambda p: ~p["key"].isin("host", "tag"))
    keys = F.array_distinct(F.transform(F.col("_rest"), lambda p: p["key"]))
    grouped = F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter("_rest", lambda p: p["key"] == k), lambda p: p["value"]).alias("values")))
    out = lines.withColumn("_pairs", pairs(part(4))).withColumn("_rest", rest).withColumn("_groups", grouped)
    out = out.select(
        *lines.columns, unquote(part(3)).alias("name"), start.alias("start_ms"), end.alias("end_ms"), values("host").alias("hosts"), values("tag").alias("event_tags"),
        F.map_from_entries(F.transform(F.filter("_groups", lambda g: F.size(g["values"]) == 1), lambda g: F.struct(g["key"], g["values"][0]))).alias("annotations"),
        F.map_from_entries(F.filter("_groups", lambda g: F.size(g["values"]) > 1)).alias("dimensions"),
    )
    return out.withColumn("error", F.when(~F.col(line).rlike(shape), F.lit("not an event line")))


def decode_source_tags(lines: DataFrame, line: str = "line") -> DataFrame:
    """Operation, action, source and values of `@SourceTag action=add source=s tag ...` and `@SourceDescription ...`."""
    shape = rf"^@(SourceTag|SourceDescription)((?:\s+(?:{TOKEN})=(?:{VALUE}))+)((?:\s+(?:{VALUE}))*)\s*$"
    part = lambda g: F.regexp_extract(line, shape, g)
    key = lambda k: T.first_value(F.col("_pairs"), k)
    description = F.when(key("description").isNotNull(), F.array(key("description"))).otherwise(F.array().cast("array<string>"))
    loose = F.transform(F.regexp_extract_all(part(3), F.lit(f"({VALUE})"), F.lit(1)), unquote)
    out = lines.withColumn("_pairs", pairs(part(2))).select(
        *lines.columns, F.when(part(1) == "SourceTag", F.lit("SOURCE_TAG")).otherwise(F.lit("SOURCE_DESCRIPTION")).alias("operation"),
        F.upper(key("action")).alias("action"), key("source").alias("source"), F.concat(loose, description).alias("values"),
    )
    ok = F.col("action").isin("ADD", "SAVE", "DELETE") & F.col("source").isNotNull()
    return out.withColumn("error", F.when(~F.col(line).rlike(shape) | ~F.coalesce(ok, F.lit(False)), F.lit("not a source tag line")))
