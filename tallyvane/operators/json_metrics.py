"""Decoders of JSON metric payloads: OpenTSDB, nested JSON, collectd, Graphite names, DataDog."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T

TEXT_MAP = "map<string,string>"


def decode_opentsdb(bodies: DataFrame, body: str = "body", hosts: dict[str, str] | None = None) -> DataFrame:
    """Points of OpenTSDB put bodies (an object or an array). Good points stay where others are rejected."""
    schema = "array<struct<metric:string,timestamp:string,value:string,tags:map<string,string>>>"
    as_array = F.when(F.ltrim(body).startswith("{"), F.concat(F.lit("["), F.col(body), F.lit("]"))).otherwise(F.col(body))
    out = bodies.withColumn("_p", F.explode_outer(F.from_json(as_array, schema)))
    tags = F.coalesce(F.col("_p.tags"), T.empty_tags())
    named = lambda name: F.get(F.transform(F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), F.lit(0))
    stamp = F.when(F.col("_p.timestamp").isNotNull(), T.millis_by_digits(F.col("_p.timestamp"))).otherwise(F.unix_millis(F.current_timestamp()))
    out = out.select(
        *bodies.columns, F.col("_p.metric").alias("metric"), F.coalesce(named("host"), named("source"), F.lit("unknown")).alias("source"), stamp.alias("ts_ms"),
        F.col("_p.value").try_cast("double").alias("value"), F.map_filter(tags, lambda k, _: ~F.lower(k).isin("host", "source")).alias("tags"),
    )
    return out.withColumn("error", F.when(F.col("metric").isNull(), F.lit("no metric")).when(F.col("value").isNull(), F.lit("no value")))


def decode_opentsdb_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Telnet `put metric timestamp value tag=value ...`."""
    shape = r"^\s*put\s+(\S+)\s+(\d+)\s+(\S+)((?:\s+\S+=\S+)*)\s*$"
    part = lambda g: F.regexp_extract(line, shape, g)
    keys, values = (F.regexp_extract_all(part(4), F.lit(r"(\S+?)=(\S+)"), F.lit(g)) for g in (1, 2))
    tags = T.from_pairs(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))
    out = lines.withColumn("_t", tags).select(
        *lines.columns, part(1).alias("metric"), F.coalesce(F.col("_t")["host"], F.col("_t")["source"], F.lit("unknown")).alias("source"),
        T.millis_by_digits(part(2)).alias("ts_ms"), part(3).try_cast("double").alias("value"), T.drop(F.col("_t"), ["host", "source"]).alias("tags"),
    )
    return out.withColumn("error", F.when(~F.col(line).rlike(shape), F.lit("not a put line")).when(F.col("value").isNull(), F.lit("no value")))


def _flat(body: str | None) -> list[dict]:
    """Numbers of one nested JSON object: path, value as text and the tags of an object with `value`; or an error."""

    def text(x: object) -> str | None:
        return x if isinstance(x, str) or x is None else json.dumps(x)

    try:
        root = json.loads(body, parse_float=str, parse_int=str) if body else None
    except (ValueError, RecursionError) as e:
        return [{"path": [], "value": None, "tags": {}, "error": f"not JSON: {e}"}]
    if not isinstance(root, dict):
        return [{"path": [], "value": None, "tags": {}, "error": "not a JSON object"}]
    out, waiting = [], [([], root)]
    while waiting:
        path, node = waiting.pop()
        if node.get("value") is not None and not isinstance(node["value"], dict):
            tags = node.get("tags")
            own = {k: text(v) for k, v in tags.items() if v is not None} if isinstance(tags, dict) else {}
            out.append({"path": path, "value": text(node["value"]), "tags": own, "error": None})
            continue
        for key, x in node.items():
            if isinstance(x, dict):
                waiting.append(([*path, key], x))
            elif isinstance(x, str):
                out.append({"path": [*path, key], "value": x, "tags": {}, "error": None})
    return out


def decode_nested_json(bodies: DataFrame, body: str = "body", prefix: str = "", query: str | None = None) -> DataFrame:
    """One point for each number in nested JSON, named by its dotted path; an object with `value` is one point.

    query: a column with the request's parameters as a map; h, p, d and t are reserved (host, prefix, time, unused),
    others are tags under those of the body. A body is read once, however deep it nests; one that is no JSON object
    is reported as an error.
    """

    @F.pandas_udf("array<struct<path:array<string>,value:string,tags:map<string,string>,error:string>>")
    def flattened(bodies: pd.Series) -> pd.Series:
        return pd.Series([_flat(x) for x in bodies], dtype=object)

    params = F.col(query) if query else T.empty_tags()
    rows = bodies.withColumn("_q", F.coalesce(params, T.empty_tags())).withColumn("_f", F.explode(flattened(F.col(body).cast("string"))))
    rows = rows.filter(F.col("_f.error").isNotNull() | F.col("_f.value").try_cast("double").isNotNull() | (F.size("_f.tags") > 0))
    names = F.concat(F.filter(F.array(F.lit(prefix), F.coalesce(F.col("_q")["p"], F.lit(""))), lambda x: x != ""), F.col("_f.path"))
    value = F.col("_f.value").try_cast("double")
    return rows.select(
        *bodies.columns, F.array_join(names, ".").alias("metric"), F.col("_q")["h"].alias("source"),
        F.coalesce(F.col("_q")["d"].try_cast("long"), F.unix_millis(F.current_timestamp())).alias("ts_ms"), value.alias("value"),
        T.merge(T.drop(F.col("_q"), ["h", "p", "d", "t"]), F.col("_f.tags")).alias("tags"), F.col("_f.error").alias("error"),
    )


def decode_collectd(bodies: DataFrame, body: str = "body", default_host: str = "unknown") -> DataFrame:
    """Points of a collectd write_http array. A record without values is rejected by itself; one without plugin,
    type or dsnames has an error for its whole request."""
    schema = "array<struct<values:array<double>,dsnames:array<string>,time:double,host:string,plugin:string,plugin_instance:string,type:string,type_instance:string>>"
    records = bodies.withColumn("_all", F.from_json(body, schema))
    broken = F.exists("_all", lambda r: r["plugin"].isNull() | r["type"].isNull() | r["dsnames"].isNull())
    records = records.withColumn("_bad", F.coalesce(broken, F.lit(True))).withColumn("_r", F.explode_outer("_all"))
    out = records.select(*bodies.columns, "_bad", "_r", F.posexplode_outer("_r.values").alias("_i", "value"))
    filled = lambda c: F.when(F.length(c) > 0, c)
    name = F.concat_ws(".", F.col("_r.plugin"), filled(F.col("_r.plugin_instance")), F.col("_r.type"), filled(F.col("_r.type_instance")), F.get("_r.dsnames", F.col("_i")))
    return out.select(
        *bodies.columns, name.alias("metric"), F.coalesce(filled(F.col("_r.host")), F.lit(default_host)).alias("source"),
        F.coalesce((F.col("_r.time") * 1000).cast("long"), F.lit(0).cast("long")).alias("ts_ms"), "value", T.empty_tags().alias("tags"),
        F.when(F.col("_bad"), F.lit("malformed request")).when(F.col("value").isNull(), F.lit("no values")).alias("error"),
    )


def graphite_to_point(name: Column, fields: list[int], delimiter: str, remove: list[int] | None = None) -> tuple[Column, Column, Column, Column]:
    """(metric, source, tags, error) of a dotted Graphite name.

    fields: 1-based segments that make up the source, in that order; the delimiter's characters become dots in the
    source. remove: segments that go from the metric too. `;k=v` after the name are tags.
    """
    if any(f < 1 for f in [*fields, *(remove or [])]):
        raise ValueError("segments count from 1")
    parts = F.split(name, ";")
    segments = F.split(parts[0], r"\.")
    gone = sorted({*fields, *(remove or [])})
    metric = F.array_join(F.filter(segments, lambda _, i: ~(i + 1).isin(*gone)), ".")
    source = F.concat_ws(".", *[F.try_element_at(segments, F.lit(f)) for f in fields])
    for c in delimiter:
        source = F.replace(source, F.lit(c), F.lit("."))
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring_index(p, "=", -1).alias("value")))
    error = F.when(F.size(segments) < max(gone), F.lit("too few segments"))
    return metric, source, T.from_pairs(pairs), error


# --- DataDog -----------------------------------------------------------------------------------------------------

#: The system metrics of an intake payload by the names they are sent under.
SYSTEM_METRICS = {
    "system.cpu.guest": "cpuGuest", "system.cpu.idle": "cpuIdle", "system.cpu.stolen": "cpuStolen", "system.cpu.system": "cpuSystem",
    "system.cpu.user": "cpuUser", "system.cpu.wait": "cpuWait",
    "system.mem.buffers": "memBuffers", "system.mem.cached": "memCached", "system.mem.page_tables": "memPageTables",
    "system.mem.shared": "memShared", "system.mem.slab": "memSlab", "system.mem.free": "memPhysFree",
    "system.mem.pct_usable": "memPhysPctUsable", "system.mem.total": "memPhysTotal", "system.mem.usable": "memPhysUsable", "system.mem.used": "memPhysUsed",
    "system.swap.cached": "memSwapCached", "system.swap.free": "memSwapFree", "system.swap.pct_free": "memSwapPctFree",
    "system.swap.total": "memSwapTotal", "system.swap.used": "memSwapUsed",
}


def clean_metric(name: Column) -> Column:
    return F.regexp_replace(name, r"[^-_.\dA-Za-z]", "_")


def coerce_value(json_text: Column) -> Column:
    """A JSON value as double: numbers, numeric text, booleans as 1 and 0; anything else is null."""
    plain = F.regexp_replace(F.trim(json_text), '^"(.*)"$', "$1")
    return F.when(plain == "true", F.lit(1.0)).when(plain == "false", F.lit(0.0)).otherwise(plain.try_cast("double"))


def tags_of_list(tag_list: Column) -> Column:
    """A tag map of `k:v` texts, each maybe a comma list; `source` becomes `_source`; texts without a key are dropped."""
    items = F.flatten(F.transform(tag_list, lambda t: F.split(t, ",")))
    good = F.filter(items, lambda t: F.instr(t, ":") > 1)
    key = lambda t: F.regexp_replace(F.substring_index(t, ":", 1), r"[^-_:./\\\dA-Za-z]", "_")
    value = lambda t: F.regexp_replace(t, r"^[^:]*:", "")
    return T.from_pairs(F.transform(good, lambda t: F.struct(F.when(key(t) == "source", F.lit("_source")).otherwise(key(t)).alias("key"), value(t).alias("value"))))


SERIES_V2 = "series:array<struct<metric:string,type:string,device:string,interval:double,tags:array<string>,resources:array<struct<type:string,name:string>>,points:array<struct<timestamp:double,value:double>>>>"


def decode_datadog_series(bodies: DataFrame, body: str = "body", version: int = 1) -> DataFrame:
    """Points of /api/v1/series or /api/v2/series, whose body may be what sources.protobuf read. A rate becomes a count by its interval."""
    if version == 1:
        schema = "series array<struct<metric:string,type:string,host:string,device:string,interval:double,tags:array<string>,points:array<array<double>>>>"
        stamp, value, host = "_pt[0]", "_pt[1]", F.lower("_s.host")
    else:
        schema = f"struct<{SERIES_V2}>"
        stamp, value = "_pt.timestamp", "_pt.value"
        host = F.get(F.transform(F.filter("_s.resources", lambda r: r["type"] == "host"), lambda r: r["name"]), F.lit(0))
    binary = dict(bodies.dtypes)[body] != "string"
    series, unread = (F.col(body)["message"]["series"], F.col(body)["error"]) if binary else (F.from_json(body, schema)["series"], F.lit(None).cast("string"))
    out = bodies.withColumn("_unread", unread).withColumn("_s", F.explode_outer(series)).withColumn("_pt", F.explode_outer("_s.points"))
    tags = T.put(tags_of_list(F.coalesce(F.col("_s.tags"), F.array().cast("array<string>"))), "device", F.col("_s.device"))
    rate = F.when(F.lower("_s.type").isin("rate", "2") & F.col("_s.interval").isNotNull(), F.col("_s.interval")).otherwise(1.0)
    return out.select(
        *bodies.columns, clean_metric(F.col("_s.metric")).alias("metric"), F.coalesce(host, F.lit("unknown")).alias("source"),
        (F.expr(stamp) * 1000).cast("long").alias("ts_ms"), (F.expr(value) * rate).alias("value"), tags.alias("tags"),
        F.when(F.col("_unread").isNotNull(), F.col("_unread")).when(F.col("_s.metric").isNull(), F.lit("no metric")).when(F.expr(value).isNull() | F.expr(stamp).isNull(), F.lit("bad point")).alias("error"),
    )


def decode_datadog_checks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Status points of service checks (an object or an array), and an error for a body that is neither; checks without a status are ignored."""
    schema = "array<struct<check:string,host_name:string,timestamp:double,status:double,tags:array<string>>>"
    as_array = F.when(F.ltrim(body).startswith("{"), F.concat(F.lit("["), F.col(body), F.lit("]"))).otherwise(F.col(body))
    parsed = bodies.withColumn("_l", F.when(F.ltrim(as_array).startswith("["), F.from_json(as_array, schema))).withColumn("_bad", F.col("_l").isNull())
    out = parsed.withColumn("_c", F.explode_outer("_l")).filter("_c.status IS NOT NULL OR _bad")
    return out.select(
        *bodies.columns, clean_metric(F.col("_c.check")).alias("metric"), F.coalesce(F.lower("_c.host_name"), F.lit("unknown")).alias("source"),
        (F.col("_c.timestamp") * 1000).cast("long").alias("ts_ms"), F.col("_c.status").alias("value"),
        tags_of_list(F.coalesce(F.col("_c.tags"), F.array().cast("array<string>"))).alias("tags"), F.when(F.col("_bad"), F.lit("malformed request")).when(F.col("_c.check").isNull(), F.lit("no check")).alias("error"),
    )


def datadog_host_tags(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(source, system_tags) of intake payloads with host tags, other columns kept."""
    out = bodies.withColumn("_m", F.from_json(body, TEXT_MAP)).filter("_m['internalHostname'] IS NOT NULL")
    system = F.from_json(F.get_json_object(F.col(body), "$['host-tags'].system"), "array<string>")
    return out.withColumn("system_tags", tags_of_list(system)).filter(F.col("system_tags").isNotNull()).select(*bodies.columns, F.lower(F.col("_m")["internalHostname"]).alias("source"), "system_tags")


def decode_datadog_intake(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Points of intake payloads: ioStats by device, every `system.*` member, and the renamed system metrics; an error
    for a body that is no object. Payloads without a host name or a time are ignored."""
    parsed = T.settled(bodies, {"_m": F.when(F.ltrim(body).startswith("{"), F.from_json(body, TEXT_MAP))}).withColumn("_bad", F.col("_m").isNull())
    out = parsed.filter("_bad OR _m['internalHostname'] IS NOT NULL AND _m['collection_timestamp'] IS NOT NULL")
    entry = "array<struct<metric:string,device:string,v:string>>"
    row = lambda name, device, value: F.struct(name.alias("metric"), device.cast("string").alias("device"), value.alias("v"))
    io = F.coalesce(F.from_json(F.col("_m")["ioStats"], "map<string,map<string,string>>"), F.from_json(F.lit("{}"), "map<string,map<string,string>>"))
    io_name = lambda k: F.concat(F.lit("system.io."), F.trim(F.replace(F.replace(k, F.lit("%"), F.lit(" ")), F.lit("/"), F.lit("_"))))
    by_device = F.flatten(F.transform(F.map_entries(io), lambda d: F.transform(F.map_entries(d["value"]), lambda e: row(io_name(e["key"]), d["key"], e["value"]))))
    own = F.transform(F.map_entries(F.map_filter("_m", lambda k, _: k.startswith("system."))), lambda e: row(e["key"], F.lit(None), e["value"]))
    renamed = F.array(*[row(F.lit(k), F.lit(None), F.col("_m")[v]) for k, v in SYSTEM_METRICS.items()])
    found = F.filter(F.concat(by_device.cast(entry), own.cast(entry), renamed.cast(entry)), lambda p: p["v"].isNotNull())
    system = F.coalesce(tags_of_list(F.from_json(F.get_json_object(F.col(body), "$['host-tags'].system"), "array<string>")), T.empty_tags())
    out = T.settled(out, {"_system": system}).withColumn("_p", F.explode_outer(F.when(~F.col("_bad"), found)))
    out = T.settled(out, {"value": coerce_value(F.col("_p.v"))}).filter("value IS NOT NULL OR _bad")
    return out.select(
        *bodies.columns, F.col("_p.metric").alias("metric"), F.lower(F.col("_m")["internalHostname"]).alias("source"), (F.col("_m")["collection_timestamp"].try_cast("long") * 1000).alias("ts_ms"),
        "value", T.put(F.col("_system"), "device", F.col("_p.device")).alias("tags"), F.when(F.col("_bad"), F.lit("malformed request")).alias("error"),
    )
