"""Jaeger and Zipkin spans from their JSON forms (D27, D28), identifiers by D29 (functions.tags.uuid_of_hex)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T

TAG = "struct<key:string,vType:string,vStr:string,vDouble:double,vBool:boolean,vLong:bigint>"
JAEGER = (
    f"struct<process:struct<serviceName:string,tags:array<{TAG}>>,spans:array<struct<traceIdHigh:string,traceIdLow:string,spanId:string,parentSpanId:string,operationName:string,"
    f"startTime:bigint,duration:bigint,tags:array<{TAG}>,references:array<struct<refType:string,traceIdHigh:string,traceIdLow:string,spanId:string>>,logs:array<struct<timestamp:bigint,fields:array<{TAG}>>>>>>"
)
ZIPKIN = (
    "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,duration:bigint,debug:boolean,shared:boolean,"
    "localEndpoint:struct<serviceName:string,ipv4:string>,tags:map<string,string>,annotations:array<struct<timestamp:bigint,value:string>>>>"
)
ZIPKIN_V1 = (
    "array<struct<traceId:string,id:string,parentId:string,name:string,timestamp:bigint,duration:bigint,debug:boolean,annotations:array<struct<timestamp:bigint,value:string,endpoint:struct<serviceName:string,ipv4:string>>>,"
    "binaryAnnotations:array<struct<key:string,value:string,endpoint:struct<serviceName:string,ipv4:string>>>>>"
)
#: Span kinds by the first version's core annotations that start and end them.
V1_KINDS = {"CLIENT": ("cs", "cr"), "SERVER": ("sr", "ss"), "PRODUCER": ("ms", "ws"), "CONSUMER": ("wr", "mr")}
V1_CORE = [x for pair in V1_KINDS.values() for x in pair]
V1_ADDRESSES = ("ca", "sa", "ma")
#: Span kinds of the binary form, from number 1 on.
ZIPKIN_KINDS = ("CLIENT", "SERVER", "PRODUCER", "CONSUMER")
PLACES = ("application", "cluster", "shard")


def _tag_pairs(tags: Column) -> Column:
    """Jaeger tags as (key, value) texts without samplers', blank and binary ones."""
    text = lambda t: F.coalesce(t["vStr"], t["vBool"].cast("string"), t["vLong"].cast("string"), t["vDouble"].cast("string"))
    good = F.filter(F.coalesce(tags, F.array().cast(f"array<{TAG}>")), lambda t: ~t["key"].isin("sampler.type", "sampler.param") & (F.trim(text(t)) != "") & ~F.coalesce(t["vType"] == "BINARY", F.lit(False)))
    return F.transform(good, lambda t: F.struct(t["key"].alias("key"), text(t).alias("value")))


def _default_tags(pairs: Column, process: Column, defaults: dict[str, str]) -> list[tuple[str, Column]]:
    """application, cluster, shard: of the span, else of the process, else the given default, else `none`."""
    fallback = {"application": "Jaeger", "cluster": "none", "shard": "none"} | defaults
    return [(k, F.coalesce(T.first_value(pairs, k), T.first_value(process, k), F.lit(fallback[k]))) for k in PLACES]


def decode_jaeger(batches: DataFrame, body: str = "body", defaults: dict[str, str] | None = None, default_source: str = "jaeger") -> DataFrame:
    """Spans of Jaeger batches, and a row with the error for what is none. CHILD_OF references to another span than the parent
    give one more parent, and all give a follows-from tag, as the wire port does; service tags give way to the process's service.

    The body is JSON, or what sources.thrift read.
    """
    if dict(batches.dtypes)[body] == "string":
        parsed = batches.withColumn("_b", F.from_json(body, JAEGER))
        parsed = parsed.withColumn("_bad", F.when(F.col("_b.spans").isNull() & F.col("_b.process").isNull() | F.col("_b").isNull(), F.lit("not a Jaeger batch")))
    else:
        parsed = batches.withColumn("_b", F.col(body)["message"]).withColumn("_bad", F.col(body)["error"])
    out = parsed.withColumn("_s", F.explode_outer("_b.spans")).filter("_s IS NOT NULL OR _bad IS NOT NULL")
    out = out.withColumn("_tags", _tag_pairs(F.col("_s.tags"))).withColumn("_process", _tag_pairs(F.col("_b.process.tags")))
    own, process = F.col("_tags"), F.col("_process")
    source = F.coalesce(T.first_value(own, "source"), T.first_value(process, "source"), T.first_value(process, "hostname"), F.lit(default_source))
    trace = T.uuid_of_hex(F.concat(F.lpad(F.coalesce("_s.traceIdHigh", F.lit("")), 16, "0"), F.lpad("_s.traceIdLow", 16, "0")))
    parent = F.when(F.coalesce("_s.parentSpanId", F.lit("0")).rlike("[^0]"), T.uuid_of_hex(F.col("_s.parentSpanId")))
    named = F.filter(F.coalesce("_s.references", F.array()), lambda r: r["refType"].isin("CHILD_OF", "FOLLOWS_FROM") & r["spanId"].rlike("[^0]"))
    ref = F.transform(named, lambda r: T.annotation("followsFrom", T.uuid_of_hex(r["spanId"])))
    others = F.transform(F.filter(named, lambda r: (r["refType"] == "CHILD_OF") & ~F.coalesce(T.uuid_of_hex(r["spanId"]) == parent, F.lit(False))), lambda r: T.annotation("parent", T.uuid_of_hex(r["spanId"])))
    kept = F.filter(own, lambda p: ~p["key"].isin("source", "service", *PLACES))
    bare_trace = F.regexp_replace(F.regexp_replace(trace, "-", ""), "^0{1,31}", "")
    inherited = F.filter(process, lambda p: ~p["key"].isin("source", "hostname", "service", *PLACES) & ~F.exists(own, lambda q: q["key"] == p["key"]))
    set_tags = [("service", F.col("_b.process.serviceName")), *_default_tags(own, process, defaults or {}), ("jaegerSpanId", F.regexp_replace("_s.spanId", "^0+(?=.)", "")), ("jaegerTraceId", bare_trace), ("parent", parent), ("_spanLogs", F.when(F.size("_s.logs") > 0, F.lit("true")))]
    annotations = F.concat(F.filter(F.array(*[T.annotation(k, v) for k, v in set_tags]), lambda a: a["value"].isNotNull()), kept.cast(T.ANNOTATIONS), inherited.cast(T.ANNOTATIONS), others.cast(T.ANNOTATIONS), ref.cast(T.ANNOTATIONS))
    logs = F.transform("_s.logs", lambda x: F.struct(x["timestamp"].alias("ts_us"), T.from_pairs(_tag_pairs(x["fields"])).alias("fields")))
    return out.select(
        *batches.columns, F.col("_s.operationName").alias("name"), source.alias("source"), T.uuid_of_hex(F.col("_s.spanId")).alias("span_id"), trace.alias("trace_id"),
        T.whole(F.col("_s.startTime"), 1000).alias("start_ms"), T.whole(F.col("_s.duration"), 1000).alias("duration_ms"), annotations.alias("annotations"), logs.alias("logs"),
        F.col("_bad").alias("error"),
    )


def _of_v1(span: Column) -> Column:
    """The spans of the second version that a span of the first stands for: one for each kind its core annotations name (a
    client and a server that share it are two), or one without a kind. What has a service goes to the span of that service."""
    notes, pairs = F.coalesce(span["annotations"], F.array()), F.coalesce(span["binaryAnnotations"], F.array())
    first = lambda values: F.get(F.filter(notes, lambda a: a["value"].isin(*values)), F.lit(0))
    kinds = F.filter(F.array(*[F.when(F.exists(notes, lambda a: a["value"].isin(*v)), F.lit(k)) for k, v in V1_KINDS.items()]), lambda k: k.isNotNull())
    start_of = first(["cs", "sr", "ms", "wr"])["timestamp"]

    def one(kind: Column, n: Column) -> Column:
        pick = lambda i: F.coalesce(*[F.when(kind == k, first([v[i]])["timestamp"]) for k, v in V1_KINDS.items()])
        core = F.get(F.filter(notes, lambda a: F.coalesce(*[F.when(kind == k, a["value"].isin(*v)) for k, v in V1_KINDS.items()], F.lit(False))), F.lit(0))["endpoint"]
        any_of = F.coalesce(F.get(F.filter(F.transform(pairs, lambda b: F.when(b["key"] == "lc", b["endpoint"])), lambda e: e.isNotNull()), F.lit(0)), F.get(F.filter(F.concat(F.transform(notes, lambda a: a["endpoint"]), F.transform(F.filter(pairs, lambda b: ~b["key"].isin(*V1_ADDRESSES)), lambda b: b["endpoint"])), lambda e: e.isNotNull()), F.lit(0)))
        local, shared = F.coalesce(core, any_of), F.size(kinds) > 1
        mine = lambda x: ~shared | (x["endpoint"]["serviceName"] == local["serviceName"]) | (x["endpoint"].isNull() & (n == 0))
        tags = F.transform(F.filter(pairs, lambda b: ~b["key"].isin("lc", *V1_ADDRESSES) & F.coalesce(mine(b), F.lit(False))), lambda b: F.struct(b["key"].alias("key"), b["value"].alias("value")))
        own = F.transform(F.filter(notes, lambda a: ~a["value"].isin(*V1_CORE) & F.coalesce(mine(a), F.lit(False))), lambda a: F.struct(a["timestamp"].alias("timestamp"), a["value"].alias("value")))
        began, ended = pick(0), pick(1)
        timestamp = F.when(shared & (n > 0), began).otherwise(F.coalesce(span["timestamp"], began, start_of))
        duration = F.when(shared & (n > 0), ended - began).otherwise(F.coalesce(span["duration"], ended - began))
        return F.struct(
            span["traceId"].alias("traceId"), span["id"].alias("id"), span["parentId"].alias("parentId"), span["name"].alias("name"), kind.alias("kind"), timestamp.alias("timestamp"), duration.alias("duration"), span["debug"].alias("debug"),
            (shared & (n > 0)).alias("shared"), F.struct(local["serviceName"].alias("serviceName"), local["ipv4"].alias("ipv4")).alias("localEndpoint"), T.from_pairs(tags).alias("tags"), own.alias("annotations"),
        )

    return F.transform(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit(None).cast("string"))), one)


def decode_zipkin(requests: DataFrame, body: str = "body", defaults: dict[str, str] | None = None, default_source: str = "zipkin") -> DataFrame:
    """Spans of Zipkin span lists, and a row with the error for what is none. Any value of an error tag marks an error.

    A list with tags or a local or remote endpoint is of the second version, any other of the first. The body is JSON, or what
    sources.protobuf read.
    """
    fallback = {"application": "Zipkin", "cluster": "none", "shard": "none"} | (defaults or {})
    if dict(requests.dtypes)[body] == "string":
        second = F.col(body).rlike('Endpoint"|"tags"')
        spans = F.when(second, F.from_json(body, ZIPKIN)).otherwise(F.flatten(F.transform(F.from_json(body, ZIPKIN_V1), _of_v1)).cast(ZIPKIN))
        listed = requests.withColumn("_l", F.when(F.ltrim(body).startswith("["), spans)).withColumn("_bad", F.when(F.col("_l").isNull(), F.lit("not a span list")))
    else:  # what sources.protobuf read: kinds are numbers
        kinds = F.array(*[F.lit(k) for k in (None, *ZIPKIN_KINDS)])
        listed = requests.withColumn("_l", F.transform(F.col(body)["message"]["spans"], lambda s: s.withField("kind", F.get(kinds, F.coalesce(s["kind"], F.lit(0)))))).withColumn("_bad", F.col(body)["error"])
    out = listed.withColumn("_s", F.explode_outer("_l")).filter("_s IS NOT NULL OR _bad IS NOT NULL").withColumn("_tags", F.coalesce("_s.tags", T.empty_tags()))
    tags = F.col("_tags")
    set_tags = [
        ("zipkinSpanId", F.col("_s.id")), ("zipkinTraceId", F.col("_s.traceId")), ("parent", F.when(F.col("_s.parentId").isNotNull() & (F.col("_s.parentId") != F.col("_s.id")), T.uuid_of_hex(F.col("_s.parentId")))),
        ("span.kind", F.lower("_s.kind")), ("_spanSecondaryId", F.when(F.size("_s.annotations") > 0, F.lower("_s.kind"))), ("service", F.coalesce("_s.localEndpoint.serviceName", F.lit("defaultService"))),
        *[(k, F.coalesce(tags[k], F.lit(v))) for k, v in fallback.items()], ("ipv4", F.col("_s.localEndpoint.ipv4")), ("debug", F.when(F.col("_s.debug"), F.lit("true"))),
        ("error", F.when(F.array_contains(F.map_keys(tags), "error"), F.lit("true"))), ("_spanLogs", F.when(F.size("_s.annotations") > 0, F.lit("true"))),
    ]
    rest = T.canonical(T.drop(tags, ["source", "error", *PLACES]))
    annotations = F.concat(F.filter(F.array(*[T.annotation(k, v) for k, v in set_tags]), lambda a: a["value"].isNotNull()), rest.cast(T.ANNOTATIONS))
    logs = F.transform("_s.annotations", lambda x: F.struct(x["timestamp"].alias("ts_us"), F.create_map(F.lit("annotation"), x["value"]).alias("fields")))
    return out.select(
        *requests.columns, F.coalesce("_s.name", F.lit("defaultOperation")).alias("name"), F.coalesce(tags["source"], F.lit(default_source)).alias("source"), T.uuid_of_hex(F.col("_s.id")).alias("span_id"), T.uuid_of_hex(F.col("_s.traceId")).alias("trace_id"),
        T.whole(F.col("_s.timestamp"), 1000).alias("start_ms"), T.whole(F.coalesce("_s.duration", F.lit(0).cast("bigint")), 1000).alias("duration_ms"), annotations.alias("annotations"), F.when(F.size("_s.annotations") > 0, logs).alias("logs"),
        F.col("_bad").alias("error"),
    )
