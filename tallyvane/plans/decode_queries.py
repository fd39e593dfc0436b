"""Queries of sources and decoders: the tables are rendered to a wire format and decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import json_metrics as J
from ..operators import lines as L
from ..operators import otlp as O
from ..operators import traces as X
from ..operators.logs import filebeat_lines
from ..sources import frames
from ..sources import protobuf as P
from ..sources import thrift
from ..sources import wire as S
from ..streaming import ingest
from .registry import query
from .views import POINTS, points, table

def _tags() -> Column:
    return T.tag_text(F.col("tags")).alias("tags")


def _second() -> Column:
    return F.floor(F.col("ts_ms") / 1000)


def _metric_body(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return points(spark, sf_dir).select("seq", *columns)


LINES = """CASE seq % 7 WHEN 0 THEN '@SourceTag action=add source=s t' WHEN 1 THEN '@Event 1 e host=h' WHEN 2 THEN '{"a":1}'
 WHEN 3 THEN '!M 1 #1 2 m source=s' WHEN 4 THEN '[1]' WHEN 5 THEN 'm' ELSE metric || ' 1 source=s' END"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = ["@SourceTag action=add source=s t", "@Event 1 e host=h", '{"a":1}', "!M 1 #1 2 m source=s", "[1]", "m"]
    line = F.coalesce(F.get(F.array(*[F.lit(c) for c in choices]), (F.col("seq") % 7).cast("int")), F.concat("metric", F.lit(" 1 source=s")))
    return points(spark, sf_dir).select("seq", "metric", line.alias("line"))


FORMAT_SQL = """CASE seq % 7 WHEN 0 THEN 'SOURCE_TAG' WHEN 1 THEN 'EVENT' WHEN 2 THEN 'SPAN_LOG' WHEN 3 THEN 'HISTOGRAM'
 WHEN 4 THEN 'LOGS_JSON_ARR' ELSE 'DEFAULT' END"""


@query(f"WITH {POINTS} SELECT {FORMAT_SQL} AS format, metric, count(*) AS n FROM points GROUP BY 1, 2")
def d1_detect_format(spark, sf_dir):
    return L.dispatch(_mixed(spark, sf_dir)).groupBy("format", "metric").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS} SELECT {FORMAT_SQL} AS format,
  CASE WHEN seq % 7 IN (1, 4) THEN 'no decoder for ' || {FORMAT_SQL} END AS error, count(*) AS n FROM points GROUP BY 1, 2""")
def d2_dispatch(spark, sf_dir):
    return L.dispatch(_mixed(spark, sf_dir), enabled={"DEFAULT", "SOURCE_TAG", "SPAN_LOG", "HISTOGRAM"}).groupBy("format", "error").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT seq, metric, source, ts_ms // 1000 * 1000 AS ts_ms, value, 'k=' || k AS tags FROM points")
def d3_point_lines(spark, sf_dir):
    line = L.encode_points(F.col("metric"), F.col("value"), F.col("ts_ms"), F.col("source"), F.col("tags"))
    return L.decode_points(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, 'm "' || metric AS metric, source, ts_ms // 3600000 * 3600000 AS bin_start_ms, c.mean AS mean, c.count AS count
  FROM (SELECT *, unnest([{{'mean': CAST(seq AS DOUBLE) / 4, 'count': CAST(seq % 5 + 1 AS INTEGER)}}, {{'mean': 2.5, 'count': 3}}]) AS c FROM points)""")
def d4_histogram_lines(spark, sf_dir):
    line = F.concat(F.lit("!H "), _second().cast("string"), F.lit(" #"), (F.col("seq") % 5 + 1).cast("string"), F.lit(" "), (F.col("seq").cast("double") / 4).cast("string"), F.lit(' #3 2.5 "m \\"'), "metric", F.lit('" source='), "source")
    out = L.decode_histograms(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL").withColumn("c", F.explode("centroids"))
    return out.select("seq", "metric", "source", "bin_start_ms", F.col("c.mean").alias("mean"), F.col("c.count").alias("count"))


@query(f"""WITH {POINTS} SELECT seq, metric AS name, source, 's-' || seq AS span_id, 't-' || k AS trace_id, ts_ms // 1000 * 1000 AS start_ms,
  (seq % 9) * 1000 AS duration_ms, 'parent=p1,parent=p2,x=a b' AS annotations FROM points""")
def d5_span_lines(spark, sf_dir):
    line = F.concat("metric", F.lit(" source="), "source", F.lit(" parent=p1 spanId=s-"), F.col("seq").cast("string"), F.lit(" traceId=t-"), F.col("tags")["k"], F.lit(' "parent"=p2 x="a b" '), _second().cast("string"), F.lit(" "), (_second() + F.col("seq") % 9).cast("string"))
    out = L.decode_spans(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL")
    return out.select("seq", "name", "source", "span_id", "trace_id", "start_ms", "duration_ms", F.array_join(F.transform("annotations", lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",").alias("annotations"))


@query(f"""WITH {POINTS} SELECT seq, 's-' || seq AS span_id, 't-' || k AS trace_id, ts_ms * 1000 AS ts_us, metric AS event, 'line' AS span FROM points""")
def d6_span_logs(spark, sf_dir):
    body = F.to_json(F.struct(
        F.concat(F.lit("s-"), F.col("seq").cast("string")).alias("spanId"), F.concat(F.lit("t-"), F.col("tags")["k"]).alias("traceId"),
        F.array(F.struct((F.col("ts_ms") * 1000).alias("timestamp"), F.create_map(F.lit("event"), F.col("metric")).alias("fields"))).alias("logs"), F.lit("line").alias("span"),
    ))
    out = L.decode_span_logs(_metric_body(spark, sf_dir, body.alias("line"))).filter("error IS NULL").withColumn("l", F.explode("logs"))
    return out.select("seq", "span_id", "trace_id", "l.ts_us", F.col("l.fields")["event"].alias("event"), "span")


@query(f"""WITH {POINTS} SELECT seq, 'Event ' || metric AS name, ts_ms // 1000 * 1000 AS start_ms, ts_ms // 1000 * 1000 + 1 AS end_ms, source || ',h2' AS hosts,
  't1' AS event_tags, 'severity=INFO' AS annotations, 'bar,baz' AS multi FROM points""")
def d7_event_lines(spark, sf_dir):
    line = F.concat(F.lit("@Event "), _second().cast("string"), F.lit(' "Event '), "metric", F.lit('" host='), "source", F.lit(" host=h2 tag=t1 severity=INFO multi=bar multi=baz"))
    out = L.decode_events(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL")
    return out.select("seq", "name", "start_ms", "end_ms", F.array_join("hosts", ",").alias("hosts"), F.array_join("event_tags", ",").alias("event_tags"), T.tag_text(F.col("annotations")).alias("annotations"), F.array_join(F.col("dimensions")["multi"], ",").alias("multi"))


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'SOURCE_TAG' ELSE 'SOURCE_DESCRIPTION' END AS operation,
  CASE WHEN seq % 2 = 0 THEN 'ADD' ELSE 'SAVE' END AS action, source, CASE WHEN seq % 2 = 0 THEN metric || ',b c' ELSE 'of ' || k END AS vals FROM points""")
def d7_source_tag_lines(spark, sf_dir):
    line = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("@SourceTag action=add source="), "source", F.lit(" "), "metric", F.lit(' "b c"'))).otherwise(F.concat(F.lit("@SourceDescription action=save source="), "source", F.lit(' description="of '), F.col("tags")["k"], F.lit('"')))
    out = L.decode_source_tags(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL")
    return out.select("seq", "operation", "action", "source", F.array_join("values", ",").alias("vals"))


@query(f"""WITH {POINTS} SELECT seq, metric, CASE WHEN seq % 2 = 0 THEN source ELSE 'unknown' END AS source,
  CASE seq % 4 WHEN 0 THEN ts_ms // 1000 * 1000 ELSE ts_ms END AS ts_ms, value, 'k=' || k AS tags FROM points WHERE seq % 5 <> 0""")
def d8_opentsdb_json(spark, sf_dir):
    stamp = F.when(F.col("seq") % 4 == 0, _second()).when(F.col("seq") % 4 == 1, F.col("ts_ms")).when(F.col("seq") % 4 == 2, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms") * 1_000_000)
    tags = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("Host"), F.col("source"), F.lit("k"), F.col("tags")["k"])).otherwise(F.col("tags"))
    body = F.to_json(F.struct("metric", stamp.alias("timestamp"), F.when(F.col("seq") % 5 != 0, F.col("value")).alias("value"), tags.alias("tags")))
    return J.decode_opentsdb(_metric_body(spark, sf_dir, body.alias("body"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"WITH {POINTS} SELECT seq, metric, source, ts_ms // 1000 * 1000 AS ts_ms, value, 'k=' || k AS tags FROM points")
def d8_opentsdb_telnet(spark, sf_dir):
    line = F.concat(F.lit("put "), "metric", F.lit(" "), _second().cast("string"), F.lit(" "), F.col("value").cast("string"), F.lit(" host="), "source", F.lit(" k="), F.col("tags")["k"])
    return J.decode_opentsdb_lines(_metric_body(spark, sf_dir, line.alias("line"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, 'base.x.' || m.metric AS metric, source, ts_ms, m.value AS value, m.tags AS tags FROM (
  SELECT *, unnest([{{'metric': 'cpu.idle', 'value': value, 'tags': 'env=q'}}, {{'metric': 'cpu.deep.n', 'value': CAST(seq AS DOUBLE), 'tags': 'env=q'}},
    {{'metric': 'mem', 'value': CAST(seq % 3 AS DOUBLE), 'tags': 'env=own,k=' || k}}]) AS m FROM points)""")
def d9_nested_json(spark, sf_dir):
    body = F.to_json(F.struct(
        F.struct(F.col("value").alias("idle"), F.struct(F.col("seq").alias("n")).alias("deep"), F.lit("text").alias("note")).alias("cpu"),
        F.struct((F.col("seq") % 3).alias("value"), F.create_map(F.lit("k"), F.col("tags")["k"], F.lit("env"), F.lit("own")).alias("tags")).alias("mem"),
    ))
    query_map = F.create_map(F.lit("h"), F.col("source"), F.lit("p"), F.lit("x"), F.lit("d"), F.col("ts_ms").cast("string"), F.lit("env"), F.lit("q"))
    return J.decode_nested_json(_metric_body(spark, sf_dir, body.alias("body"), query_map.alias("q")), prefix="base", query="q").filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, 'disk.' || k || '.ops.' || d.ds AS metric, CASE WHEN seq % 2 = 0 THEN source ELSE 'unknown' END AS source,
  ts_ms // 1000 * 1000 AS ts_ms, d.v AS value FROM (SELECT *, unnest([{{'ds': 'read', 'v': value}}, {{'ds': 'write', 'v': CAST(seq AS DOUBLE)}}]) AS d FROM points)""")
def d10_collectd(spark, sf_dir):
    record = F.struct(
        F.array(F.col("value"), F.col("seq").cast("double")).alias("values"), F.array(F.lit("read"), F.lit("write")).alias("dsnames"), _second().alias("time"), F.when(F.col("seq") % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("host"),
        F.lit("disk").alias("plugin"), F.col("tags")["k"].alias("plugin_instance"), F.lit("ops").alias("type"), F.lit("").alias("type_instance"),
    )
    return J.decode_collectd(_metric_body(spark, sf_dir, F.to_json(F.array(record)).alias("body"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value")


@query(f"""WITH {POINTS} SELECT seq, 'collectd.' || metric AS metric, replace('www_' || k, '_', '.') || '.' || replace(source, '_', '.') || '.com' AS source, 'dc=' || k AS tags FROM points""")
def d11_graphite(spark, sf_dir):
    name = F.concat(F.lit("collectd.com."), "source", F.lit(".www_"), F.col("tags")["k"], F.lit("."), "metric", F.lit(";dc="), F.col("tags")["k"])
    metric, source, tags, error = J.graphite_to_point(F.col("name"), [4, 3, 2], "_")
    out = _metric_body(spark, sf_dir, name.alias("name"))
    return out.select("seq", metric.alias("metric"), source.alias("source"), T.tag_text(tags).alias("tags"), error.alias("error")).filter("error IS NULL").drop("error")


@query(f"""WITH {POINTS} SELECT seq, replace(metric, '.', '.') || '_x' AS metric, source, ts_ms // 1000 * 1000 AS ts_ms, value * CASE WHEN seq % 2 = 0 THEN 20 ELSE 1 END AS value,
  '_source=a,device=d' || k || ',env=prod' AS tags FROM points""")
def d12_datadog_series(spark, sf_dir):
    series = F.struct(
        F.concat("metric", F.lit("#x")).alias("metric"), F.when(F.col("seq") % 2 == 0, F.lit("rate")).otherwise(F.lit("gauge")).alias("type"), F.upper("source").alias("host"), F.concat(F.lit("d"), F.col("tags")["k"]).alias("device"), F.lit(20.0).alias("interval"),
        F.array(F.lit("env:prod,source:a"), F.lit("bad"), F.lit(":worse")).alias("tags"), F.array(F.array(_second().cast("double"), F.col("value"))).alias("points"),
    )
    body = F.to_json(F.struct(F.array(series).alias("series")))
    return J.decode_datadog_series(_metric_body(spark, sf_dir, body.alias("body"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"WITH {POINTS} SELECT seq, metric, upper(source) AS source, ts_ms // 1000 * 1000 AS ts_ms, value, 'env=prod' AS tags FROM points")
def d12_datadog_series_v2(spark, sf_dir):
    series = F.struct(
        "metric", F.lit("3").alias("type"), F.array(F.struct(F.lit("host").alias("type"), F.upper("source").alias("name"))).alias("resources"), F.array(F.lit("env:prod")).alias("tags"),
        F.array(F.struct(_second().alias("timestamp"), "value")).alias("points"),
    )
    body = F.to_json(F.struct(F.array(series).alias("series")))
    return J.decode_datadog_series(_metric_body(spark, sf_dir, body.alias("body")), version=2).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, CASE seq % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(seq AS DOUBLE) WHEN 3 THEN CAST(seq AS DOUBLE) + 0.5 END AS value FROM points""")
def d13_value_coercion(spark, sf_dir):
    n = F.col("seq").cast("string")
    text = F.when(F.col("seq") % 5 == 0, F.lit("true")).when(F.col("seq") % 5 == 1, F.lit('"false"')).when(F.col("seq") % 5 == 2, n).when(F.col("seq") % 5 == 3, F.concat(F.lit('"'), n, F.lit('.5"'))).otherwise(F.lit('"none"'))
    return _metric_body(spark, sf_dir, J.coerce_value(text).alias("value"))


@query(f"WITH {POINTS} SELECT seq, '_source=' || source || ',a=b:c,k_y=' || k AS tags FROM points")
def d14_datadog_tags(spark, sf_dir):
    listed = F.array(F.concat(F.lit("source:"), "source", F.lit(",k y:"), F.col("tags")["k"]), F.lit("a:b:c"), F.lit("none"), F.lit(":v"))
    return _metric_body(spark, sf_dir, J.tags_of_list(listed).alias("tags")).select("seq", _tags())


@query(f"WITH {POINTS} SELECT seq, metric || '.status' AS metric, source, ts_ms // 1000 * 1000 AS ts_ms, CAST(seq % 4 AS DOUBLE) AS value FROM points WHERE seq % 4 <> 3")
def d15_datadog_checks(spark, sf_dir):
    body = F.to_json(F.struct(F.concat("metric", F.lit(".status")).alias("check"), F.upper("source").alias("host_name"), _second().alias("timestamp"), F.when(F.col("seq") % 4 != 3, F.col("seq") % 4).alias("status")))
    return J.decode_datadog_checks(_metric_body(spark, sf_dir, body.alias("body"))).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value")


@query(f"""WITH {POINTS} SELECT seq, m.metric AS metric, source, ts_ms // 1000 * 1000 AS ts_ms, m.value AS value, m.tags AS tags FROM (SELECT *, unnest([
  {{'metric': 'system.io.r_s', 'value': value, 'tags': 'app:x'}}, {{'metric': 'system.load.1', 'value': CAST(seq AS DOUBLE), 'tags': ''}},
  {{'metric': 'system.cpu.idle', 'value': 7.5, 'tags': ''}}, {{'metric': 'system.mem.total', 'value': CAST(seq % 10 AS DOUBLE), 'tags': ''}}]) AS m0 FROM points) p,
  LATERAL (SELECT {{'metric': m0.metric, 'value': m0.value, 'tags': CASE WHEN m0.metric = 'system.io.r_s' THEN 'app=cs,device=sda' ELSE 'app=cs' END}} AS m) t""")
def d16_datadog_intake(spark, sf_dir):
    body = F.to_json(F.struct(
        F.upper("source").alias("internalHostname"), _second().alias("collection_timestamp"), F.struct(F.struct(F.col("value").alias("r/s")).alias("sda")).alias("ioStats"),
        F.col("seq").alias("system.load.1"), F.lit("7.5").alias("cpuIdle"), (F.col("seq") % 10).alias("memPhysTotal"), F.struct(F.array(F.lit("app:cs")).alias("system")).alias("host-tags"),
    ))
    return J.decode_datadog_intake(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "metric", "source", "ts_ms", "value", _tags())


# --- OTLP ----------------------------------------------------------------------------------------------------------


def _attribute(key: str, value: Column, kind: str = "stringValue") -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


def _otlp(spark: SparkSession, sf_dir: str, metric: Column) -> DataFrame:
    scope = F.struct(F.array(metric).alias("metrics"))
    resource = F.struct(F.array(_attribute("host.name", F.col("source")), _attribute("service.name", F.lit("svc"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeMetrics"))).alias("resourceMetrics")))
    return O.decode_metrics(_metric_body(spark, sf_dir, body.alias("body"))).drop("body")


def _nanos() -> Column:
    return (F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano")


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 3 = 1 THEN '∆' ELSE '' END || metric AS metric, source, ts_ms, CASE WHEN seq % 3 = 0 THEN value ELSE CAST(seq AS DOUBLE) END AS value,
  '_source=s,k=' || k || ',service=svc' AS tags FROM points""")
def d17_otlp_numbers(spark, sf_dir):
    attributes = F.array(_attribute("k", F.col("tags")["k"]), _attribute("_source", F.lit("s"))).alias("attributes")
    gauge = F.struct(F.array(F.struct(attributes, _nanos(), F.col("value").alias("asDouble"))).alias("dataPoints"))
    total = F.struct(F.when(F.col("seq") % 3 == 1, F.lit(1)).otherwise(F.lit(2)).alias("aggregationTemporality"), F.array(F.struct(attributes, _nanos(), F.col("seq").cast("string").alias("asInt"))).alias("dataPoints"))
    is_gauge = F.col("seq") % 3 == 0
    metric = F.struct(F.col("metric").alias("name"), F.when(is_gauge, gauge).alias("gauge"), F.when(~is_gauge, total).alias("sum"))
    return O.numbers(_otlp(spark, sf_dir, metric)).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, metric || m.suffix AS metric, source, ts_ms, m.value AS value, m.tags AS tags FROM (SELECT *, unnest([
  {{'suffix': '_sum', 'value': value, 'tags': 'quantile=a,service=svc'}}, {{'suffix': '_count', 'value': CAST(seq AS DOUBLE), 'tags': 'quantile=a,service=svc'}},
  {{'suffix': '', 'value': CAST(seq % 7 AS DOUBLE), 'tags': '_quantile=a,quantile=0.5,service=svc'}}]) AS m FROM points)""")
def d18_otlp_summary(spark, sf_dir):
    point = F.struct(F.array(_attribute("quantile", F.lit("a"))).alias("attributes"), _nanos(), F.col("seq").alias("count"), F.col("value").alias("sum"), F.array(F.struct(F.lit(0.5).alias("quantile"), (F.col("seq") % 7).cast("double").alias("value"))).alias("quantileValues"))
    metric = F.struct(F.col("metric").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("summary"))
    return O.summaries(_otlp(spark, sf_dir, metric)).select("seq", "metric", "source", "ts_ms", "value", _tags())


def _explicit(temporality: int, counts: Column) -> Column:
    point = F.struct(F.array(_attribute("le", F.lit("x"))).alias("attributes"), _nanos(), F.transform(counts, lambda c: c.cast("string")).alias("bucketCounts"), F.array(F.lit(1.0), F.lit(2.0)).alias("explicitBounds"))
    return F.struct(F.col("metric").alias("name"), F.struct(F.lit(temporality).alias("aggregationTemporality"), F.array(point).alias("dataPoints")).alias("histogram"))


@query(f"""WITH {POINTS} SELECT seq, metric, source, ts_ms, CAST(m.value AS DOUBLE) AS value, '_le=x,le=' || m.le || ',service=svc' AS tags FROM (SELECT *, unnest([
  {{'le': '1.0', 'value': seq % 4}}, {{'le': '2.0', 'value': seq % 4 + 1}}, {{'le': '+Inf', 'value': seq % 4 + 1 + seq % 3}}]) AS m FROM points)""")
def d19_cumulative_le(spark, sf_dir):
    metrics = _otlp(spark, sf_dir, _explicit(2, F.array(F.col("seq") % 4, F.lit(1), F.col("seq") % 3)))
    return O.histogram_points(metrics).filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, metric, source, ts_ms // d.ms * d.ms AS bin_start_ms, d.ms AS duration_ms, m.mean AS mean, CAST(m.count AS BIGINT) AS count FROM points,
  (VALUES (60000), (3600000), (86400000)) AS d(ms), LATERAL (SELECT unnest([{{'mean': 1.0, 'count': seq % 4}}, {{'mean': 1.5, 'count': 1}}, {{'mean': 2.0, 'count': seq % 3}}]) AS m) t
  WHERE m.count > 0""")
def d20_delta_histogram(spark, sf_dir):
    metrics = _otlp(spark, sf_dir, _explicit(1, F.array(F.col("seq") % 4, F.lit(1), F.col("seq") % 3)))
    out = O.histogram_bins(metrics).filter("error IS NULL").withColumn("c", F.explode("centroids"))
    return out.select("seq", "metric", "source", "bin_start_ms", "duration_ms", F.col("c.mean").alias("mean"), F.col("c.count").cast("long").alias("count"))


@query(f"WITH {POINTS} SELECT metric, CASE WHEN seq % 2 = 0 THEN 'explicit bounds must be one fewer than bucket counts' END AS error, count(*) AS n FROM points GROUP BY 1, 2")
def d21_bounds_check(spark, sf_dir):
    counts = F.when(F.col("seq") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return O.histogram_bins(_otlp(spark, sf_dir, _explicit(1, counts))).filter("duration_ms = 60000").groupBy("metric", "error").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS} SELECT seq, metric, round(m.mean, 6) AS mean, CAST(m.count AS BIGINT) AS count FROM points, LATERAL (SELECT unnest([
  {{'mean': -2.5, 'count': seq % 5}}, {{'mean': -0.625, 'count': 6}}, {{'mean': 7.875, 'count': seq % 2}}, {{'mean': 40.0, 'count': 3}}, {{'mean': 160.0, 'count': 2}}, {{'mean': 640.0, 'count': seq % 7}}]) AS m) t
  WHERE m.count > 0""")
def d22_exponential_histogram(spark, sf_dir):
    side = lambda offset, *counts: F.struct(F.lit(offset).alias("offset"), F.array(*[c.cast("string") for c in counts]).alias("bucketCounts"))
    point = F.struct(_nanos(), F.lit(-1).alias("scale"), (F.col("seq") % 2).alias("zeroCount"), side(2, F.lit(3), F.lit(2), F.col("seq") % 7).alias("positive"), side(-1, F.lit(6), F.col("seq") % 5).alias("negative"))
    metric = F.struct(F.col("metric").alias("name"), F.struct(F.lit(1).alias("aggregationTemporality"), F.array(point).alias("dataPoints")).alias("exponentialHistogram"))
    out = O.histogram_bins(_otlp(spark, sf_dir, metric)).filter("duration_ms = 60000").withColumn("c", F.explode("centroids"))
    return out.select("seq", "metric", F.round("c.mean", 6).alias("mean"), F.col("c.count").cast("long").alias("count"))


@query(f"""WITH {POINTS} SELECT seq, CASE seq % 3 WHEN 0 THEN 'own' WHEN 1 THEN source ELSE 'dflt' END AS source,
  CASE seq % 3 WHEN 0 THEN 'host.name=' || source || ',service=given,service.name=sn' WHEN 1 THEN 'service=sn' ELSE 'service=sn' END AS tags FROM points""")
def d23_otlp_attributes(spark, sf_dir):
    full = F.create_map(F.lit("source"), F.lit("own"), F.lit("host.name"), F.col("source"), F.lit("service"), F.lit("given"), F.lit("service.name"), F.lit("sn"))
    host = F.create_map(F.lit("host.name"), F.col("source"), F.lit("service.name"), F.lit("sn"))
    attributes = F.when(F.col("seq") % 3 == 0, full).when(F.col("seq") % 3 == 1, host).otherwise(F.create_map(F.lit("service.name"), F.lit("sn")))
    source, rest = O.source_and_tags(F.col("a"), "dflt")
    return _metric_body(spark, sf_dir, attributes.alias("a")).select("seq", source.alias("source"), T.tag_text(rest).alias("tags"))


OTLP_REJECTS = """CASE seq % 5 WHEN 0 THEN 'not an OTLP {0} request' WHEN 1 THEN 'not an OTLP {0} request' WHEN 2 THEN {1} END"""


def _broken_metrics(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Requests of which some are cut, some no objects and some of an unknown kind or empty; the rest have the metric."""
    n = F.col("seq") % 5
    body = lambda m: F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"'), "metric", F.lit(f'",{m}}}]}}]}}]}}'))
    made = F.when(n == 0, F.lit('{"resourceMetrics":[{')).when(n == 1, F.lit("[1]")).when(n == 2, body('"unit":"s"')).when(n == 3, F.lit("{}")).otherwise(body(metric))
    return O.decode_metrics(_metric_body(spark, sf_dir, made.alias("body")))


@query(f"""WITH {POINTS} SELECT 'numbers' AS kind, {OTLP_REJECTS.format("metrics", "'unsupported metric type'")} AS error, count(*) AS n FROM points WHERE seq % 5 <> 3 GROUP BY ALL
  UNION ALL SELECT 'summaries', {OTLP_REJECTS.format("metrics", "'unsupported metric type'")}, CAST(sum(CASE WHEN seq % 5 = 4 THEN 2 ELSE 1 END) AS BIGINT) FROM points WHERE seq % 5 <> 3 GROUP BY ALL
  UNION ALL SELECT 'points', CASE WHEN seq % 5 = 4 THEN 'unsupported temporality' ELSE {OTLP_REJECTS.format("metrics", "'unsupported metric type'")} END, count(*) FROM points WHERE seq % 5 <> 3 GROUP BY ALL
  UNION ALL SELECT 'bins', CASE WHEN seq % 5 = 4 THEN 'explicit bounds must be one fewer than bucket counts' ELSE {OTLP_REJECTS.format("metrics", "'unsupported metric type'")} END, CAST(sum(CASE WHEN seq % 5 = 4 THEN 3 ELSE 1 END) AS BIGINT) FROM points WHERE seq % 5 <> 3 GROUP BY ALL""")
def d17_otlp_rejects(spark, sf_dir):
    """Each decoder reports bodies that are no requests and metrics of no known kind; an empty request is nothing."""
    bins = '"histogram":{"aggregationTemporality":1,"dataPoints":[{"timeUnixNano":"1000000","bucketCounts":["1"],"explicitBounds":[1,2]}]}'
    decoded = {
        "numbers": O.numbers(_broken_metrics(spark, sf_dir, '"gauge":{"dataPoints":[{"asDouble":1}]}')), "summaries": O.summaries(_broken_metrics(spark, sf_dir, '"summary":{"dataPoints":[{}]}')),
        "points": O.histogram_points(_broken_metrics(spark, sf_dir, '"histogram":{"dataPoints":[{"bucketCounts":["1"]}]}')), "bins": O.histogram_bins(_broken_metrics(spark, sf_dir, bins)),
    }
    found = [df.groupBy("error").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "error", "n") for k, df in decoded.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""WITH {POINTS} SELECT seq, {OTLP_REJECTS.format("trace", "NULL")} AS error, CASE WHEN seq % 5 IN (2, 4) THEN metric END AS name FROM points WHERE seq % 5 <> 3""")
def d24_otlp_rejects(spark, sf_dir):
    n = F.col("seq") % 5
    good = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"'), "metric", F.lit('"}]}]}]}'))
    body = F.when(n == 0, F.lit('{"resourceSpans":')).when(n == 1, F.lit('{"resourceSpans":7}')).when(n == 3, F.lit(" { } ")).otherwise(good)
    return O.decode_spans(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "error", "name")


def _annotation_text() -> Column:
    return F.array_join(F.transform(F.array_sort("annotations"), lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",").alias("annotations")


def _otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.struct(_nanos(), F.lit("ev").alias("name"), F.array(_attribute("x", F.col("tags")["k"])).alias("attributes"))
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    span = F.struct(
        hexes.alias("traceId"), F.substring(hexes, 1, 16).alias("spanId"), F.col("metric").alias("name"), F.lit(2).alias("kind"), (F.col("ts_ms") * 1_000_000).cast("string").alias("startTimeUnixNano"),
        F.when(F.col("seq") % 4 == 0, F.lit("0")).otherwise(((F.col("ts_ms") + F.col("seq") % 9) * 1_000_000).cast("string")).alias("endTimeUnixNano"), F.array(_attribute("k", F.col("tags")["k"])).alias("attributes"),
        F.when(F.col("seq") % 2 == 0, F.array(event)).otherwise(F.array().cast("array<struct<timeUnixNano:string,name:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>>")).alias("events"),
        F.struct(F.when(F.col("seq") % 5 == 0, F.lit(2)).otherwise(F.lit(1)).alias("code"), F.lit("boom").alias("message")).alias("status"),
    )
    resource = F.struct(F.array(_attribute("host.name", F.col("source")), _attribute("service.name", F.lit("svc"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return O.decode_spans(_metric_body(spark, sf_dir, body.alias("body")))


HEX = "md5(CAST(seq AS VARCHAR))"
UUID = "regexp_replace({}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@query(f"""WITH {POINTS} SELECT seq, metric AS name, source, {UUID.format(f"lpad(left({HEX}, 16), 32, '0')")} AS span_id, {UUID.format(HEX)} AS trace_id, ts_ms AS start_ms,
  CASE WHEN seq % 4 = 0 THEN 0 ELSE seq % 9 END AS duration_ms, CASE WHEN seq % 2 = 0 THEN '_spanLogs=true,' ELSE '' END || 'application=defaultApplication,cluster=none,'
  || CASE WHEN seq % 5 = 0 THEN 'error=true,' ELSE '' END || 'k=' || k || CASE WHEN seq % 5 = 0 THEN ',otel.status_description=boom' ELSE '' END || ',service=svc,shard=none,span.kind=server' AS annotations FROM points""")
def d24_otlp_spans(spark, sf_dir):
    return O.with_required_tags(_otlp_spans(spark, sf_dir)).select("seq", "name", "source", "span_id", "trace_id", "start_ms", "duration_ms", _annotation_text())


@query(f"WITH {POINTS} SELECT seq, ts_ms * 1000 AS ts_us, 'name=ev,x=' || k AS fields FROM points WHERE seq % 2 = 0")
def d25_otlp_events(spark, sf_dir):
    return _otlp_spans(spark, sf_dir).withColumn("l", F.explode("logs")).select("seq", "l.ts_us", T.tag_text(F.col("l.fields")).alias("fields"))


@query(f"""WITH {POINTS} SELECT seq, CASE seq % 4 WHEN 0 THEN source WHEN 1 THEN CAST(seq AS VARCHAR) WHEN 2 THEN 'true' ELSE '[a, ' || k || ']' END AS text FROM points""")
def d26_any_value(spark, sf_dir):
    kind = F.col("seq") % 4
    value = F.when(kind == 0, F.to_json(F.struct(F.col("source").alias("stringValue")))).when(kind == 1, F.to_json(F.struct(F.col("seq").cast("string").alias("intValue")))).when(kind == 2, F.lit('{"boolValue":true}'))
    value = value.otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("a").alias("stringValue")), F.struct(F.col("tags")["k"].alias("stringValue"))).alias("values")).alias("arrayValue"))))
    return _metric_body(spark, sf_dir, O.any_text(F.from_json(value, O.ANY)).alias("text"))


# --- traces --------------------------------------------------------------------------------------------------------


def _tag(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit("STRING").alias("vType"), value.alias("vStr"))


#: Columns of spans that a JSON and a thrift batch give alike.
JAEGER_SQL = f"""metric AS name, CASE WHEN seq % 2 = 0 THEN source ELSE 'p-host' END AS source, {UUID.format(f"lpad(left({HEX}, 16), 32, '0')")} AS span_id,
  ts_ms AS start_ms, seq % 9 AS duration_ms, 'application=' || CASE WHEN seq % 3 = 0 THEN 'own' ELSE 'proc' END || ',cluster=none,error=' || CASE WHEN seq % 5 = 0 THEN 'true' ELSE 'false' END
  || ',followsFrom=' || {UUID.format(f"lpad(right({HEX}, 16), 32, '0')")} || ',jaegerSpanId=' || ltrim(left({HEX}, 16), '0') || ',jaegerTraceId=' || ltrim(right({HEX}, 16), '0') || ',k=' || k
  || ',parent=' || {UUID.format(f"lpad(right({HEX}, 16), 32, '0')")} || ',service=svc,shard=none' AS annotations"""


@query(f"WITH {POINTS} SELECT seq, {JAEGER_SQL} FROM points")
def d27_jaeger(spark, sf_dir):
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    own = F.filter(F.array(
        _tag("k", F.col("tags")["k"]), _tag("sampler.type", F.lit("const")), _tag("blank", F.lit(" ")), _tag("source", F.when(F.col("seq") % 2 == 0, F.col("source"))), _tag("application", F.when(F.col("seq") % 3 == 0, F.lit("own"))),
        _tag("error", F.when(F.col("seq") % 5 == 0, F.lit("true")).otherwise(F.lit("false"))),
    ), lambda t: t["vStr"].isNotNull())
    span = F.struct(
        F.substring(hexes, 17, 16).alias("traceIdLow"), F.substring(hexes, 1, 16).alias("spanId"), F.col("metric").alias("operationName"), (F.col("ts_ms") * 1000 + 999).alias("startTime"), ((F.col("seq") % 9) * 1000 + 1).alias("duration"), own.alias("tags"),
        F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.substring(hexes, 17, 16).alias("spanId"))).alias("references"),
    )
    process = F.struct(F.lit("svc").alias("serviceName"), F.array(_tag("hostname", F.lit("p-host")), _tag("application", F.lit("proc"))).alias("tags"))
    body = F.to_json(F.struct(process.alias("process"), F.array(span).alias("spans")))
    return X.decode_jaeger(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "name", "source", "span_id", "start_ms", "duration_ms", _annotation_text())


@query(f"""WITH {POINTS} SELECT seq, metric AS name, CASE WHEN seq % 2 = 0 THEN source ELSE 'zipkin' END AS source, ts_ms AS start_ms, seq % 9 AS duration_ms,
  '_spanLogs=true,_spanSecondaryId=client,application=Zipkin,cluster=none,' || CASE WHEN seq % 5 = 0 THEN 'error=true,' ELSE '' END || 'ipv4=10.0.0.1,k=' || k || ',service=svc,shard=none,span.kind=client,zipkinSpanId='
  || left({HEX}, 16) || ',zipkinTraceId=' || {HEX} AS annotations FROM points""")
def d28_zipkin(spark, sf_dir):
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    tags = F.map_filter(F.create_map(F.lit("k"), F.col("tags")["k"], F.lit("source"), F.when(F.col("seq") % 2 == 0, F.col("source")), F.lit("error"), F.when(F.col("seq") % 5 == 0, F.lit("no"))), lambda _, v: v.isNotNull())
    span = F.struct(
        hexes.alias("traceId"), F.substring(hexes, 1, 16).alias("id"), F.col("metric").alias("name"), F.lit("CLIENT").alias("kind"), (F.col("ts_ms") * 1000).alias("timestamp"), ((F.col("seq") % 9) * 1000 + 500).alias("duration"),
        F.struct(F.lit("svc").alias("serviceName"), F.lit("10.0.0.1").alias("ipv4")).alias("localEndpoint"), tags.alias("tags"), F.array(F.struct((F.col("ts_ms") * 1000).alias("timestamp"), F.lit("cs").alias("value"))).alias("annotations"),
    )
    return X.decode_zipkin(_metric_body(spark, sf_dir, F.to_json(F.array(span)).alias("body"))).select("seq", "name", "source", "start_ms", "duration_ms", _annotation_text())


@query(f"WITH {POINTS} SELECT seq, {UUID.format(f'lpad(left({HEX}, CAST(seq % 16 + 1 AS INTEGER)), 32, {chr(39)}0{chr(39)})')} AS id FROM points")
def d29_id_to_uuid(spark, sf_dir):
    short = F.left(F.md5(F.col("seq").cast("string").cast("binary")), (F.col("seq") % 16 + 1).cast("int"))
    return _metric_body(spark, sf_dir, T.uuid_of_hex(short).alias("id"))


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(length(l) AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) BETWEEN 1 AND 200 AND l = trim(l)")
def s2_line_length(spark, sf_dir):
    """Lines of the documents up to a length; longer ones are left out."""
    lines = S.body_lines(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")))
    return lines.filter(F.char_length("line") <= 200).select("doc_id", F.char_length("line").alias("n"))


@query(f"WITH {POINTS} SELECT seq, l AS line FROM (SELECT seq, unnest([metric, source]) AS l FROM points)")
def s3_body_lines(spark, sf_dir):
    return S.body_lines(_metric_body(spark, sf_dir, F.concat(F.lit(" "), "metric", F.lit(" \n\n  \n"), "source").alias("body"))).select("seq", "line")


@query(f"""WITH {POINTS} SELECT seq, l AS line FROM (SELECT seq, unnest(['{{"m":"' || metric || '"}}', source]) AS l FROM points)""")
def s4_json_array(spark, sf_dir):
    body = F.concat(F.lit("["), F.to_json(F.struct(F.col("metric").alias("m"))), F.lit(', "'), "source", F.lit('"]'))
    return S.json_array_lines(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "line")


@query(f"""WITH {POINTS} SELECT seq, l AS line FROM (SELECT seq, unnest(['{{"m":"' || metric || '"}}', '{{"s":"' || source || '"}}']) AS l FROM points)""")
def s5_json_lines(spark, sf_dir):
    body = F.concat(F.to_json(F.struct(F.col("metric").alias("m"))), F.to_json(F.struct(F.col("source").alias("s"))))
    return S.json_lines(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "line")


@query(f"""WITH {POINTS} SELECT seq, '{{"source":"' || source || '"}}' AS line FROM points""")
def s6_cloudwatch(spark, sf_dir):
    body = F.to_json(F.struct(F.lit(1).alias("other"), F.array(F.struct("source")).alias("logEvents")))
    return S.cloudwatch_lines(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "line")


@query(f"WITH {POINTS} SELECT seq, CASE seq % 3 WHEN 0 THEN 'HISTOGRAM' WHEN 1 THEN 'LOGS_JSON_ARR' END AS format FROM points")
def s7_format_parameter(spark, sf_dir):
    uri = F.when(F.col("seq") % 3 == 0, F.lit("/report?f=histogram")).when(F.col("seq") % 3 == 1, F.lit("/logs?format=logs_json_arr")).otherwise(F.lit("/report"))
    return _metric_body(spark, sf_dir, S.format_of_uri(uri).alias("format"))


@query(f"WITH {POINTS} SELECT {FORMAT_SQL} AS format, seq % 7 IN (2, 3, 5, 6) AS taken, count(*) AS n FROM points GROUP BY 1, 2")
def s9_relay_filter(spark, sf_dir):
    taken, refused = S.relay_filter(L.dispatch(_mixed(spark, sf_dir)))
    return taken.withColumn("taken", F.lit(True)).unionByName(refused.withColumn("taken", F.lit(False))).groupBy("format", "taken").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT DISTINCT source, k FROM points")
def s10_drop_repeated_batches(spark, sf_dir):
    return S.drop_repeated_batches(points(spark, sf_dir).select("source", F.col("tags")["k"].alias("k")), ["source", "k"])


@query(f"""WITH {POINTS} SELECT seq, metric AS line, ts_ms, CASE WHEN seq % 2 = 0 THEN source ELSE 'agent-' || k END AS source FROM points WHERE seq % 5 <> 0""")
def s11_filebeat(spark, sf_dir):
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.to_json(F.struct(
        F.when(F.col("seq") % 5 != 0, F.col("metric")).alias("message"), stamp.alias("@timestamp"), F.struct(F.when(F.col("seq") % 2 == 0, F.col("source")).alias("hostname")).alias("beat"),
        F.struct(F.concat(F.lit("agent-"), F.col("tags")["k"]).alias("hostname")).alias("agent"),
    ))
    return filebeat_lines(_metric_body(spark, sf_dir, body.alias("body"))).filter("error IS NULL").select("seq", "line", "ts_ms", "source")


@query(f"WITH {POINTS} SELECT CASE seq % 3 WHEN 0 THEN 'series' WHEN 1 THEN 'intake' ELSE 'ignored' END AS route, count(*) AS n FROM points GROUP BY 1")
def s16_datadog_routes(spark, sf_dir):
    path = F.when(F.col("seq") % 3 == 0, F.lit("/api/v1/series/")).when(F.col("seq") % 3 == 1, F.lit("/intake")).otherwise(F.lit("/other"))
    return _metric_body(spark, sf_dir, S.datadog_route(path).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS} SELECT metric || '.' || k AS metric, ts_ms // 1000 * 1000 AS ts_ms, CAST(seq AS DOUBLE) AS value, NULL AS error FROM points WHERE seq % 10 <> 3
  UNION ALL SELECT NULL, NULL, NULL, 'frame of 64 bytes ends after 1' FROM points WHERE seq % 10 = 3""")
def s8_pickle(spark, sf_dir):
    """Points pickled by protocol 0, which is text; one payload in ten is cut short."""
    rows = points(spark, sf_dir)
    text = F.concat(F.lit("(lp0\n(V"), "metric", F.lit("."), F.col("tags")["k"], F.lit("\np1\n(L"), F.floor(F.col("ts_ms") / 1000).cast("string"), F.lit("L\nF"), F.col("seq").cast("double").cast("string"), F.lit("\ntp2\ntp3\na."))
    frame = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), text.cast("binary"))
    short = F.concat(F.unhex(F.lit("00000040")), F.lit("x").cast("binary"))
    return S.decode_pickles(rows.select(F.when(F.col("seq") % 10 == 3, short).otherwise(frame).alias("content")))


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'not JSON' WHEN seq % 3 = 1 THEN 'not a JSON object' END AS error, CASE WHEN seq % 3 = 2 THEN 'a.b.c.d.e.f.g.h.i.j.k' END AS metric FROM points""")
def d9_rejects(spark, sf_dir):
    """Bodies that are no JSON objects are reported; ten levels of nesting are not."""
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":{"k":1}}}}}}}}}}}'
    body = F.when(F.col("seq") % 3 == 0, F.lit('{"a":')).when(F.col("seq") % 3 == 1, F.lit("[1]")).otherwise(F.lit(deep))
    out = J.decode_nested_json(_metric_body(spark, sf_dir, body.alias("body")))
    return out.select("seq", F.substring_index("error", ":", 1).alias("error"), F.when(F.col("error").isNull(), F.col("metric")).alias("metric"))


@query(f"""WITH {POINTS} SELECT seq, 'no value' AS error FROM points WHERE seq % 2 = 0 UNION ALL SELECT seq, 'not a put line' FROM points WHERE seq % 2 = 1""")
def d8_rejects(spark, sf_dir):
    line = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("put m "), _second().cast("string"), F.lit(" one host=h"))).otherwise(F.concat(F.lit("set m "), _second().cast("string"), F.lit(" 1")))
    return J.decode_opentsdb_lines(_metric_body(spark, sf_dir, line.alias("line"))).select("seq", "error")


@query(f"""WITH {POINTS}, k AS (SELECT seq, metric, ts_ms, k, unnest(CASE seq % 3 WHEN 0 THEN ['client', 'server'] WHEN 1 THEN ['server'] ELSE [NULL] END) AS kind FROM points)
  SELECT seq, metric AS name, kind, CASE WHEN seq % 3 = 0 AND kind = 'server' THEN ts_ms + 2 ELSE ts_ms END AS start_ms, CASE WHEN seq % 3 = 0 AND kind = 'server' THEN 3 ELSE 9 END AS duration_ms,
    CASE WHEN seq % 3 = 0 AND kind = 'client' THEN 'web' ELSE 'db' END AS service, CASE WHEN seq % 3 > 0 OR kind = 'client' THEN k END AS k FROM k""")
def s15_zipkin_v1(spark, sf_dir):
    """Span lists of the first version: a shared span is a client and a server, and tags go to the service they name."""
    rows, third = points(spark, sf_dir), F.col("seq") % 3
    hexes, service = F.md5(F.col("seq").cast("string").cast("binary")), F.when(third == 0, F.lit("web")).otherwise(F.lit("db"))
    note = lambda value, after, place: F.struct((F.col("ts_ms") * 1000 + after).alias("timestamp"), F.lit(value).alias("value"), F.struct(F.lit(place).alias("serviceName")).alias("endpoint"))
    server = [note("sr", 2000, "db"), note("ss", 5000, "db")]
    notes = F.when(third == 0, F.array(note("cs", 0, "web"), *server)).when(third == 1, F.array(*server)).otherwise(F.array().cast("array<struct<timestamp:bigint,value:string,endpoint:struct<serviceName:string>>>"))
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.col("tags")["k"].alias("value"), F.struct(service.alias("serviceName")).alias("endpoint")))
    span = F.struct(hexes.alias("traceId"), F.substring(hexes, 1, 16).alias("id"), F.col("metric").alias("name"), (F.col("ts_ms") * 1000).alias("timestamp"), F.lit(9000).alias("duration"), notes.alias("annotations"), pairs.alias("binaryAnnotations"))
    out = X.decode_zipkin(rows.select("seq", F.to_json(F.array(span)).alias("body")))
    value = lambda key: T.first_value(F.col("annotations"), key)
    return out.select("seq", "name", value("span.kind").alias("kind"), "start_ms", "duration_ms", value("service").alias("service"), value("k").alias("k"))


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 4 < 2 THEN 'not a span list' END AS error, CASE WHEN seq % 4 = 3 THEN metric END AS name FROM points WHERE seq % 4 <> 2""")
def d28_rejects(spark, sf_dir):
    """What is no span list is reported; an empty list is nothing."""
    n = F.col("seq") % 4
    body = F.when(n == 0, F.lit('[{"id":')).when(n == 1, F.lit("{}")).when(n == 2, F.lit("[]")).otherwise(F.to_json(F.array(F.struct(F.lit("a").alias("traceId"), F.lit("b").alias("id"), F.col("metric").alias("name")))))
    return X.decode_zipkin(_metric_body(spark, sf_dir, body.alias("body"))).select("seq", "error", F.when(F.col("error").isNull(), F.col("name")).alias("name"))


@query(f"""WITH {POINTS}, e AS (SELECT CASE seq % 7 WHEN 0 THEN 'SOURCE_TAG' WHEN 1 THEN 'EVENT' WHEN 2 THEN 'SPAN_LOG' WHEN 3 THEN 'HISTOGRAM' WHEN 4 THEN 'LOG' ELSE 'POINT' END AS entity,
    CASE seq % 7 WHEN 2 THEN 'not a span log' WHEN 4 THEN 'not a JSON object' WHEN 5 THEN 'not a point line' WHEN 6 THEN CASE WHEN metric = 'event.error' THEN 'no errors' END END AS reason FROM points)
  SELECT entity, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS n FROM e GROUP BY ALL""")
def s1_ingest_entities(spark, sf_dir):
    """A port's mixed lines by entity: every line is accepted or rejected with its reason."""
    some = ingest.dispatched(_mixed(spark, sf_dir).select("line"))
    rules = [{"rule": "no errors", "action": "block", "scope": "pointLine", "match": ".*event.error.*"}]
    found = [ingest.rows_of_entity(some, rules, e).select(F.lit(e).alias("entity"), "status", "reason") for e in ingest.COLUMNS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("entity", "status", "reason").agg(F.count("*").alias("n"))


# --- binary bodies -------------------------------------------------------------------------------------------------


def _small(n: int) -> bytes:
    """A fixed number as a varint."""
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _of_long(n: Column) -> Column:
    byte = lambda k, last: F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127) + (0 if last else 128)), 2, "0"))
    out = F.concat(*[byte(k, k == 4) for k in range(5)])
    for size in (4, 3, 2, 1):
        out = F.when(n < 1 << 7 * size, F.concat(*[byte(k, k == size - 1) for k in range(size)])).otherwise(out)
    return out


def _varint(n: Column) -> Column:
    """Numbers below 2^35 as one to five bytes."""
    return T.once(n.cast("long"), _of_long)


def _held(number: int, *parts: Column) -> Column:
    """A field that holds bytes: texts or messages."""
    body = F.concat(*[p.cast("binary") for p in parts])
    return T.once(body, lambda b: F.concat(F.lit(_small(number << 3 | 2)), _of_long(F.octet_length(b).cast("long")), b))


def _plain(number: int, n: Column) -> Column:
    return F.concat(F.lit(_small(number << 3)), _varint(n))


def _eight(number: int, n: Column) -> Column:
    """A field of eight bytes, the least first."""
    whole = F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    return F.concat(F.lit(_small(number << 3 | 1)), T.once(whole, lambda x: F.concat(*[F.substring(x, k, 1) for k in range(8, 0, -1)])))


def _pair(number: int, key: str, value: Column) -> Column:
    return _held(number, _held(1, F.lit(key)), _held(2, _held(1, value)))


def _cut(body: Column) -> Column:
    """One body in ten lacks its last byte."""
    return T.once(body, lambda b: F.when(F.col("seq") % 10 == 3, F.substring(b, F.lit(1), F.octet_length(b) - 1)).otherwise(b)).alias("body")


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 10 <> 3 THEN CASE WHEN seq % 3 = 1 THEN '∆' ELSE '' END || metric END AS metric, CASE WHEN seq % 10 <> 3 THEN source END AS source, CASE WHEN seq % 10 <> 3 THEN ts_ms END AS ts_ms,
  CASE WHEN seq % 10 <> 3 THEN CAST(seq - 50 AS DOUBLE) END AS value, CASE WHEN seq % 10 <> 3 THEN 'k=' || k || ',service=svc' ELSE '' END AS tags, CASE WHEN seq % 10 = 3 THEN 'it ends within a field' END AS error FROM points""")
def s13_otlp_protobuf_numbers(spark, sf_dir):
    """Binary metrics: delta and cumulative sums, with fields of unknown numbers between the known ones."""
    point = F.concat(_held(99, F.lit("later")), _pair(7, "k", F.col("tags")["k"]), _eight(3, F.col("ts_ms") * 1_000_000), _plain(77, F.col("seq")), _eight(6, F.col("seq") - 50))
    metric = F.concat(_held(1, F.col("metric")), _held(2, F.lit("what it is")), _held(7, _plain(2, F.when(F.col("seq") % 3 == 1, F.lit(1)).otherwise(F.lit(2))), _held(1, point)))
    resource = F.concat(_pair(1, "host.name", F.col("source")), _pair(1, "service.name", F.lit("svc")))
    body = _held(1, _held(1, resource), _held(2, _held(2, metric)))
    out = O.numbers(O.decode_metrics(P.otlp_metrics(_metric_body(spark, sf_dir, _cut(body)))))
    return out.select("seq", "metric", "source", "ts_ms", "value", _tags(), "error")


@query(f"""WITH {POINTS} SELECT seq, metric, source, ts_ms, CAST(m.value AS DOUBLE) AS value, 'le=' || m.le AS tags FROM (SELECT *, unnest([
  {{'le': '1.0', 'value': seq % 4}}, {{'le': '2.0', 'value': seq % 4 + 300}}, {{'le': '+Inf', 'value': seq % 4 + 300 + seq % 3}}]) AS m FROM points)""")
def s13_otlp_protobuf_histograms(spark, sf_dir):
    """Binary cumulative histograms: packed counts of eight bytes and packed bounds."""
    count = lambda n: F.substring(_eight(1, n), 2, 8)
    bounds = F.unhex(F.lit("000000000000f03f" + "0000000000000040"))
    point = F.concat(_eight(3, F.col("ts_ms") * 1_000_000), _held(6, count(F.col("seq") % 4), count(F.lit(300)), count(F.col("seq") % 3)), _held(7, bounds))
    metric = F.concat(_held(1, F.col("metric")), _held(9, _held(1, point), _plain(2, F.lit(2))))
    body = _held(1, _held(1, _pair(1, "host.name", F.col("source"))), _held(2, _held(2, metric)))
    out = O.histogram_points(O.decode_metrics(P.otlp_metrics(_metric_body(spark, sf_dir, body.alias("body")))))
    return out.filter("error IS NULL").select("seq", "metric", "source", "ts_ms", "value", _tags())


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 10 <> 3 THEN metric END AS name, CASE WHEN seq % 10 <> 3 THEN {UUID.format(HEX)} END AS trace_id, CASE WHEN seq % 10 <> 3 THEN ts_ms END AS start_ms, CASE WHEN seq % 10 <> 3 THEN seq % 9 END AS duration_ms,
  CASE WHEN seq % 10 <> 3 AND seq % 2 = 0 THEN ts_ms * 1000 END AS ts_us, CASE WHEN seq % 10 = 3 THEN 'it ends within a field' END AS error FROM points""")
def s13_otlp_protobuf_spans(spark, sf_dir):
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    event = F.when(F.col("seq") % 2 == 0, _held(11, _eight(1, F.col("ts_ms") * 1_000_000), _held(2, F.lit("ev")))).otherwise(F.lit("").cast("binary"))
    span = F.concat(_held(1, F.unhex(hexes)), _held(2, F.unhex(F.substring(hexes, 1, 16))), _held(5, F.col("metric")), _plain(6, F.lit(2)), _eight(7, F.col("ts_ms") * 1_000_000), _eight(8, (F.col("ts_ms") + F.col("seq") % 9) * 1_000_000), event)
    body = _held(1, _held(1, _pair(1, "host.name", F.col("source"))), _held(2, _held(2, span)))
    out = O.decode_spans(P.otlp_traces(_metric_body(spark, sf_dir, _cut(body))))
    return out.select("seq", "name", "trace_id", "start_ms", "duration_ms", F.get("logs", F.lit(0))["ts_us"].alias("ts_us"), "error")


@query(f"""WITH {POINTS} SELECT seq, CASE WHEN seq % 10 <> 3 THEN regexp_replace(metric, '[^-_.0-9A-Za-z]', '_', 'g') END AS metric, CASE WHEN seq % 10 <> 3 THEN source ELSE 'unknown' END AS source, CASE WHEN seq % 10 <> 3 THEN ts_ms // 1000 * 1000 END AS ts_ms,
  CASE WHEN seq % 10 <> 3 THEN CASE WHEN seq % 2 = 0 THEN 25.0 ELSE 2.5 END END AS value, CASE WHEN seq % 10 <> 3 THEN 'k=' || k ELSE '' END AS tags, CASE WHEN seq % 10 = 3 THEN 'it ends within a field' END AS error FROM points""")
def s16_series_protobuf(spark, sf_dir):
    """Binary series of the second version; a rate is a count by its interval."""
    point = F.concat(F.unhex(F.lit("090000000000000440")), _plain(2, F.floor(F.col("ts_ms") / 1000)))
    series = F.concat(_held(1, _held(1, F.lit("host")), _held(2, F.col("source"))), _held(2, F.col("metric")), _held(3, F.concat(F.lit("k:"), F.col("tags")["k"])), _held(4, point), _plain(5, F.when(F.col("seq") % 2 == 0, F.lit(2)).otherwise(F.lit(3))), _plain(8, F.lit(10)))
    out = J.decode_datadog_series(P.datadog_series(_metric_body(spark, sf_dir, _cut(_held(1, series)))), version=2)
    return out.select("seq", "metric", "source", "ts_ms", "value", _tags(), "error")


@query(f"""WITH {POINTS} SELECT seq, metric AS name, 'src' AS source, {UUID.format(HEX)} AS trace_id, ts_ms AS start_ms, seq % 9 AS duration_ms, CASE WHEN seq % 2 = 0 THEN 'client' END AS kind, 'db' AS service, k FROM points""")
def s15_zipkin_protobuf(spark, sf_dir):
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    tag = lambda key, value: _held(11, _held(1, F.lit(key)), _held(2, value))
    kind = F.when(F.col("seq") % 2 == 0, _plain(4, F.lit(1))).otherwise(F.lit("").cast("binary"))
    span = F.concat(_held(1, F.unhex(hexes)), _held(3, F.unhex(F.substring(hexes, 1, 16))), kind, _held(5, F.col("metric")), _eight(6, F.col("ts_ms") * 1000), _plain(7, F.col("seq") % 9 * 1000), _held(8, _held(1, F.lit("db"))), tag("k", F.col("tags")["k"]), tag("source", F.lit("src")))
    out = X.decode_zipkin(P.zipkin_spans(_metric_body(spark, sf_dir, _held(1, span).alias("body"))))
    value = lambda key: T.first_value(F.col("annotations"), key)
    return out.filter("error IS NULL").select("seq", "name", "source", "trace_id", "start_ms", "duration_ms", value("span.kind").alias("kind"), value("service").alias("service"), value("k").alias("k"))


def _number(n: Column, size: int = 4) -> Column:
    """A number with the most significant byte first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def _window(n: int) -> Column:
    return F.concat(F.lit("2W").cast("binary"), _number(F.lit(n)))


def _message(sequence: int, text: Column) -> Column:
    return F.concat(F.lit("2J").cast("binary"), _number(F.lit(sequence)), _number(F.octet_length(text)), text.cast("binary"))


@query(f"""WITH {POINTS}, m AS (SELECT seq, unnest(CASE seq % 4
    WHEN 0 THEN [{{'batch': 0, 'sequence': 1, 'line': metric}}, {{'batch': 0, 'sequence': 2, 'line': metric}}, {{'batch': 1, 'sequence': 1, 'line': k}}]
    WHEN 1 THEN [{{'batch': 0, 'sequence': 1, 'line': 'pair ' || k}}] WHEN 2 THEN [{{'batch': 0, 'sequence': 7, 'line': metric}}]
    ELSE [{{'batch': 0, 'sequence': 1, 'line': metric}}, {{'batch': 0, 'sequence': NULL, 'line': NULL}}] END) AS m, source, ts_ms FROM points)
  SELECT seq, m.batch AS batch, CAST(m.sequence AS BIGINT) AS sequence, m.line AS line, CASE WHEN m.line IS NOT NULL THEN ts_ms END AS ts_ms, CASE WHEN m.line IS NULL OR seq % 4 = 1 THEN 'unknown' ELSE source END AS source,
    CASE WHEN m.line IS NULL THEN 'payload ends within a frame' END AS error FROM m""")
def s10_frames(spark, sf_dir):
    """Payloads of both versions, some cut; each was sent twice, and what was sent again goes. Frames in frames: tests/test_frames.py."""
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = lambda line: F.to_json(F.struct(line.alias("message"), stamp.alias("@timestamp"), F.struct(F.col("source").alias("hostname")).alias("beat")))
    metric, k = event(F.col("metric")), event(F.col("tags")["k"])
    text = lambda x: F.concat(_number(F.octet_length(x)), x.cast("binary"))
    pairs = F.concat(F.lit("1D").cast("binary"), _number(F.lit(1)), _number(F.lit(2)), text(F.lit("message")), text(F.concat(F.lit("pair "), F.col("tags")["k"])), text(F.lit("@timestamp")), text(stamp))
    n = F.col("seq") % 4
    two = F.concat(_window(2), _message(1, metric), _message(2, metric), _window(1), _message(1, k))
    cut = F.concat(_window(2), _message(1, metric), _message(2, k))
    body = F.when(n == 0, two).when(n == 1, F.concat(F.lit("1").cast("binary"), F.substring(_window(1), 2, 5), pairs)).when(n == 2, F.concat(_window(1), _message(7, metric))).otherwise(F.substring(cut, F.lit(1), F.octet_length(cut) - 1))
    sent = points(spark, sf_dir).select("seq", body.alias("content")).withColumn("time", F.explode(F.array(F.lit(0), F.lit(1))))
    found = frames.drop_resent_batches(frames.decode_frames(sent, "content"), ["seq", "time"], ["seq"]).filter("time = 0 OR error IS NULL")
    reason = F.col("error").alias("reason")
    return filebeat_lines(found.select("seq", "batch", "sequence", "message", reason), "message").select("seq", "batch", "sequence", "line", "ts_ms", "source", F.coalesce("reason", "error").alias("error"))


Both = tuple[Column, Column]


def _thrift_long(n: Column) -> Both:
    """A long in the binary and in the compact protocol, where it has all of its ten bytes."""
    n = n.cast("long")
    zigzag = F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))
    septets = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.lpad(F.hex(F.call_function("shiftrightunsigned", zigzag, 7 * k).bitwiseAND(127) + F.when(k < 9, 128).otherwise(0)), 2, "0"))
    return _number(n, 8), F.unhex(F.array_join(septets, ""))


def _thrift_text(text: Column) -> Both:
    """Texts of less than 128 bytes."""
    size = F.octet_length(text)
    return F.concat(_number(size), text.cast("binary")), F.concat(_number(size, 1), text.cast("binary"))


def _thrift_choice(n: int) -> Both:
    return _number(F.lit(n)), _varint(F.lit(2 * n))


def _thrift_struct(**fields: Both) -> Both:
    """Fields by names of a kind and a number; the compact protocol has steps from the field before."""
    kinds = {"long": (10, 6), "text": (11, 8), "choice": (8, 5), "struct": (12, 12), "list": (15, 9)}
    parts: list[list[Column]] = [[], []]
    before = 0
    for name, value in fields.items():
        kind, number = name.split("_")[0], int(name.split("_")[1])
        heads = f"{kinds[kind][0]:02x}{number:04x}", f"{number - before << 4 | kinds[kind][1]:02x}"
        before = number
        for part, head, x in zip(parts, heads, value):
            part += [F.unhex(F.lit(head)), x]
    end = F.unhex(F.lit("00"))
    return F.concat(*parts[0], end), F.concat(*parts[1], end)


def _thrift_list(*structs: Both) -> Both:
    n = len(structs)
    return F.concat(F.unhex(F.lit(f"0c{n:08x}")), *[x for x, _ in structs]), F.concat(F.unhex(F.lit(f"{n << 4 | 12:02x}")), *[x for _, x in structs])


def _thrift_tag(key: str, value: Column) -> Both:
    return _thrift_struct(text_1=_thrift_text(F.lit(key)), choice_2=_thrift_choice(0), text_3=_thrift_text(value))


@query(f"""WITH {POINTS} SELECT seq, error, CASE WHEN error IS NULL THEN name END AS name, CASE WHEN error IS NULL THEN source ELSE 'jaeger' END AS source, CASE WHEN error IS NULL THEN span_id END AS span_id, CASE WHEN error IS NULL THEN start_ms END AS start_ms,
  CASE WHEN error IS NULL THEN duration_ms END AS duration_ms, CASE WHEN error IS NULL THEN annotations END AS annotations FROM (SELECT seq, {JAEGER_SQL}, CASE WHEN seq % 10 = 3 THEN 'body ends within a field' END AS error FROM points)""")
def s14_jaeger_thrift(spark, sf_dir):
    """Batches in the binary protocol, and of odd rows in the compact one; one in ten is cut. The spans are those of d27_jaeger."""
    hexes = F.md5(F.col("seq").cast("string").cast("binary"))
    ids = [F.conv(F.substring(hexes, start, 16), 16, -10).cast("long").alias(name) for name, start in (("high", 1), ("low", 17))]
    given = points(spark, sf_dir).select("seq", "metric", "source", "ts_ms", "tags", *ids)
    low, high, zero, blank = _thrift_long(F.col("low")), _thrift_long(F.col("high")), _thrift_long(F.lit(0)), F.lit(" ")
    own = _thrift_list(
        _thrift_tag("k", F.col("tags")["k"]), _thrift_tag("sampler.type", F.lit("const")), _thrift_tag("blank", blank), _thrift_tag("source", F.when(F.col("seq") % 2 == 0, F.col("source")).otherwise(blank)),
        _thrift_tag("application", F.when(F.col("seq") % 3 == 0, F.lit("own")).otherwise(blank)), _thrift_tag("error", F.when(F.col("seq") % 5 == 0, F.lit("true")).otherwise(F.lit("false"))),
    )
    reference = _thrift_struct(choice_1=_thrift_choice(0), long_2=zero, long_3=zero, long_4=low)
    span = _thrift_struct(
        long_1=low, long_2=zero, long_3=high, long_4=zero, text_5=_thrift_text(F.col("metric")), list_6=_thrift_list(reference), choice_7=_thrift_choice(1), long_8=_thrift_long(F.col("ts_ms") * 1000 + 999),
        long_9=_thrift_long(F.col("seq") % 9 * 1000 + 1), list_10=own,
    )
    process = _thrift_struct(text_1=_thrift_text(F.lit("svc")), list_2=_thrift_list(_thrift_tag("hostname", F.lit("p-host")), _thrift_tag("application", F.lit("proc"))))
    binary, compact = _thrift_struct(struct_1=process, list_2=_thrift_list(span))
    bodies = given.select("seq", F.when(F.col("seq") % 2 == 0, binary).otherwise(compact).alias("body")).select("seq", _cut(F.col("body")))
    out = X.decode_jaeger(thrift.jaeger_batches(bodies))
    return out.select("seq", "name", "source", "span_id", "start_ms", "duration_ms", F.when(F.col("error").isNull(), _annotation_text()).alias("annotations"), "error")
