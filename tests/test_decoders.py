"""Golden payloads of the decoders."""

import json
import pickle
import struct

import pytest
from pyspark.sql import functions as F

from tallyvane.functions import tags as T
from tallyvane.operators import json_metrics as J
from tallyvane.operators import lines as L
from tallyvane.operators import otlp as O
from tallyvane.operators import traces as X
from tallyvane.sources import wire as S


def lines(spark, *texts, name="line"):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


def test_point_lines(spark):
    df = L.decode_points(lines(spark, "metric.test 0 1700000000 source=test1", 'metric.name 1 1700000000 source=metric.source tagk1=tagv1', '"a b" 2.5 source="x y" "k 1"="v\\"1"', "metric.name", "m x source=s", "m 1 1700000000 k=v"))
    rows = df.collect()
    assert (rows[0].metric, rows[0].source, rows[0].ts_ms, rows[0].value, rows[0].tags) == ("metric.test", "test1", 1_700_000_000_000, 0.0, {})
    assert rows[1].tags == {"tagk1": "tagv1"}
    assert (rows[2].metric, rows[2].source, rows[2].tags) == ("a b", "x y", {"k 1": 'v"1'})
    assert [r.error is None for r in rows] == [True, True, True, False, False, False]
    line = df.limit(2).select(L.encode_points(F.col("metric"), F.col("value"), F.col("ts_ms"), F.col("source"), F.col("tags")).alias("l")).collect()[1].l
    assert line == '"metric.name" 1.0 1700000000 source="metric.source" "tagk1"="tagv1"'


def test_histogram_and_span_lines(spark):
    r = L.decode_histograms(lines(spark, "!M 1700000000 #5 10.0 #10 100.0 metric.test.histo source=test1", "!M #5")).collect()
    assert [tuple(c) for c in r[0].centroids] == [(10.0, 5), (100.0, 10)] and r[0].duration_ms == 60_000 and r[0].bin_start_ms == 1_699_999_980_000
    assert r[1].error == "not a histogram line"
    s = L.decode_spans(lines(spark, 'testSpanName parent=parent1 source=testsource spanId=testspanid traceId="t-1" parent=parent2 1700000000 1700000001')).collect()[0]
    assert (s.name, s.source, s.span_id, s.trace_id, s.duration_ms) == ("testSpanName", "testsource", "testspanid", "t-1", 1000)
    assert [tuple(a) for a in s.annotations] == [("parent", "parent1"), ("parent", "parent2")]


def test_events_and_source_tags(spark):
    e = L.decode_events(lines(spark, '@Event 1700000000 "Event name for testing" host=host1 host=host2 tag=tag1 severity=INFO multi=bar multi=baz', "@Event")).collect()
    assert (e[0].name, e[0].end_ms - e[0].start_ms, e[0].hosts, e[0].event_tags, e[0].annotations, e[0].dimensions) == ("Event name for testing", 1, ["host1", "host2"], ["tag1"], {"severity": "INFO"}, {"multi": ["bar", "baz"]})
    assert e[1].error
    t = L.decode_source_tags(lines(spark, "@SourceTag action=add source=testSource newtag1 newtag2", "@SourceTag", '@SourceDescription action=save source=s description="a b"')).collect()
    assert (t[0].operation, t[0].action, t[0].source, t[0].values) == ("SOURCE_TAG", "ADD", "testSource", ["newtag1", "newtag2"])
    assert t[1].error and t[2]["values"] == ["a b"]


def test_format_detection(spark):
    texts = ["@SourceTag x", "@SourceDescription x", "@Event x", '{"a":1}', "!D #1 1 m", "[1]", "m 1", "x", ""]
    got = [r.f for r in lines(spark, *texts).select(L.detect_format(F.col("line")).alias("f")).collect()]
    assert got == ["SOURCE_TAG", "SOURCE_TAG", "EVENT", "SPAN_LOG", "HISTOGRAM", "LOGS_JSON_ARR", "DEFAULT", "DEFAULT", "DEFAULT"]


def test_graphite_names(spark):
    def one(name, *args):
        m, s, t, e = J.graphite_to_point(F.col("line"), *args)
        return lines(spark, name).select(m.alias("m"), s.alias("s"), t.alias("t"), e.alias("e")).first()

    assert one("collectd.com.bigcorp.www02_web.cpu.loadavg.1m", [4, 3, 2], "_")[:2] == ("collectd.cpu.loadavg.1m", "www02.web.bigcorp.com")
    assert one("hosts.host1.collectd.cpu.loadavg.1m", [2], "", [1, 3])[:2] == ("cpu.loadavg.1m", "host1")
    assert one("a.b;k=v;x=y", [2], "").t == {"k": "v", "x": "y"}
    assert one("a.b", [4], "").e == "too few segments"
    with pytest.raises(ValueError):
        J.graphite_to_point(F.col("line"), [0], "_")


def test_datadog(spark):
    body = '{"series":[{"metric":"m%d","type":"rate","host":"HoSt","interval":20,"device":"eth0","points":[[1531176936,20]],"tags":["env:prod,app:openstack","source:x","none"]}]}'
    r = J.decode_datadog_series(lines(spark, body, name="body")).collect()[0]
    assert (r.metric, r.source, r.ts_ms, r.value, r.tags) == ("m_d", "host", 1_531_176_936_000, 400.0, {"env": "prod", "app": "openstack", "_source": "x", "device": "eth0"})
    c = J.decode_datadog_checks(lines(spark, '{"check":"testApp.status","host_name":"testHost","timestamp":1536719228,"status":3}', name="body")).collect()[0]
    assert (c.metric, c.source, c.ts_ms, c.value) == ("testApp.status", "testhost", 1_536_719_228_000, 3.0)
    h = J.datadog_host_tags(lines(spark, '{"internalHostname":"testHost","host-tags":{"system":["app:closedstack","role:control"]}}', name="body")).collect()[0]
    assert (h.source, h.system_tags) == ("testhost", {"app": "closedstack", "role": "control"})


def test_datadog_rejects(spark):
    check = '{"check":"c","timestamp":1,"status":2}'
    got = J.decode_datadog_checks(lines(spark, check, f"[{check},{check}]", '{"check":"none"}', "{", "x", None, name="body")).collect()
    assert [(r.metric, r.value, r.error) for r in got] == [("c", 2.0, None)] * 3 + [(None, None, "malformed request")] * 3
    got = J.decode_datadog_intake(lines(spark, '{"internalHostname":"H","collection_timestamp":1,"cpuIdle":5}', '{"internalHostname":"H"}', "{", "[1]", None, name="body")).collect()
    assert [(r.metric, r.value, r.error) for r in got] == [("system.cpu.idle", 5.0, None)] + [(None, None, "malformed request")] * 3


def test_collectd_rejects(spark):
    good = '[{"values":[1.5,2],"dsnames":["read","write"],"time":1,"host":"h","plugin":"disk","plugin_instance":"sda","type":"disk_octets","type_instance":""}]'
    rows = J.decode_collectd(lines(spark, good, '[{"dsnames":["x"],"plugin":"p","type":"t"}]', '[{"values":[1],"type":"t"}]', name="body")).collect()
    assert [(r.metric, r.source, r.ts_ms, r.value) for r in rows[:2]] == [("disk.sda.disk_octets.read", "h", 1000, 1.5), ("disk.sda.disk_octets.write", "h", 1000, 2.0)]
    assert [r.error for r in rows[2:]] == ["no values", "malformed request"]


def test_exponential_histograms(spark):
    def bins(scale, zero, p, n):
        side = lambda s: "null" if s is None else f'{{"offset":{s[0]},"bucketCounts":{[str(x) for x in s[1]]}}}'.replace("'", '"')
        body = f'{{"resourceMetrics":[{{"scopeMetrics":[{{"metrics":[{{"name":"m","exponentialHistogram":{{"aggregationTemporality":1,"dataPoints":[{{"timeUnixNano":"60000000000","scale":{scale},"zeroCount":"{zero}","positive":{side(p)},"negative":{side(n)}}}]}}}}]}}]}}]}}'
        rows = O.histogram_bins(O.decode_metrics(lines(spark, body, name="body"))).collect()
        assert [r.duration_ms for r in rows] == [60_000, 3_600_000, 86_400_000]
        return rows[0].centroids

    got = bins(1, 5, (3, [2, 1, 4, 3]), None)
    assert [c["count"] for c in got] == [5, 2, 1, 4, 3] and [round(c["mean"], 4) for c in got] == [0.9142, 3.4142, 4.8284, 6.8284, 9.6569]
    got = bins(-1, 1, (2, [3, 2, 5]), (-1, [6, 4]))
    assert [(c["mean"], c["count"]) for c in got] == [(-2.5, 4), (-0.625, 6), (7.875, 1), (40.0, 3), (160.0, 2), (640.0, 5)]


def test_cumulative_histogram(spark):
    body = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","histogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"1","bucketCounts":["1","1","1"],"explicitBounds":[1.0,2.0]}]}}]}]}]}'
    rows = O.histogram_points(O.decode_metrics(lines(spark, body, name="body"))).collect()
    assert [(r.tags["le"], r.value) for r in rows] == [("1.0", 1.0), ("2.0", 2.0), ("+Inf", 3.0)]


def test_jaeger_child_of_also_follows(spark):
    body = '{"process":{"serviceName":"s"},"spans":[{"traceIdLow":"a","spanId":"b","operationName":"o","startTime":1999,"duration":1999,"references":[{"refType":"CHILD_OF","spanId":"c"}],"tags":[{"key":"error","vBool":true},{"key":"sampler.param","vStr":"x"},{"key":"service","vStr":"x"}]}]}'
    r = X.decode_jaeger(lines(spark, body, name="body")).first()
    keys = {a.key: a.value for a in r.annotations}
    assert (r.start_ms, r.duration_ms, keys["error"], keys["service"]) == (1, 1, "true", "s")
    assert keys["followsFrom"].endswith("00000000000c") and "sampler.param" not in keys and keys["parent"] == keys["followsFrom"]


def test_zipkin_of_the_first_version(spark):
    place = lambda s: {"serviceName": s, "ipv4": "10.0.0.1"}
    shared = {"traceId": "a", "id": "b", "name": "get", "timestamp": 5000, "duration": 4000, "annotations": [{"timestamp": 5000, "value": "cs", "endpoint": place("web")}, {"timestamp": 6000, "value": "sr", "endpoint": place("db")},
        {"timestamp": 7000, "value": "cached", "endpoint": place("db")}, {"timestamp": 8000, "value": "ss", "endpoint": place("db")}], "binaryAnnotations": [{"key": "path", "value": "/x", "endpoint": place("web")}, {"key": "sa", "value": True, "endpoint": place("db")}]}
    local = {"traceId": "a", "id": "c", "parentId": "b", "name": "in", "timestamp": 1000, "duration": 1000, "binaryAnnotations": [{"key": "lc", "value": "", "endpoint": place("web")}, {"key": "error", "value": "x"}]}
    df = lines(spark, json.dumps([shared, local]), "[{", "{}", None, "[]", '[{"traceId":"a","id":"d","localEndpoint":{"serviceName":"v2"}}]', name="body")
    got = X.decode_zipkin(df).collect()
    tags = [{a.key: a.value for a in r.annotations} for r in got]
    assert [r.error for r in got] == [None] * 3 + ["not a span list"] * 3 + [None]
    assert [(r.name, r.start_ms, r.duration_ms) for r in got[:3]] == [("get", 5, 4), ("get", 6, 2), ("in", 1, 1)]
    assert [(t["service"], t.get("span.kind"), t.get("path"), t.get("error")) for t in tags[:3]] == [("web", "client", "/x", None), ("db", "server", None, None), ("web", None, None, "true")]
    assert [[x.fields for x in r.logs or []] for r in got[:3]] == [[], [{"annotation": "cached"}], []] and tags[6]["service"] == "v2"
    assert [r.error for r in X.decode_jaeger(lines(spark, "{", '{"process":{"serviceName":"s"}}', None, name="body")).collect()] == ["not a Jaeger batch"] * 2


def test_identifiers_and_units(spark):
    df = lines(spark, "5b8efff798038103d269b633813fc60c", "1", "ab")
    assert [r[0] for r in df.select(T.uuid_of_hex(F.col("line"))).collect()] == ["5b8efff7-9803-8103-d269-b633813fc60c", "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-0000000000ab"]
    assert [r[0] for r in lines(spark, "hello", "", "∆x", "polygenelubricants").select(T.java_hash(F.col("line"))).collect()] == [99162322, 0, 8710 * 31 + 120, -2147483648]
    assert [r[0] for r in lines(spark, "1700000000", "1700000000123", "1700000000123456", "1700000000123456789").select(T.millis_by_digits(F.col("line"))).collect()] == [1_700_000_000_000] + [1_700_000_000_123] * 3


def test_pickles_import_nothing(spark):
    good = pickle.dumps([("a.b", (1700000000, 1.5)), ("c", (1700000001, 2))], protocol=2)
    evil, long = pickle.dumps(print), b"x" * 200
    payload = b"".join(struct.pack(">I", len(p)) + p for p in (evil, long, good)) + b"\x00\x00"
    rows = list(S.pickled_points(payload, max_size=150))
    assert [r[:3] for r in rows if r[3] is None] == [("a.b", 1700000000, 1.5), ("c", 1700000001, 2.0)]
    assert [r[3].split(":")[0] for r in rows if r[3]] == ["frame can't be read", "frame of 200 bytes is longer than 150", "payload ends within a length"]
    df = spark.createDataFrame([(bytearray(payload),), (None,)], "content binary")
    assert [tuple(r)[:3] for r in S.decode_pickles(df).filter("error IS NULL").orderBy("metric").collect()] == [("a.b", 1_700_000_000_000, 1.5), ("c", 1_700_000_001_000, 2.0)]
    assert S.decode_pickles(df).filter("error IS NOT NULL").count() == 3


def test_bodies(spark):
    assert [r.line for r in S.cloudwatch_lines(lines(spark, '{"someKey":1,"logEvents":[{"a":1},{"b":2}]}', name="body")).collect()] == ['{"a":1}', '{"b":2}']
    assert [r.line for r in S.json_lines(lines(spark, '{"a":1}{"b":2}\n{"c":3}', name="body")).collect()] == ['{"a":1}', '{"b":2}', '{"c":3}']
    tricky = '{"a":"x}{y \\\\"}{"b":"q\\" } {"}  {"c":{"d":1}}'
    assert [r.line for r in S.json_lines(lines(spark, tricky, name="body")).collect()] == ['{"a":"x}{y \\\\"}', '{"b":"q\\" } {"}', '{"c":{"d":1}}']
    deep = '{"a":' * 200 + "1" + "}" * 200
    got = J.decode_nested_json(lines(spark, deep, "[1]", "{", None, name="body")).collect()
    assert [(r.metric, r.value) for r in got if not r.error] == [(".".join("a" * 200), 1.0)] and len([r for r in got if r.error]) == 3


def test_read_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("m 1 source=s\n" + "x" * 100 + "\n")
    assert [r.line for r in S.read_lines(spark, str(tmp_path), max_length=50).collect()] == ["m 1 source=s"]
