"""The protobuf reader against bodies that a plain encoder writes."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import json_metrics, otlp, traces
from tallyvane.sources import protobuf as P


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def encode(spec, message, packed=True, extra=b""):
    """A dict (as JSON would have it) as a message; extra: fields of unknown numbers put between the others."""
    out = extra
    for name, value in message.items():
        number, kind = spec[name]
        if isinstance(value, dict) and isinstance(kind, dict) and set(kind) == {"key", "value"} and kind["key"][1] == "string" and kind["value"][1] == "string":
            value = [{"key": k, "value": v} for k, v in value.items()]
        values = value if isinstance(value, list) else [value]
        tag = lambda wire: varint(number << 3 | wire)
        if isinstance(kind, dict):
            parts = [encode(kind, v, packed, extra) for v in values]
            out += b"".join(tag(2) + varint(len(p)) + p for p in parts) + extra
            continue
        one = {
            "double": lambda v: struct.pack("<d", v), "fixed64": lambda v: struct.pack("<Q", int(v)), "sfixed64": lambda v: struct.pack("<q", int(v)), "bool": lambda v: varint(int(v)), "int": lambda v: varint(int(v)), "uint": lambda v: varint(int(v)),
            "enum": lambda v: varint(int(v)), "sint": lambda v: varint(int(v) << 1 ^ int(v) >> 63), "string": lambda v: v.encode(), "hex": bytes.fromhex, "ipv4": lambda v: bytes(map(int, v.split("."))),
        }[kind]
        wire = P.WIRE[kind]
        if wire == 2:
            out += b"".join(tag(2) + varint(len(one(v))) + one(v) for v in values)
        elif isinstance(value, list) and packed:
            body = b"".join(one(v) for v in values)
            out += tag(2) + varint(len(body)) + body
        else:
            out += b"".join(tag(wire) + one(v) for v in values)
    return out


UNKNOWN = varint(99 << 3) + varint(1 << 40) + varint(100 << 3 | 2) + varint(3) + b"abc" + varint(101 << 3 | 1) + bytes(8) + varint(102 << 3 | 5) + bytes(4)


def metrics(rng):
    attributes = lambda: [{"key": rng.choice("abc"), "value": rng.choice([{"stringValue": "é" * rng.randint(0, 3)}, {"boolValue": True}, {"intValue": str(-rng.randint(0, 9))}, {"doubleValue": 0.5}, {"arrayValue": {"values": [{"stringValue": "x"}, {"intValue": "5"}]}}])} for _ in range(rng.randint(0, 3))]
    nanos = lambda: str(rng.randint(1, 1 << 62))
    point = lambda **kw: {"attributes": attributes(), "timeUnixNano": nanos(), **kw}
    some = lambda make: [make() for _ in range(rng.randint(0, 4))]
    kinds = [
        lambda: {"gauge": {"dataPoints": some(lambda: point(asDouble=rng.random()))}},
        lambda: {"sum": {"aggregationTemporality": rng.randint(1, 2), "dataPoints": some(lambda: point(asInt=str(rng.randint(-9, 1 << 40))))}},
        lambda: {"histogram": {"aggregationTemporality": rng.randint(1, 2), "dataPoints": some(lambda: point(bucketCounts=[str(rng.randint(0, 300)) for _ in range(3)], explicitBounds=[1.0, 2.5]))}},
        lambda: {"exponentialHistogram": {"aggregationTemporality": rng.randint(1, 2), "dataPoints": some(lambda: point(scale=rng.randint(-3, 3), zeroCount="5", positive={"offset": rng.randint(-9, 9), "bucketCounts": [str(rng.randint(0, 1000)) for _ in range(3)]}, negative={"offset": 1, "bucketCounts": ["7"]}))}},
        lambda: {"summary": {"dataPoints": some(lambda: point(count="3", sum=1.5, quantileValues=[{"quantile": 0.5, "value": rng.random()}]))}},
    ]
    one = lambda: {"name": f"m{rng.randint(0, 9)}", **rng.choice(kinds)()}
    return {"resourceMetrics": some(lambda: {"resource": {"attributes": attributes()}, "scopeMetrics": some(lambda: {"scope": {"name": "s"}, "metrics": some(one)})})}


def spans(rng):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    one = lambda: {"traceId": hexes(32), "spanId": hexes(16), "parentSpanId": hexes(16), "name": "op", "kind": rng.randint(0, 5), "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000500000000", "attributes": [{"key": "k", "value": {"stringValue": "v"}}], "droppedEventsCount": rng.randint(0, 2), "events": [{"timeUnixNano": "1700000000000000000", "name": "e"}] * rng.randint(0, 2), "status": {"code": rng.randint(0, 2), "message": "why"}}
    return {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": [one() for _ in range(rng.randint(0, 3))]}]}]}


def rows(df):
    return sorted((repr(r.asDict(recursive=True)) for r in df.drop("body").collect()))


@pytest.mark.parametrize("packed,extra", [(True, b""), (False, UNKNOWN)])
def test_otlp_rows_are_those_of_json(spark, packed, extra):
    rng = random.Random(3)
    made = [metrics(rng) for _ in range(40)] + [{}]
    text = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(made)], "id int, body string")
    binary = P.otlp_metrics(spark.createDataFrame([(k, bytearray(encode(P.METRICS, m, packed, extra))) for k, m in enumerate(made)], "id int, body binary"))
    for decode in (otlp.numbers, otlp.summaries, otlp.histogram_points, otlp.histogram_bins):
        assert rows(decode(otlp.decode_metrics(binary))) == rows(decode(otlp.decode_metrics(text)))
    made = [spans(rng) for _ in range(20)]
    text = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(made)], "id int, body string")
    binary = P.otlp_traces(spark.createDataFrame([(k, bytearray(encode(P.TRACES, m, packed, extra))) for k, m in enumerate(made)], "id int, body binary"))
    assert rows(otlp.decode_spans(binary)) == rows(otlp.decode_spans(text))


def test_series_and_span_lists_are_those_of_json(spark):
    series = {"series": [{"metric": "a.b", "type": 2, "interval": 10, "tags": ["x:1", "y:2"], "resources": [{"type": "host", "name": "H1"}], "points": [{"timestamp": 1700000000, "value": 2.5}, {"timestamp": 1700000001, "value": 1.0}]}]}
    text = spark.createDataFrame([(json.dumps(series),)], "body string")
    binary = P.datadog_series(spark.createDataFrame([(bytearray(encode(P.SERIES, series)),), (bytearray(b"\x0a\x05ab"),)], "body binary"))
    got = json_metrics.decode_datadog_series(binary, version=2)
    assert rows(got.filter("error IS NULL")) == rows(json_metrics.decode_datadog_series(text, version=2)) and got.filter("error = 'it ends within a field'").count() == 1
    span = {"traceId": "0" * 16 + "1234567890abcdef", "id": "00000000000000ff", "kind": 2, "name": "get", "timestamp": 1700000000000000, "duration": 2000, "localEndpoint": {"serviceName": "svc", "ipv4": "10.0.0.1"}, "tags": {"error": "x", "k": "v"}, "annotations": [{"timestamp": 1700000000000001, "value": "note"}], "debug": True}
    text = spark.createDataFrame([(json.dumps([span | {"kind": "SERVER"}]),)], "body string")
    binary = P.zipkin_spans(spark.createDataFrame([(bytearray(encode(P.SPAN_LIST, {"spans": [span]})),), (None,)], "body binary"))
    got = traces.decode_zipkin(binary)
    assert rows(got.filter("error IS NULL")) == rows(traces.decode_zipkin(text)) and got.filter("error IS NOT NULL").count() == 1


def test_broken_bodies_are_errors(spark):
    rng = random.Random(5)
    whole = encode(P.METRICS, metrics(rng) | {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "abc", "gauge": {"dataPoints": [{"asDouble": 1.0, "timeUnixNano": "5"}]}}]}]}]})
    cut = [whole[:k] for k in range(1, len(whole))]
    bad = [b"\x0f", b"\x07", b"\x00\x01", b"\xff" * 12, b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01", b"\x08" + b"\xff" * 11, encode({"resourceMetrics": (1, {"scopeMetrics": (2, {"metrics": (2, {"name": (1, "hex")})})})}, {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "ff80"}]}]}]})]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate([whole, *cut, *bad])] + [(999, None)], "id int, body binary")
    got = {r.id: r for r in otlp.numbers(otlp.decode_metrics(P.otlp_metrics(df))).collect()}
    assert got[0].error is None and got[0].value == 1.0 and len(got) == 2 + len(cut) + len(bad)
    assert all(r.error and r.value is None for k, r in got.items() if k)
    noise = spark.createDataFrame([(k, bytearray(rng.randbytes(rng.randint(0, 60)))) for k in range(2000)], "id int, body binary")
    assert otlp.decode_spans(P.otlp_traces(noise)).count() >= 0


def test_long_messages(spark):
    point = {"asDouble": 2.0, "timeUnixNano": "5"}
    body = encode(P.METRICS, {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [point] * 3000}}]}]}]})
    df = spark.createDataFrame([(bytearray(body),)] * 3, "body binary")
    assert otlp.numbers(otlp.decode_metrics(P.otlp_metrics(df))).agg(F.sum("value")).first()[0] == 18000.0


def test_bodies_of_queries_hold_each_part_once(spark):
    """a part within parts is not written again for each place its length is needed in."""
    from tallyvane.plans.decode_queries import _eight, _held, _plain

    col, want = F.concat(_held(3, F.col("t")), _plain(77, F.col("n")), _eight(6, F.col("n"))), lambda t, n: b"\x1a" + varint(len(t)) + t + varint(77 << 3) + varint(n) + b"\x31" + struct.pack("<q", n)
    for _ in range(12):
        col, want = _held(20, col), lambda t, n, w=want: varint(20 << 3 | 2) + varint(len(w(t, n))) + w(t, n)
    rows = [(bytearray(b"x" * size), n) for size, n in ((0, 0), (5, 127), (100, 128), (127, 16383), (128, 16384), (20000, (1 << 35) - 1))]
    got = spark.createDataFrame(rows, "t binary, n long").select("t", "n", col.alias("body")).collect()
    assert [bytes(r.body) for r in got] == [want(bytes(t), n) for t, n in rows]
