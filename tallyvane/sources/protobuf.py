"""Binary protobuf bodies (S13; series of S16, span lists of S15) as the structs that their JSON form is read to.

Messages are read field by field in numpy, all messages of a kind in an Arrow batch at once: a round reads the next field of every
message that has one left. Varints end at the next byte below 128, found for all bytes beforehand; what a field holds is kept as offsets
into the batch's bytes, and messages within messages are read from those, level by level. Columns follow a schema of field numbers.

Fields of other numbers, or whose wire type does not fit, are skipped, as the format has it; of a field that may stand once the last
counts, repeated numbers may be packed or not. A body that ends within a field, or has a tag, length or text that can't be, is null
with an error. Absent fields are null, as in JSON; numbers of 64 bits are texts where the JSON form has texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from ..operators import json_metrics, otlp, traces

VARINT, WIDE, LONG, SHORT = 0, 1, 2, 5
#: Wire types by kind of value.
WIRE = {"bool": VARINT, "int": VARINT, "uint": VARINT, "sint": VARINT, "enum": VARINT, "fixed64": WIDE, "sfixed64": WIDE, "double": WIDE, "string": LONG, "hex": LONG, "base64": LONG, "ipv4": LONG}
Spec = dict[str, tuple]

# Field numbers and kinds of the public message definitions.
_ANY: Spec = {"stringValue": (1, "string"), "boolValue": (2, "bool"), "intValue": (3, "int"), "doubleValue": (4, "double"), "arrayValue": (5, {}), "kvlistValue": (6, "base64"), "bytesValue": (7, "base64")}
_ANY["arrayValue"] = (5, {"values": (1, {k: _ANY[k] for k in ("stringValue", "boolValue", "intValue", "doubleValue")})})
_ATTRIBUTE: Spec = {"key": (1, "string"), "value": (2, _ANY)}
_RESOURCE: Spec = {"attributes": (1, _ATTRIBUTE)}
_SCOPE: Spec = {"name": (1, "string"), "version": (2, "string")}
_NUMBER: Spec = {"attributes": (7, _ATTRIBUTE), "timeUnixNano": (3, "fixed64"), "asDouble": (4, "double"), "asInt": (6, "sfixed64")}
_HISTOGRAM: Spec = {"attributes": (9, _ATTRIBUTE), "timeUnixNano": (3, "fixed64"), "bucketCounts": (6, "fixed64"), "explicitBounds": (7, "double")}
_BUCKETS: Spec = {"offset": (1, "sint"), "bucketCounts": (2, "uint")}
_EXPONENTIAL: Spec = {"attributes": (1, _ATTRIBUTE), "timeUnixNano": (3, "fixed64"), "scale": (6, "sint"), "zeroCount": (7, "fixed64"), "positive": (8, _BUCKETS), "negative": (9, _BUCKETS)}
_SUMMARY: Spec = {"attributes": (7, _ATTRIBUTE), "timeUnixNano": (3, "fixed64"), "count": (4, "fixed64"), "sum": (5, "double"), "quantileValues": (6, {"quantile": (1, "double"), "value": (2, "double")})}
_METRIC: Spec = {
    "name": (1, "string"), "gauge": (5, {"dataPoints": (1, _NUMBER)}), "sum": (7, {"aggregationTemporality": (2, "enum"), "dataPoints": (1, _NUMBER)}), "histogram": (9, {"aggregationTemporality": (2, "enum"), "dataPoints": (1, _HISTOGRAM)}),
    "exponentialHistogram": (10, {"aggregationTemporality": (2, "enum"), "dataPoints": (1, _EXPONENTIAL)}), "summary": (11, {"dataPoints": (1, _SUMMARY)}),
}
METRICS: Spec = {"resourceMetrics": (1, {"resource": (1, _RESOURCE), "scopeMetrics": (2, {"scope": (1, _SCOPE), "metrics": (2, _METRIC)})})}
_SPAN: Spec = {
    "traceId": (1, "hex"), "spanId": (2, "hex"), "traceState": (3, "string"), "parentSpanId": (4, "hex"), "name": (5, "string"), "kind": (6, "enum"), "startTimeUnixNano": (7, "fixed64"), "endTimeUnixNano": (8, "fixed64"), "attributes": (9, _ATTRIBUTE),
    "droppedAttributesCount": (10, "uint"), "events": (11, {"timeUnixNano": (1, "fixed64"), "name": (2, "string"), "attributes": (3, _ATTRIBUTE)}), "droppedEventsCount": (12, "uint"), "droppedLinksCount": (14, "uint"), "status": (15, {"message": (2, "string"), "code": (3, "enum")}),
}
TRACES: Spec = {"resourceSpans": (1, {"resource": (1, _RESOURCE), "scopeSpans": (2, {"scope": (1, _SCOPE), "spans": (2, _SPAN)})})}
SERIES: Spec = {
    "series": (1, {"metric": (2, "string"), "type": (5, "enum"), "interval": (8, "int"), "tags": (3, "string"), "resources": (1, {"type": (1, "string"), "name": (2, "string")}), "points": (4, {"timestamp": (2, "int"), "value": (1, "double")})}),
}
#: Zipkin's list is its one field; kinds are numbers there and names in JSON.
SPAN_LIST: Spec = {
    "spans": (1, {
        "traceId": (1, "hex"), "parentId": (2, "hex"), "id": (3, "hex"), "kind": (4, "enum"), "name": (5, "string"), "timestamp": (6, "fixed64"), "duration": (7, "uint"), "localEndpoint": (8, {"serviceName": (1, "string"), "ipv4": (2, "ipv4")}),
        "annotations": (10, {"timestamp": (1, "fixed64"), "value": (2, "string")}), "tags": (11, {"key": (1, "string"), "value": (2, "string")}), "debug": (12, "bool"), "shared": (13, "bool"),
    }),
}


class Batch:
    """Bytes of all bodies of a batch. bad: the error of each body, where it has one."""

    def __init__(self, bodies: list[bytes]):
        self.ends = np.cumsum([0, *map(len, bodies)])
        self.raw = np.frombuffer(b"".join(bodies) + b"\0" * 16, np.uint8)
        stops = np.where(self.raw < 128, np.arange(len(self.raw)), len(self.raw))
        self.stop = np.minimum.accumulate(stops[::-1])[::-1]  # the last byte of a varint that begins here
        self.bad: list[str | None] = [None] * len(bodies)

    def fail(self, bodies: np.ndarray, why: str) -> None:
        for k in np.unique(bodies).tolist():
            self.bad[k] = self.bad[k] or why

    def varints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places after them); only of the first ten bytes each."""
        last = self.stop[at]
        value = np.zeros(len(at), np.uint64)
        for k in range(int(min(10, (last - at).max(initial=-1) + 1))):
            more = at + k <= last
            value |= np.where(more, self.raw[np.minimum(at + k, len(self.raw) - 1)] & 127, 0).astype(np.uint64) << np.uint64(7 * k)
        return value, last + 1

    def wide(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at[:, None] + np.arange(8)].copy().view("<u8").ravel() if len(at) else np.zeros(0, np.uint64)

    def fields(self, start: np.ndarray, end: np.ndarray, body: np.ndarray) -> dict[str, np.ndarray]:
        """All fields of messages, by message and then as they stand: their numbers, wire types, values and, if long, bounds."""
        found: list[tuple[np.ndarray, ...]] = []
        at, live = start.copy(), np.flatnonzero(start < end)
        while len(live):
            tag, place = self.varints(at[live])
            number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
            # values: a varint, eight or four bytes, or a length with so many bytes after it
            value, after = self.varints(np.minimum(place, len(self.raw) - 1))
            held = np.where(wire == LONG, after, place)
            size = np.minimum(value, np.uint64(1 << 40)).astype(np.int64)
            to = np.select([wire == VARINT, wire == WIDE, wire == SHORT, wire == LONG], [after, place + 8, place + 4, after + size], -1)
            slow = (place - at[live] > 10) | (np.isin(wire, (VARINT, LONG)) & (after - place > 10))
            wrong = (to < 0) | (number == 0) | slow
            cut = ~wrong & (to > end[live])
            self.fail(body[live[wrong]], "a tag that can't be")
            self.fail(body[live[cut]], "it ends within a field")
            good = ~wrong & ~cut
            live = live[good]
            found.append((live, number[good], wire[good], value[good], held[good], to[good]))
            at[live] = to[good]
            live = live[at[live] < end[live]]
        names = ("message", "number", "wire", "value", "start", "end")
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64 if n == "value" else np.int64) for n in names]
        order = np.argsort(columns[0], kind="stable")
        return {n: c[order] for n, c in zip(names, columns)}

    def texts(self, start: np.ndarray, end: np.ndarray, body: np.ndarray, kind: str) -> pa.Array:
        size = end - start
        offsets = np.concatenate(([0], np.cumsum(size)))
        taken = self.raw[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)]
        plain = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())])
        if kind == "string":
            try:
                return plain.cast(pa.string())
            except pa.ArrowInvalid:
                pieces = plain.to_pylist()
                wrong = [k for k, x in enumerate(pieces) if not _is_text(x)]
                self.fail(body[wrong], "a text that is not UTF-8")
                return pa.array([x.decode("utf-8", "replace") for x in pieces], pa.string())
        turn = {"hex": bytes.hex, "base64": lambda x: base64.b64encode(x).decode(), "ipv4": lambda x: ".".join(map(str, x)) if len(x) == 4 else None}[kind]
        return pa.array([turn(x) for x in plain.to_pylist()], pa.string())

    def values(self, kind: str, dtype: S.DataType, value: np.ndarray, start: np.ndarray, end: np.ndarray, body: np.ndarray) -> pa.Array:
        """Values of one kind. value: varints; start: of the other kinds, their places."""
        if WIRE[kind] == LONG:
            return self.texts(start, end, body, kind)
        if WIRE[kind] == WIDE:
            value = self.wide(start)
        if kind == "double":
            out = pa.array(value.view(np.float64))
        elif kind == "bool":
            out = pa.array(value != 0)
        elif kind in ("uint", "fixed64"):
            out = pa.array(value)
        else:
            signed = value.view(np.int64)
            if kind == "sint":
                signed = (value >> np.uint64(1)).view(np.int64) ^ -(value & np.uint64(1)).view(np.int64)
            out = pa.array(signed)
        arrow = _arrow(dtype)
        if pa.types.is_integer(arrow):  # as a program would take them: the low bits
            out = pa.array(value.astype(np.int64) if kind in ("uint", "fixed64") else signed)
            return pa.array(out.to_numpy().astype(arrow.to_pandas_dtype()))
        return out.cast(arrow)

    def messages(self, spec: Spec, kind: S.StructType, start: np.ndarray, end: np.ndarray, body: np.ndarray) -> pa.StructArray:
        """Messages as structs of the kind; fields that the spec does not have are null."""
        f = self.fields(start, end, body)
        columns = []
        for field in kind.fields:
            if field.name not in spec:
                columns.append(pa.nulls(len(start), _arrow(field.dataType)))
                continue
            number, what = spec[field.name]
            wire = LONG if isinstance(what, dict) else WIRE[what]
            repeated = isinstance(field.dataType, (S.ArrayType, S.MapType))
            packed = (f["wire"] == LONG) if repeated and wire != LONG else np.zeros(len(f["wire"]), bool)
            own = np.flatnonzero((f["number"] == number) & ((f["wire"] == wire) | packed))
            columns.append(self.repeated(f, own, what, field.dataType, len(start), body) if repeated else self.single(f, own, what, field.dataType, len(start), body))
        return pa.StructArray.from_arrays(columns, fields=[pa.field(x.name, c.type) for x, c in zip(kind.fields, columns)])

    def single(self, f: dict, own: np.ndarray, what: object, dtype: S.DataType, n: int, body: np.ndarray) -> pa.Array:
        message = f["message"][own]
        last = own[np.append(message[1:] != message[:-1], True)] if len(own) else own
        message = f["message"][last]
        held = self._held(f, last, what, dtype, body)
        at = np.full(n, -1)
        at[message] = np.arange(len(last))
        return held.take(pa.array(at, mask=at < 0))

    def _held(self, f: dict, rows: np.ndarray, what: object, dtype: S.DataType, body: np.ndarray) -> pa.Array:
        of = body[f["message"][rows]]
        if isinstance(what, dict):
            return self.messages(what, dtype, f["start"][rows], f["end"][rows], of)
        return self.values(what, dtype, f["value"][rows], f["start"][rows], f["end"][rows], of)

    def repeated(self, f: dict, own: np.ndarray, what: object, dtype: S.DataType, n: int, body: np.ndarray) -> pa.Array:
        message = f["message"][own]
        if isinstance(dtype, S.MapType):
            pairs = self.messages(what, S.StructType([S.StructField("key", dtype.keyType), S.StructField("value", dtype.valueType)]), f["start"][own], f["end"][own], body[message])
            # of a key given twice the last counts; absent keys and values are empty texts
            keys, values = (pc.fill_null(pairs.field(k), "") for k in (0, 1))
            seen = {(m, k): i for i, (m, k) in enumerate(zip(message.tolist(), keys.to_pylist()))}
            stay = np.array(sorted(seen.values()), np.int64)
            counts = np.bincount(message[stay], minlength=n) if len(stay) else np.zeros(n, np.int64)
            out = pa.MapArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), keys.take(pa.array(stay)), values.take(pa.array(stay)))
            return out if counts.all() else pc.if_else(pa.array(counts > 0), out, pa.nulls(n, out.type))
        assert isinstance(dtype, S.ArrayType)
        if isinstance(what, dict) or WIRE[what] == LONG:
            held, counts = self._held(f, own, what, dtype.elementType, body), np.bincount(message, minlength=n)
        else:
            # each stretch of packed numbers, or a number by itself
            long = f["wire"][own] == LONG
            start = np.where(long, f["start"][own], 0)
            size = np.where(long, f["end"][own] - start, 0)
            if WIRE[what] == WIDE:
                self.fail(body[message[long & (size % 8 > 0)]], "packed numbers that end early")
                many = np.where(long, size // 8, 1)
                of = np.repeat(np.arange(len(own)), many)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                at = f["start"][own][of] + 8 * nth
                value = np.zeros(len(of), np.uint64)
            else:
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
                of_byte = np.repeat(np.arange(len(own)), size)
                ends = self.raw[inside] < 128
                last = np.where(size > 0, start + size - 1, 0)
                self.fail(body[message[long & (size > 0) & (self.raw[last] >= 128)]], "packed numbers that end early")
                begin = np.ones(len(inside), bool)
                begin[1:] = ends[:-1] | (of_byte[1:] != of_byte[:-1])
                packed_of, packed_at = of_byte[begin], inside[begin]
                of = np.concatenate((packed_of, np.flatnonzero(~long)))
                value = np.concatenate((self.varints(packed_at)[0], f["value"][own][~long]))
                order = np.argsort(of, kind="stable")
                of, value, at = of[order], value[order], np.zeros(len(order), np.int64)
            held = self.values(what, dtype.elementType, value, at, at, body[message[of]])
            counts = np.bincount(message[of], minlength=n)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        none = np.bincount(message, minlength=n) == 0
        lists = pa.ListArray.from_arrays(offsets, held)
        return pa.ListArray.from_arrays(offsets, held, mask=pa.array(none)) if none.any() and len(lists) else lists


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _arrow(dtype: S.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)


def read(bodies: DataFrame, spec: Spec, kind: str, body: str = "body") -> DataFrame:
    """bodies with the binary body as a struct (message, error): message is a struct of the kind, null where there is an error or no body."""
    schema = S._parse_datatype_string(kind)
    assert isinstance(schema, S.StructType)
    out = S.StructType([S.StructField("message", schema), S.StructField("error", S.StringType())])
    whole = S.StructType([S.StructField(f.name, out if f.name == body else f.dataType) for f in bodies.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            given = rows.column(body).to_pylist()
            batch = Batch([x or b"" for x in given])
            messages = batch.messages(spec, schema, batch.ends[:-1].copy(), batch.ends[1:], np.arange(len(given)))
            bad = [x if g is not None else "no body" for x, g in zip(batch.bad, given)]
            messages = messages.take(pa.array([k if b is None else None for k, b in enumerate(bad)], pa.int64()))
            held = pa.StructArray.from_arrays([messages, pa.array(bad, pa.string())], ["message", "error"])
            yield pa.RecordBatch.from_arrays([held if n == body else rows.column(n) for n in rows.schema.names], names=rows.schema.names)

    return bodies.mapInArrow(run, whole)


def otlp_metrics(bodies: DataFrame, body: str = "body") -> DataFrame:
    """For operators.otlp.decode_metrics."""
    return read(bodies, METRICS, otlp.METRICS, body)


def otlp_traces(bodies: DataFrame, body: str = "body") -> DataFrame:
    """For operators.otlp.decode_spans."""
    return read(bodies, TRACES, otlp.TRACES, body)


def datadog_series(bodies: DataFrame, body: str = "body") -> DataFrame:
    """For operators.json_metrics.decode_datadog_series, version 2."""
    return read(bodies, SERIES, f"struct<{json_metrics.SERIES_V2}>", body)


def zipkin_spans(bodies: DataFrame, body: str = "body") -> DataFrame:
    """For operators.traces.decode_zipkin."""
    kind = traces.ZIPKIN.removeprefix("array<").removesuffix(">").replace("kind:string", "kind:int")
    return read(bodies, SPAN_LIST, f"struct<spans:array<{kind}>>", body)
