"""Frames of log shippers against payloads that a plain encoder writes."""

import json
import random
import struct
import zlib

import pyarrow as pa

from tallyvane.sources import frames

number = lambda n: struct.pack(">I", n)
window = lambda n, v=b"2": v + b"W" + number(n)
message = lambda s, body: b"2J" + number(s) + number(len(body.encode())) + body.encode()
pairs = lambda s, d: b"1D" + number(s) + number(len(d)) + b"".join(number(len(x.encode())) + x.encode() for kv in d.items() for x in kv)


def packed(body):
    inner = zlib.compress(body)
    return b"2C" + number(len(inner)) + inner


def rows(payload, **options):
    return list(frames.messages(payload, **options))


def test_both_versions_and_compressed_frames():
    assert rows(window(2) + message(1, '{"a":"é"}') + message(2, "{}")) == [(0, 0, 2, 1, '{"a":"é"}', None), (1, 0, 2, 2, "{}", None)]
    assert rows(window(1, b"1") + pairs(9, {"line": "x é", "": ""})) == [(0, 0, 1, 9, '{"line": "x é", "": ""}', None)]
    body = window(3) + message(1, "1") + packed(message(2, "2") + packed(packed(message(3, "3")))) + window(1) + message(1, "4")
    assert [r[1:5] for r in rows(body)] == [(0, 3, 1, "1"), (0, 3, 2, "2"), (0, 3, 3, "3"), (1, 1, 1, "4")]
    deep = message(1, "{}")
    for _ in range(3000):
        deep = packed(deep)
    assert rows(deep) == [(0, 0, None, 1, "{}", None)] and rows(b"") == []
    # a window before the batch is full ends it; no message has both
    assert [r[1:3] for r in rows(window(3) + message(1, "1") + window(2) + message(1, "1") + message(2, "2") + message(3, "3"))] == [(0, 3), (1, 2), (1, 2), (2, None)]


def test_what_cannot_be_read():
    good = window(5) + message(1, "1")
    cases = {good + b"2X": "unknown frame type 88", good + message(2, ""): "message without content", good + b"2C" + number(3) + b"abc": "incorrect header", good + packed(b"x" * 5000): "inflate to more than 100"}
    for payload, error in cases.items():
        found = rows(payload, max_inflated=100)
        assert found[0][3:] == (1, "1", None) and len(found) == 2 and error in found[1][5] and found[1][:3] == (1, 0, 5)
    parts = [window(2), message(1, "one"), pairs(2, {"k": "v"}), packed(message(3, "three"))]
    whole = b"".join(parts)
    ends = {sum(map(len, parts[:k])) for k in range(5)}
    for cut in range(len(whole)):
        found = rows(whole[:cut])
        assert cut in ends or found[-1][5] is not None
    rng = random.Random(1)
    for _ in range(2000):  # no bytes raise
        noise = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            noise[rng.randrange(len(noise))] = rng.randrange(256)
        rows(bytes(noise), max_inflated=1000)


def test_payloads_share_blocks(spark):
    """Small payloads are handed on together, and a block still has `rows` messages at most."""
    body = window(3) + b"".join(message(n, "{}") for n in (1, 2, 3))
    rows = [(k, body) for k in range(40)]
    df = frames.decode_frames(spark.createDataFrame(rows, "id int, content binary"))
    given = pa.RecordBatch.from_pydict({"id": [k for k, _ in rows], "content": [x for _, x in rows]})
    for size, blocks in ((4096, [120]), (50, [50, 50, 20])):
        found = list(frames._blocks(iter([given]), "content", df.columns, frames.MAX_INFLATED, size))
        assert [x.num_rows for x in found] == blocks
        assert [(r["id"], r["position"], r["sequence"]) for x in found for r in x.to_pylist()] == [(k, n, n + 1) for k in range(40) for n in range(3)]
    assert df.count() == 120


def test_resent_batches_go(spark):
    body = lambda t, **more: json.dumps({"@timestamp": t, **more})
    log = lambda n: {"log": {"file": {"path": "/x"}, "offset": n}}
    first = window(2) + message(1, body("t1")) + message(2, body("t2")) + window(1) + message(1, body("t3", **log(5)))
    sent = [
        ("a", 1, first), ("a", 2, first), ("b", 3, first), ("a", 4, window(1) + message(1, body("t3", **log(6)))), ("a", 5, window(1) + message(1, body("t3", **log(5)))), ("a", 6, window(2) + message(1, body("t1"))),
        ("a", 7, window(1) + message(1, "{}")), ("a", 8, window(1) + message(1, "{}")), (None, 9, first), (None, 10, first), ("a", 11, None), ("a", 12, first + b"2X"),
    ]
    found = frames.decode_frames(spark.createDataFrame(sent, "host string, id int, content binary").repartition(3), rows=2)
    assert found.count() == 3 * 6 + 1 + 1 + 1 + 2 + 1
    left = frames.drop_resent_batches(found, ["id"], ["host"]).orderBy("id", "position").collect()
    assert [(r.id, r.batch, r.sequence) for r in left] == [(1, 0, 1), (1, 0, 2), (1, 1, 1), (3, 0, 1), (3, 0, 2), (3, 1, 1), (4, 0, 1), (6, 0, 1), (7, 0, 1), (8, 0, 1), (9, 0, 1), (9, 0, 2), (9, 1, 1), (12, 2, None)]
    assert frames.drop_resent_batches(found.limit(0), ["id"], ["host"]).collect() == []
