"""The ingest path over a stream of files, and the same path over a batch."""

import json

from tallyvane.sources.wire import stream_lines
from tallyvane.streaming import ingest

RULES = [
    {"rule": "no stop", "action": "block", "scope": "pointLine", "match": ".*stop.*"},
    {"rule": "clean", "action": "replaceRegex", "scope": "pointLine", "search": "&", "replace": "_"},
    {"rule": "env", "action": "addTag", "tag": "env", "value": "prod"},
    {"rule": "no dev", "action": "block", "scope": "sourceName", "match": "dev.*"},
]
LINES = ["a&b 1 1700000000 source=h k=v", "stop.it 1 source=h", "c 2 1700000000 source=dev1", "broken", "@Event 1 e", "d x source=h", "bad!name 1 1700000000 source=h"]
WANT = {"stop.it 1 source=h": "no stop", "c 2 1700000000 source=dev1": "no dev", "broken": "not a point line", "d x source=h": "value is not a number", "bad!name 1 1700000000 source=h": "WF-400: illegal character in metric"}


def test_batch(spark):
    rows = ingest.points_of_lines(spark.createDataFrame([(x,) for x in LINES], "line string"), RULES).collect()
    assert {r.line: r.reason for r in rows if r.status == "rejected"} == WANT
    good = [r for r in rows if r.status == "accepted"]
    assert [(r.name, r.source, r.value, r.tags) for r in good] == [("a_b", "h", 1.0, {"k": "v", "env": "prod"})]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(LINES))
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"2878": RULES}))
    paths = [str(tmp_path / x) for x in ("out", "dead", "cp")]
    for more in (None, "e 5 1700000000 source=h2"):
        if more:
            (tmp_path / "in" / "2.txt").write_text(more)
        ingest.start_ingest(stream_lines(spark, str(tmp_path / "in")), str(rules), "2878", *paths, once=True).awaitTermination(60)
    assert sorted(r.name for r in spark.read.parquet(f"{paths[0]}/POINT").collect()) == ["a_b", "e"]
    assert [r.name for r in spark.read.parquet(f"{paths[0]}/EVENT").collect()] == ["e"]
    assert {r.line: r.reason for r in spark.read.parquet(paths[1]).collect()} == WANT


SPAN = '"op" source="s" spanId=00000000-0000-0000-0000-000000000001 traceId=00000000-0000-0000-0000-000000000002 k=v 1700000000000 1700000000050'
SPAN_RULES = [*RULES, {"rule": "no stop", "action": "spanBlock", "scope": "spanName", "match": "stop.*"}, {"rule": "env", "action": "spanAddTag", "key": "env", "value": "prod"}, {"rule": "no secrets", "action": "logBlock", "scope": "message", "match": ".*secret.*"}]


def test_every_format(spark):
    log = lambda span: json.dumps({"spanId": "1", "traceId": "2", "logs": [{"timestamp": 1, "fields": {"a": "b"}}], "span": span})
    lines = [
        ("!M 1700000000 #5 10.0 m.h source=s", None), ("!M 1700000000 #5", None), (SPAN, "SPAN"), (SPAN.replace("op", "stop it"), "SPAN"), (SPAN.replace("k=v", '"bad key"=v'), "SPAN"), (log(SPAN), None), (log(SPAN.replace("op", "stop it")), None), ("{}", None),
        ("@Event 1700000000 e host=h sev=x", None), ('@Event 1700000000 e "bad key"=x', None), ("@SourceTag action=add source=s t1", None), ("@SourceTag action=add source=s t1!", None), ("@SourceTag", None), ("m 1 1700000000 source=h", None),
        ('[{"message":"hello","source":"s","timestamp":1700000000,"env":"x"},{"message":"a secret","source":"s"},{"source":"s"}]', None), ('{"message":"one"}\n{"message":"two"}', "LOGS_JSON_LINES"), ('{"logEvents":[{"message":"three"}]}', "LOGS_JSON_CLOUDWATCH"), ("broken", "LOGS_JSON_ARR"),
    ]
    some = ingest.dispatched(spark.createDataFrame(lines, "line string, format string"))
    got = {e: ingest.rows_of_entity(some, SPAN_RULES, e).collect() for e in ingest.COLUMNS}
    good = {e: [r for r in rows if r.status == "accepted"] for e, rows in got.items()}
    assert [(r.name, r.bin_start_ms, r.tags) for r in good["HISTOGRAM"]] == [("m.h", 1_699_999_980_000, {"env": "prod"})]
    assert [(r.name, r.duration_ms, [tuple(a) for a in r.tags]) for r in good["SPAN"]] == [("op", 50, [("k", "v"), ("env", "prod")])]
    assert [(r.span_id, r.span) for r in good["SPAN_LOG"]] == [("1", "_sampledByPolicy=NONE")]
    assert [(r.name, r.hosts, r.annotations) for r in good["EVENT"]] == [("e", ["h"], {"sev": "x"})]
    assert [(r.source, r["values"]) for r in good["SOURCE_TAG"]] == [("s", ["t1"])]
    assert sorted((r.name, r.source, [tuple(a) for a in r.tags]) for r in good["LOG"]) == [("hello", "s", [("env", "x")]), ("one", "unknown", []), ("three", "unknown", []), ("two", "unknown", [])]
    assert sorted((e, r.reason) for e, rows in got.items() for r in rows if r.status == "rejected") == [
        ("EVENT", "WF-401: illegal character in key"), ("HISTOGRAM", "not a histogram line"), ("LOG", "message is empty"), ("LOG", "no list of logs"), ("LOG", "no secrets"), ("SOURCE_TAG", "WF-401: illegal character in key"),
        ("SOURCE_TAG", "not a source tag line"), ("SPAN", "illegal character in annotation key"), ("SPAN", "no stop"), ("SPAN_LOG", "no stop"), ("SPAN_LOG", "not a span log"),
    ]
