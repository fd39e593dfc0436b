"""Rules, sampling, digests, logs to metrics and streaming forms."""

import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyvane.functions import digest as D
from tallyvane.functions import tags as T
from tallyvane.operators import aggregate as A
from tallyvane.operators import conditions
from tallyvane.operators import enrich as E
from tallyvane.operators import logs as L
from tallyvane.operators import ordering as K
from tallyvane.operators import rules as R
from tallyvane.operators import sample as P
from tallyvane.sinks import delivery as S
from tallyvane.streaming import state as Z

BAD_RULES = [
    {}, {"action": "dropTag", "tag": "x"}, {"rule": "", "action": "dropTag", "tag": "x"}, {"rule": "$%^", "action": "dropTag", "tag": "x"}, {"rule": "r", "tag": "x"},
    {"rule": "r", "action": "nonexistent"}, {"rule": "r", "action": "DropTag", "tag": "x"}, {"rule": "r", "action": "dropTag", "tag": "x", "invalid": 1}, {"rule": "r", "action": "dropTag", "scope": "pointLine", "tag": "x"},
    {"rule": "r", "action": "addTag", "tag": "x"}, {"rule": "r", "action": "replaceRegex", "scope": "metricName", "search": "["}, {"rule": "r", "action": "replaceRegex", "scope": "metricName", "search": "(", "replace": ""},
    {"rule": "r", "action": "allow"}, {"rule": "r", "action": "block", "scope": "metricName"}, {"rule": "r", "action": "limitLength", "scope": "metricName", "actionSubtype": "drop", "maxLength": 5},
    {"rule": "r", "action": "limitLength", "scope": "metricName", "actionSubtype": "truncateWithEllipsis", "maxLength": 2}, {"rule": "r", "action": "limitLength", "scope": "metricName", "actionSubtype": "x", "maxLength": 9},
    {"rule": "r", "action": "metricsFilter", "function": "keep", "names": ["a"]}, {"rule": "r", "action": "spanMetricsFilter", "function": "allow", "names": ["a"]}, {"rule": "r", "action": "allow", "if": {"some": []}},
    {"rule": "r", "action": "allow", "if": {"equals": {"scope": "x"}}},
]


@pytest.mark.parametrize("rule", BAD_RULES, ids=str)
def test_bad_rules(rule):
    with pytest.raises(R.RuleError):
        R.parse(rule)


def record(spark, name="some.metric", source="host", tags=None, value=1.0):
    return spark.createDataFrame([(name, source, tags or {}, value)], "name string, source string, tags map<string,string>, value double")


def test_rule_order_and_rejects(spark):
    rules = [
        {"rule": "a", "action": "replaceRegex", "scope": "metricName", "search": "a", "replace": "aa", "iterations": 2}, {"rule": "b", "action": "block", "scope": "metricName", "match": "baad"},
        {"rule": "c", "action": "addTag", "tag": "late", "value": "1"},
    ]
    r = R.apply_rules(record(spark, "bad"), rules).first()
    assert (r.name, r.status, r.tags) == ("baaaad", None, {"late": "1"})
    r = R.apply_rules(record(spark, "bad"), rules[1:] + [{"rule": "d", "action": "block", "scope": "metricName", "match": "bad"}, {"rule": "e", "action": "addTag", "tag": "x", "value": "1"}]).first()
    assert (r.status, r.reason, r.tags) == ("rejected", "d", {"late": "1"})
    assert R.apply_rules(record(spark), [{"rule": "r", "action": "allow", "scope": "missing", "match": ".*"}]).first().status == "rejected"
    assert R.apply_rules(record(spark), [{"rule": "r", "action": "block", "scope": "missing", "match": ".*"}]).first().status is None


def test_span_rules_keep_repeated_keys(spark):
    df = spark.createDataFrame([("n", "s", [("p", "1"), ("p", "2"), ("q", "az4")])], f"name string, source string, tags {T.ANNOTATIONS}")
    rules = [{"rule": "a", "action": "spanRenameTag", "key": "p", "newkey": "parent"}, {"rule": "b", "action": "spanDropAnnotation", "key": "q", "match": "az[4-6]"}, {"rule": "c", "action": "spanAddAnnotationIfNotExists", "key": "parent", "value": "3"}, {"rule": "d", "action": "block", "scope": "metricName", "match": "n"}]
    r = R.apply_rules(df, rules, "span").first()
    assert [tuple(a) for a in r.tags] == [("parent", "1"), ("parent", "2")] and r.status is None


def test_rule_file_reloads(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"2878, 4242": [{"rule": "a", "action": "count"}], "global": [{"rule": "b", "action": "count"}]}))
    rules = R.RuleFile(str(path))
    assert [r.name for r in rules.for_port("4242")] == ["a", "b"] and [r.name for r in rules.for_port("1")] == ["b"]
    path.write_text(json.dumps({"global": []}))
    import os

    os.utime(path, (time.time() + 10,) * 2)
    assert rules.for_port("4242") == []
    rules.remote = {"global": [{"rule": "ui", "action": "count"}]}
    assert [r.name for r in rules.for_port("4242")] == ["ui"]


def test_expression_conditions(spark):
    def met(text, **kw):
        return R.apply_rules(record(spark, **kw), [{"rule": "r", "action": "count", "if": text}]).first().counted == ["r"]

    assert met('$value = 1 and {{k}} = "v"', tags={"k": "v"}) and not met("$value != 1")
    assert met('{{metricName}} startsWith "some" and not {{sourceName}} contains "x"')
    assert met("{{k}}.hashCode() % 10 = 2", tags={"k": "hello"}) and met("1 = 1") and not met('{{missing}} = "x"')
    assert met('time("10 minutes ago") < time("1 second ago")')
    assert met('{{k}} = "$value {{x}} it\'s"', tags={"k": "$value {{x}} it's"}) and met("({{metricName}} startsWith 'some') and ($value = 1)")
    assert met('not {{debug}} = "true"') and met('{{k}}.hashCode() = 1772899', tags={"k": "\U0001f600"})
    clash = {"port": "web", "n": "7"}
    assert not met("{{port}} > 8000", tags=clash) and met("{{port}} != 5 and not {{port}} = 5", tags=clash) and not met("{{port}} = $value", tags=clash) and met("{{n}} * 2 = 14 and {{n}} > 6.5", tags=clash)
    assert not met("{{absent}} + 1 = 3") and not met("$value / 0 > 1") and not met("$value % 0 = 0 or -$value > 0") and not met("9223372036854775807 + 1 > 0") and met("(1 = 1) = true")
    assert not met("$value = 1", value=None) and met("$value != 1", value=None)
    for bad in ("$value $value", "$value", "'x'", "{{k}} and 1 = 1", "$value startsWith 'x'", "$value.hashCode() = 1", "(1 = 1) + 1 = 2", "1 < 2 < 3", "{{k}} = 'x' {{k}}", "not", "(" * 3000, "1 = 1)", "(1 = 1", "time('soon') > 1", "1 = true"):
        with pytest.raises(R.RuleError):
            R.parse({"rule": "r", "action": "count", "if": bad})
    for bad in ("current_user() = 'x'", "{{k}} = ", "startsWith 'x'", "$other > 1", "{{k}} contains )", '{{k}} = "x"; drop', ""):
        with pytest.raises(R.RuleError):
            R.parse({"rule": "r", "action": "count", "if": bad or " "})
    with pytest.raises(R.RuleError):
        R.parse({"rule": "r", "action": "count", "if": "java_method('a', 'b')"})


def test_random_conditions(spark):
    """Against a plain evaluation of the tree."""
    rng = random.Random(9)
    rows = [("web", "7", 2.0), ("", "-3.5", None), ("0", "abc", 0.0), ("12", "", 7.0)]
    df = spark.createDataFrame([({"a": a, "b": b}, v) for a, b, v in rows], "tags map<string,string>, value double").coalesce(1)

    def number(depth):
        if depth and rng.random() < 0.5:
            return f"({operand(depth - 1)} {rng.choice('+-*/%')} {operand(depth - 1)})"
        return rng.choice(["1", "2.5", "$value", "0", "{{a}}.hashCode()", "-3"])

    def operand(depth):
        return rng.choice([number(depth), "{{a}}", "{{b}}", "'12'"])

    def truth(depth):
        if depth and rng.random() < 0.6:
            return rng.choice([f"not {truth(depth - 1)}", f"({truth(depth - 1)} and {truth(depth - 1)})", f"({truth(depth - 1)} or {truth(depth - 1)})"])
        if rng.random() < 0.2:
            return f"{{{{a}}}} {rng.choice(['startsWith', 'endsWith', 'contains'])} '{rng.choice(['w', '1', ''])}'"
        return f"{operand(2)} {rng.choice(['=', '!=', '<', '<=', '>', '>='])} {operand(2)}"

    def read(x):
        try:
            return float(x) if re.fullmatch(r"[+-]?\d+(\.\d+)?", x) else None
        except ValueError:
            return None

    def value(n, row):
        a, b, v = row
        of = [value(x, row) for x in n.of]
        if n.op in ("text", "truth", "number"):
            return n.value
        if n.op in ("scope", "field"):
            return {"a": a, "b": b, "value": v}[n.value]
        if n.op == "hash":
            h = 0
            for c in of[0]:
                h = (h * 31 + ord(c)) & 0xFFFFFFFF
            return h - (1 << 32) if h >> 31 else h
        if n.op in ("not", "and", "or"):
            return not of[0] if n.op == "not" else of[0] and of[1] if n.op == "and" else of[0] or of[1]
        if n.op in ("startswith", "endswith"):
            return getattr(of[0], n.op)(of[1])
        if n.op == "contains":
            return of[1] in of[0]
        if n.op in "+-*/%" or {x.kind for x in n.of} != {"text"}:
            of = [read(x) if k.kind == "text" else x for x, k in zip(of, n.of)]
        x, y = of
        if n.op in "+-*/%":
            if x is None or y is None or n.op in "/%" and y == 0:
                return None
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: math.fmod(x, y)}[n.op]()
        if x is None or y is None:
            return n.op == "!="
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[n.op]

    texts = [truth(3) for _ in range(120)]
    trees = [conditions.read(t) for t in texts]
    got = df.select(*[conditions.column(t, "point").alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for row, found in zip(rows, got):
        for k, tree in enumerate(trees):
            assert found[k] == value(tree, row), (texts[k], row)


def test_traffic_limits(spark):
    rng = random.Random(2)
    at = {key: sorted(rng.choice([k, k // 3, 400 + k // 9]) for k in range(300) for _ in range(rng.randint(0, 3))) for key in ("a", "b", None)}
    df = spark.createDataFrame([(key, t) for key, times in at.items() for t in times], "key string, t long").withColumn("at", F.timestamp_seconds("t")).repartition(3)
    got = {(r.key, r.second): r for r in A.traffic_limits(df, "at", ["key"], history=100).collect()}
    for key, times in at.items():
        counts, held, ring = Counter(times), 10_000_000.0, []
        for second in range(times[0], times[-1] + 1):
            ring = [*ring, counts[second]][-100:]
            if len(ring) >= 60:
                limit = 10 + sum(ring) / len(ring) * 1.15
                applied = abs(held - limit) > 0.05 * held
                held = limit if applied else held
                r = got.pop((key, second), None)
                if r is None:  # nothing changed in this second
                    assert not applied and not counts[second]
                else:
                    assert (r.applied, r.n) == (applied, counts[second]) and abs(r.held - held) < 1e-9 and abs(r.rate_limit - limit) < 1e-9
    assert not got
    assert A.traffic_limits(df.filter("false"), "at", ["key"]).count() == 0


def test_sampling(spark):
    rows = [("n", f"00000000-0000-0000-0000-{i:012x}", [("debug", "true")] if i == 99 else []) for i in range(100)]
    df = spark.createDataFrame(rows, f"name string, trace_id string, annotations {T.ANNOTATIONS}").withColumn("duration_ms", F.lit(5))
    out = P.sample_spans(df, [("zero", F.col("name") == "n", 0), ("some", F.col("name") == "n", 25)]).collect()
    assert sum(r.keep for r in out) == 27  # 26 of 100 buckets at 25 percent, and the debug span
    assert {r.policy for r in out} == {"some", None}
    assert [tuple(a) for a in out[99].annotations] == [("debug", "true")] and ("_sampledByPolicy", "some") in [tuple(a) for a in out[0].annotations]


def test_run_length_and_recompression(spark):
    means, counts = D.run_length(np.array([1.0, 1, 1, 2, 3, 3, 3]), np.array([3, 1, 2, 2, 1, 2, 3]))
    assert (means.tolist(), counts.tolist()) == ([1, 2, 3], [6, 2, 6])
    for n, same in ((1000, False), (65, False), (64, True)):
        m, c = D.recompress(np.arange(n, dtype=float), np.ones(n, np.int64))
        assert c.sum() == n and (len(m) == n if same else len(m) < 48)
    df = spark.createDataFrame([([(1.0, 3), (1.0, 1), (2.0, 2), (1.0, 1)],), ([],), (None,)], "centroids array<struct<mean:double,count:bigint>>")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(D.run_length_column(F.col("centroids"))).collect()] == [[(1.0, 4), (2.0, 2), (1.0, 1)], [], None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.integers(1, 50)), min_size=1, max_size=400), st.integers(20, 100))
def test_digest_invariants(values, compression):
    values.sort()
    means, counts = np.array([v for v, _ in values]), np.array([n for _, n in values], np.int64)
    m, c = D.compress(means, counts, compression)
    assert c.sum() == counts.sum() and np.isclose((m * c).sum(), (means * counts).sum(), rtol=1e-9, atol=1e-3)
    assert m.min() >= means.min() - 1e-6 and m.max() <= means.max() + 1e-6 and len(m) <= 2 * compression + 2


def test_large_bins_are_cut(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("value"), F.lit(1).alias("count"))
    c = D.digest_bins(df, ["k"]).first().centroids
    assert sum(x["count"] for x in c) == 5000 and len(c) < 70


def test_hot_bins_are_counted_before_arrays(spark):
    hot = spark.range(60000).select(F.lit("m").alias("metric"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("source"), (F.col("id") % 3000).cast("double").alias("mean"), F.lit(1).cast("long").alias("count"))
    found = {r.source: r.centroids for r in D.recompress_bins(hot, ["metric", "source"], "mean", "count", accuracy=20).collect()}
    assert {k: sum(c["count"] for c in v) for k, v in found.items()} == {"hot": 40000, None: 20000} and all(len(v) <= 40 for v in found.values())
    assert all(sum(c["mean"] * c["count"] for c in v) == pytest.approx(sum(i % 3000 for i in range(60000) if (i % 3 > 0) == (k == "hot"))) for k, v in found.items())


def test_source_tags(spark):
    changes = [("s", 1, "ADD", "a"), ("s", 2, "ADD", "b"), ("s", 3, "DELETE", "a"), ("t", 1, "ADD", "x"), ("t", 2, "SAVE", "y"), ("t", 2, "SAVE", "z"), ("t", 3, "DELETE", "z"), ("u", 1, "DELETE", "q")]
    df = spark.createDataFrame(changes, "source string, seq long, action string, tag string")
    assert sorted(map(tuple, A.source_tag_state(df).collect())) == [("s", "b"), ("t", "y")]


def test_delta_counters(spark):
    rows = [("∆test.mixed1", "h", 1.0), ("∆test.mixed2", "H", 2.0), ("∆test.mixed2", "h", 2.0), ("test.mixed3", "h", 3.0), ("∆test.mixed3", "h", 3.0), ("∆zero", "h", 1.0), ("∆zero", "h", -1.0)]
    df = spark.createDataFrame(rows, "metric string, source string, value double").withColumn("ts_ms", F.lit(1)).withColumn("tags", T.empty_tags())
    assert sorted((r.metric, r.value) for r in A.delta_sums(df).collect()) == [("∆test.mixed1", 1.0), ("∆test.mixed2", 4.0), ("∆test.mixed3", 3.0)]
    assert A.rejected_points(df).count() == 1


APACHE = '52.34.54.96 - - [11/Oct/2016:06:35:45 +0000] "GET /css/app-96.css HTTP/1.1" 200 632 "https://dev.example.com/user/settings" "Mozilla/5.0 (X11)"'


def test_grok(spark):
    lines = spark.createDataFrame([("plainCounter",), ("dynamicCounter foo 1 done",), (APACHE,), ("gauges 42",), ("histo x",), ("hello and 5",)], "line string")
    m = lambda *a, **k: [(r.metric, r.value_text, r.tags) for r in L.matched(lines, L.Matcher(*a, **k)).collect()]
    assert m("dynamicCounter %{WORD:name} %{NUMBER:type} done", "dynamic_%{name}_%{type}") == [("dynamic_foo_1", None, {})]
    assert m("%{COMBINEDAPACHELOG}", "apacheBytes", "bytes", tag_keys=("verb", "auth"), tag_value_labels=("verb", "auth")) == [("apacheBytes", "632", {"auth": "-", "verb": "GET"})]
    assert m("%{COMBINEDAPACHELOG}", "apacheStatus", "response")[0][1] == "200"
    assert m("%{MYPATTERN}", "custom", patterns=L.load_patterns("MYPATTERN %{WORD:myword} and %{NUMBER:value}")) == [("custom", "5", {})]
    for bad in ({"pattern": "x", "metricName": "m"}, {"pattern": "%{NUMBER:value}", "metricName": ""}, {"pattern": "%{NUMBER:value}", "metricName": "m", "tagKeys": ["a"]}, {"pattern": "%{NOPE:value}", "metricName": "m"}):
        with pytest.raises(L.ConfigError):
            L.parse_config({"gauges": [bad]})


def test_histogram_statistics(spark):
    rows = spark.range(1, 101).select(F.lit("h").alias("metric"), F.lit("s").alias("source"), T.empty_tags().alias("tags"), F.col("id").cast("string").alias("value_text"))
    got = {r.metric: r.value for r in L.histogram_statistics(rows).collect()}
    assert set(got) == {f"h.{k}" for k in ("count", "min", "max", "mean", "median", "p75", "p95", "p99", "p999")}
    assert (got["h.count"], got["h.min"], got["h.max"], got["h.mean"], got["h.median"]) == (100, 1, 100, 50.5, 50.5)


def test_grok_library(spark):
    """Every name of the library compiles; addresses are told from times."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    for name in L.PATTERNS:
        regex, groups = L.compile_grok(f"%{{{name}:x}}")
        assert java.compile(regex).matcher("").groupCount() >= groups["x"] >= 1
    texts = ["from 2001:db8::ff00:42:8329 now", "at 12:34:56 now", "from ::1"]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = L.matched(df, L.Matcher("from %{IPV6:value}", "m")).collect()
    assert [r.value_text for r in got] == ["2001:db8::ff00:42:8329", "::1"]
    both = L.matched_all(df, [L.Matcher("at %{TIME:value}", "time"), L.Matcher("%{WORD:value} now", "word"), L.Matcher("nothing", "none")]).collect()
    assert sorted((r.matcher, r.metric, r.value_text) for r in both) == [(0, "time", "12:34:56"), (1, "word", "56"), (1, "word", "8329")]


def test_byte_batches_never_pass_the_cap(spark):
    rows = [(1, n, "x" * size) for n, size in enumerate([200, 200, 56, 300, 10, 246, 1])] + [(2, 0, "y" * 500), (2, 1, None)]
    got = K.byte_batches(spark.createDataFrame(rows, "k int, n int, p string"), "p", 256, ["k"], ["n"]).orderBy("k", "n").collect()
    assert [r.batch for r in got] == [0, 1, 1, 2, 3, 3, 4, 0, 1]
    # keys over many Arrow batches, null keys and payloads of no, few and too many bytes, against a plain fold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(5)
        rows = [(rng.choice([None, 1, 1, 1, 2, 3]), n, rng.choice([None, "", "x" * rng.randint(1, 60), "y" * rng.randint(1, 60), "z" * 120])) for n in range(600)]
        found = K.byte_batches(spark.createDataFrame(rows, "k int, n int, p string").repartition(3), "p", 100, ["k"], ["n"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, want = {}, []
    for k, n, p in rows:
        size = len(p or "")
        number, filled = held.get(k, (0, None))
        if filled is not None and filled + size > 100:
            number, filled = number + 1, 0
        held[k] = number, (filled or 0) + size
        want.append((k, n, p, number))
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert K.byte_batches(spark.createDataFrame([], "k int, n int, p string"), "p", 100, ["k"], ["n"]).collect() == []


def test_span_logs_are_decided_by_their_own_line(spark):
    line = '"op" source="s" spanId=00000000-0000-0000-0000-000000000001 traceId=00000000-0000-0000-0000-000000000002 1700000000000 1700000000050'
    df = spark.createDataFrame([("a", line), ("b", None), ("c", "no line"), ("d", line.replace("op", "blocked"))], "trace_id string, span string")
    ruled = lambda s: s.withColumn("status", F.when(F.col("name") == "blocked", F.lit("blocked")))
    got = {r.trace_id: (r.span, r.error) for r in E.span_logs_with_decision(df, lambda s: P.sample_spans(s, [("all", F.col("duration_ms") == 50, 100)]), ruled).collect()}
    assert got["a"] == ("_sampledByPolicy=all", None) and got["b"] == (None, None) and got["c"][1] == "not a span line" and got["d"][1] == "blocked"
    none = E.span_logs_with_decision(df.filter("trace_id = 'a'"), lambda s: P.sample_spans(s, [], rate=0.0)).collect()
    assert none == []


def test_large_bins_are_cut_by_values(spark, monkeypatch):
    monkeypatch.setattr(D, "PARTS", 2)
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("value"), F.lit(1).alias("count"))
    for r in D.digest_bins(df, ["k"]).collect():
        assert sum(c["count"] for c in r.centroids) == 2500 and len(r.centroids) < 200
        below = 0
        for c in r.centroids:  # values are 0, 2, 4, ...: a mean's rank is half of it
            assert abs(below + c["count"] / 2 - c["mean"] / 2) <= 25
            below += c["count"]


def worst_rank(means, counts, values):
    """How far a centroid's rank by weights is from its rank among the sorted values, as a share of them."""
    middle = np.cumsum(counts) - np.asarray(counts) / 2
    ranks = (np.searchsorted(values, means, "left") + np.searchsorted(values, means, "right")) / 2
    return np.abs(middle - ranks).max() / len(values)


def test_digests_in_one_pass(spark):
    """A bin of 200000 distinct values, a null key and small bins beside it; keys that are arrays; what has no value goes."""
    hot = spark.range(0, 200_000, 1, 16).select(F.lit(None).cast("string").alias("k"), F.array(F.lit("t")).alias("tags"), F.exp(F.col("id") / 20_000).alias("value"), F.lit(1).cast("long").alias("count"))
    small = spark.range(0, 9_000, 1, 5).select((F.col("id") % 300).cast("string").alias("k"), F.array((F.col("id") % 2).cast("string")).alias("tags"), (F.col("id") % 7).cast("double").alias("value"), F.lit(2).cast("long").alias("count"))
    bad = spark.createDataFrame([("bad", [], None, 1), ("bad", [], math.nan, 1), ("bad", [], math.inf, 1), ("bad", [], 1.0, 0), ("bad", [], 1.0, None), ("good", None, 1.0, 3)], "k string, tags array<string>, value double, count long")
    rows = hot.unionByName(small).unionByName(bad)
    out = D.digest_bins(rows, ["k", "tags"])
    found = {(r.k, r.tags and tuple(r.tags)): r.centroids for r in out.collect()}
    m, c = zip(*found.pop((None, ("t",))))
    values = np.exp(np.arange(200_000) / 20_000)
    assert sum(c) == 200_000 and len(c) <= 2 * D.EXACT_VALUES and np.dot(m, c) == pytest.approx(values.sum()) and worst_rank(m, c, values) <= 0.02
    assert [tuple(x) for x in found.pop(("good", None))] == [(1.0, 3)] and ("bad", ()) not in found
    want = Counter()
    for i in range(9_000):
        want[str(i % 300), (str(i % 2),), i % 7] += 2
    assert {(*k, x["mean"]): x["count"] for k, v in found.items() for x in v} == want
    assert str(out._jdf.queryExecution().optimizedPlan().toString()).count("Range (0, 200000") == 1  # the input is read once
    assert D.digest_bins(rows.limit(0), ["k"]).collect() == []


def test_tasks_let_go_of_many_keys(monkeypatch):
    """What a task holds is bounded, whether values are many or keys."""
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD_ROWS", 2_000)
    rng = np.random.default_rng(3)
    keys = [None if k == 0 else f"k{k}" for k in np.minimum(rng.integers(0, 3_000, 20_000), 1_500).tolist()]
    rows = pa.record_batch({"k": pa.array(keys), "mean": rng.random(20_000), "count": rng.integers(1, 9, 20_000)})
    out = pa.Table.from_batches(list(D._task_digests((rows.slice(a, 500) for a in range(0, 20_000, 500)), ["k"], 40, 100))).to_pandas()
    of = rows.to_pandas()
    same = lambda df: df.assign(total=df["mean"] * df["count"]).groupby("k", dropna=False)[["count", "total"]].sum().sort_index()
    assert np.allclose(same(out), same(of)) and len(out[out.k == "k1500"]) < 2_500 < 9_000 < len(of[of.k == "k1500"])


def test_absorbed_values_stay_few():
    rng = np.random.default_rng(4)
    values, means, counts = rng.lognormal(0, 2, 1_000_000), np.array([]), np.array([], np.int64)
    for a in range(0, 1_000_000, 10_000):
        means, counts = D.absorb(means, counts, values[a : a + 10_000], np.ones(10_000, np.int64))
        assert len(means) <= 4 * D.FINE
    assert counts.sum() == 1_000_000 and np.dot(means, counts) == pytest.approx(values.sum()) and worst_rank(means, counts, np.sort(values)) <= 0.02
    exact = D.absorb(*D.absorb(np.array([]), np.array([], np.int64), np.array([3.0, 1, 3]), np.array([1, 2, 1])), np.array([2.0, 1.0]), np.array([5, 1]))
    assert [x.tolist() for x in exact] == [[1, 2, 3], [3, 5, 2]]


def test_delivery(spark, tmp_path):
    df = spark.createDataFrame([("POINT", "a\nb\nc"), ("POINT", "ok"), ("LOGS", "down")], "entity string, payload string")
    post = lambda text: 413 if text.count("\n") >= 2 else 500 if text == "down" else 202
    left = S.deliver(df, post, str(tmp_path / "dead")).collect()
    assert [(r.entity, r.payload, r.last_status, r.action) for r in left] == [("LOGS", "down", 500, "removed")]
    refused = S.deliver(df, lambda text: 429, str(tmp_path / "dead")).collect()
    assert sorted((r.entity, r.action) for r in refused) == [("POINT", "removed"), ("POINT", "removed")]  # refused logs are dropped; earlier letters are not returned
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3
    S.export_lines(df.withColumnRenamed("payload", "line"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5
    S.fan_out(df.withColumn("tenant", F.lit("central")), str(tmp_path / "fan"))
    assert spark.read.parquet(str(tmp_path / "fan")).count() == 3
    S.discard(df)


def run_stream(spark, tmp_path, rows, schema, function, name, seconds=25, later=None, enough="1 = 1"):
    """Rows of the stream's first answer that is enough; `later` are rows that come in a batch of their own."""
    source = tmp_path / "in"
    source.mkdir()
    first = rows if hasattr(rows, "schema") else spark.createDataFrame(rows, schema).coalesce(1)
    first.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    mode = "update" if name == "counts" else "append"
    q = function(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + seconds
        while later and not q.recentProgress:
            time.sleep(0.1)
        if later:
            spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(source))
        while time.time() < end and not spark.sql(f"SELECT 1 FROM {name} HAVING count(*) > 0 AND {enough}").head(1):
            time.sleep(0.3)
        return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
    finally:
        q.stop()


def test_streaming_delta_sums(spark, tmp_path):
    rows = [("h", "∆a", "", 1.0), ("h", "∆a", "", 2.0), ("h", "∆z", "", 0.0)]
    got = run_stream(spark, tmp_path, rows, "source string, metric string, tag_text string, value double", lambda s: Z.streaming_delta_sums(s, 300), "deltas")
    assert got == [("h", "∆a", "", 3.0)]


def test_streaming_bins(spark, tmp_path):
    rows = [("m", "s", "", 60_000, 1.0, 1), ("m", "s", "", 60_000, 1.0, 2), ("m", "s", "", 60_000, 5.0, 1)]
    got = run_stream(spark, tmp_path, rows, "metric string, source string, tag_text string, bin_start_ms long, mean double, count long", lambda s: Z.streaming_bins(s, 300), "bins")
    assert got == [("m", "s", "", 60_000, 1.0, 3), ("m", "s", "", 60_000, 5.0, 1)]


def test_bins_with_rows_in_several_batches_are_released(spark, tmp_path):
    """A key that gets rows again before its release is released all the same, at its first due time."""
    schema = "metric string, source string, tag_text string, bin_start_ms long, mean double, count long"
    one, two = [("m", "s", "", 60_000, 1.0, 1), ("m", "s", "", 60_000, None, 1)], [("m", "s", "", 60_000, 1.0, 2), ("m", "s", "", 60_000, 5.0, 1)]
    got = run_stream(spark, tmp_path, one, schema, lambda s: Z.streaming_bins(s, 4_000), "again", 40, two, "sum(count) = 4")
    assert sum(r[5] for r in got) == 4 and {r[4] for r in got} == {1.0, 5.0}


def test_deltas_in_several_batches_are_released(spark, tmp_path):
    one, two = [("h", "∆a", "", 1.0)], [("h", "∆a", "", 2.5)]
    got = run_stream(spark, tmp_path, one, "source string, metric string, tag_text string, value double", lambda s: Z.streaming_delta_sums(s, 4_000), "more_deltas", 40, two, "sum(value) = 3.5")
    assert sum(r[3] for r in got) == 3.5


def test_stream_of_a_million_values_in_a_bin(spark, tmp_path):
    values = spark.range(0, 1_000_000, 1, 4).select(F.lit("m").alias("metric"), F.lit("s").alias("source"), F.lit("").alias("tag_text"), F.lit(60_000).cast("long").alias("bin_start_ms"), F.col("id").cast("double").alias("mean"), F.lit(1).cast("long").alias("count"))
    schema = "metric string, source string, tag_text string, bin_start_ms long, mean double, count long"
    got = sorted(run_stream(spark, tmp_path, values, schema, lambda s: Z.streaming_bins(s, 300), "million", 60, enough="sum(count) = 1000000"), key=lambda r: r[4])
    means, counts = np.array([r[4] for r in got]), np.array([r[5] for r in got])
    assert counts.sum() == 1_000_000 and len(got) <= 2 * D.EXACT_VALUES and worst_rank(means, counts, np.arange(1_000_000.0)) <= 0.02


def test_streaming_counters(spark, tmp_path):
    got = run_stream(spark, tmp_path, [("m", "s", "", 4), ("m", "s", "", 3)], "metric string, source string, tag_text string, n long", Z.streaming_counters, "counts")
    assert got == [("m", "s", "", 7)]


def test_query_of_types_and_arithmetic_equals_its_sql(spark):
    """The SQL leaves out what NOT is given an unknown; at sf0.01 there are rows of both kinds."""
    import duckdb

    from tallyvane import queries as registered

    sf_dir, name = "/root/testdata/sf0.01", "p14_types_and_arithmetic"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    rows = con.execute(registered.oracle_sql()[name]).fetchall()
    got = registered.queries()[name](spark, sf_dir)
    columns = [d[0] for d in con.description]
    assert rows and sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(rows)
