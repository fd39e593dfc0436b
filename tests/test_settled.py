"""What decoders work out stands in the plan once, whatever is filtered or read afterwards."""

from pyspark.sql import functions as F

from tallyvane.operators import json_metrics, lines, otlp


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_matched_once(spark):
    """not once for each group, column and filter; lines with the mark itself are read too."""
    given = spark.createDataFrame([("!M 1 #3 2.5 m source=s k=v",), ('!M 1 #3 2.5 "m\x01" source=s "k\x01="="v=\\" w"',), ("no\x01 line",), ("!M",), (None,)], "line string")
    out = lines.decode_histograms(given)
    assert plan(out.filter("error IS NULL").select("metric", "source", F.explode("centroids"))).count(r"((?:#\d+\s+\S+\s+)+)") <= 6
    got = [(r.metric, r.source, r.tags, r.error) for r in out.collect()]
    assert got[:2] == [("m", "s", {"k": "v"}, None), ("m\x01", "s", {"k\x01=": 'v=" w'}, None)] and [r[3] for r in got[2:]] == ["not a histogram line", "not a histogram line", "no source"]


def test_otlp_attributes_are_renamed_once(spark):
    """tags of renamed tags were copied at each level."""
    given = spark.createDataFrame([('{"resourceMetrics":[{}]}',)], "body string")
    assert plan(otlp.numbers(otlp.decode_metrics(given)).filter("error IS NULL")).count("map_filter(") < 20


def test_intake_rows_without_values_are_not_exploded(spark):
    """what has no value goes before the rows are made, and host tags are read once a body."""
    given = spark.createDataFrame([('{"internalHostname":"H","collection_timestamp":1,"system.load.1":2,"host-tags":{"system":["a:b"]}}',), ('{"internalHostname":"H","collection_timestamp":1}',), ("x",)], "body string")
    out = json_metrics.decode_datadog_intake(given)
    assert [(r.metric, r.source, r.value, r.tags, r.error) for r in out.orderBy("error").collect()] == [("system.load.1", "h", 2.0, {"a": "b"}, None), (None, None, None, {}, "malformed request")]
    text = plan(out)
    assert text.rfind("get_json_object") > text.find("Generate explode") and "_settled" in text
