"""Queries of aggregation, logs to metrics, ordering and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions import tags as T
from ..operators import aggregate as A
from ..operators import logs as L
from ..operators import ordering as K
from ..operators import rules as R
from ..sinks import delivery as S
from ..streaming.held import with_live_series
from .registry import query
from .views import CHANGES, POINTS, SPANS, deltas, log_lines, points, scratch, source_tag_changes, spans, table


def _entries() -> F.Column:
    return F.array_join(F.transform("tags", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("tags")


@query(f"""WITH {POINTS} SELECT metric, source, 'env=prod,k=' || k AS tags, ts_ms // 60000 * 60000 AS bin_start_ms, value AS mean, count(*) AS count FROM points WHERE metric <> 'event.error' GROUP BY ALL""")
def a2_minute_bins(spark, sf_dir):
    """The flagship: block, tag, and count values of minute distributions."""
    rules = [{"rule": "no errors", "action": "block", "scope": "metricName", "match": "event\\.error"}, {"rule": "env", "action": "addTag", "tag": "env", "value": "prod"}]
    kept = R.accepted(R.apply_rules(points(spark, sf_dir).withColumnRenamed("metric", "name"), rules))
    return A.value_bins(kept.withColumnRenamed("name", "metric")).select("metric", "source", _entries(), "bin_start_ms", "mean", "count")


DELTAS = """deltas AS (SELECT '∆item.qty' AS metric, lower(s_name) AS source, 'flag=' || l_returnflag || ',status=' || l_linestatus AS tags, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity - 25 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"WITH {DELTAS} SELECT metric, source, tags, (ts_ms // 30000 + 1) * 30000 AS flush_ms, sum(value) AS value FROM deltas GROUP BY ALL HAVING sum(value) <> 0")
def a1_delta_sum(spark, sf_dir):
    return A.delta_sums(deltas(spark, sf_dir)).select("metric", "source", _entries(), "flush_ms", "value")


@query(f"""WITH {POINTS}, c AS (SELECT metric, source, ts_ms, unnest([{{'mean': floor(value), 'count': seq % 3}}, {{'mean': 1.0, 'count': 2}}]) AS c FROM points)
  SELECT metric, ts_ms // 3600000 * 3600000 AS bin_start_ms, c.mean AS mean, CAST(sum(c.count) AS BIGINT) AS count FROM c WHERE c.count > 0 GROUP BY ALL""")
def a3_merge_histograms(spark, sf_dir):
    centroids = F.array(F.struct(F.floor("value").cast("double").alias("mean"), (F.col("seq") % 3).alias("count")), F.struct(F.lit(1.0).alias("mean"), F.lit(2).cast("long").alias("count")), F.struct(F.lit(float("nan")).alias("mean"), F.lit(1).cast("long").alias("count")))
    h = points(spark, sf_dir).select("metric", F.lit("all").alias("source"), F.array().cast(T.ANNOTATIONS).alias("tags"), A.bin_start(F.col("ts_ms"), A.MINUTE).alias("bin_start_ms"), F.lit(A.MINUTE).alias("duration_ms"), centroids.alias("centroids"))
    return A.merge_histograms(A.explode_centroids(h), A.HOUR).select("metric", "bin_start_ms", "mean", "count")


@query(f"""WITH {POINTS}, g AS (SELECT unnest([60000, 3600000, 86400000]) AS ms)
  SELECT metric, source, 'k=' || k AS tags, ts_ms // ms * ms AS bin_start_ms, CAST(ms AS INTEGER) AS duration_ms, value AS mean, CAST(count(*) AS BIGINT) AS count FROM points, g GROUP BY ALL""")
def a4_hour_day_rollup(spark, sf_dir):
    return A.roll_up(points(spark, sf_dir)).select("metric", "source", _entries(), "bin_start_ms", "duration_ms", "mean", "count")


DAY_DIGESTS = f"""WITH {POINTS} SELECT metric, ts_ms // 86400000 * 86400000 AS bin_start_ms, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, true AS close, true AS small FROM points GROUP BY ALL"""


def _day_values(spark, sf_dir):
    return points(spark, sf_dir).select("metric", A.bin_start(F.col("ts_ms"), A.DAY).alias("bin_start_ms"), "seq", "value", F.lit(1).alias("count"))


def _invariants(out, rows):
    """Count and sum of day digests, whether their ranks lie within 2 % of those of all values, and whether they are few."""
    total = F.aggregate("centroids", F.lit(0.0), lambda s, c: s + c["mean"] * c["count"])
    n = F.aggregate("centroids", F.lit(0).cast("bigint"), lambda s, c: s + c["count"])
    # the share of the count up to a centroid (half of its own) against the share of values below its mean, at most 2 % apart
    own = F.posexplode(F.transform("centroids", lambda c: c["mean"]))
    marks = out.select("metric", "bin_start_ms", "centroids", own.alias("i", "mean"))
    below = F.aggregate(F.slice("centroids", 1, F.col("i")), F.lit(0.0), lambda s, c: s + c["count"]) + F.get("centroids", F.col("i"))["count"] / 2
    marks = marks.select(F.col("metric").alias("m"), F.col("bin_start_ms").alias("b"), "mean", below.alias("below"))
    values = rows.groupBy("metric", "bin_start_ms").agg(F.count("*").alias("of"), F.array_sort(F.collect_list("value")).alias("vs"))
    rank = F.size(F.filter("vs", lambda v: v < F.col("mean"))) + F.size(F.filter("vs", lambda v: v == F.col("mean"))) / 2
    close = values.join(marks, (values.metric == marks.m) & (values["bin_start_ms"] == marks.b)).groupBy("metric", "bin_start_ms").agg((F.max(F.abs(rank - F.col("below")) / F.col("of")) <= 0.02).alias("close"))
    found = out.select("metric", "bin_start_ms", n.alias("n"), F.round(total, 4).alias("total"), (F.size("centroids") <= 2 * D.EXACT_VALUES).alias("small"))
    return found.join(close, ["metric", "bin_start_ms"])


@query(DAY_DIGESTS)
def a5_digest_invariants(spark, sf_dir):
    """Centroids of day bins keep count and sum, their quantiles lie near the exact ones in rank, and they stay few."""
    rows = _day_values(spark, sf_dir)
    return _invariants(D.digest_bins(rows, ["metric", "bin_start_ms"]), rows)


@query(DAY_DIGESTS)
def a8_absorbed_digests(spark, sf_dir):
    """Day bins that were flushed as digests three times: the stored digest takes the later ones in and keeps what A5 keeps."""
    rows, keys = _day_values(spark, sf_dir), ["metric", "bin_start_ms"]
    third = F.least(F.col("seq") % 5, F.lit(2)).alias("flush")
    flushed = D.digest_bins(rows.select(*keys, third, "value", "count"), [*keys, "flush"], D.FINE).select(*keys, F.inline("centroids"))
    return _invariants(D.digest_bins(flushed, keys, value="mean"), rows)


@query(f"""WITH {POINTS}, f AS (SELECT *, CASE WHEN lag(floor(value / 50)) OVER w IS NOT DISTINCT FROM floor(value / 50) THEN 0 ELSE 1 END AS new FROM points WINDOW w AS (PARTITION BY metric, source ORDER BY seq)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY metric, source ORDER BY seq) AS island FROM f)
  SELECT metric, source, CAST(island AS BIGINT) AS island, floor(value / 50) AS mean, CAST(count(*) AS BIGINT) AS count FROM i GROUP BY ALL""")
def a6_run_length(spark, sf_dir):
    rows = points(spark, sf_dir).select("metric", "source", "seq", F.floor(F.col("value") / 50).cast("double").alias("mean"), F.lit(1).cast("long").alias("count"))
    return A.run_length_rows(rows, ["metric", "source"], ["seq"]).select("metric", "source", "island", "mean", "count")


@query(f"WITH {POINTS} SELECT metric, source, CAST(count(*) AS BIGINT) AS n, true AS small FROM points GROUP BY ALL")
def a7_recompress(spark, sf_dir):
    """Centroids of each user, merged and compressed: counts stay, sizes are bounded."""
    rows = points(spark, sf_dir).select("metric", "source", F.floor("value").cast("double").alias("mean"), F.lit(1).cast("long").alias("count"))
    out = D.recompress_bins(rows, ["metric", "source"], "mean", "count", accuracy=20)
    return out.select("metric", "source", F.aggregate("centroids", F.lit(0).cast("bigint"), lambda s, c: s + c["count"]).alias("n"), (F.size("centroids") <= 40).alias("small"))


NOW_MS = 1_705_795_200_000  # 2024-01-21, within the events' days


@query(f"""WITH {POINTS}, b AS (SELECT metric, ts_ms // 3600000 * 3600000 AS bin_start_ms, min(ts_ms) + 500 AS first_ms FROM points GROUP BY ALL)
  SELECT metric, bin_start_ms FROM b WHERE first_ms + 4200000 < {NOW_MS}""")
def a9_ripe_bins(spark, sf_dir):
    bins = points(spark, sf_dir).groupBy("metric", A.bin_start(F.col("ts_ms"), A.HOUR).alias("bin_start_ms")).agg((F.min("ts_ms") + 500).alias("first_ms")).withColumn("duration_ms", F.lit(A.HOUR))
    return A.ripe(bins, "first_ms", F.lit(NOW_MS)).select("metric", "bin_start_ms")


@query(f"""WITH {POINTS} SELECT metric, source, ts_ms // 60000 * 60000 AS bin_start_ms, value AS mean, CAST(count(*) AS BIGINT) AS count FROM points GROUP BY ALL""")
def a8_flush_merge(spark, sf_dir):
    """Bins that were flushed in two parts merge into what one pass would count."""
    p = points(spark, sf_dir)
    flushed = A.value_bins(p.filter("seq % 2 = 0")).unionByName(A.value_bins(p.filter("seq % 2 = 1")))
    return A.merge_histograms(flushed).select("metric", "source", "bin_start_ms", "mean", "count")


@query(f"""WITH {POINTS}, b AS (SELECT metric, CASE WHEN seq % 2 = 0 THEN 60000 ELSE 3600000 END AS ms, ts_ms, floor(value) AS mean FROM points)
  SELECT metric, CAST(ms AS INTEGER) AS duration_ms, ts_ms // ms * ms AS bin_start_ms, mean, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY ALL""")
def a10_relay_bins(spark, sf_dir):
    """Relayed distributions merge at their own granularity."""
    ms = F.when(F.col("seq") % 2 == 0, F.lit(A.MINUTE)).otherwise(F.lit(A.HOUR))
    rows = points(spark, sf_dir).select("metric", F.lit("all").alias("source"), F.array().cast(T.ANNOTATIONS).alias("tags"), A.bin_start(F.col("ts_ms"), ms).alias("bin_start_ms"), ms.alias("duration_ms"), F.floor("value").cast("double").alias("mean"), F.lit(1).cast("long").alias("count"))
    return A.merge_histograms(rows).select("metric", "duration_ms", "bin_start_ms", "mean", "count")


RED = "start_ms // 60000 * 60000 AS minute_ms, source, name AS operation, application, service, 'none' AS cluster, 'none' AS shard, 'none' AS component"


@query(f"WITH {SPANS} SELECT {RED}, count(*) AS invocations, count(*) FILTER (error) AS errors, CAST(sum(duration_ms) * 1000 AS BIGINT) AS duration_micros FROM spans GROUP BY ALL")
def a11_red(spark, sf_dir):
    return A.red_metrics(spans(spark, sf_dir))


@query(f"WITH {SPANS} SELECT {RED}, duration_ms * 1000 AS mean, count(*) AS count FROM spans GROUP BY ALL")
def a11_duration_bins(spark, sf_dir):
    return A.duration_bins(spans(spark, sf_dir))


@query(f"WITH {SPANS} SELECT DISTINCT {RED.replace('name AS operation, ', '')} FROM spans")
def a12_heartbeats(spark, sf_dir):
    return A.heartbeats(spans(spark, sf_dir))


@query(f"""WITH {CHANGES}, s AS (SELECT source, max(seq) AS saved FROM changes WHERE action = 'SAVE' GROUP BY 1), l AS (SELECT source, tag, max(seq) AS seq, arg_max(action, seq) AS action FROM changes GROUP BY 1, 2)
  SELECT l.source, l.tag FROM l LEFT JOIN s ON l.source = s.source WHERE (saved IS NULL OR l.seq >= saved) AND action <> 'DELETE'""")
def a13_source_tags(spark, sf_dir):
    return A.source_tag_state(source_tag_changes(spark, sf_dir))


@query("""WITH RECURSIVE t AS (
    SELECT event_type, 3 * CASE WHEN event_id % 2 = 0 THEN CAST(floor(sqrt(event_id)) AS BIGINT) ELSE abs(150 - CAST(floor(sqrt(event_id)) AS BIGINT)) END AS second FROM events
  ), s AS (SELECT event_type, second, count(*) AS n FROM t GROUP BY ALL
  ), b AS (SELECT event_type, min(second) AS first, max(second) AS last FROM s GROUP BY ALL
  ), d AS (SELECT event_type, first, unnest(range(first, last + 1)) AS second FROM b
  ), f AS (SELECT d.event_type, d.second, d.first, coalesce(n, 0) AS n FROM d LEFT JOIN s USING (event_type, second)
  ), l AS (SELECT *, 10 + avg(n) OVER w * 1.15 AS rate_limit, n > 0 OR second < first + 120 OR lag(n, 120, 0) OVER (PARTITION BY event_type ORDER BY second) > 0 AS shown
    FROM f WINDOW w AS (PARTITION BY event_type ORDER BY second ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)
  ), r AS (
    SELECT event_type, first + 58 AS second, CAST(10000000 AS DOUBLE) AS held, false AS applied FROM b
    UNION ALL
    SELECT l.event_type, l.second, CASE WHEN abs(l.rate_limit - r.held) > 0.05 * r.held THEN l.rate_limit ELSE r.held END, abs(l.rate_limit - r.held) > 0.05 * r.held FROM r JOIN l ON l.event_type = r.event_type AND l.second = r.second + 1
  )
  SELECT event_type, second, n, round(rate_limit, 6) AS rate_limit, applied, round(held, 6) AS held FROM l JOIN r USING (event_type, second) WHERE shown AND second >= first + 59""")
def a14_traffic_limit(spark, sf_dir):
    """Traffic that swells and ebbs, with quiet seconds between: limits by the last two minutes, and the rates they leave in force."""
    root = F.floor(F.sqrt("event_id"))
    second = 3 * F.when(F.col("event_id") % 2 == 0, root).otherwise(F.abs(150 - root))
    rows = table(spark, sf_dir, "events").select("event_type", F.timestamp_seconds(second).alias("at"))
    out = A.traffic_limits(rows, "at", ["event_type"], history=120)
    return out.select("event_type", "second", "n", F.round("rate_limit", 6).alias("rate_limit"), "applied", F.round("held", 6).alias("held"))


# --- logs ----------------------------------------------------------------------------------------------------------

OPERATION = L.Matcher(
    "operation %{WORD:op} took %{NUMBER:value} seconds in DC=%{NOTSPACE:dc}.*AZ=%{WORD:az}", "%{op}.totalSeconds", tag_keys=("theDC", "theAZ", "none", "noMatch"), tag_values=("%{dc}", "az-%{az}", " ", "aa%{q}bb")
)
LOGS = f"""{POINTS}, ops AS (SELECT seq, ts_ms, substr(metric, 7) AS op, CAST(floor(abs(value)) AS BIGINT) AS v, source AS dc, k FROM points WHERE seq % 3 = 0)"""
TAGS = "'noMatch=aa%{q}bb,theAZ=az-az' || k || ',theDC=' || dc"


@query(f"WITH {LOGS} SELECT seq, op || '.totalSeconds' AS metric, 'host' AS source, {TAGS} AS tags, CAST(v AS VARCHAR) AS value_text FROM ops")
def l1_grok_match(spark, sf_dir):
    return L.matched(log_lines(spark, sf_dir), OPERATION).select("seq", "metric", "source", T.tag_text(F.col("tags")).alias("tags"), "value_text")


@query(f"WITH {LOGS} SELECT seq, dc || '.corp' AS source, op AS metric FROM ops")
def l2_templates(spark, sf_dir):
    m = L.Matcher(OPERATION.pattern, "%{op}", host_name="%{dc}.corp")
    return L.matched(log_lines(spark, sf_dir), m).select("seq", "source", "metric")


@query(f"WITH {LOGS} SELECT seq, CASE WHEN k = '7' THEN 'b=' || dc ELSE 'a=' || k || ',b=' || dc END AS tags FROM ops WHERE k <> ''")
def l3_tags(spark, sf_dir):
    """Tags of captures by label, sorted; blank ones are left out."""
    lines = log_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", "AZ=az7$", "AZ="))
    m = L.Matcher("operation %{WORD:op} took %{NUMBER:value} seconds in DC=%{NOTSPACE:dc} AZ=(?:az)?%{DATA:az}$", "m", tag_keys=("b", "a"), tag_value_labels=("dc", "az"))
    return L.matched(lines, m).select("seq", T.tag_text(F.col("tags")).alias("tags"))


@query(f"WITH {LOGS} SELECT '∆' || op || '.totalSeconds' AS metric, {TAGS} AS tags, CAST(sum(v) AS BIGINT) AS value FROM ops GROUP BY ALL HAVING sum(v) <> 0 UNION ALL SELECT '∆plainCounter', '', count(*) FROM points WHERE seq % 3 = 1")
def l4_counter(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    rows = L.matched(lines, OPERATION).unionByName(L.matched(lines, L.Matcher("plainCounter", "plainCounter")))
    return L.counters(rows).select("metric", _entries(), "value")


@query(f"WITH {POINTS} SELECT 'myGauge' AS metric, arg_max(floor(value), (ts_ms, seq)) AS value FROM points WHERE seq % 3 = 2")
def l5_gauge(spark, sf_dir):
    rows = L.matched(log_lines(spark, sf_dir), L.Matcher("gauges %{NUMBER:value}", "myGauge"))
    return L.gauges(rows, F.struct("ts_ms", "seq")).select("metric", "value")


@query(f"""WITH {POINTS}, p AS (SELECT *, CAST(floor(value) AS DOUBLE) AS v, seq % 4 AS b, seq // 4 % 3 AS m FROM points WHERE value IS NOT NULL)
  SELECT f.flush, CASE m WHEN 0 THEN 'removed' WHEN 1 THEN 'kept' ELSE 'idle' END AS matcher, metric, source, CASE WHEN m = 1 THEN arg_max(v, (b, ts_ms, seq)) ELSE sum(v) END AS value
  FROM p JOIN (SELECT unnest(range(4)) AS flush) AS f ON CASE m WHEN 0 THEN f.flush <= 1 AND b <= f.flush OR f.flush = 3 AND b = 3 WHEN 1 THEN b <= f.flush ELSE b = 0 AND f.flush <= 2 END
  GROUP BY f.flush, m, metric, source HAVING m <> 1 OR f.flush < 3 OR max(b) >= 2""")
def l8_live_series(spark, sf_dir):
    """Counters and gauges over four flushes: one matcher is removed before the third and comes back for the fourth, when series that
    nothing came for since the second have been idle for too long."""
    matcher = F.get(F.array(*[F.lit(x) for x in ("removed", "kept", "idle")]), (F.floor(F.col("seq") / 4) % 3).cast("int"))
    rows = points(spark, sf_dir).select(matcher.alias("matcher"), F.when(matcher == "kept", F.lit("gauge")).otherwise(F.lit("counter")).alias("kind"), "metric", "source", F.lit("").alias("tag_text"), F.floor("value").cast("double").alias("value"), "ts_ms", "seq")
    rows = rows.filter("matcher <> 'idle' OR seq % 4 = 0")
    out, times, sets = scratch(spark, "live-series"), [0, 1_000_000, 2_000_000, 5_000_000], [["removed", "kept", "idle"]] * 2 + [["kept", "idle"], ["removed", "kept", "idle"]]
    at = [0]
    each = with_live_series(f"{out}/held", lambda: sets[at[0]], lambda live, epoch: live.write.mode("overwrite").parquet(f"{out}/rows/flush={epoch}"), now=lambda: times[at[0]])
    for epoch in range(4):  # a stream's micro-batches
        at[0] = epoch
        each(rows.filter(F.col("seq") % 4 == epoch), epoch)
    return spark.read.parquet(f"{out}/rows").select(F.col("flush").cast("long").alias("flush"), "matcher", "metric", "source", "value")


@query(f"WITH {LOGS} SELECT op || '.totalSeconds' AS metric, {TAGS} AS tags, ts_ms // 60000 * 60000 AS bin_start_ms, CAST(v AS DOUBLE) AS mean, count(*) AS count FROM ops GROUP BY ALL")
def l6_histogram_bins(spark, sf_dir):
    return L.histogram_bins(L.matched(log_lines(spark, sf_dir), OPERATION)).select("metric", _entries(), "bin_start_ms", "mean", "count")


@query(f"""WITH {LOGS}, s AS (SELECT op, count(*)::DOUBLE AS c, min(v)::DOUBLE AS mi, max(v)::DOUBLE AS ma, avg(v) AS me, quantile_cont(v::DOUBLE, [0.5, 0.75, 0.95, 0.99, 0.999]) AS q FROM ops GROUP BY 1)
  SELECT op || m.s AS metric, round(m.v, 6) AS value FROM (SELECT op, unnest([{{'s': '.count', 'v': c}}, {{'s': '.min', 'v': mi}}, {{'s': '.max', 'v': ma}}, {{'s': '.mean', 'v': me}}, {{'s': '.median', 'v': q[1]}},
    {{'s': '.p75', 'v': q[2]}}, {{'s': '.p95', 'v': q[3]}}, {{'s': '.p99', 'v': q[4]}}, {{'s': '.p999', 'v': q[5]}}]) AS m FROM s)""")
def l7_explode(spark, sf_dir):
    rows = L.matched(log_lines(spark, sf_dir), L.Matcher(OPERATION.pattern, "%{op}"))
    return L.histogram_statistics(rows).select("metric", F.round("value", 6).alias("value"))


# --- ordering and sinks --------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT seq, 'a=1,k=' || k || ',z=2' AS tags FROM points")
def k1_sorted_tags(spark, sf_dir):
    return points(spark, sf_dir).select("seq", T.tag_text(T.put(F.create_map(F.lit("z"), F.lit("2"), F.lit("a"), F.lit("1")), "k", F.col("tags")["k"])).alias("tags"))


@query(f"WITH {POINTS} SELECT seq, CASE seq % 3 WHEN 0 THEN source WHEN 1 THEN k ELSE 'none' END AS found FROM points")
def k2_first_by_precedence(spark, sf_dir):
    from ..operators.enrich import first_by_precedence

    tags = F.map_filter(F.create_map(F.lit("a"), F.when(F.col("seq") % 3 == 0, F.col("source")), F.lit("b"), F.when(F.col("seq") % 3 < 2, F.col("tags")["k"])), lambda _, v: v.isNotNull())
    return points(spark, sf_dir).select("seq", first_by_precedence(tags, ["a", "b"], F.lit("none")).alias("found"))


@query("""WITH g AS (SELECT event_type, event_id % 16 AS sender, list({'bytes': CAST(octet_length(encode(props)) AS BIGINT), 'n': 1::BIGINT, 'done': []::STRUCT(n BIGINT, bytes BIGINT)[]} ORDER BY event_id) AS l FROM events GROUP BY ALL),
  f AS (SELECT event_type, sender, list_reduce(l, lambda a, x: CASE WHEN a.bytes + x.bytes > 256
    THEN {'bytes': x.bytes, 'n': 1::BIGINT, 'done': list_append(a.done, {'n': a.n, 'bytes': a.bytes})} ELSE {'bytes': a.bytes + x.bytes, 'n': a.n + 1, 'done': a.done} END) AS r FROM g),
  b AS (SELECT event_type, sender, list_append(r.done, {'n': r.n, 'bytes': r.bytes}) AS l FROM f)
  SELECT event_type, sender, CAST(i - 1 AS BIGINT) AS batch, l[i].n AS n, l[i].bytes AS bytes FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b)""")
def k3_byte_batches(spark, sf_dir):
    """Batches by sender: each sender's share is a window of its own."""
    rows = K.byte_batches(table(spark, sf_dir, "events").withColumn("sender", F.col("event_id") % 16), "props", 256, ["event_type", "sender"], ["event_id"])
    return rows.groupBy("event_type", "sender", "batch").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


@query(f"WITH {POINTS} SELECT seq, metric FROM points ORDER BY ts_ms, seq LIMIT 250")
def k4_dispatch_limit(spark, sf_dir):
    return K.dispatch_limit(points(spark, sf_dir), [F.col("ts_ms"), F.col("seq")], 250).select("seq", "metric")


@query(f"WITH {POINTS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(16 AS BIGINT) AS senders, true AS even FROM points")
def k5_round_robin(spark, sf_dir):
    """Rows of each sender partition: none has more than another by more than a row for each partition read."""
    rows = points(spark, sf_dir)
    read = rows.rdd.getNumPartitions()
    sent = K.round_robin(rows.select("seq"), 16).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return sent.agg(F.sum("n").alias("n"), F.count("*").alias("senders"), (F.max("n") - F.min("n") <= read).alias("even"))


@query(f"""WITH {POINTS}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY metric, seq % 16 ORDER BY seq) - 1) // 20 AS BIGINT) AS batch, seq % 16 AS sender FROM points)
  SELECT metric, sender, batch, string_agg(source, chr(10) ORDER BY seq) AS payload, count(*) AS n FROM b GROUP BY ALL""")
def r2_line_payloads(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("sender", F.col("seq") % 16)
    return S.line_payloads(K.item_batches(rows, 20, ["metric", "sender"], ["seq"]), "source", ["metric", "sender", "batch"], "seq").select("metric", "sender", "batch", "payload", "n")


@query(f"""WITH {POINTS}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY metric, seq % 16 ORDER BY seq) - 1) // 50 AS BIGINT) AS batch, seq % 16 AS sender FROM points)
  SELECT metric, sender, batch, '[' || string_agg('{{"seq":' || seq || ',"source":"' || source || '"}}', ',' ORDER BY seq) || ']' AS payload, count(*) AS n FROM b GROUP BY ALL""")
def r3_json_payloads(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("sender", F.col("seq") % 16)
    rows = K.item_batches(rows, 50, ["metric", "sender"], ["seq"]).select("metric", "sender", "batch", "seq", "source")
    return S.json_payloads(rows, ["metric", "sender", "batch"], "seq")


@query(f"""WITH {CHANGES} SELECT source, seq, CASE action WHEN 'SAVE' THEN 'POST' WHEN 'ADD' THEN 'PUT' ELSE 'DELETE' END AS method,
  '/v2/source/' || source || '/tag' || CASE WHEN action = 'SAVE' THEN '' ELSE '/' || tag END AS path, CASE WHEN action = 'SAVE' THEN '["' || tag || '"]' END AS payload FROM changes""")
def r3_source_tag_calls(spark, sf_dir):
    return S.source_tag_calls(source_tag_changes(spark, sf_dir))


@query(f"""WITH {POINTS} SELECT CASE WHEN seq % 8 = 0 THEN 'delivered' WHEN seq % 8 = 1 AND metric = 'event.view' THEN 'dropped' WHEN seq % 8 IN (1, 2) THEN CASE WHEN metric = 'event.click' AND seq % 20 >= 15 THEN 'removed' ELSE 'pushback' END
  WHEN seq % 8 = 3 THEN 'removed' WHEN seq % 8 = 4 THEN 'split' ELSE CASE WHEN metric = 'event.click' AND seq % 20 >= 15 THEN 'removed' ELSE 'retry' END END AS action, count(*) AS n FROM points GROUP BY 1""")
def r4_response_actions(spark, sf_dir):
    status = F.get(F.array(*[F.lit(x) for x in (202, 429, 406, 401, 413, 407, 500, 599)]), (F.col("seq") % 8).cast("int"))
    entity = F.when(F.col("metric") == "event.view", F.lit("LOGS")).when(F.col("metric") == "event.click", F.lit("SOURCE_TAG")).otherwise(F.lit("POINT"))
    return points(spark, sf_dir).select(S.response_action(status, entity, (F.col("seq") % 20).cast("int")).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, x AS (SELECT metric, seq % 16 AS sender, seq, count(*) OVER (PARTITION BY metric, seq % 16) AS c, row_number() OVER (PARTITION BY metric, seq % 16 ORDER BY seq) - 1 AS r FROM points)
  SELECT metric, sender, r // CAST(least(40, ceil(c / 2.0)) AS BIGINT) AS part, count(*) AS n FROM x GROUP BY ALL""")
def r5_batch_split(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("sender", F.col("seq") % 16)
    return K.split_batches(rows, 40, ["metric", "sender"], ["seq"]).groupBy("metric", "sender", "part").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT seq, (1 + 0.5) * 2 * pow(2, least(seq % 7, 4)) AS wait, seq % 12 < 10 AS goes_on FROM points")
def r9_backoff(spark, sf_dir):
    return points(spark, sf_dir).select("seq", S.backoff_seconds(F.col("seq") % 7, 2.0, 2.0, F.lit(0.5)).alias("wait"), S.keep_draining(F.col("seq") % 12).alias("goes_on"))


@query(f"WITH {POINTS} SELECT CASE WHEN seq % 5 = 0 THEN 'HISTOGRAM' ELSE 'POINT' END AS entity, CASE WHEN k < '5' THEN 'central' ELSE 'other' END AS tenant, count(*) AS n FROM points GROUP BY ALL")
def r1_fan_out(spark, sf_dir):
    """Rows are written to a folder for each entity and tenant; what each folder holds is read back."""
    rows = points(spark, sf_dir).select("seq", F.when(F.col("seq") % 5 == 0, F.lit("HISTOGRAM")).otherwise(F.lit("POINT")).alias("entity"), F.when(F.col("tags")["k"] < "5", F.lit("central")).otherwise(F.lit("other")).alias("tenant"))
    path = scratch(spark, "fan-out")
    S.fan_out(rows, path)
    return spark.read.schema("seq long, entity string, tenant string").parquet(path).groupBy("entity", "tenant").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT CASE WHEN seq % 5 = 0 THEN 'HISTOGRAM' ELSE 'POINT' END AS entity, metric || ' ' || source AS line FROM points")
def r11_export(spark, sf_dir):
    """The spool as text, read back by entity."""
    path = scratch(spark, "export")
    entity = F.when(F.col("seq") % 5 == 0, F.lit("HISTOGRAM")).otherwise(F.lit("POINT"))
    S.export_lines(points(spark, sf_dir).select(entity.alias("entity"), F.concat_ws(" ", "metric", "source").alias("line")), path)
    return spark.read.schema("value string, entity string").text(path).select("entity", F.col("value").alias("line"))
