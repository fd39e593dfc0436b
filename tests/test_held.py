"""Tables carried between micro-batches: host tags and live series."""

import json
import math
import random

from pyspark.sql import functions as F

from tallyvane.streaming.held import with_host_tags, with_live_series

SAMPLE = "source string, ts_ms long, n int, tags map<string,string>, system_tags map<string,string>"


def plain_tags(batches, expiry, times):
    """By arrival: intake of earlier batches first, then that of the batch up to the sample's time."""
    last, out = {}, {}
    for rows, at in zip(batches, times):
        last = {s: x for s, x in last.items() if x[1] > at - expiry}
        came = sorted((r for r in rows if r[4] is not None and r[0] is not None and r[1] is not None), key=lambda r: (r[1], sorted(r[4].items())))
        for source, ts, n, tags, mark in rows:
            if mark is None:
                seen = last.get(source, ({}, 0))[0]
                for r in came:
                    seen = r[4] if r[0] == source and ts is not None and r[1] <= ts else seen
                out[n] = {**(seen if ts is not None and source is not None else {}), **tags}
        for r in came:
            last[r[0]] = (r[4], at)
    return out


def test_host_tags_by_arrival(spark, tmp_path):
    rng, batches, n = random.Random(7), [], 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            source, ts = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(0, 9_000_000, 450_000)])
            mark = {"rack": str(rng.randint(0, 5)), **({"own": "x"} if rng.random() < 0.3 else {})} if rng.random() < 0.3 else None
            rows.append((source, ts, None if mark else n, None if mark else {"own": "y"}, mark))
            n += 1
        batches.append([r for r in rows if not (r[0] == "b" and r[4] and len(batches) > 0)])
    batches.insert(2, [])
    times, got = [0, 100, 200, 300, 1150], {}
    tick = iter(times)

    def sink(rows, epoch):
        assert rows.columns == ["source", "ts_ms", "n", "tags"]
        for r in rows.collect():
            assert r.n not in got or epoch == 1
            got[r.n] = r.tags

    each = with_host_tags(str(tmp_path / "held"), sink, expiry_ms=1000, now=lambda: next(tick))
    for epoch, rows in enumerate(batches):
        each(spark.createDataFrame(rows, SAMPLE), epoch)
    want = plain_tags(batches, 1000, times)
    assert got == want and any("rack" in x for x in got.values())
    # a batch that is tried again gives the same
    again = with_host_tags(str(tmp_path / "other"), lambda rows, epoch: got.update({r.n: r.tags for r in rows.collect()}) if epoch == 1 else None, expiry_ms=1000, now=lambda: 0)
    for epoch in (0, 1, 1):
        again(spark.createDataFrame(batches[epoch], SAMPLE), epoch)
    assert got == want


def test_host_tags_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    each = with_host_tags(str(tmp_path / "held"), lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    steps = [[{"source": "h", "ts_ms": 9, "system_tags": {"env": "p"}}, {"source": "h", "ts_ms": 3, "n": 1, "tags": {}}], [{"source": "h", "ts_ms": 4, "n": 2, "tags": {"k": "v"}}, {"source": "g", "ts_ms": 4, "n": 3, "tags": {}}]]
    for k, rows in enumerate(steps):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SAMPLE).json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert {r.n: r.tags for r in spark.read.parquet(out).collect()} == {1: {}, 2: {"env": "p", "k": "v"}, 3: {}}


ROW = "matcher string, kind string, metric string, source string, tag_text string, value double, ts_ms long, seq int"


def test_live_series(spark, tmp_path):
    c = lambda m, value, seq=0, ts=0: (m, "counter", f"c.{m}", None, "", value, ts, seq)
    g = lambda value, ts, seq=0: ("g", "gauge", "level", "s", "k=v", value, ts, seq)
    hour = 3_600_000
    steps = [  # (now, matchers, rows, what is given)
        (0, "abg", [c("a", 1.0), c("a", 2.0), c("b", 5.0), g(7.0, 10, 1), g(8.0, 10, 2), g(math.nan, 11), g(None, 12), g(math.inf, 13), c("x", 1.0)], {"c.a": 3, "c.b": 5, "level": 8}),
        (10, "abg", [(None,) * 8], {"c.a": 3, "c.b": 5, "level": 8}),  # a tick of the clock: all are given again
        (hour - 1, "abg", [c("a", 1.0), g(1.0, 5)], {"c.a": 4, "c.b": 5, "level": 1}),  # the latest that came counts
        (hour + 10, "abg", [], {"c.a": 4, "level": 1}),  # nothing came for b
        (hour + 20, "bg", [c("b", 1.0), c("a", 9.0)], {"c.b": 1, "level": 1}),  # a was removed, b starts anew
        (hour + 30, "abg", [c("a", 2.0)], {"c.a": 2, "c.b": 1, "level": 1}),
        (3 * hour, "abg", [], {}),
    ]
    current, got = {}, []
    each = with_live_series(str(tmp_path), lambda: current["matchers"], lambda rows, epoch: got.append({r.metric: r.value for r in rows.collect()}), now=lambda: current["now"])
    for epoch, (at, matchers, rows, want) in enumerate(steps):
        current.update(now=at, matchers=list(matchers))
        for _ in range(2):  # the second time as if the batch had failed
            each(spark.createDataFrame(rows, ROW), epoch)
            assert got[-1] == want, epoch


def test_ingest_counts_what_it_writes(spark, tmp_path):
    from tallyvane.streaming.ingest import write_batch

    lines = ["m 1 1700000000 source=h"] * 5 + ["broken", "@Event 1 e", '@Event 1 e "bad key"=x'] + ["@Event"]
    counts = write_batch(spark.createDataFrame([(x,) for x in lines], "line string").repartition(3), [], str(tmp_path / "good"), str(tmp_path / "bad"))
    good = {e: spark.read.parquet(str(tmp_path / "good" / e)).count() for e in ("POINT", "EVENT")}
    bad = {r.entity: r.n for r in spark.read.parquet(str(tmp_path / "bad")).groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert counts == {e: (good[e], bad.get(e, 0)) for e in good} and counts["POINT"][0] == 5
