"""Logs to metrics: grok patterns, templates, counters, gauges, histograms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T


class ConfigError(ValueError):
    """A logs-to-metrics configuration that can't be used."""


def load_patterns(text: str) -> dict[str, str]:
    """Patterns of a library file: `NAME pattern` lines, # for comments."""
    return {name: body for name, _, body in (line.strip().partition(" ") for line in text.splitlines() if line.strip() and not line.startswith("#"))}


#: The library that configurations name patterns of, in a file of its own.
PATTERNS = load_patterns(Path(__file__).with_name("grok_patterns.txt").read_text())


def compile_grok(pattern: str, patterns: dict[str, str] | None = None, depth: int = 0) -> tuple[str, dict[str, int]]:
    """L1: the Java pattern of a grok pattern, and the group number of each capture (the first of a name counts)."""
    known = PATTERNS | (patterns or {})

    def expand(text: str, level: int) -> str:
        if level > 20:
            raise ConfigError(f"pattern nests too deeply: {pattern}")

        def one(m: re.Match) -> str:
            name, capture = m[1], m[2]
            if name not in known:
                raise ConfigError(f"unknown pattern {name}")
            inner = expand(known[name], level + 1)
            return f"(?<{capture}>{inner})" if capture else f"(?:{inner})"

        return re.sub(r"%\{(\w+)(?::([\w.]+))?(?:;[^}]*)?\}", one, text)

    named = expand(pattern, depth)
    groups, number, out, i = {}, 0, [], 0
    while i < len(named):  # names may repeat, so captures become plain numbered groups
        c = named[i]
        if c == "\\":
            out.append(named[i : i + 2])
            i += 2
            continue
        if c == "[":
            end = i + 1 + (named[i + 1 : i + 2] == "^")
            end += named[end : end + 1] == "]"
            while named[end] != "]":
                end += 2 if named[end] == "\\" else 1
            out.append(named[i : end + 1])
            i = end + 1
            continue
        if c == "(":
            m = re.match(r"\(\?<([A-Za-z][\w.]*)>", named[i:])
            if m:
                number += 1
                groups.setdefault(m[1], number)
                out.append("(")
                i += m.end()
                continue
            if named[i + 1 : i + 2] != "?":
                number += 1
        out.append(c)
        i += 1
    return "".join(out), groups


@dataclass(frozen=True)
class Matcher:
    """One entry of a logs-to-metrics configuration."""

    pattern: str
    metric_name: str
    value_label: str = "value"
    host_name: str = ""
    tag_keys: tuple[str, ...] = ()
    tag_values: tuple[str, ...] = ()
    tag_value_labels: tuple[str, ...] = ()
    patterns: dict = field(default_factory=dict, hash=False)

    def check(self, needs_value: bool) -> None:
        """L9."""
        if not self.pattern or not self.metric_name:
            raise ConfigError("a matcher needs a pattern and a metric name")
        values = self.tag_values or self.tag_value_labels
        if self.tag_values and self.tag_value_labels:
            raise ConfigError("tagValues and tagValueLabels exclude each other")
        if len(self.tag_keys) != len(values):
            raise ConfigError("as many tag keys as tag values are needed")
        _, groups = compile_grok(self.pattern, self.patterns)
        if needs_value and self.value_label not in groups:
            raise ConfigError(f"the pattern has no capture {self.value_label}")
        if missing := [x for x in self.tag_value_labels if x not in groups]:
            raise ConfigError(f"the pattern has no capture {missing[0]}")


MARK = "\x01"


def _hit(line: str, regex: str, groups: dict[str, int]) -> tuple[Column, dict[str, Column]]:
    """Whether a line has a match that is not empty, and its captures; the regex runs once for all of them."""
    order = sorted(set(groups.values()))
    cut = MARK + MARK.join(["$1", *(f"${n + 1}" for n in order)])
    fields = F.split(F.regexp_replace(F.translate(line, MARK, " "), f"^(?s:.*?)({regex})(?s:.*)$", cut), MARK)
    capture = {k: F.coalesce(F.get(fields, F.lit(2 + order.index(n))), F.lit("")) for k, n in groups.items()}
    return F.coalesce(F.get(fields, F.lit(1)) != "", F.lit(False)), capture


def _metric_of(matcher: Matcher, line: str, host: Column, prefix: str) -> Column:
    """(metric, source, tags, value_text) of a line that matches, null of another one."""
    hit, capture = _hit(line, *compile_grok(matcher.pattern, matcher.patterns))

    def fill(template: str) -> Column:
        parts = re.split(r"(%\{[\w.]+\})", template)
        columns = [capture.get(p[2:-1], F.lit(p)) if p.startswith("%{") else F.lit(p) for p in parts if p]
        return F.concat(*columns) if columns else F.lit("")

    values = [fill(v) for v in matcher.tag_values] or [capture[v] for v in matcher.tag_value_labels]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(zip(matcher.tag_keys, values), key=lambda x: x[0])]) if values else F.array().cast(T.ANNOTATIONS)
    tags = F.map_from_entries(F.filter(entries, lambda e: F.trim(e["value"]) != ""))
    value = capture.get(matcher.value_label, F.lit(None).cast("string"))
    source = fill(matcher.host_name) if matcher.host_name else host
    return F.when(hit, F.struct(F.concat(F.lit(prefix), fill(matcher.metric_name)).alias("metric"), source.alias("source"), tags.alias("tags"), value.alias("value_text")))


def matched_all(lines: DataFrame, matchers: list[Matcher], line: str = "line", default_host: str = "unknown", prefix: str = "") -> DataFrame:
    """L1-L3: (own columns, matcher, metric, source, tags, value_text), a row for each matcher that a line matches, in one read
    of the lines. matcher: its number in the list. Unknown placeholders stay as they are."""
    host = F.col("source") if "source" in lines.columns else F.lit(default_host)
    found = F.array(*[F.struct(F.lit(n).alias("matcher"), _metric_of(m, line, host, prefix).alias("m")) for n, m in enumerate(matchers)])
    kept = [c for c in lines.columns if c != "source"]
    hits = lines.withColumn("_hit", F.explode(F.filter(found, lambda x: x["m"].isNotNull())))
    return hits.select(*kept, "_hit.matcher", "_hit.m.metric", "_hit.m.source", "_hit.m.tags", "_hit.m.value_text")


def matched(lines: DataFrame, matcher: Matcher, line: str = "line", default_host: str = "unknown", prefix: str = "") -> DataFrame:
    """L1-L3 of one matcher: (own columns, metric, source, tags, value_text)."""
    return matched_all(lines, [matcher], line, default_host, prefix).drop("matcher")


SERIES = ["metric", "source", "tags"]


def _series(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", T.canonical(F.col("tags")))


def counters(rows: DataFrame, window_ms: int | None = None, ts: str = "ts_ms", prefix_delta: bool = True) -> DataFrame:
    """L4: the sum of rounded values (1 where a line has none) by series, and by flush window if given; a zero sum is suppressed."""
    value = F.coalesce(F.floor(F.col("value_text").try_cast("double") + 0.5), F.lit(1)).cast("long")
    keys = SERIES + (["flush_ms"] if window_ms else [])
    rows = _series(rows).withColumn("_n", value)
    if window_ms:
        rows = rows.withColumn("flush_ms", (F.floor(F.col(ts) / window_ms) + 1).cast("long") * window_ms)
    out = rows.groupBy(*keys).agg(F.sum("_n").alias("value")).filter("value <> 0")
    return out.withColumn("metric", F.concat(F.lit("∆"), "metric")) if prefix_delta else out


def gauges(rows: DataFrame, order: Column) -> DataFrame:
    """The last value by series; values that are not finite numbers are left out."""
    value = F.col("value_text").try_cast("double")
    good = _series(rows).withColumn("_v", value).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != F.lit(float("inf"))))
    return good.groupBy(*SERIES).agg(F.max_by("_v", order).alias("value"))


def histogram_bins(rows: DataFrame, duration_ms: int = 60_000, ts: str = "ts_ms") -> DataFrame:
    """Counted values of each completed bin by series."""
    start = (F.floor(F.col(ts) / duration_ms) * duration_ms).cast("long")
    good = _series(rows).withColumn("mean", F.col("value_text").try_cast("double")).filter("mean IS NOT NULL")
    return good.withColumn("bin_start_ms", start).groupBy(*SERIES, "bin_start_ms", "mean").agg(F.count("*").alias("count"))


#: Names of a histogram's derived metrics with their quantiles.
QUANTILES = {"median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def histogram_statistics(rows: DataFrame, exact: bool = True) -> DataFrame:
    """(series with suffix, value): count, min, max, mean and quantiles of a histogram's values. Exact quantiles keep a
    series' distinct values in one task; approximate ones a bounded summary."""
    quantile = F.percentile if exact else lambda c, q: F.percentile_approx(c, q, 10_000)
    good = _series(rows).withColumn("_v", F.col("value_text").try_cast("double")).filter("_v IS NOT NULL")
    named = {"count": F.count("_v").cast("double"), "min": F.min("_v"), "max": F.max("_v"), "mean": F.avg("_v")} | {k: quantile("_v", q) for k, q in QUANTILES.items()}
    wide = good.groupBy(*SERIES).agg(*[c.alias(k) for k, c in named.items()])
    parts = F.array(*[F.struct(F.lit(f".{k}").alias("suffix"), F.col(k).alias("value")) for k in named])
    out = wide.select(*SERIES, F.explode(parts).alias("p")).filter("NOT isnan(p.value)")
    return out.select(F.concat("metric", "p.suffix").alias("metric"), "source", "tags", F.col("p.value").alias("value"))


def parse_config(raw: dict) -> dict[str, list[Matcher]]:
    """Matchers by kind (counters, gauges, histograms) of a configuration dictionary, checked."""
    extra = load_patterns("\n".join(raw.get("additionalPatterns", [])))
    out = {}
    for kind in ("counters", "gauges", "histograms"):
        out[kind] = [
            Matcher(m.get("pattern", ""), m.get("metricName", ""), m.get("valueLabel", "value"), m.get("hostName", ""), tuple(m.get("tagKeys", ())), tuple(m.get("tagValues", ())), tuple(m.get("tagValueLabels", ())), extra)
            for m in raw.get(kind) or []
        ]
        for m in out[kind]:
            m.check(kind != "counters")
    return out


def decode_logs(lines: DataFrame, line: str = "line", message_keys: tuple[str, ...] = ("message", "text"), time_keys: tuple[str, ...] = ("timestamp", "log_timestamp"), source_keys: tuple[str, ...] = ("source", "host", "hostname"), default_source: str = "unknown") -> DataFrame:
    """Logs of JSON objects: name (the message), source, ts_ms and annotations of what else the object has, sorted by key, and
    error for what is no object. The first of each list of keys that is there counts; no time is the time of reading."""
    out = lines.withColumn("_m", F.when(F.ltrim(line).startswith("{"), F.from_json(line, "map<string,string>")))
    first = lambda keys: F.coalesce(*[F.col("_m")[k] for k in keys])
    stamp = F.when(first(time_keys).rlike(r"^\d+$"), T.millis_by_digits(first(time_keys)))
    rest = T.canonical(F.map_filter("_m", lambda k, v: ~k.isin(*message_keys, *time_keys, *source_keys) & v.isNotNull()))
    return out.select(
        *lines.columns, first(message_keys).alias("name"), F.coalesce(first(source_keys), F.lit(default_source)).alias("source"), F.coalesce(stamp, F.unix_millis(F.current_timestamp())).alias("ts_ms"),
        F.coalesce(rest.cast(T.ANNOTATIONS), F.array().cast(T.ANNOTATIONS)).alias("tags"), F.when(F.col("_m").isNull(), F.lit("not a JSON object")).alias("error"),
    )


def filebeat_lines(messages: DataFrame, body: str = "body", fallback_host: str = "unknown") -> DataFrame:
    """(line, ts_ms, source, error) of shipped log messages; the host comes from beat.hostname, host.name or agent.hostname."""
    get = lambda path: F.get_json_object(F.col(body), path)
    out = messages.select(
        *messages.columns, get("$.message").alias("line"), F.unix_millis(F.try_to_timestamp(get("$['@timestamp']"))).alias("ts_ms"),
        F.coalesce(get("$.beat.hostname"), get("$.host.name"), get("$.agent.hostname"), F.lit(fallback_host)).alias("source"),
    )
    return out.withColumn("error", F.when(F.col("line").isNull() | F.col("ts_ms").isNull(), F.lit("message or timestamp is missing")))
