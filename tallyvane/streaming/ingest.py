"""The ingest path of a port, the same for a batch of lines and for a stream of them.

Lines are dispatched by format (their own, or one a `format` column gives), decoded to the entity of the format, changed
by the line rules and then the rules of their kind in order, and validated. Nothing is lost on the way: every line comes
out as accepted or rejected with its reason. Accepted rows have a folder for each entity; what is rejected goes to one
dead-letter table. On a stream each micro-batch reads the rules again, and a batch that is tried twice replaces what it
wrote the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tags as T
from ..operators import lines as L
from ..operators import logs as G
from ..operators import rules as R
from ..operators import validate as V
from ..operators.enrich import span_logs_with_decision
from ..sources import wire as S

POINT_COLUMNS = ["name", "source", "ts_ms", "value", "tags"]
#: Columns of accepted rows by entity.
COLUMNS = {
    "POINT": POINT_COLUMNS,
    "HISTOGRAM": ["name", "source", "bin_start_ms", "duration_ms", "centroids", "tags"],
    "SPAN": ["name", "source", "span_id", "trace_id", "start_ms", "duration_ms", "tags"],
    "SPAN_LOG": ["span_id", "trace_id", "secondary_id", "logs", "span"],
    "EVENT": ["name", "start_ms", "end_ms", "hosts", "event_tags", "annotations", "dimensions"],
    "SOURCE_TAG": ["operation", "action", "source", "values"],
    "LOG": ["name", "source", "ts_ms", "tags"],
}
#: Entities by format; other formats are points.
ENTITIES = {"HISTOGRAM": "HISTOGRAM", "SPAN": "SPAN", "SPAN_LOG": "SPAN_LOG", "EVENT": "EVENT", "SOURCE_TAG": "SOURCE_TAG", "LOGS_JSON_ARR": "LOG", "LOGS_JSON_LINES": "LOG", "LOGS_JSON_CLOUDWATCH": "LOG"}
Rules = list[R.Rule | dict]


def dispatched(lines: DataFrame) -> DataFrame:
    """(line, entity, format, _undecoded) of lines, with a format column or without."""
    found = L.dispatch(lines.select("line", *(F.col(c).alias("_given") for c in lines.columns if c == "format")))
    given = F.coalesce(F.col("_given"), F.col("format")) if "format" in lines.columns else F.col("format")
    entity = F.coalesce(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])[given], F.lit("POINT"))
    return found.select("line", entity.alias("entity"), given.alias("format"), F.col("error").alias("_undecoded"))


def _split_rules(rules: Rules, kind: str) -> tuple[Rules, Rules]:
    """The kind's rules over whole lines, and its others."""
    own = [r for r in (r if isinstance(r, R.Rule) else R.parse(r) for r in rules) if r.kind == kind]
    of_line = [R.SCOPES.get(r.arguments.get("scope", r.arguments.get("source", ""))) == "line" for r in own]
    return [r for r, x in zip(own, of_line) if x], [r for r, x in zip(own, of_line) if not x]


def _ruled_lines(some: DataFrame, line_rules: Rules, kind: str) -> DataFrame:
    """(line, _before): lines after their rules, with what speaks against them so far."""
    tags = F.array().cast(T.ANNOTATIONS) if kind != "point" else T.empty_tags()
    ruled = R.apply_rules(some.withColumns({"name": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "tags": tags}), line_rules, kind)
    return ruled.select("line", F.coalesce("_undecoded", F.when(F.col("status").isNotNull(), F.col("reason"))).alias("_before"))


def _entity(some: DataFrame, rules: Rules, entity: str, kind: str, decode: Callable[[DataFrame], DataFrame], invalid: Callable[[], Column]) -> DataFrame:
    line_rules, own_rules = _split_rules(rules, kind)
    decoded = decode(_ruled_lines(some, line_rules, kind)).withColumnRenamed("error", "_error")
    for old, new in (("metric", "name"), ("annotations", "tags")):
        if new not in decoded.columns:
            decoded = decoded.withColumnRenamed(old, new)
    changed = R.apply_rules(decoded, own_rules, kind)
    reason = F.coalesce("_before", "_error", F.when(F.col("status").isNotNull(), F.col("reason")), invalid())
    return V.with_status(changed.withColumn("_why", reason), F.col("_why")).select("line", *COLUMNS[entity], "status", "reason")


def _span_logs(some: DataFrame, rules: Rules, sampled: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Span logs, changed and judged by the span line they hold."""
    line_rules, own_rules = _split_rules(rules, "span")

    def ruled(spans: DataFrame) -> DataFrame:
        out = R.apply_rules(spans.withColumns({"tags": F.col("annotations"), "line": F.col("_line")}), [*line_rules, *own_rules], "span")
        return out.withColumn("annotations", F.col("tags"))

    all_of_them = lambda spans: spans.withColumns({"keep": F.lit(True), "policy": F.lit(None).cast("string")})
    decoded = L.decode_span_logs(some.select("line", "_undecoded")).withColumnRenamed("error", "_error")
    judged = span_logs_with_decision(decoded, sampled or all_of_them, ruled)
    return V.with_status(judged, F.coalesce("_undecoded", "_error", "error")).select("line", *COLUMNS["SPAN_LOG"], "status", "reason")


def _log_lines(some: DataFrame) -> DataFrame:
    """One line for each log of a body; a body that holds none is a line of its own, to be reported."""
    fmt, body = F.col("format"), some.withColumn("body", F.col("line"))
    parts = {"LOGS_JSON_ARR": S.json_array_lines, "LOGS_JSON_LINES": S.json_lines, "LOGS_JSON_CLOUDWATCH": S.cloudwatch_lines}
    held = {"LOGS_JSON_ARR": F.from_json("line", "array<string>"), "LOGS_JSON_CLOUDWATCH": F.from_json(F.get_json_object("line", "$.logEvents"), "array<string>")}
    good = None
    for name, lines_of in parts.items():
        own = body.filter(fmt == name)
        broken = held[name].isNull() if name in held else F.lit(False)
        cut = lines_of(own.filter(~broken)).select("line", "_undecoded").unionByName(own.filter(broken).select("line", F.coalesce("_undecoded", F.lit("no list of logs")).alias("_undecoded")))
        good = cut if good is None else good.unionByName(cut)
    return good


def rows_of_entity(some: DataFrame, rules: Rules, entity: str, sampled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The entity's columns with line, status (accepted or rejected) and reason, of its dispatched lines. sampled adds keep and
    policy to the spans that span logs hold; logs of spans that don't stay are left out, as the sampler has them."""
    some = some.filter(F.col("entity") == entity)
    col = F.col
    if entity == "SPAN_LOG":
        return _span_logs(some, rules, sampled)
    if entity == "LOG":
        return _entity(_log_lines(some), rules, entity, "log", G.decode_logs, lambda: V.annotations_error(col("name"), col("source"), col("tags"), "message", max_name=1 << 20))
    if entity == "SPAN":
        return _entity(some, rules, entity, "span", L.decode_spans, lambda: V.annotations_error(col("name"), col("source"), col("tags"), "span name"))
    if entity in ("POINT", "HISTOGRAM"):
        decode = L.decode_points if entity == "POINT" else L.decode_histograms
        return _entity(some, rules, entity, "point", decode, lambda: V.point_error(col("name"), col("source"), col("tags")))
    decode, keys = (L.decode_events, F.map_keys("annotations")) if entity == "EVENT" else (L.decode_source_tags, F.when(col("operation") == "SOURCE_TAG", col("values")))
    decoded = decode(some.select("line", "_undecoded"))
    return V.with_status(decoded, F.coalesce("_undecoded", "error", V.key_error(keys))).select("line", *COLUMNS[entity], "status", "reason")


def points_of_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """Columns of points with line, status (accepted or rejected) and reason, for every point line."""
    return rows_of_entity(dispatched(lines), rules, "POINT")


def write_batch(lines: DataFrame, rules: Rules, accepted: str, dead_letters: str, epoch: int = 0) -> dict[str, tuple[int, int]]:
    """Accepted rows to <accepted>/<entity>/epoch=<n>, rejected lines to <dead_letters>/entity=<entity>/epoch=<n>; only entities the batch has.

    Gives V3's counts by entity, (accepted, rejected), observed by the writes themselves.
    """
    some, counts = dispatched(lines).persist(), {}
    try:
        present = [r.entity for r in some.select("entity").distinct().collect()]  # seven at most
        for entity in present:
            rows = rows_of_entity(some, rules, entity).persist()
            good, bad = V.split(rows)
            seen = [Observation(), Observation()]
            good.select(*COLUMNS[entity]).observe(seen[0], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{accepted}/{entity}/epoch={epoch}")
            bad.select("line", "status", "reason").observe(seen[1], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{dead_letters}/entity={entity}/epoch={epoch}")
            counts[entity] = (seen[0].get["n"], seen[1].get["n"])
            rows.unpersist()
    finally:
        some.unpersist()
    return counts


def start_ingest(
    lines: DataFrame, rule_file: str, port: str, accepted: str, dead_letters: str, checkpoint: str, once: bool = False, interval: str = "1 second", counted: Callable[[int, dict[str, tuple[int, int]]], None] | None = None
) -> StreamingQuery:
    """Run the path on a stream of lines; once: over what there is, then stop. counted takes each batch's number and counts."""
    rules = R.RuleFile(rule_file)

    def each(batch: DataFrame, epoch: int) -> None:
        counts = write_batch(batch, rules.for_port(port), accepted, dead_letters, epoch)
        if counted:
            counted(epoch, counts)

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
