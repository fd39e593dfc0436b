"""Sinks: fan-out by entity and tenant, payloads, responses, dead letters."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is done for a response status; others are tried again.
ACTIONS = {406: "pushback", 429: "pushback", 401: "removed", 403: "removed", 407: "retry", 408: "retry", 413: "split"}
RETRY_LIMIT = {"SOURCE_TAG": 15}
LOG_ENTITIES = ("LOGS",)


def fan_out(rows: DataFrame, path: str, entity: str = "entity", tenant: str = "tenant") -> None:
    """One folder for each entity and tenant."""
    rows.write.mode("append").partitionBy(entity, tenant).parquet(path)


def line_payloads(rows: DataFrame, line: str, batch: list[str], order: str) -> DataFrame:
    """R2: newline-joined payloads of batches; a batch has a bounded number of rows, so it is a small group."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return rows.groupBy(*batch).agg(joined.alias("payload"), F.count("*").alias("n"))


def json_payloads(rows: DataFrame, batch: list[str], order: str) -> DataFrame:
    """JSON array payloads of batches."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[c for c in rows.columns if c not in batch]).alias("item"))))
    return rows.groupBy(*batch).agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("payload"), F.count("*").alias("n"))


def source_tag_calls(changes: DataFrame) -> DataFrame:
    """Method and path of the calls for source tag changes: one for each added or deleted tag, one with the list for SAVE."""
    one = F.concat(F.lit("/v2/source/"), "source", F.lit("/tag/"), "tag")
    single = changes.filter("action <> 'SAVE'").select("source", "seq", F.when(F.col("action") == "ADD", F.lit("PUT")).otherwise(F.lit("DELETE")).alias("method"), one.alias("path"), F.lit(None).cast("string").alias("payload"))
    saves = changes.filter("action = 'SAVE'").groupBy("source", "seq").agg(F.to_json(F.array_sort(F.collect_set("tag"))).alias("payload"))
    return single.unionByName(saves.select("source", "seq", F.lit("POST").alias("method"), F.concat(F.lit("/v2/source/"), "source", F.lit("/tag")).alias("path"), "payload"))


def response_action(status: Column, entity: Column, attempts: Column) -> Column:
    """Delivered, pushback, removed, retry or split; refused logs are dropped, and some entities give up after a limit."""
    known = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    limit = F.create_map(*[F.lit(x) for kv in RETRY_LIMIT.items() for x in kv])[entity]
    action = F.when(status.between(200, 299), F.lit("delivered")).when((status == 429) & entity.isin(*LOG_ENTITIES), F.lit("dropped")).otherwise(F.coalesce(known[status], F.lit("retry")))
    return F.when(action.isin("retry", "pushback") & (attempts >= limit), F.lit("removed")).otherwise(action)


def backoff_seconds(failures: Column, interval: float, base: float = 2.0, jitter: Column | None = None) -> Column:
    """(1 + jitter) * interval * base ^ min(failures, 4)."""
    return (1 + (jitter if jitter is not None else F.rand())) * interval * F.pow(F.lit(base), F.least(failures, F.lit(4)))


def keep_draining(failures: Column) -> Column:
    """A backlog is left alone after ten failures on end."""
    return failures < 10


def _action(status: int, entity: str, tried: int, attempts: int) -> str:
    """R4 of one answer, by the same tables as response_action."""
    if 200 <= status < 300:
        return "delivered"
    if status == 429 and entity in LOG_ENTITIES:
        return "dropped"
    action = ACTIONS.get(status, "retry")
    return "removed" if action in ("retry", "pushback") and tried >= min(attempts, RETRY_LIMIT.get(entity, attempts)) else action


def deliver(payloads: DataFrame, post: Callable[[str], int], dead_letters: str, entity: str = "entity", attempts: int = 3, wait_seconds: float = 0.0) -> DataFrame:
    """Post payloads from the executors by the actions of their answers; those given up go to a folder of this call
    in the dead-letter table and are returned, with the last status and the action. Refused logs are dropped.

    post(payload) returns a status; it is called at least once for each payload, again after a lost task. wait_seconds: the
    interval that a retry's wait grows from.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                kind, waiting = getattr(row, entity), [(row.payload, 0)]
                while waiting:
                    text, tried = waiting.pop()
                    if tried and wait_seconds:
                        time.sleep(wait_seconds * 2 ** min(tried, 4))
                    status = post(text)
                    action = _action(status, kind, tried + 1, attempts)
                    if action == "split" and "\n" in text:
                        lines = text.split("\n")
                        half = -(-len(lines) // 2)
                        waiting += [("\n".join(lines[half:]), 0), ("\n".join(lines[:half]), 0)]
                    elif action in ("retry", "pushback"):
                        waiting.append((text, tried + 1))
                    elif action not in ("delivered", "dropped"):
                        rows.append((kind, text, status, "removed" if action == "split" else action))
            yield pd.DataFrame(rows, columns=[entity, "payload", "last_status", "action"])

    failed = payloads.select(entity, "payload").mapInPandas(run, f"{entity} string, payload string, last_status int, action string")
    path = f"{dead_letters.rstrip('/')}/delivery={uuid.uuid4().hex}"
    failed.write.parquet(path)
    return payloads.sparkSession.read.schema(failed.schema).parquet(path)


def export_lines(spool: DataFrame, path: str, entity: str = "entity", line: str = "line") -> None:
    """The spool as text, a folder for each entity."""
    spool.select(entity, F.col(line).alias("value")).write.mode("overwrite").partitionBy(entity).text(path)


def discard(rows: DataFrame) -> None:
    """R12."""
    rows.write.format("noop").mode("overwrite").save()
