"""Telemetry views over the star-schema tables, in Spark and in SQL (as common table expressions of the oracles)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; only a local master gets a local one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/tallyvane-shared"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: metric, source, ts_ms, value, tags {k}, and seq as the order of arrival."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("event."), "event_type").alias("metric"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        T.epoch_millis(F.col("ts")).alias("ts_ms"), "value", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"),
    )


POINTS = """points AS (
  SELECT event_id AS seq, 'event.' || event_type AS metric, 'user-' || user_id AS source, epoch_us(ts) // 1000 AS ts_ms, value,
    json_extract_string(props, '$.k') AS k
  FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as records of the rules: name, source, tags."""
    return points(spark, sf_dir).withColumnRenamed("metric", "name")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans of their order's trace."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    pairs = F.array(
        T.annotation("application", F.concat(F.lit("app-"), "l_returnflag")), T.annotation("service", F.concat(F.lit("svc-"), "l_linestatus")),
        T.annotation("error", F.when(F.col("l_discount") > 0.08, F.lit("true"))), T.annotation("debug", F.when(F.col("l_linenumber") == 7, F.lit("true"))),
    )
    return i.join(o, i.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("name"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("source"), T.uuid_of_hex(F.md5(F.col("l_orderkey").cast("string").cast("binary"))).alias("trace_id"),
        T.uuid_of_hex(F.md5(key.cast("binary"))).alias("span_id"), (T.epoch_millis(F.col("o_orderdate")) + F.col("l_linenumber") * 1000).alias("start_ms"), F.col("l_quantity").cast("long").alias("duration_ms"),
        F.filter(pairs, lambda a: a["value"].isNotNull()).alias("annotations"),
    )


def _uuid_sql(text: str) -> str:
    return f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


SPANS = f"""spans AS (
  SELECT o_orderpriority AS name, 'supplier-' || l_suppkey AS source, {_uuid_sql("CAST(l_orderkey AS VARCHAR)")} AS trace_id,
    {_uuid_sql("l_orderkey || '-' || l_linenumber")} AS span_id, epoch_us(o_orderdate) // 1000 + l_linenumber * 1000 AS start_ms,
    CAST(l_quantity AS BIGINT) AS duration_ms, 'app-' || l_returnflag AS application, 'svc-' || l_linestatus AS service,
    l_discount > 0.08 AS error, l_linenumber = 7 AS debug
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as delta counters of their supplier, stamped by the shipping date."""
    i, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return i.join(s, i.l_suppkey == s.s_suppkey).select(
        F.lit("∆item.qty").alias("metric"), F.col("s_name").alias("source"), T.epoch_millis(F.col("l_shipdate")).alias("ts_ms"), (F.col("l_quantity") - 25).alias("value"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("tags"),
    )


def source_tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source tag changes of their customer: SAVE, ADD or DELETE by the status, the priority as tag."""
    o = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderkey") % 5 == 0, F.lit("SAVE")).when(F.col("o_orderstatus") == "O", F.lit("DELETE")).otherwise(F.lit("ADD"))
    return o.select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.col("o_orderpriority").alias("tag"))


CHANGES = """changes AS (
  SELECT CAST(o_custkey AS VARCHAR) AS source, o_orderkey AS seq,
    CASE WHEN o_orderkey % 5 = 0 THEN 'SAVE' WHEN o_orderstatus = 'O' THEN 'DELETE' ELSE 'ADD' END AS action, o_orderpriority AS tag
  FROM orders)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: operations with a time and two places, plain counters and gauges."""
    p = points(spark, sf_dir)
    kind = F.col("seq") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("operation "), F.substring_index("metric", ".", -1), F.lit(" took "), F.floor(F.abs("value")).cast("string"), F.lit(" seconds in DC="), F.col("source"), F.lit(" AZ=az"), F.col("tags")["k"]))
        .when(kind == 1, F.concat(F.lit("plainCounter of "), F.col("source")))
        .otherwise(F.concat(F.lit("gauges "), F.floor("value").cast("string")))
    )
    return p.select("seq", "ts_ms", F.lit("host").alias("source"), text.alias("line"))
