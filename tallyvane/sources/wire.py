"""Sources of wire payloads (S1-S16): framing, bodies, envelopes, shipped-log frames and pickled points."""

from __future__ import annotations

import io
import pickle
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, max_length: int = 32_768, whole: bool = False) -> DataFrame:
    """(line) of text files, gzip included; longer lines are left out. whole: each file is one body."""
    rows = spark.read.text(path, wholetext=whole).select(F.col("value").alias("body" if whole else "line"))
    return rows if whole else rows.filter(F.char_length("line") <= max_length)


def stream_lines(spark: SparkSession, path: str, max_length: int = 32_768, files_per_trigger: int = 100) -> DataFrame:
    """S1, S2 as a stream of new files."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.col("value").alias("line")).filter(F.char_length("line") <= max_length)


def body_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """S3: the trimmed lines of a body that are not empty."""
    return bodies.withColumn("line", F.explode(F.split(body, "\n"))).withColumn("line", F.trim("line")).filter("line <> ''")


def json_array_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One line for each element of a JSON array."""
    return bodies.withColumn("line", F.explode(F.from_json(body, "array<string>")))


def json_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One line for each of a body's JSON values, on lines of their own or just one after the other."""
    # quotes part the body into what is outside of strings (even places) and inside; escapes stand aside meanwhile
    aside = F.replace(F.replace(F.col(body), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    pieces = F.transform(F.split(aside, '"'), lambda x, n: F.when(n % 2 == 0, F.regexp_replace(x, r"\}\s*\{", "}\n{")).otherwise(x))
    cut = F.replace(F.replace(F.array_join(pieces, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return body_lines(bodies.withColumn(body, cut), body)


def cloudwatch_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The elements of logEvents; what stands beside them is left out."""
    return bodies.withColumn("line", F.explode(F.from_json(F.get_json_object(body, "$.logEvents"), "array<string>")))


#: Formats by the value of the request's f or format parameter; others are the default format.
FORMATS = {"histogram": "HISTOGRAM", "trace": "SPAN", "spanLogs": "SPAN_LOG", "logs_json_arr": "LOGS_JSON_ARR", "logs_json_lines": "LOGS_JSON_LINES", "logs_json_cloudwatch": "LOGS_JSON_CLOUDWATCH"}


def format_of_uri(uri: Column) -> Column:
    """S7."""
    full = F.concat(F.lit("http://h"), uri)
    asked = F.coalesce(F.parse_url(full, F.lit("QUERY"), F.lit("f")), F.parse_url(full, F.lit("QUERY"), F.lit("format")))
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[asked]


RELAYED = ("DEFAULT", "HISTOGRAM", "SPAN", "SPAN_LOG")
DATADOG_PATHS = {"/api/v1/series": "series", "/api/v2/series": "series_v2", "/api/v1/check_run": "check", "/api/v1/validate": "validate", "/intake": "intake"}


def relay_filter(lines: DataFrame, fmt: str = "format") -> tuple[DataFrame, DataFrame]:
    """What a relay accepts (points, histograms, spans, span logs), and events and source tags with an error."""
    ok = F.col(fmt).isin(*RELAYED)
    return lines.filter(ok), lines.filter(~F.coalesce(ok, F.lit(False))).withColumn("error", F.concat(F.lit("relay does not take "), F.col(fmt)))


def datadog_route(path: Column) -> Column:
    """The kind of a DataDog request by its path; others are `ignored`."""
    kinds = F.create_map(*[F.lit(x) for kv in DATADOG_PATHS.items() for x in kv])
    return F.coalesce(kinds[F.regexp_replace(path, "/+$", "")], F.lit("ignored"))


def drop_repeated_batches(frames: DataFrame, keys: list[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One of each repeated frame; on a stream with ts, within the delay."""
    if ts and frames.isStreaming:
        return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return frames.dropDuplicates(keys)


class _Plain(pickle.Unpickler):
    """Numbers, text, tuples and lists only: nothing is imported."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def pickled_points(payload: bytes, max_size: int = 16 << 20) -> Iterator[tuple[str | None, int | None, float | None, str | None]]:
    """(name, seconds, value, error) of frames with a 4-byte big-endian length, each a pickled list of (name, (time, value)).

    A frame that is too large, can't be read or ends early gives one row with an error; the frames after it are read.
    """
    at = 0
    while at < len(payload):
        if at + 4 > len(payload):
            yield None, None, None, "payload ends within a length"
            return
        (size,) = struct.unpack_from(">I", payload, at)
        frame = payload[at + 4 : at + 4 + size]
        at += 4 + size
        if len(frame) < size:
            yield None, None, None, f"frame of {size} bytes ends after {len(frame)}"
            return
        if size > max_size:
            yield None, None, None, f"frame of {size} bytes is longer than {max_size}"
            continue
        try:
            rows = [(str(name), int(ts), float(value), None) for name, (ts, value) in _Plain(io.BytesIO(frame)).load()]
        except (pickle.UnpicklingError, ValueError, TypeError, EOFError, IndexError, AttributeError, KeyError, OverflowError) as e:
            rows = [(None, None, None, f"frame can't be read: {e}")]
        yield from rows


def decode_pickles(files: DataFrame, content: str = "content") -> DataFrame:
    """Points of pickle payloads, such as spark.read.format('binaryFile') gives, and an error for each frame that is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                rows = list(pickled_points(payload or b""))
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([None if r[1] is None else r[1] * 1000 for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.string())], names=["metric", "ts_ms", "value", "error"])

    return files.select(content).mapInArrow(run, "metric string, ts_ms long, value double, error string")
