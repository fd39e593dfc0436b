"""Frames of log shippers (S10): binary payloads to messages, and batches that were sent again.

A payload is what a connection carried: frames of a version, a type and a body of that type, numbers with the most significant byte first.
A window tells how many messages the next batch has; messages are JSON, or pairs of texts in the first version; a compressed frame holds
frames, compressed ones too. A batch ends with its last message, or with a window that comes before that.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: The types of frames.
WINDOW, JSON, PAIRS, COMPRESSED = b"WJDC"
MESSAGE = "position int, batch int, window bigint, sequence bigint, message string, error string"
MAX_INFLATED = 256 << 20


class _Reader:
    """Numbers and bytes of a buffer from its start on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bytes(self, size: int) -> bytes:
        found = self.data[self.at : self.at + size]
        if len(found) < size:
            raise ValueError("payload ends within a frame")
        self.at += size
        return found

    def number(self) -> int:
        return struct.unpack(">I", self.bytes(4))[0]

    def text(self) -> str:
        return self.bytes(self.number()).decode("utf-8", "replace")


def messages(payload: bytes, max_inflated: int = MAX_INFLATED) -> Iterator[tuple]:
    """Rows of MESSAGE. What can't be read ends the payload with a row that has an error; the messages before it stay.

    Frames in frames wait in a list, so they may be as deep as they like; what all of them inflate to is bounded by max_inflated.
    """
    position, batch, window, held, inflated = 0, 0, None, 0, 0
    waiting = [_Reader(payload)]
    try:
        while waiting:
            reader = waiting[-1]
            if reader.at == len(reader.data):
                waiting.pop()
                continue
            _, kind = reader.bytes(2)
            if kind == WINDOW:
                batch, held, window = batch + (held > 0), 0, reader.number()
                continue
            if kind == COMPRESSED:
                unpacker = zlib.decompressobj()
                inner = unpacker.decompress(reader.bytes(reader.number()), max_inflated - inflated + 1)
                inflated += len(inner)
                if inflated > max_inflated:
                    raise ValueError(f"frames inflate to more than {max_inflated} bytes")
                if not unpacker.eof:
                    raise ValueError("compressed frame ends early")
                waiting.append(_Reader(inner))
                continue
            if kind not in (JSON, PAIRS):
                raise ValueError(f"unknown frame type {kind}")
            sequence, size = reader.number(), reader.number()
            if not size:
                raise ValueError("message without content")
            if kind == JSON:
                message = reader.bytes(size).decode("utf-8", "replace")
            else:
                message = json.dumps(dict([(reader.text(), reader.text()) for _ in range(size)]), ensure_ascii=False)
            yield position, batch, window, sequence, message, None
            position, held = position + 1, held + 1
            if held == window:
                batch, held, window = batch + 1, 0, None
    except (ValueError, zlib.error) as e:
        yield position, batch, window, None, None, str(e)


def _blocks(batches: Iterator[pa.RecordBatch], content: str, names: list[str], max_inflated: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Messages of the payloads of each batch, `rows` at most at a time."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for given in batches:
        kept = [given.column(c) for c in given.schema.names if c != content]
        found = ((k, *row) for k, payload in enumerate(given.column(content)) for row in messages(payload.as_py() or b"", max_inflated))
        while block := list(islice(found, rows)):
            of, *columns = zip(*block)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in kept), *(pa.array(x, t) for x, t in zip(columns, kinds))], names=names)


def decode_frames(payloads: DataFrame, content: str = "content", max_inflated: int = MAX_INFLATED, rows: int = 4096) -> DataFrame:
    """The other columns with the MESSAGE columns, a row for each message and for what ends a payload early.

    sequence is the shipper's own number, position the place in the payload; window is null for messages that no window announced.
    A null or empty payload gives nothing. Messages are handed on in blocks of `rows`, of many payloads together: a block costs more than a message.
    """
    others = [f for f in payloads.schema.fields if f.name != content]
    out = StructType([*others, *_parse_datatype_string(MESSAGE).fields])
    return payloads.mapInArrow(lambda batches: _blocks(batches, content, out.names, max_inflated, rows), out)


def drop_resent_batches(found: DataFrame, payload: list[str], by: list[str]) -> DataFrame:
    """Messages without those of batches that came before in another payload or the same one. payload: the columns that name a payload,
    by: those within which batches are compared (the shipper). A batch is known by its size, its greatest sequence number and its first
    message's @timestamp, log file and offset in it; batches without @timestamp are all kept, and so are rows with an error.

    Batches are compared by one row each, so what is grouped by identity is small however many messages there are.
    """
    get = lambda path: F.get_json_object("_message", path)
    file = F.when(get("$.log.offset").isNotNull(), get("$.log.file.path"))
    first = F.struct(get("$['@timestamp']").alias("stamp"), file.alias("file"), F.when(file.isNotNull(), get("$.log.offset")).alias("offset"))
    name = [*payload, "batch"]
    keys = list(dict.fromkeys([*by, *name]))
    batches = found.filter("error IS NULL").groupBy(*keys).agg(F.count("*").alias("_size"), F.max("sequence").alias("_last"), F.min_by("message", "position").alias("_message"))
    batches = batches.withColumn("_first", first).drop("_message")
    known = batches.filter("_first.stamp IS NOT NULL").groupBy(*[F.col(c).alias(f"_by{n}") for n, c in enumerate(by)], "_size", "_last", "_first")
    kept = known.agg(F.min(F.struct(*name)).alias("_kept"), F.count("*").alias("_times")).filter("_times > 1")
    same = [F.col(c).eqNullSafe(F.col(f"_by{n}")) for n, c in enumerate(by)] + [batches[c] == kept[c] for c in ("_size", "_last")] + [batches["_first"].eqNullSafe(kept["_first"])]
    again = batches.join(kept, reduce(and_, same)).filter(~F.struct(*name).eqNullSafe(F.col("_kept"))).select(*[F.col(c).alias(f"_n{n}") for n, c in enumerate(keys)])
    gone = [found["error"].isNull(), *(found[c].eqNullSafe(again[f"_n{n}"]) for n, c in enumerate(keys))]
    return found.join(again, reduce(and_, gone), "left_anti")
