"""Conflict-constrained best-fit packing of texts into bins of a fixed number of words.

A text longer than a bin is cut into pieces of a whole bin and a rest. Pieces are dealt to shards by a
hash of document and piece (so no source, cluster or document makes a shard large), and each shard is
packed in falling size. Bins stand in residual order and carry two bitmaps, of their sources and of
their duplicate clusters. A piece takes the tightest bin that fits and holds neither its source nor its cluster;
successor search goes on to the next larger residual until one is compatible, else a bin is opened. Bins of one residual are kept by source bitmap, so a
residual whose bins all hold a common source costs one step for each distinct bitmap, not for each bin.

The shard count follows the number of pieces, so a shard's work is the same at every input size. Rows without a doc_id
are dealt by where they were read, not by their id; a task holds two shards' worth of pieces at most, whatever repeats.
Texts are read once, for their sizes and keys, which are written to the shared folder.
Null and wordless texts take one piece of no words, which any compatible bin holds. A null source or
cluster conflicts with nothing. Rows repeated with the same id are packed each by itself and, being of
one cluster, never share a bin. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

CAPACITY = 1024
#: Pieces of a shard on average; 4096 or fewer, as bin_id has 13 bits for the bins of twice as many.
SHARD_PIECES = 2048


class Shard:
    """Bins of one shard, by residual and then by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.filled = 0  # bit r: some bin has residual r
        self.bins: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(capacity + 1)]
        self.count = 0

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece. source and cluster: one bit each, or 0 where there is no conflict."""
        open_residuals = self.filled >> size
        residual = size
        while open_residuals:
            step = (open_residuals & -open_residuals).bit_length() - 1
            residual += step
            groups = self.bins[residual]
            for sources, group in groups.items():
                if sources & source:
                    continue
                for k in range(len(group) - 1, -1, -1):
                    number, clusters = group[k]
                    if not clusters & cluster:
                        group[k] = group[-1]
                        group.pop()
                        if not group:
                            del groups[sources]
                            if not groups:
                                self.filled &= ~(1 << residual)
                        self._put(number, residual - size, sources | source, clusters | cluster)
                        return number, self.capacity - residual
            open_residuals >>= step + 1
            residual += 1
        number, self.count = self.count, self.count + 1
        self._put(number, self.capacity - size, source, cluster)
        return number, 0

    def _put(self, number: int, residual: int, sources: int, clusters: int) -> None:
        self.bins[residual].setdefault(sources, []).append((number, clusters))
        self.filled |= 1 << residual


def pack_shard(size: np.ndarray, source: list, cluster: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, packed in the given order."""
    source_bits: dict = {}
    cluster_bits: dict = {}
    counts = pd.Series(cluster).value_counts()
    shared = set(counts.index[counts > 1])  # only clusters met twice can conflict
    shard, bins, offsets = Shard(capacity), [], []
    for n, s, c in zip(size.tolist(), source, cluster):
        bit = 0 if s is None else source_bits.setdefault(s, 1 << len(source_bits))
        mark = 0 if c not in shared else cluster_bits.setdefault(c, 1 << len(cluster_bits))
        number, offset = shard.place(n, bit, mark)
        bins.append(number)
        offsets.append(offset)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of exact copies but for case and white space at the ends; two hashes, as good as the text itself."""
    plain = F.lower(F.trim(text))
    return F.when(text.isNotNull(), F.concat_ws("-", F.xxhash64(plain), F.crc32(plain.cast("binary"))))


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, n_words, bin_id, bin_offset) of every piece; only sizes and keys are shuffled, never texts."""
    rows = docs.select("doc_id", size.cast("long").alias("_n"), source.cast("string").alias("_s"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("_c"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_at"))
    rows = materialise(rows, "packing-sizes")
    whole = F.when(F.col("_n") > capacity, F.floor((F.col("_n") - 1) / capacity)).otherwise(0)
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), whole.cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "_at", "piece", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias("n_words"), "_s", "_c")
    total = rows.agg(F.sum(whole + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "_at", "piece", "n_words"), F.lit(shards)).cast("int")).drop("_at")
    tasks = min(shards, 4 * shuffle_partitions(docs.sparkSession))  # a task takes its shards one after the other
    dealt = dealt.repartition(tasks, "_shard").sortWithinPartitions("_shard", F.desc("n_words"), "doc_id", "piece", "_s", "_c")
    most = 2 * shard_pieces

    def finish(shard: int, run_of: int, part: pd.DataFrame) -> pd.DataFrame:
        source = [x if isinstance(x, str) else None for x in part["_s"]]
        cluster = [None if pd.isna(x) else int(x) for x in part["_c"].array]
        bins, offsets = pack_shard(part["n_words"].to_numpy(), source, cluster, capacity)
        bin_id = (np.int64(shard) << np.int64(36)) + (np.int64(run_of) << np.int64(13)) + bins  # a run has fewer than 2 ** 13 bins
        return part[["doc_id", "piece", "n_words"]].assign(bin_id=bin_id, bin_offset=offsets)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shards of sorted batches; one beyond its size, of rows that hash alike, is packed in runs of `most` pieces."""
        held, rows_held, shard, run_of = [], 0, -1, 0
        for part in parts:
            while len(part):
                shards_of = part["_shard"].to_numpy()
                if rows_held and (shards_of[0] != shard or rows_held == most):
                    yield finish(shard, run_of, pd.concat(held))
                    run_of = run_of + 1 if shards_of[0] == shard else 0
                    held, rows_held = [], 0
                elif shards_of[0] != shard:
                    run_of = 0
                shard = shards_of[0]
                cut = min(int(np.searchsorted(shards_of != shard, True)), most - rows_held)
                held.append(part.iloc[:cut])
                rows_held += cut
                part = part.iloc[cut:]
        if rows_held:
            yield finish(shard, run_of, pd.concat(held))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInPandas(run, f"doc_id {kind}, piece int, n_words int, bin_id long, bin_offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text, source) by words; exact copies are a cluster."""
    return pack(docs, word_count(F.col("text")), F.col("source"), text_cluster(F.col("text")), capacity)
