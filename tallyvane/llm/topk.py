"""Exact top-k inner products by descending norm with rotated partial sums.

Components become integers floor(scale * x), so scores are exact. Vectors are dealt to levels by falling length (quantile
bounds of the norm) and levels to blocks. The right singular vectors of all vectors (from the
d x d matrix of their products, summed over Spark tasks) give a rotation that gathers length in the first
coordinates. Each query is scored against the block of the longest vectors, which goes to every task; its k-th best score
there is its threshold. A level is live for a query if the query's length times the level's greatest length can reach
the threshold (Cauchy-Schwarz); live levels are the first so many, a number found from the levels' lengths before
anything is sent. Queries of one such number travel together, and only to the blocks of their live levels. In
a block only vectors whose partial sum over the leading coordinates, plus the product of the two residual
lengths, can reach the threshold get an exact score. Bounds are widened by the rounding error.

Each pair of a query block and a live vector block is one row of one task and returns at most k rows a query. Null
vectors, vectors with null or non-finite components and rows without a vec_id take no part; shorter vectors count as ended by zeros. Ties go to
the smaller vec_id; candidates repeated under one vec_id stand as often as they occur; a query repeated with its
vector is one query, and one of several vectors has the best of them all. An empty table, or one without
queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, remove

VECTOR_BLOCK, QUERY_BLOCK, HEAD = 4096, 1024, 16
#: Norm levels at most; a level beyond VECTOR_BLOCK rows is cut in blocks by a hash.
MAX_LEVELS = 1000


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(_q, vec_id, v, norm2) of the usable rows, v the integers as array<long>."""
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.filter(_usable(doubles) & F.col("vec_id").isNotNull()).select("_q", F.col("vec_id").cast("long").alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * scale)).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column, ended by zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows: each task sends d x d sums, whatever its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    sums = rows.select("v").mapInArrow(run, "i int, row array<double>")
    parts = sums.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((dim, dim))
    gram[parts["i"], parts["j"]] = parts["x"]
    return np.linalg.svd(gram)[0]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _search(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, scores) of the k best of each query among the vectors m, of those whose bounds reach the query's floor."""
    order = np.argsort(-(m * m).sum(axis=1), kind="stable")
    ids, m = ids[order], m[order]
    mr, qr = m @ rotation, q @ rotation
    head = min(HEAD, m.shape[1])
    m_rest, q_rest = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (mr, qr))
    m_len, q_len = (np.sqrt((x**2).sum(axis=1)) for x in (m, q))
    slack = 1e-9 * (1 + q_len * m_len[0])
    found = []
    for i in range(len(qids)):
        # vectors are in falling length: those that can reach the floor are the first
        reach = np.searchsorted(-m_len * q_len[i], slack[i] - floor[i], side="right") if floor[i] > -np.inf else len(ids)
        part = mr[:reach, :head] @ qr[i, :head]
        near = np.flatnonzero(part + m_rest[:reach] * q_rest[i] + slack[i] >= floor[i])
        near = near[ids[near] != qids[i]]
        scores = np.rint(m[near] @ q[i]).astype(np.int64)
        best = _best(scores, ids[near], k)
        found.append((ids[near][best], scores[best]))
    return found


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all other rows."""
    spark, old = vectors.sparkSession, []
    rows = materialise(integer_vectors(vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))), scale), "topk-vectors", old)
    facts = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts[0] or not facts[1]:
        return spark.createDataFrame([], schema)
    dim, blocks = facts[1], -(-facts[0] // vector_block)
    rotation = _rotation(rows, dim)
    # levels of falling norm by quantile bounds; a level beyond a block's size is cut by a hash of the row, so no block grows with ties or one vec_id
    levels = min(blocks, MAX_LEVELS)
    bounds = rows.stat.approxQuantile("norm2", [i / levels for i in range(1, levels)], 0.1 / levels) if levels > 1 else []
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(bounds), reverse=True)]).cast("array<double>")
    counted = rows.withColumn("level", F.size(F.filter(cuts, lambda b: b > F.col("norm2"))))
    sizes = counted.groupBy("level").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).orderBy("level").collect()  # a row for each level
    slices = [-(-r["n"] // vector_block) for r in sizes]
    ends = np.cumsum(slices).tolist()
    number = {r["level"]: n for n, r in enumerate(sizes)}
    of = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("level")))
    block = of([0, *ends[:-1]]) + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), of(slices)).cast("int")
    placed = counted.select("vec_id", "v", block.cast("int").alias("block"))
    packed = materialise(placed.groupBy("block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs")), "topk-blocks", old)
    longest = packed.filter("block = 0").select("ids", "vs").toArrow()  # about vector_block rows, whatever the table's size
    first_ids = longest.column("ids").combine_chunks().flatten().to_numpy() if longest.num_rows else np.zeros(0, np.int64)
    first = spark.sparkContext.broadcast((first_ids, _matrix(longest.column("vs").combine_chunks().flatten(), dim) if longest.num_rows else np.zeros((0, dim))))

    def open_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = first.value
        for batch in batches:
            if not batch.num_rows:
                continue
            qids, q = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)
            found = _search(ids, m, qids, q, np.full(len(qids), -np.inf), rotation, k) if len(ids) else [(np.zeros(0, np.int64),) * 2] * len(qids)
            low = [float(f[1].min()) if len(f[1]) >= k else None for f in found]  # a query without k scores yet has no threshold
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(low, pa.float64()), _lists([f[0] for f in found]), _lists([f[1] for f in found])], names=["query_id", "v", "low", "ids", "scores"])

    queries = rows.filter("_q").select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    opened = materialise(queries.mapInArrow(open_queries, "query_id long, v array<bigint>, low double, ids array<bigint>, scores array<bigint>"), "topk-first", old)
    hits = F.arrays_zip("ids", "scores")
    results = opened.select("query_id", F.explode(hits).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    if ends[-1] > 1:
        own = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        tops = F.array(*[F.lit(float(r["top"]) ** 0.5) for r in sizes])
        live = F.when(F.col("low").isNull(), F.lit(len(sizes))).otherwise(F.size(F.filter(tops, lambda t: t * own * (1 + 1e-9) + 1e-9 >= F.col("low"))))
        aimed = opened.select("query_id", "v", "low", live.alias("live"))
        aimed = aimed.withColumn("last", F.get(F.array(*[F.lit(int(e)) for e in ends]), F.col("live") - 1) - 1).filter("last >= 1")
        asked = aimed.groupBy("live").agg(F.count("*").alias("n")).collect()  # a row for each number of live levels
        shares = F.create_map(*[F.lit(x) for r in asked for x in (r["live"], -(-r["n"] // query_block))]) if asked else F.lit(None).cast("map<int,int>")
        aimed = aimed.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(7)), F.element_at(shares, F.col("live"))).cast("int"))
        sets = aimed.groupBy("live", "last", "part").agg(F.collect_list("query_id").alias("qids"), F.collect_list("v").alias("qvs"), F.collect_list(F.coalesce("low", F.lit(float("-inf")))).alias("lows"))
        sent = sets.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("last")))).join(packed.hint("shuffle_hash"), F.col("at") == F.col("block")).select("ids", "vs", "qids", "qvs", "lows", "part", "live", "block")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    ids, qids, lows = (row.column(c).flatten().to_numpy() for c in ("ids", "qids", "lows"))
                    found = _search(ids, _matrix(row.column("vs").flatten(), dim), qids, _matrix(row.column("qvs").flatten(), dim), lows, rotation, k)
                    who = np.repeat(qids, [len(f[0]) for f in found])
                    cols = [who, *(np.concatenate([f[c] for f in found]) for c in range(2))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        results = results.unionByName(sent.repartition("live", "part", "block").drop("live", "part", "block").mapInArrow(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = materialise(ranked, "topk")
    remove(spark, old)
    return found
