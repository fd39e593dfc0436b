"""Quality classifier: supervised subword embeddings.

Words and byte n-grams are hashed to buckets; a document is the average of its buckets' learned
vectors, read by a softmax. Training is stochastic gradient descent in numpy on the driver, over a
sample of labelled rows bounded by `train_rows`. Because averaging and the read-out are linear,
scoring needs one learned number a bucket: each executor gets two tables of fixed size and maps over
whole texts without a shuffle.

Null, empty and wordless texts get the score of the learned bias alone; repeated rows get equal
scores; extra columns are ignored. Without labelled rows of both classes the score is the share of
label 1 (0.5 without any label). Labels without a doc_id are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, small_batches, text_bytes, unpacked, word_hashes, words_of

WORD_BITS, GRAM_BITS, DIM = 17, 17, 8
TRAIN_ROWS, EPOCHS, RATE, SEED = 3000, 8, 0.5, 17
THRESHOLD = 0.7
#: The bucket of a word that repeats the word before it, whatever the word.
REPEAT = 0


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key, limit: int) -> DataFrame:
    """The `limit` rows with the least hashes of the key: the same on every run, at every partitioning.

    Only hashes below a bound that about twice as many have go on to be ordered, however many tasks there are.
    """
    hashed, share = F.xxhash64(key, F.lit(SEED)), 2 * limit / max(1, rows.count())
    some = rows if share >= 1 else rows.filter(hashed < int((share - 0.5) * 2.0**64))
    return some.orderBy(hashed, key).limit(limit)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets with the first of each text, n-gram buckets (two a byte place) and the texts' byte bounds."""
    raw, starts, ends, first = words_of(texts)
    words = (word_hashes(raw, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    words[again[~np.isin(again, first)]] = REPEAT
    b = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.uint32)
    three = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    four = three | b[3:] << np.uint32(24)
    grams = np.stack([(x * np.uint32(m) >> np.uint32(32 - GRAM_BITS + 1)).astype(np.int32) for x, m in ((three, 0x9E3779B1), (four, 0x85EBCA6B))])
    grams[1] += 1 << (GRAM_BITS - 1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, first, grams, begins[:-1], begins[1:] - 1


class SubwordModel:
    """Scores by bucket: the learned vectors seen through the read-out of label 1 against label 0."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, bias: float):
        self.words, self.grams, self.bias = words, grams, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        words, first, grams, begin, end = features(texts)
        by_word = np.concatenate(([0.0], np.cumsum(self.words[words], dtype=np.float64)))
        by_gram = np.concatenate(([0.0], np.cumsum(self.grams[grams[0]] + self.grams[grams[1]], dtype=np.float64)))
        last = np.maximum(begin, end - 3)
        n = np.diff(first) + 2 * (last - begin)
        total = by_word[first[1:]] - by_word[first[:-1]] + by_gram[last] - by_gram[begin]
        return np.round(1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + self.bias, -40, 40))), 9)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> SubwordModel:
    """Averaged bucket vectors and a two-class softmax, by plain SGD; classes weigh alike by the root of their counts."""
    y = np.asarray(labels, int)
    words_n, grams_n = 1 << WORD_BITS, 1 << GRAM_BITS
    share = float(y.mean()) if len(y) else 0.5
    bias0 = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if len(set(y.tolist())) < 2:
        return SubwordModel(np.zeros(words_n, np.float32), np.zeros(grams_n, np.float32), bias0)
    rng = np.random.default_rng(SEED)
    docs = []
    for text in texts:
        words, _, grams, begin, end = features([text])
        last = max(begin[0], end[0] - 3)
        ids, counts = np.unique(np.concatenate((words, grams[:, begin[0] : last].ravel() + words_n)), return_counts=True)
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (words_n + grams_n, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.array([0.0, bias0], np.float32)
    weight = np.sqrt(len(y) / (2 * np.bincount(y, minlength=2)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share_of = docs[i]
            rate = RATE * (1 - done / steps)
            own = vectors[ids]
            hidden = share_of @ own
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = (p * weight[y[i]]).astype(np.float32)
            vectors[ids] = own - rate * 20 * share_of[:, None] * (out @ grad)
            out -= rate * np.outer(hidden, grad)
            bias -= rate * 0.05 * grad
            done += 1
    seen = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return SubwordModel(seen[:words_n], seen[words_n:], float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> SubwordModel:
    """Learn from at most train_rows labelled documents, none of them held out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("_label"))
    sample = bounded_sample(known, F.col("doc_id"), train_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_label")
    rows = met.orderBy(F.xxhash64("doc_id", "text", "_label")).limit(train_rows).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])  # ids may repeat
    return train([(x or "").encode() for x in rows["text"].to_pylist()], rows["_label"].to_pylist())


def scored(docs: DataFrame, model: SubwordModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(_keep, score, predicted) of every row; _keep is a struct of the columns named in keep."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.words, model.grams, model.bias))
    source = docs.select(kept(keep), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel(*shared.value)
        for batch in chunks(batches):
            s = own.score(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_keep"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["_keep", "score", "predicted"])

    return source.mapInArrow(run, f"_keep {source.schema['_keep'].dataType.simpleString()}, score double, predicted int")


def score(docs: DataFrame, model: SubwordModel, keep: list[str] = [], threshold: float = THRESHOLD) -> DataFrame:  # noqa: B006
    """The columns named in keep, then score and predicted, of every row."""
    return unpacked(scored(docs, model, keep, threshold), keep, "score", "predicted")
