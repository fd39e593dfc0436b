"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of fixed length, each filter is
max-pooled over the window, and a softmax reads the pooled filters; a document's prediction is the
mean over all its windows, so whole texts count. Training (Adam, in numpy, on the driver) uses a
sample of labelled rows bounded by `train_rows`; the weights, a few kilobytes, are broadcast.

A null text and one without any letter give `und` with score 0. Repeated rows give equal results;
extra columns are ignored. With no labelled row every text gives `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, small_batches, text_bytes, unpacked
from .quality import bounded_sample, is_held_out

WINDOW, EMBED, WIDTHS, FILTERS = 128, 4, (2, 3, 4, 5), 6
SPAN = max(WIDTHS)
TRAIN_ROWS, WINDOWS_PER_DOC, EPOCHS, BATCH, SEED = 1500, 6, 8, 64, 5
STEP_WINDOWS = 2048


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (padded by zeros) of all texts and the number of the text of each."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist()))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


class ByteConv:
    """Weights: byte embeddings, one filter bank (narrow filters are zero beyond their width), and the read-out."""

    def __init__(self, langs: list[str], embed: np.ndarray, bank: np.ndarray, shift: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.langs, self.embed, self.bank, self.shift, self.out, self.bias = langs, embed, bank, shift, out, bias

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        e = self.embed[windows]
        n, places = len(windows), WINDOW - SPAN + 1
        view = np.lib.stride_tricks.as_strided(e, (n, places, SPAN * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
        return view.reshape(n * places, SPAN * EMBED)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self.unfold(windows)
        maps = (cols @ self.bank).reshape(len(windows), WINDOW - SPAN + 1, -1)
        top = maps.max(axis=1)
        return np.maximum(top + self.shift, 0), maps, cols

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        found = [np.zeros((0, len(self.langs)), np.float32)]
        for i in range(0, len(windows), STEP_WINDOWS):
            z = self.pooled(windows[i : i + STEP_WINDOWS])[0] @ self.out + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(found)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        letters = np.array([any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        windows, of = windows_of([t if ok else b"" for t, ok in zip(texts, letters)])
        p = self.probabilities(windows)
        counts = np.bincount(of, minlength=len(texts))
        mean = np.stack([np.bincount(of, p[:, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1) / np.maximum(1, counts)[:, None]
        best = mean.argmax(axis=1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, letters)], np.where(letters, np.round(mean[np.arange(len(texts)), best], 6), 0.0)


def train(texts: list[bytes], langs_of: list[str], epochs: int = EPOCHS) -> ByteConv:
    langs = sorted(set(langs_of))
    rng = np.random.default_rng(SEED)
    n_filters = FILTERS * len(WIDTHS)
    mask = np.zeros((SPAN, EMBED, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(SPAN * EMBED, n_filters)
    w = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "bank": rng.normal(0, 0.4, mask.shape) * mask, "shift": np.zeros(n_filters),
        "out": rng.normal(0, 0.2, (n_filters, max(1, len(langs)))), "bias": np.zeros(max(1, len(langs))),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    net = ByteConv(langs, **w)
    if len(langs) < 2:
        return net
    windows, of = windows_of(texts)
    order = rng.permutation(len(windows))
    rank = np.zeros(len(texts), int)
    chosen = []
    for i in order:  # so many random windows of each text
        if rank[of[i]] < WINDOWS_PER_DOC:
            rank[of[i]] += 1
            chosen.append(i)
    chosen = np.array(chosen)
    codes = {lang: k for k, lang in enumerate(langs)}
    y = np.array([codes[langs_of[k]] for k in of[chosen]])
    weight = (len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs)))))[y].astype(np.float32)
    x, places = windows[chosen], WINDOW - SPAN + 1
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            xb, yb, wb = x[rows], y[rows], weight[rows]
            hidden, maps, cols = net.pooled(xb)
            z = hidden @ w["out"] + w["bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), yb] -= 1
            p *= wb[:, None] / len(rows)
            back = (p @ w["out"].T) * (hidden > 0)
            at = maps.argmax(axis=1) + (np.arange(len(rows)) * places)[:, None]  # the place that won, by filter
            taken = cols[at]  # rows, filters, span * embed
            grad = {"out": hidden.T @ p, "bias": p.sum(axis=0), "shift": back.sum(axis=0), "bank": np.einsum("nf,nfk->kf", back, taken) * mask}
            to_cols = (back[:, :, None] * w["bank"].T[None]).reshape(len(rows), n_filters, SPAN, EMBED)
            which = (at - (np.arange(len(rows)) * places)[:, None])[:, :, None] + np.arange(SPAN)
            byte = xb[np.arange(len(rows))[:, None, None], which]
            grad["embed"] = np.stack([np.bincount(byte.ravel(), to_cols[..., k].ravel(), minlength=256) for k in range(EMBED)], axis=1)
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ByteConv:
    """Learn from at most train_rows documents with a language, none of them held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = bounded_sample(known, F.xxhash64("doc_id", "text", "lang"), train_rows).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train([x.encode() for x in rows["text"].to_pylist()], rows["lang"].to_pylist())


def predicted(docs: DataFrame, net: ByteConv, keep: list[str]) -> DataFrame:
    """(_keep, lang_pred, score) of every row; _keep is a struct of the columns named in keep."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((net.langs, net.embed, net.bank, net.shift, net.out, net.bias))
    source = docs.select(kept(keep), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteConv(*shared.value)
        for batch in chunks(batches):
            langs, score = own.predict(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_keep"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["_keep", "lang_pred", "score"])

    return source.mapInArrow(run, f"_keep {source.schema['_keep'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, net: ByteConv, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns named in keep, then lang_pred and score, of every row."""
    return unpacked(predicted(docs, net, keep), keep, "lang_pred", "score")
