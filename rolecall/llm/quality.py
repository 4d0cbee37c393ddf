"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are covered by chunks of 256 that overlap by half.  Filters of
eight bytes, learned as one weight for each (place, byte), run at every fourth
byte; each chunk keeps the maximum of each filter, and the text keeps the
greatest, the mean and the least of its chunks, which a small hidden layer
combines into one probability.  (The least matters for texts that repeat
themselves: a chunk of one repeated word wakes few filters.)

The network is fitted on the driver from at most ``SAMPLE`` labelled rows of at
most ``SAMPLE_BYTES`` bytes, those with the least hash of doc_id; scoring runs
over every byte of every text inside the tasks, one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .rows import quoted, shipped

SAMPLE = 6000
SAMPLE_BYTES = 1 << 16
FILTERS = 32
HIDDEN = 16
EPOCHS = 8
_HALF = 128
_STEP = 4
_WIDTH = 8


def _rows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as windows [positions, 8], zero-padded so that each text has whole half chunks (two at least),
    and each text's first half chunk."""
    size = np.diff(at)
    halves = np.maximum(2, -(-size // _HALF))
    first = np.append(0, np.cumsum(halves))
    grid = np.zeros(first[-1] * _HALF, np.uint8)
    grid[np.arange(len(data)) + np.repeat(first[:-1] * _HALF - at[:-1], size)] = data
    grid = grid.reshape(-1, _STEP)
    after = np.zeros_like(grid)
    after[:-1] = grid[1:]
    after[first[1:] * (_HALF // _STEP) - 1] = 0
    return np.concatenate([grid, after], axis=1), first


class Network:
    def __init__(self, filters: int = FILTERS, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (_WIDTH, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.inner = rng.normal(0, (3 * filters) ** -0.5, (3 * filters, hidden)).astype(np.float32)
        self.inner_bias = np.zeros(hidden, np.float32)
        self.out = rng.normal(0, hidden**-0.5, hidden).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def convolve(self, windows: np.ndarray) -> np.ndarray:
        z = self.table[0].take(windows[:, 0], axis=0)
        for k in range(1, _WIDTH):
            z += self.table[k].take(windows[:, k], axis=0)
        return z

    def _pool(self, half: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half-chunk maxima to chunk activations, the first chunk of each text (n + 1), and text features."""
        inside = np.ones(len(half), bool)
        inside[first[1:] - 1] = False
        chunk = np.maximum(np.maximum(half[:-1], half[1:])[inside[:-1]] + self.bias, 0)
        begin = first - np.arange(len(first))
        count = np.diff(begin)[:, None]
        b = begin[:-1]
        return chunk, begin, np.concatenate([np.maximum.reduceat(chunk, b), np.add.reduceat(chunk, b) / count, np.minimum.reduceat(chunk, b)], axis=1)

    def _head(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(feature @ self.inner + self.inner_bias, 0)
        return hidden, 1 / (1 + np.exp(-np.clip((hidden @ self.out + self.shift).astype(np.float64), -40, 40)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text."""
        out = np.empty(len(at) - 1)
        for i, j in W.groups(at, 1 << 19):
            windows, first = _rows(data[at[i] : at[j]], at[i : j + 1] - at[i])
            half = np.empty((first[-1], len(self.bias)), np.float32)
            for k in range(0, len(half), 1024):  # a slice of half chunks at a time stays in cache
                part = windows[k * (_HALF // _STEP) : (k + 1024) * (_HALF // _STEP)]
                half[k : k + 1024] = self.convolve(part).reshape(-1, _HALF // _STEP, len(self.bias)).max(axis=1)
            out[i:j] = self._head(self._pool(half, first)[2])[1]
        return out

    def gradients(self, windows: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss, in the order of ``params``."""
        f, per = len(self.bias), _HALF // _STEP
        blocks = self.convolve(windows).reshape(-1, per, f)
        top = blocks.argmax(axis=1)
        half = np.take_along_axis(blocks, top[:, None, :], axis=1)[:, 0]
        place = top + np.arange(len(half))[:, None] * per
        chunk, begin, feature = self._pool(half, first)
        hidden, p = self._head(feature)
        d = ((p - label) * weight / len(label)).astype(np.float32)
        d_hidden = d[:, None] * self.out * (hidden > 0)
        d_feature = d_hidden @ self.inner.T
        inside = np.ones(len(half), bool)
        inside[first[1:] - 1] = False
        inside = inside[:-1]
        where = np.where(half[1:] > half[:-1], place[1:], place[:-1])[inside]
        doc = np.repeat(np.arange(len(label)), np.diff(begin))
        g = (d_feature[:, f : 2 * f] / np.diff(begin)[:, None])[doc]
        g += d_feature[doc, :f] * _first_of(chunk == feature[doc, :f], begin)
        g += d_feature[doc, 2 * f :] * _first_of(chunk == feature[doc, 2 * f :], begin)
        g *= chunk > 0
        channel = np.tile(np.arange(f), len(g))
        flat = where.ravel()
        table = [np.bincount(windows[flat, k].astype(np.int64) * f + channel, g.ravel(), 256 * f).reshape(256, f) for k in range(_WIDTH)]
        return [np.stack(table).astype(np.float32), g.sum(axis=0), feature.T @ d_hidden, d_hidden.sum(axis=0), d @ hidden, np.array([d.sum()], np.float32)]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 11) -> "Network":
        """Adam on the log loss; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        ones = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9)) if 0 < ones < 1 else np.ones(len(labels))
        params = [self.table, self.bias, self.inner, self.inner_bias, self.out, self.shift]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                raw = [texts[i] for i in pick]
                at = np.append(0, np.cumsum([len(x) for x in raw]))
                windows, first = _rows(np.frombuffer(b"".join(raw), np.uint8), at)
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for p, g, a, b in zip(params, self.gradients(windows, first, labels[pick], weight[pick]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _first_of(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each text's chunks, the first where the mask holds, for every filter."""
    rank = np.cumsum(mask, axis=0, dtype=np.int32)
    before = np.where(begin[:-1, None] > 0, rank[np.maximum(begin[:-1] - 1, 0)], 0)
    return mask & (rank - np.repeat(before, np.diff(begin), axis=0) == 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, target: str = "quality", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted on at most ``sample`` labelled rows.  ``learn`` is a condition
    on ``labels``.  Null labels are ignored, labels of one document are averaged;
    without any usable row the network is as it was drawn."""
    usable = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        usable = usable.filter(learn)
    drawn = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(target) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = text.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return Network().fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.float64)) if rows else Network()


def scores(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; null and empty texts are
    scored as a chunk of zeros; repeated rows and null ids get one row each."""
    model = shipped(docs.sparkSession, network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model().score(*W.text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` without the rows the network rejects; columns unchanged, whatever their names; one pass."""
    model = shipped(docs.sparkSession, network)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model().score(*W.text_buffers(batch.column(0).field(at))) >= 0.5))

    # the columns travel as one struct: names with dots are no columns to mapInArrow
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"))
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
