"""Quality: a byte-level convolutional network, written in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each
filter is one table of weights for each of its positions and byte values, so a
convolution is a sum of table rows; its rectified maximum over a chunk is the
chunk's feature.  The means and maxima of the chunks' features over the text are
combined into one probability.

The network is fitted on the whole texts of a bounded sample of labelled rows by
gradient descent; through a maximum the gradient reaches only the bytes where it
was found.

Defined results: a null or empty text is one chunk of padding; a very long text
is scored whole, some chunks at a time; repeated rows give repeated rows; where
labels of one document disagree the greater one holds; an empty table gives an
empty table; without labelled rows of both kinds every score is the share of
ones (0.5 without labels); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows whose whole texts the network is fitted on: those of least hash.
TRAIN_ROWS = 2_000
FILTERS, WIDTH, CHUNK, STEP = 16, 6, 256, 224
EPOCHS, RATE, BATCH = 6, 0.02, 64
#: Chunks that a task holds at a time.
BAND = 2048


@dataclass
class Network:
    """Weights: ``table[position, byte, filter]``, and of the last layer."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def maxima(self, chunks: np.ndarray, where: bool = False):
        """Rectified maxima of the filters over each chunk (and their places)."""
        n, size = chunks.shape
        if n > BAND:
            parts = [self.maxima(chunks[k : k + BAND], where) for k in range(0, n, BAND)]
            return tuple(np.concatenate(x) for x in zip(*parts)) if where else np.concatenate(parts)
        span = size - WIDTH + 1
        total = self.table[0].take(chunks[:, :span], 0)
        for j in range(1, WIDTH):
            total += self.table[j].take(chunks[:, j : j + span], 0)
        best = np.maximum(total.max(1) + self.bias, 0)
        return (best, total.argmax(1)) if where else best

    def combine(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.out[:-1] + self.out[-1], -30, 30)))


def cut(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; the last ends with it."""
    if len(raw) <= CHUNK:
        return np.frombuffer(raw.ljust(CHUNK, b"\0"), np.uint8)[None, :]
    flat = np.frombuffer(raw, np.uint8)
    starts = np.arange(0, len(raw) - CHUNK, STEP)
    starts = np.append(starts, len(raw) - CHUNK)
    return flat[starts[:, None] + np.arange(CHUNK)]


def long_maxima(network: Network, raw: bytes) -> np.ndarray:
    """``maxima`` of the chunks of a long text, which are views of it until a band of them is looked at."""
    flat = np.frombuffer(raw, np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[: len(raw) - CHUNK : STEP]
    parts = [network.maxima(views[k : k + BAND]) for k in range(0, len(views), BAND)]
    return np.concatenate([*parts, network.maxima(flat[None, -CHUNK:])])


def pooled(maxima: np.ndarray) -> np.ndarray:
    return np.concatenate([maxima.mean(0), maxima.max(0)])


def text_features(network: Network, texts: list[bytes]) -> np.ndarray:
    """Means and maxima over each text, some texts' chunks in one array at a time."""
    out, held, size = [], [], 0

    def flush():
        if not held:
            return
        counts = [len(c) for c in held]
        maxima = network.maxima(np.concatenate(held))
        for k, e in enumerate(np.cumsum(counts)):
            out.append(pooled(maxima[e - counts[k] : e]))

    for raw in texts:
        if len(raw) > BAND * STEP:  # a very long text in bands of its own
            flush()
            held, size = [], 0
            out.append(pooled(long_maxima(network, raw)))
            continue
        chunks = cut(raw)
        if size + len(chunks) > BAND:
            flush()
            held, size = [], 0
        held.append(chunks)
        size += len(chunks)
    flush()
    return np.array(out, np.float64).reshape(len(texts), 2 * FILTERS)


def fit(samples: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit on chunks of texts (one array each) by Adam, then refit the last layer."""
    from .toxicity import logistic

    r = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    net = Network((r.normal(0, 0.15, (WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), np.concatenate([r.normal(0, 0.3, 2 * FILTERS), [0.0]]), np.zeros(2 * FILTERS), np.ones(2 * FILTERS))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("table", net.table), ("bias", net.bias), ("out", net.out))}
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(samples))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            counts = [len(samples[k]) for k in some]
            ends = np.cumsum(counts)
            chunks = np.concatenate([samples[k] for k in some])
            maxima, places = net.maxima(chunks, where=True)
            doc = np.repeat(np.arange(len(some)), counts)
            x = np.array([pooled(maxima[e - c : e]) for e, c in zip(ends, counts)], np.float64)
            error = (net.combine(x) - y[some]) * weight[some] / len(some)
            grad_out = np.concatenate([x.T @ error, [error.sum()]]) + 1e-4 * net.out
            into = error[:, None] * net.out[None, :-1]
            back = into[doc, :FILTERS] / np.array(counts)[doc][:, None]
            top = np.array([maxima[e - c : e].argmax(0) + e - c for e, c in zip(ends, counts)])
            np.add.at(back, (top, np.arange(FILTERS)), into[:, FILTERS:])
            back = np.where(maxima > 0, back, 0).astype(np.float32)
            grad_table = np.zeros_like(net.table)
            rows, filters = np.nonzero(back)
            for j in range(WIDTH):
                np.add.at(grad_table[j], (chunks[rows, places[rows, filters] + j], filters), back[rows, filters])
            step += 1
            for name, g in (("table", grad_table), ("bias", back.sum(0)), ("out", grad_out)):
                m, v = state[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                rate = RATE * min(1, step / 20) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - rate).astype(getattr(net, name).dtype))
    x = np.array([pooled(net.maxima(c)) for c in samples], np.float64)
    net.center, net.scale = x.mean(0), x.std(0) + 1e-3
    a = logistic(np.column_stack([np.ones(len(x)), (x - net.center) / net.scale]), y, ridge=2.0)
    net.out = np.append(a[1:], a[0])
    return net


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on the whole texts of at most ``TRAIN_ROWS`` labelled rows, which the driver collects."""
    marked = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = F.xxhash64("doc_id"), "doc_id"
    chosen = marked.orderBy(*order).limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw")).join(F.broadcast(chosen), "doc_id")
    # an id may stand for several rows: the bound holds for rows
    found = rows.orderBy(*order, F.xxhash64("raw"), "raw").limit(TRAIN_ROWS).select("label", "raw").collect()
    y = np.array([r["label"] for r in found], float)
    if len(y) == 0 or y.min() == y.max():
        zero = np.zeros(2 * FILTERS)
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1), zero, zero + 1, float(y.mean()) if len(y) else 0.5)
    return fit([cut(bytes(r["raw"])) for r in found], y)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every whole text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                if network.constant is not None:
                    scores = np.full(some.num_rows, network.constant)
                else:
                    scores = network.combine(text_features(network, [t.as_py() or b"" for t in some.column(1)]))
                yield pa.record_batch([some.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Scores of all documents, learned from the rows that are not held out.

    Columns: ``doc_id``, ``held_out`` boolean, ``score`` double, ``predicted`` int.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    network = learn(docs, labels, fold != held_out)
    scored = score(docs, network)
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
