"""A quality score from a byte-level convolutional network, in numpy.

A text is read as bytes in blocks of ``BLOCK``; two neighbouring blocks are a chunk, so
chunks overlap by half and cover the whole text. Learned filters slide over every byte, each
chunk keeps the largest response of each filter, and the chunks' logits are averaged into
one probability. A filter over one-hot bytes is a table per position, so a convolution is a
few table look-ups per byte.

The network is fitted on the driver from a bounded sample of labelled rows; its weights have
a fixed size and go to the tasks that score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytetext import slices

WIDTH, FILTERS, BLOCK = 5, 16, 256
FOLDS = 5


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    base: float


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole blocks, and the first block of each text.

    Every text gets a block at least and ``WIDTH - 1`` zero bytes behind it. The places that
    start there read into the next text; :func:`hide` takes them out.
    """
    size = np.diff(offsets)
    count = -(-(size + WIDTH - 1) // BLOCK)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    at = np.repeat(first[:-1] * BLOCK - offsets[:-1], size) + np.arange(len(data))
    out[at] = data
    return out, first


def hide(values: np.ndarray, first: np.ndarray, low: int) -> None:
    """No response at the last places of a text; ``values`` start at block ``low``."""
    ends = first[1:] * BLOCK - low * BLOCK
    last = ends[(ends > 0) & (ends <= len(values))]
    for k in range(1, WIDTH):
        values[last - k] = -1e30


def responses(net: Network, padded: np.ndarray, first: np.ndarray, step: int = 256) -> np.ndarray:
    """The largest response of each filter in each block."""
    total = (len(padded) - WIDTH) // BLOCK
    best = np.empty((total, FILTERS), np.float32)
    one = np.empty((step * BLOCK, FILTERS), np.float32)
    sum_ = np.empty_like(one)
    for low in range(0, total, step):
        high = min(low + step, total)
        a, n = low * BLOCK, (high - low) * BLOCK
        np.take(net.tables[0], padded[a : a + n], axis=0, out=sum_[:n], mode="clip")
        for k in range(1, WIDTH):
            np.take(net.tables[k], padded[a + k : a + k + n], axis=0, out=one[:n], mode="clip")
            sum_[:n] += one[:n]
        hide(sum_[:n], first, low)
        best[low:high] = sum_[:n].reshape(high - low, BLOCK, FILTERS).max(axis=1)
    return best


def chunk_rows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second block of each chunk, and the first chunk of each text."""
    count = np.diff(first)
    chunks = np.maximum(count - 1, 1)
    bounds = np.concatenate([[0], np.cumsum(chunks)])
    left = np.repeat(first[:-1], chunks) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], chunks)
    right = np.where(np.repeat(count, chunks) > 1, left + 1, left)
    return left, right, bounds


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    padded, first = blocks(data, offsets)
    best = responses(net, padded, first)
    left, right, bounds = chunk_rows(first)
    hidden = np.maximum(np.maximum(best[left], best[right]) + net.bias, 0)
    logit = np.add.reduceat((hidden @ net.out).astype(np.float64), bounds[:-1]) / np.diff(bounds)
    return 1 / (1 + np.exp(-np.clip(logit + net.base, -30, 30)))


# --- training ----------------------------------------------------------------------


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = 500, batch: int = 48) -> Network:
    """Adam on the log loss; a sample with one class only gives a constant score."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    net.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    weights = [net.tables, net.bias, net.out, np.array([net.base])]
    m1 = [np.zeros(w.shape) for w in weights]
    m2 = [np.zeros(w.shape) for w in weights]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order += rng.permutation(len(y)).tolist()
        picked, order = order[:batch], order[batch:]
        net.base = float(weights[3][0])
        grads = _gradients(net, [texts[i] for i in picked], y[picked])
        rate = 0.02 * min(1, 2 * (1 - (step - 1) / steps))
        for w, g, a, b in zip(weights, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(w.dtype)
    net.base = float(weights[3][0])
    return net


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    padded, first = blocks(data, offsets)
    total = first[-1]
    where = np.empty((total, FILTERS), np.int64)
    best = np.empty((total, FILTERS), np.float32)
    for low in range(0, total, 256):
        high = min(low + 256, total)
        a, n = low * BLOCK, (high - low) * BLOCK
        value = sum(net.tables[k][padded[a + k : a + k + n]] for k in range(WIDTH))
        hide(value, first, low)
        value = value.reshape(-1, BLOCK, FILTERS)
        at = value.argmax(axis=1)
        best[low:high] = np.take_along_axis(value, at[:, None], axis=1)[:, 0]
        where[low:high] = at + (np.arange(low, high) * BLOCK)[:, None]
    left, right, bounds = chunk_rows(first)
    use_left = best[left] >= best[right]
    top = np.where(use_left, best[left], best[right]) + net.bias
    spot = np.where(use_left, where[left], where[right])
    hidden = np.maximum(top, 0)
    chunks = np.diff(bounds)
    logit = np.add.reduceat((hidden @ net.out).astype(np.float64), bounds[:-1]) / chunks + net.base
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    per_chunk = np.repeat(error / chunks, chunks)
    back = per_chunk[:, None] * net.out * (top > 0)
    tables = np.zeros(net.tables.shape)
    column = np.broadcast_to(np.arange(FILTERS), spot.shape)
    for k in range(WIDTH):
        np.add.at(tables[k], (padded[spot + k], column), back)
    decay = 1e-4
    return [
        tables + decay * net.tables,
        back.sum(axis=0),
        per_chunk @ hidden + decay * net.out,
        np.array([error.sum()]),
    ]


# --- the operator ------------------------------------------------------------------


def fold(id_: Column) -> Column:
    """The remainder that tells held-out rows (0) from the others; a null id counts as ''."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 3000,
    max_bytes: int = 200_000,
) -> Network:
    """Fit the network on labelled rows that are not held out.

    At most ``max_rows`` labelled rows are used, those with the smallest hash of the id, and
    of these the texts of at most ``max_bytes`` bytes. This bounds training, not scoring.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = (
        texts.where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(chosen), "id")
        .orderBy(F.xxhash64("id"), "id", "text", "label")
        .limit(max_rows)
        .toArrow()
    )
    return fit([t.encode() for t in rows["text"].to_pylist()], rows["label"].to_numpy())


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(probabilities(net, data, offsets))], ["id", "score"]
            )

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    **training,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row per document.

    ``score`` is the probability of label 1, from the text's bytes alone. A null text is an
    empty one and gets the score of an empty block. Repeated rows are scored each, rows with
    a null id too. Without labels of both classes all scores are the labels' share. Other
    columns are ignored; an empty table gives no rows.
    """
    net = train(docs, labels, id_col, text_col, **training)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_score(net), "id bigint, score double").select(
        F.col("id").alias(id_col),
        (fold(F.col("id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
