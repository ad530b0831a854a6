"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters, each a
weight for every byte value at every place of a short span, slide over each chunk; every filter's
largest response in a chunk is kept, and the mean and the maximum over the chunks go to a logistic
output. It is trained by Adam on a balanced sample of labelled rows, whose number is bounded; their
texts are taken whole, in training as in scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Shared, batch_of, filter_texts, map_batches

#: Bytes of a chunk, bytes from one chunk's start to the next, bytes under a filter, filters.
CHUNK, STEP, SPAN, FILTERS = 256, 224, 4, 8
#: Bound of the training sample: rows of each label. It bounds the fit alone; scoring has no bound.
SAMPLE_ROWS = 600
EPOCHS, RATE, GROUP = 20, 0.01, 32
#: Chunks that are convolved at once (some 8 MB).
SLICE = 1024


@dataclass
class Network:
    filters: np.ndarray  # SPAN x 256 x FILTERS
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.mean_weight, self.max_weight, self.offset]


def chunks_of(data: bytes) -> np.ndarray:
    """n x CHUNK; the last one is filled with zeros. An empty text is one chunk of zeros."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _responses(net: Network, chunks: np.ndarray) -> np.ndarray:
    places = CHUNK - SPAN + 1
    out = net.filters[0][chunks[:, :places]]
    for k in range(1, SPAN):
        out += net.filters[k][chunks[:, k : k + places]]
    return out


def pooled(net: Network, chunks: np.ndarray, places: bool = False):
    """The largest response of each filter in each chunk, at least 0; with places, also where it is."""
    out, place = np.empty((len(chunks), len(net.bias)), np.float32), np.empty((len(chunks), len(net.bias)), np.intp)
    for i in range(0, len(chunks), SLICE):
        r = _responses(net, chunks[i : i + SLICE])
        if places:
            place[i : i + SLICE] = r.argmax(axis=1)
            out[i : i + SLICE] = np.take_along_axis(r, place[i : i + SLICE, None], axis=1)[:, 0]
        else:
            out[i : i + SLICE] = r.max(axis=1)
    out = np.maximum(out + net.bias, 0)
    return (out, place) if places else out


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    each = [chunks_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    pool = np.concatenate([pooled(net, np.concatenate(each[i : i + 64])) for i in range(0, len(each), 64)])
    mean = np.add.reduceat(pool, starts) / np.array([*map(len, each)], np.float32)[:, None]
    most = np.maximum.reduceat(pool, starts)
    return 1 / (1 + np.exp(-(mean @ net.mean_weight + most @ net.max_weight + net.offset[0]).astype(np.float64)))


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """With labels of one kind only, or none, the network gives a constant: 1, or 0.5."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    net = Network(normal(SPAN, 256, FILTERS), np.zeros(FILTERS, np.float32), normal(FILTERS), normal(FILTERS), np.zeros(1, np.float32))
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.mean_weight[:], net.max_weight[:] = 0, 0
        net.offset[0] = 0 if not labels else 20 if labels[0] else -20
        return net
    each = [chunks_of(t) for t in texts]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(each))
        for i in range(0, len(order), GROUP):
            step += 1
            grads = _gradients(net, [each[k] for k in order[i : i + GROUP]], y[order[i : i + GROUP]], weight[order[i : i + GROUP]])
            for p, g, m, v in zip(net.parts(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, each: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    chunks = np.concatenate(each)
    sizes = np.array([*map(len, each)])
    starts, doc = np.cumsum([0, *sizes])[:-1], np.repeat(np.arange(len(each)), sizes)
    pool, place = pooled(net, chunks, places=True)
    mean, most = np.add.reduceat(pool, starts) / sizes[:, None], np.maximum.reduceat(pool, starts)
    p = 1 / (1 + np.exp(-(mean @ net.mean_weight + most @ net.max_weight + net.offset[0])))
    g = (p - y) * weight / len(each)
    top = (pool == most[doc]) & (pool > 0)
    g_pool = g[doc, None] * (net.mean_weight / sizes[doc, None] + net.max_weight * top) * (pool > 0)
    g_filters = np.zeros_like(net.filters)
    f = np.broadcast_to(np.arange(FILTERS), place.shape)
    for k in range(SPAN):
        np.add.at(g_filters[k], (np.take_along_axis(chunks, place + k, axis=1), f), g_pool)
    return [g_filters, g_pool.sum(axis=0), g @ mean, g @ most, np.array([g.sum()], np.float32)]


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """Up to `rows` labelled whole texts of each label, the same each time: those with the smallest hashes
    of doc_id outside the held-out fold. A doc_id with both labels counts as 0; of rows that repeat a
    doc_id the least text is taken; null texts count as empty; labels without a document add nothing."""
    known = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.filter("quality = 0").orderBy(*order).limit(rows).unionByName(known.filter("quality = 1").orderBy(*order).limit(rows))
    # broadcast: 2 * rows ids
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted(texts.collect(), key=lambda r: r.doc_id)
    return [r.text.encode() for r in got], [int(r.quality) for r in got]


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    return train(*sample(documents, labels, rows))


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents(doc_id, text).

    The score is the probability of label 1 from the whole text's bytes; a null or empty text is one
    chunk of zeros; repeated rows are scored one by one and alike; a score of exactly 0.5 is label 1; an
    empty table gives no rows; a null doc_id is not held out; other columns are ignored. No shuffle.
    """
    shared = Shared(documents.sparkSession, net)

    def start():
        def each(batch):
            texts = [t or b"" for t in batch["text"].to_pylist()]
            s = np.concatenate([probabilities(shared.value, texts[i : i + 128]) for i in range(0, len(texts), 128)])
            yield batch_of(doc_id=batch["doc_id"], score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = map_batches(documents.select("doc_id", F.col("text").cast("binary").alias("text")), start, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, net: Network) -> DataFrame:
    """The rows whose text has a score of at least 0.5, with all their columns, whatever these are called. Null
    texts are judged as empty ones; repeated rows stay or go together; an empty table stays empty."""
    shared = Shared(documents.sparkSession, net)

    def start():
        return lambda texts: [s >= 0.5 for i in range(0, len(texts), 128) for s in probabilities(shared.value, texts[i : i + 128])]

    return filter_texts(documents, start)
