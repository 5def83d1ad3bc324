"""Quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. Learned filters slide over the embedded bytes of a
chunk and are max-pooled; the chunks' pooled activations are combined by their maximum, mean and minimum, and a small
dense layer turns these into one probability. The minimum is low where a chunk lacks the variety of running text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, holdout, in_slices, kept_rows, labelled_sample

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Bounds of the labelled sample that is fitted, in one task.
MOST_DOCUMENTS, MOST_BYTES = 1500, 1 << 13

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 6, 2, 32, 16
#: Bytes of a chunk, and how far the next one begins after it: chunks overlap by a quarter.
CHUNK, STEP = 384, 288
#: Chunks that are convolved at once.
SLAB = 256


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # 3 * FILTERS + 1 x HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: np.ndarray  # of the document's features
    scale: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def fresh(seed: int = 11) -> Net:
    r = np.random.default_rng(seed)
    f = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
    k = 3 * FILTERS + 1
    return Net(f(256, EMBED), f(WIDTH * EMBED, FILTERS, by=(WIDTH * EMBED) ** -0.5), np.zeros(FILTERS, np.float32), f(k, HIDDEN, by=k**-0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, by=HIDDEN**-0.5), np.zeros(1, np.float32), np.zeros(k, np.float32), np.ones(k, np.float32))


def chunks(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that overlap and together hold every byte; the end is filled with zeros."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


_AT = np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)


def columns(rows: np.ndarray) -> np.ndarray:
    """Byte codes under the filters: chunks x positions x WIDTH."""
    return rows[:, _AT]


def pooled(net: Net, rows: np.ndarray, where: bool = False):
    """Max-pooled filter activations of each chunk, and the positions they come from."""
    x = net.embed[columns(rows)].reshape(len(rows), len(_AT), WIDTH * EMBED)
    z = (x.reshape(-1, WIDTH * EMBED) @ net.conv).reshape(len(rows), len(_AT), FILTERS)
    top = z.max(1) + net.bias
    return (np.maximum(top, 0), z.argmax(1)) if where else np.maximum(top, 0)


def combined(acts: np.ndarray, first: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of documents from their chunks' activations; first: where each document's chunks begin."""
    return np.concatenate([np.maximum.reduceat(acts, first), np.add.reduceat(acts, first) / sizes[:, None], np.minimum.reduceat(acts, first), np.log1p(lengths)[:, None]], 1, dtype=np.float32)


def features(net: Net, texts: list[bytes]) -> np.ndarray:
    """One row a document, in slabs of chunks, so that a very long text needs little memory besides itself."""
    rows = [chunks(t) for t in texts]
    sizes = np.array([len(r) for r in rows])
    acts = np.empty((sizes.sum(), FILTERS), np.float32)
    at, held, held_n = 0, [], 0

    def flush() -> None:
        nonlocal at, held, held_n
        if held:
            acts[at : at + held_n] = pooled(net, np.concatenate(held))
            at, held, held_n = at + held_n, [], 0

    for r in rows:
        for k in range(0, len(r), SLAB):
            held.append(r[k : k + SLAB])
            held_n += len(held[-1])
            if held_n >= SLAB:
                flush()
    flush()
    return combined(acts, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, np.array([len(t) for t in texts], float))


def probability(net: Net, feats: np.ndarray) -> np.ndarray:
    h = np.maximum((feats - net.shift) / net.scale @ net.dense + net.dense_bias, 0)
    return 1 / (1 + np.exp(-np.clip((h @ net.out + net.out_bias).astype(float), -30, 30)))


def predict(net: Net, texts: list[bytes]) -> np.ndarray:
    return probability(net, features(net, texts)) if texts else np.zeros(0)


def fit(samples: list[tuple[str | None, int]], epochs: int = 4, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> Net:
    """Gradient descent (Adam) through pooling and filters. With labels of one kind only, that label's rate is the score."""
    net, r = fresh(seed), np.random.default_rng(seed)
    texts = [(t or "").encode() for t, _ in samples]
    y = np.array([float(v > 0) for _, v in samples], np.float32)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        net.out_bias[:] = np.log(rate_1 / (1 - rate_1))
        return net
    net.out_bias[:] = np.log(rate_1 / (1 - rate_1))
    first = features(net, texts)
    net.shift, net.scale = first.mean(0), first.std(0) + 1e-2
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    t = 0
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            rows = [chunks(texts[i]) for i in ids]
            sizes = np.array([len(x) for x in rows])
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.concatenate(rows)
            acts, where = pooled(net, rows, True)
            feats = combined(acts, start, sizes, np.array([len(texts[i]) for i in ids], float))
            x = (feats - net.shift) / net.scale
            pre = x @ net.dense + net.dense_bias
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
            d = ((p - y[ids]) / len(ids)).astype(np.float32)
            dh = np.outer(d, net.out) * (pre > 0)
            df = (dh @ net.dense.T) / net.scale
            doc = np.repeat(np.arange(len(ids)), sizes)
            top, mean, low = (df[:, j * FILTERS : (j + 1) * FILTERS] for j in range(3))
            da = mean[doc] / sizes[doc, None]
            for g, edge in ((top, feats[:, :FILTERS]), (low, feats[:, 2 * FILTERS : 3 * FILTERS])):
                hit = acts == edge[doc]
                da += np.where(hit, g[doc] / np.maximum(np.add.reduceat(hit, start)[doc], 1), 0)
            da = da * (acts > 0)
            codes = rows[np.arange(len(rows))[:, None, None], _AT[where]]  # chunks x FILTERS x WIDTH
            seen = net.embed[codes].reshape(len(rows), FILTERS, WIDTH * EMBED)
            g_conv = np.einsum("nfk,nf->kf", seen, da, optimize=True)
            g_seen = (da[:, :, None] * net.conv.T[None]).reshape(-1, EMBED)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, codes.reshape(-1), g_seen)
            grads = [g_embed, g_conv, da.sum(0), x.T @ dh + 1e-4 * net.dense, dh.sum(0), h.T @ d, d.sum(keepdims=True)]
            t += 1
            step = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
            for j, (part, g) in enumerate(zip(net.parts(), grads, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                part -= (step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def train(documents: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Net:
    """Fits on at most MOST_DOCUMENTS labelled texts outside the held-out fold."""
    return fitted(labelled_sample(documents, labels, "quality", ~holdout("doc_id", modulus, remainder), MOST_DOCUMENTS, MOST_BYTES), fit)


def score(documents: DataFrame, net: Net, threshold: float = 0.3, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """One row a document with the probability of label 1 and whether it reaches `threshold`.

    Null and empty texts are one chunk of padding and scored like any. Repeated rows keep a row each; a null id counts as
    not held out; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 64):
            p = predict(net, [t or b"" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [f.split()[0] for f in SCHEMA.split(", ")])

    return documents.select("doc_id", holdout("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """The rows that are not predicted poor, each judged by its own text, with all their columns."""

    def judge(texts: pa.Array) -> list[bool]:
        codes = [(t or "").encode() for t in texts.to_pylist()]
        return [p >= threshold for at in range(0, len(codes), 64) for p in predict(net, codes[at : at + 64])]

    return kept_rows(documents, judge)
