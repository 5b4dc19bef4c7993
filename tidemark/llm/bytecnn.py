"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes, cut into overlapping chunks that cover all of
it (neighbours share ``width - 1`` bytes, so no window is lost at a border).
Learned filters slide over each chunk; their rectified answers are
max-pooled inside the chunk. The chunk maxima are combined over the whole
text twice, by their maximum and by their mean, and a logistic layer turns
both into one probability.

Training reads a bounded sample of labelled rows: at most ``sample`` labels,
the smallest by a hash of the id. Their texts are read whole, a group of
chunks at a time; the driver holds their bytes. Scoring reads every text
whole.

Defined cases: a null or empty text is one chunk of padding and gets a score;
repeated label rows of an id count once (largest label); null labels or ids
teach nothing; without any labelled text every score is 0.5; one class only:
the score still is a number in [0, 1]. Extra columns pass through; the
operator's own column names (``score``) replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_at_once

WIDTH, CHUNK = 8, 512  # bytes
EMBED, FILTERS = 8, 16
GROUP = 64  # chunks per matrix product


@dataclass
class ByteCNN:
    embed: np.ndarray  # 257 x EMBED, row 256 is padding
    filters: np.ndarray  # WIDTH*EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2*FILTERS
    out_bias: float


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def chunks_of(raw: np.ndarray) -> np.ndarray:
    """Overlapping chunks (rows) of a whole text's bytes, padded with 256; each window of bytes is in one of them."""
    step = CHUNK - WIDTH + 1
    n = max(1, -(-max(len(raw) - (WIDTH - 1), 1) // step))
    flat = np.full((n - 1) * step + CHUNK, 256, np.int16)
    flat[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


def _windows(model: ByteCNN, x: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH*EMBED) view of the embedded bytes."""
    e = model.embed[x]
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (len(x), CHUNK - WIDTH + 1, WIDTH * EMBED), s)


def pair_tables(model: ByteCNN) -> np.ndarray:
    """What each pair of bytes adds to the filters, for each pair of a window (257**2 rows each)."""
    w = model.filters.reshape(WIDTH, EMBED, FILTERS)
    one = np.einsum("be,jef->jbf", model.embed, w)
    return (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(WIDTH // 2, 257 * 257, FILTERS)


def pooled(model: ByteCNN, tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Max-pooled filter answers of each chunk: the convolution as sums of table rows."""
    n = CHUNK - WIDTH + 1
    parts = []
    for i in range(0, len(x), GROUP):
        c = x[i : i + GROUP].astype(np.int32)
        c = c[:, :-1] * 257 + c[:, 1:]
        a = np.take(tables[0], c[:, :n], axis=0)
        for j in range(1, WIDTH // 2):
            a += np.take(tables[j], c[:, 2 * j : 2 * j + n], axis=0)
        parts.append(a.max(1))
    return np.maximum(np.concatenate(parts) + model.bias, 0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(model: ByteCNN, texts: list[str | None], tables: np.ndarray | None = None) -> np.ndarray:
    """Probability of label 1 for each text, read whole, a bounded group of chunks at a time."""
    tables = pair_tables(model) if tables is None else tables
    out = np.empty(len(texts))
    pending: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush():
        counts = np.array([len(c) for _, c in pending])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        p = pooled(model, tables, np.concatenate([c for _, c in pending]))
        top = np.maximum.reduceat(p, starts)
        mean = np.add.reduceat(p, starts) / counts[:, None]
        z = np.concatenate([top, mean], 1) @ model.out + model.out_bias
        out[[i for i, _ in pending]] = _sigmoid(z.astype(np.float64))

    for i, t in enumerate(texts):
        c = chunks_of(bytes_of(t))
        if len(c) > GROUP * 32:  # a very long text on its own, in pieces
            top, total = None, 0
            for j in range(0, len(c), GROUP):
                p = pooled(model, tables, c[j : j + GROUP])
                top = p.max(0) if top is None else np.maximum(top, p.max(0))
                total = total + p.sum(0, dtype=np.float64)
            z = np.concatenate([top, total / len(c)]) @ model.out + model.out_bias
            out[i] = _sigmoid(float(z))
            continue
        pending.append((i, c))
        held += len(c)
        if held >= GROUP * 16:
            flush()
            pending, held = [], 0
    if pending:
        flush()
    return out


def fit(texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 32,
        rate: float = 0.004, seed: int = 7) -> ByteCNN:
    """Adam on the log loss; the gradient goes through both poolings to the winning windows."""
    rng = np.random.default_rng(seed)
    m = ByteCNN(rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
                np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    m.embed[256] = 0
    if not len(texts):
        return m
    rate_1 = float(np.clip(labels.mean(), 0.01, 0.99))
    m.out_bias = float(np.log(rate_1 / (1 - rate_1)))
    m.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    raws = [bytes_of(t) for t in texts]
    params = {"embed": m.embed, "filters": m.filters, "bias": m.bias, "out": m.out,
              "out_bias": np.array([m.out_bias], np.float32)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    t_step = 0
    epochs = min(60, max(epochs, 600 * batch // len(texts)))  # few texts are seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - epoch / epochs) + rate * 0.05
        for b in range(0, len(order), batch):
            ids = order[b : b + batch]
            cut = [chunks_of(raws[i]) for i in ids]
            counts = np.array([len(c) for c in cut])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            x = np.concatenate(cut)
            best, where = [], []
            for i in range(0, len(x), GROUP):
                w = _windows(m, x[i : i + GROUP])
                a = (w.reshape(-1, w.shape[2]) @ m.filters).reshape(w.shape[0], w.shape[1], -1)
                where.append(a.argmax(1))
                best.append(np.take_along_axis(a, where[-1][:, None], 1)[:, 0])
            where, raw = np.concatenate(where), np.concatenate(best) + m.bias
            p = np.maximum(raw, 0)
            top, mean = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts) / counts[:, None]
            feats = np.concatenate([top, mean], 1)
            prob = _sigmoid(feats @ m.out + params["out_bias"][0])
            err = ((prob - labels[ids]) / len(ids)).astype(np.float32)
            doc = np.repeat(np.arange(len(ids)), counts)
            d_feat = err[:, None] * m.out[None]
            d_p = d_feat[doc, FILTERS:] / counts[doc][:, None]
            d_p += (p == top[doc]) * d_feat[doc, :FILTERS] / np.maximum(
                np.add.reduceat((p == top[doc]).astype(np.float32), starts)[doc], 1)
            d_p *= raw > 0
            grads = {"out": feats.T @ err + 1e-4 * m.out, "out_bias": np.array([err.sum()]), "bias": d_p.sum(0),
                     "filters": np.zeros_like(m.filters), "embed": np.zeros_like(m.embed)}
            for i in range(0, len(x), GROUP):  # the winning windows only: their bytes, filters and embeddings
                g, c = d_p[i : i + GROUP], x[i : i + GROUP]
                bytes_at = c[np.arange(len(c))[:, None, None], where[i : i + GROUP, :, None] + np.arange(WIDTH)]
                e = m.embed[bytes_at].reshape(len(c), FILTERS, WIDTH * EMBED)
                grads["filters"] += (g[:, :, None] * e).sum(0).T
                d_e = (g[:, :, None] * m.filters.T[None]).reshape(-1, EMBED)
                at = bytes_at.reshape(-1)
                grads["embed"] += np.stack([np.bincount(at, d_e[:, j], 257) for j in range(EMBED)], 1)
            grads["embed"][256] = 0
            t_step += 1
            for k, v in params.items():
                m1, m2 = mom[k]
                m1 *= 0.9
                m1 += 0.1 * grads[k]
                m2 *= 0.999
                m2 += 0.001 * grads[k] ** 2
                v -= lr * (m1 / (1 - 0.9**t_step)) / (np.sqrt(m2 / (1 - 0.999**t_step)) + 1e-7)
            m.out_bias = float(params["out_bias"][0])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2000, keep=None) -> ByteCNN:
    """Fit on at most ``sample`` labelled ids; ``keep`` is the row filter of the labels."""
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        lab = lab.where(keep)
    lab = (lab.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(lab), "doc_id").groupBy("doc_id")
           .agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").toPandas())
    return fit(got["text"].tolist(), got["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: ByteCNN, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1 of every whole text."""
    spark = docs.sparkSession
    rows_at_once(spark)
    shared = spark.sparkContext.broadcast(model)  # about 20 KB, fixed by the shape of the network

    @F.pandas_udf("double")
    def prob(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = pair_tables(shared.value)
        for s in texts:
            yield pd.Series(score_texts(shared.value, s.tolist(), tables))

    return docs.withColumn(out, prob(F.col("text")))
