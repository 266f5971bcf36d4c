"""Quality classifier: a byte-level convolutional network in numpy (operator 10).

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded,
learned filters slide over each chunk and are max-pooled over the windows that begin within the
text; the pooled vectors of all chunks are combined by their mean and their maximum into one
probability. The network is fitted on the driver on a bounded number of labelled documents, each
read whole; scoring runs in Spark tasks over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.common import bounded_batches, documents, fold, labels, training_rows

CHUNK, STEP = 1024, 960  #: bytes of a chunk, and from one chunk's start to the next's
WIDTH, STRIDE = 8, 4
EMBED, FILTERS = 8, 32
SAMPLE_BOUND = 4_000  #: labelled training documents at most, whole ones
STEPS, RATE = 600, 0.01
SIDES = 16, 48  #: bad and good documents of a training batch
BLOCK_CHUNKS = 256  #: convolved at once


@dataclass
class ByteCNN:
    embed: np.ndarray  #: 256 x EMBED; the row of byte 0, the padding, is zero
    filters: np.ndarray  #: WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  #: weights of features()
    shift: float

    @staticmethod
    def new(seed: int = 11) -> ByteCNN:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED / 2), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        return ByteCNN(embed, filters, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded windows of byte chunks: chunks x windows x (WIDTH * EMBED)."""
        x = self.embed[chunks].reshape(len(chunks), -1)
        n = (chunks.shape[1] - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(x, (len(x), n, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * x.itemsize, x.itemsize))
        return np.ascontiguousarray(view)

    def responses(self, chunks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk, and at which window; windows behind a chunk's length don't count."""
        most, where = [], []
        for at in range(0, len(chunks), BLOCK_CHUNKS):
            w = self.windows(chunks[at : at + BLOCK_CHUNKS])
            y = (w.reshape(-1, w.shape[2]) @ self.filters).reshape(len(w), -1, FILTERS)
            begins = np.arange(y.shape[1]) * STRIDE
            y[(begins > 0) & (begins >= lengths[at : at + BLOCK_CHUNKS, None])] = -np.inf
            top = y.argmax(axis=1)
            where.append(top)
            most.append(np.take_along_axis(y, top[:, None, :], 1)[:, 0])
        return np.concatenate(most), np.concatenate(where)

    def pooled(self, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses, a row of FILTERS for each chunk."""
        return np.maximum(self.responses(chunks, lengths)[0] + self.bias, 0)

    def probability(self, pooled: np.ndarray) -> float:
        """Of a document by the pooled rows of all its chunks."""
        x = features(pooled.mean(axis=0)[None], pooled.max(axis=0)[None])
        return float(1 / (1 + np.exp(-np.clip(x @ self.out + self.shift, -30, 30)))[0])


def features(mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of documents: mean and maximum over chunks."""
    return np.concatenate([mean, most], axis=1)


def chunked(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text, zero-padded, and their lengths; one empty chunk for null or empty texts."""
    raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    out = np.zeros((n, CHUNK), np.uint8)
    for k in range(n):
        part = raw[k * STEP : k * STEP + CHUNK]
        out[k, : len(part)] = part
    return out, np.minimum(CHUNK, len(raw) - STEP * np.arange(n))


def fit(docs: list[bytes], marks: np.ndarray, seed: int = 11) -> ByteCNN:
    """Adam on the cross entropy of batches of whole documents, SIDES of each class. One class only: a constant."""
    net, rng = ByteCNN.new(seed), np.random.default_rng(seed)
    sides = [np.flatnonzero(marks == k) for k in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        net.shift = 2.0 if len(sides[1]) or not len(marks) else -2.0
        return net
    net.out[:] = rng.normal(0, 0.05, len(net.out))
    names = ["embed", "filters", "bias", "out"]
    moment = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names} | {"shift": [0.0, 0.0]}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(s, k) for s, k in zip(sides, SIDES)])
        cut = [chunked(docs[i]) for i in pick]
        chunks, lengths = np.concatenate([c for c, _ in cut]), np.concatenate([n for _, n in cut])
        owner = np.repeat(np.arange(len(pick)), [len(c) for c, _ in cut])
        counts = np.bincount(owner)
        most_y, top = net.responses(chunks, lengths)
        z = most_y + net.bias
        pooled = np.maximum(z, 0)
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(pooled, starts) / counts[:, None]
        most = np.maximum.reduceat(pooled, starts)
        x = features(mean, most)
        p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.shift, -30, 30)))
        d = ((p - marks[pick]) / len(pick)).astype(np.float32)
        g_x = d[:, None] * net.out
        winner = pooled == most[owner]
        ties = np.add.reduceat(winner.astype(np.float32), starts)
        g = g_x[owner, :FILTERS] / counts[owner][:, None] + g_x[owner, FILTERS:] * winner / ties[owner]
        g = np.where(z > 0, g, 0).astype(np.float32)
        grads = {"filters": 1e-4 * net.filters, "bias": g.sum(axis=0), "out": x.T @ d + 1e-3 * net.out, "shift": float(d.sum()), "embed": np.zeros_like(net.embed)}
        for at in range(0, len(chunks), BLOCK_CHUNKS):  # through the windows that won
            part, some = g[at : at + BLOCK_CHUNKS], chunks[at : at + BLOCK_CHUNKS]
            where = top[at : at + BLOCK_CHUNKS, :, None] * STRIDE + np.arange(WIDTH)
            bytes_at = some[np.arange(len(some))[:, None, None], where]
            picked = net.embed[bytes_at].reshape(len(some), FILTERS, -1)
            grads["filters"] = grads["filters"] + np.einsum("cf,cfw->wf", part, picked)
            back = (part[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            grads["embed"] += np.stack([np.bincount(bytes_at.ravel(), back[:, e], 256) for e in range(EMBED)], axis=1)
        grads["embed"][0] = 0
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, grad in grads.items():
            m = moment[k]
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.999 * m[1] + 0.001 * grad * grad
            change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            if k == "shift":
                net.shift -= float(change)
            else:
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def learn(rows: DataFrame) -> ByteCNN:
    """The network fitted on `(text, label)` rows, at most SAMPLE_BOUND; their texts reach the driver whole."""
    got = rows.select(F.encode("text", "utf-8").alias("text"), "label").toPandas()
    got = got.sort_values(["label", "text"]).reset_index(drop=True)  # the order of rows must not matter
    return fit([bytes(x) for x in got["text"]], got["label"].to_numpy(np.float32))


def score_quality(docs: DataFrame, net: ByteCNN, text_col: str = "text") -> DataFrame:
    """`docs` with `quality_score`, 0 to 1.

    Null texts are scored like empty ones; every row is scored by itself, so repeated rows score
    alike; an empty table gives an empty one. Other columns stay; a column of that name is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            if waiting:
                pooled = net.pooled(np.concatenate([c for c, _ in waiting]), np.concatenate([n for _, n in waiting]))
                out.extend(net.probability(p) for p in np.split(pooled, np.cumsum([len(c) for c, _ in waiting])[:-1]))
                waiting.clear()

        for t in texts:
            waiting.append(chunked(t))
            held += len(waiting[-1][0])
            if held >= BLOCK_CHUNKS:
                flush()
                held = 0
        flush()
        return pd.Series(out, dtype=float)

    return docs.withColumn("quality_score", score(text_col))


def fitted(spark: SparkSession, sf_dir: str) -> ByteCNN:
    """Learned from the labelled rows of `sf_dir` whose crc32 remainder by 5 isn't 0."""
    return learn(training_rows(documents(spark, sf_dir), labels(spark, sf_dir), "quality", fold("doc_id", 5) != 0, SAMPLE_BOUND))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 10: doc_id, held_out, score, predicted."""
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), fitted(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
