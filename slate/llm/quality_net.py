"""Quality classifier: a byte-level convolutional network in numpy.

Input: the bytes of the whole text in overlapping chunks.  Each place has its
byte value and whether the bytes around it occurred before in the chunk (so
that filters can see repetition, whatever is repeated).  Learned filters run
over the chunk, are max-pooled over short stretches, and each filter's pooled
values are combined over all chunks by their mean and their maximum into one
logistic probability.

Trained here by Adam on a bounded sample of labelled rows; classes are drawn
evenly and the prior is put back afterwards, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import held_out

#: Bound of the training sample: about so many labelled rows of each class, drawn by a hash of the id.
ROWS_PER_CLASS = 600
CHUNK, OVERLAP = 4096, 512
WIDTH, FILTERS, STRIDE, POOL = 6, 16, 2, 32
RECUR = 6  # bytes that must recur
EPOCHS, BATCH, RATE, DECAY = 14, 24, 0.02, 1e-5


def _places(text: bytes) -> Iterator[np.ndarray]:
    """Input symbols (byte, plus 256 where it recurs) of each chunk of a whole text."""
    last_seen = np.empty(1 << 16, np.int32)
    for at in range(0, max(1, len(text) - OVERLAP), CHUNK - OVERLAP):
        b = np.frombuffer(text[at : at + CHUNK], np.uint8).astype(np.uint32)
        if len(b) < WIDTH:
            b = np.pad(b, (0, WIDTH - len(b)))
        n = len(b) - RECUR + 1
        gram = b[:n].copy()
        for j in range(1, RECUR):
            gram = gram * np.uint32(0x01000193) + b[j : n + j]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
        here = np.arange(n, dtype=np.int32)
        last_seen[gram[::-1]] = here[::-1]  # of equal grams the first place stays
        symbols = b.astype(np.int32)
        symbols[:n] += 256 * (last_seen[gram] < here)
        yield symbols


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 512, FILTERS): a filter's weight for each symbol at each tap
    shift: np.ndarray
    out: np.ndarray  # means, then maxima
    bias: float

    def pooled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filter values of a chunk, and the place of each."""
        starts = np.arange(0, len(symbols) - WIDTH + 1, STRIDE)
        a = self.table[0][symbols[starts]]
        for j in range(1, WIDTH):
            a += self.table[j][symbols[starts + j]]
        pad = -len(a) % POOL
        if pad:
            a = np.concatenate([a, np.full((pad, FILTERS), -1e9, np.float32)])
        a = a.reshape(-1, POOL, FILTERS)
        best = a.argmax(1)
        values = np.take_along_axis(a, best[:, None], 1)[:, 0] + self.shift
        return values, starts[np.minimum(best + POOL * np.arange(len(a))[:, None], len(starts) - 1)]

    def combined(self, text: bytes) -> np.ndarray:
        total, top, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
        if text:
            for symbols in _places(text):
                v = np.maximum(self.pooled(symbols)[0], 0.0)
                total, top, n = total + v.sum(0), np.maximum(top, v.max(0)), n + len(v)
        return np.concatenate([total / max(1, n), top])

    def score(self, text: bytes | None) -> float:
        z = float(self.combined(text or b"") @ self.out + self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, positive_share: float) -> Net:
    """A network for evenly drawn classes, shifted to ``positive_share`` afterwards."""
    rng = np.random.default_rng(4)
    net = Net(rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    params = [net.table, net.shift, net.out, np.zeros(1)]
    moments = [(np.zeros_like(p, float), np.zeros_like(p, float)) for p in params]
    chunks = [[*_places(t)] if t else [] for t in texts]
    step = 0
    for _ in range(EPOCHS if len(texts) else 0):
        for batch in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            grads = [np.zeros_like(p, float) for p in params]
            flat = np.zeros(WIDTH * 512 * FILTERS)
            for e in batch:
                found = [net.pooled(c) for c in chunks[e]]
                if not found:
                    continue
                values, own = np.concatenate([v for v, _ in found]), np.cumsum([0] + [len(v) for v, _ in found])
                active = np.maximum(values, 0.0)
                h = np.concatenate([active.mean(0), active.max(0)])
                gap = 1 / (1 + np.exp(-np.clip(h @ net.out + params[3][0], -40, 40))) - labels[e]
                grads[2] += gap * h
                grads[3] += gap
                g = np.repeat(gap * net.out[None, :FILTERS] / len(values), len(values), 0)
                g[active.argmax(0), np.arange(FILTERS)] += gap * net.out[FILTERS:]
                g *= values > 0
                grads[1] += g.sum(0)
                for c, (_, places), a, b in zip(chunks[e], found, own, own[1:], strict=False):
                    for j in range(WIDTH):
                        at = (j * 512 + c[places + j]) * FILTERS + np.arange(FILTERS)
                        flat += np.bincount(at.ravel(), g[a:b].ravel(), len(flat))
            grads[0] = flat.reshape(net.table.shape)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g / len(batch) + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    share = float(np.mean(labels)) if len(labels) else 0.5
    odds = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    net.bias = float(params[3][0] + odds(positive_share) - odds(share))
    return net


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Net:
    """A network from labelled rows that are not held out; without any, every score is the same."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where(
        "_id is not null and _label in (0, 1)").where(~held_out(F.col("_id"))).dropDuplicates(["_id"])
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, rows_per_class / counts.get(1, 1)).otherwise(rows_per_class / counts.get(0, 1))
    draw = F.shiftrightunsigned(F.xxhash64("_id", F.lit(4)), 11) / F.lit(float(1 << 53))
    # the drawn labels are bounded by the parameter: their texts come by one scan
    drawn = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(known.where(draw < share)), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    rows = sorted(drawn.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["text"] or b""))
    total = sum(counts.values())
    return fit([r["text"] or b"" for r in rows], np.array([r["_label"] for r in rows], float), counts.get(1, 0) / total if total else 0.5)


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), whole texts.

    Null and empty texts have the score of a text without any filter hit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("binary")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))
