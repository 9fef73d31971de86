"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to an alphabet of 64 (letters without case, one class for all
other ASCII, 32 classes for the bytes of other characters); features are its
2- and 3-grams, an exact index of fixed size.  Document frequencies come from
all rows that may be learned from.  Weights are trained with the
follow-the-regularised-leader update and an elastic-net penalty, which leaves
most of them at exactly 0, on a bounded sample of each language; a temperature
fitted on a part of the sample that training does not see calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import fresh, held_out, whole_row

#: Bound of the training sample: about so many rows of each language, drawn by a hash of id and text.
ROWS_PER_LANGUAGE = 600
CLASSES = 64
DIM = CLASSES**2 + CLASSES**3
BLOCK = 1 << 20  # bytes of a text that are held as n-grams at a time
#: Learning rate, smoothing, elastic net (L1, L2), passes, and the feature scale.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 0.02, 0.01, 4, 25.0
CALIBRATE_EVERY = 5
UNDETERMINED = "und"
#: Below this calibrated score a filtering stage rejects a document.
LEAST_SCORE = 0.3

FOLD = np.zeros(256, np.int32)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
FOLD[128:] = 27 + (np.arange(128) & 31)


def _codes(text: bytes) -> Iterator[np.ndarray]:
    """Feature numbers of a whole text, block by block (blocks overlap by two bytes)."""
    for at in range(0, max(1, len(text) - 2), BLOCK):
        c = FOLD[np.frombuffer(text[at : at + BLOCK + 2], np.uint8)]
        pairs = c[:-1] * CLASSES + c[1:]
        yield np.concatenate([pairs[:BLOCK], CLASSES**2 + pairs[:-1] * CLASSES + c[2:]])


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    c = FOLD[np.frombuffer(text, np.uint8)]
    return bool(((c > 0) & (c < 27)).any()) or (bool((c >= 27).any()) and any(x.isalpha() for x in text.decode(errors="replace")))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: (feature, documents that have it); feature -1 counts the documents."""
    found, seen, n = np.zeros(DIM, np.int64), np.zeros(DIM, bool), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            n += 1
            codes = [*_codes(text)]
            for c in codes:
                seen[c] = True
            hit = np.flatnonzero(seen) if sum(map(len, codes)) > DIM // 8 else np.unique(np.concatenate(codes))
            found[hit] += 1
            seen[hit] = False
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["feature", "n"])


def _term_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, counts = [], []
        for text in batch.column("text").to_pylist():
            f, c = np.unique(np.concatenate([*_codes(text)]), return_counts=True)
            features.append(f)
            counts.append(c.astype(np.float32) / max(1, c.sum()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("lang", "part", "at")), pa.array(features, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.float32()))], ["lang", "part", "at", "features", "tf"])


@dataclass
class Model:
    langs: list[str]
    row: np.ndarray  # of each feature, its row in table; row 0 holds zeros
    table: np.ndarray  # weights of the features that have any, times idf and scale
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for codes in _codes(text):
            total += np.bincount(self.row[codes], minlength=len(self.table)) @ self.table
            n += len(codes)
        return total / max(1, n) + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(langs: list[str], labels: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], parts: np.ndarray, idf: np.ndarray) -> Model:
    """Train on the examples (features, term frequencies) whose part is not 0; calibrate on the others."""
    z, n = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))  # the last row is the bias, without penalty

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    xs = [(np.append(f, DIM), np.append(SCALE * tf * idf[f], 1.0)) for f, tf in examples]
    target = np.eye(len(langs))[labels]
    for _ in range(EPOCHS):
        for e in np.flatnonzero(parts != 0):
            f, x = xs[e]
            l1 = np.where(f == DIM, 0.0, L1)[:, None]
            zi, ni = z[f], n[f]
            w = weights(zi, ni, l1)
            g = x[:, None] * (_softmax(x @ w) - target[e])
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[f] = ni + g * g
    w = weights(z, n, np.where(np.arange(DIM + 1) == DIM, 0.0, L1)[:, None])
    kept = np.flatnonzero(np.abs(w[:DIM]).sum(1))
    row = np.zeros(DIM, np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    table = np.vstack([np.zeros((1, len(langs))), w[kept] * idf[kept, None] * SCALE])
    model = Model(langs, row, table, w[DIM])

    check = np.flatnonzero(parts == 0)
    if len(check):
        logits = np.array([xs[e][1] @ w[xs[e][0]] for e in check])
        own = np.arange(len(check)), labels[check]
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[own], 1e-300)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from rows (doc_id, text, lang) that are not held out; None if no such row has a language."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").where(
        "text is not null and octet_length(text) > 2 and lang is not null").where(~held_out(F.col("doc_id")))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())  # a row per language
    if not counts:
        return None
    langs = [lang for lang, _ in counts]
    df = np.zeros(DIM, np.int64)
    total = 0
    for feature, n in rows.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).toLocalIterator():
        if feature < 0:
            total = n
        else:
            df[feature] = n  # an array of fixed size
    idf = np.log((1 + total) / (1 + df)) + 1

    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, min(1.0, rows_per_language / n)))), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(7)), 11) / F.lit(float(1 << 53))
    sample = rows.where(draw < share).select(
        F.xxhash64("text", "doc_id").alias("at"), "lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(CALIBRATE_EVERY)).cast("int").alias("part"))
    found = sample.select("lang", "part", "at", "text").mapInArrow(
        _term_frequencies, "lang string, part int, at long, features array<int>, tf array<float>").toArrow().to_pylist()
    found.sort(key=lambda r: r["at"])  # an order that does not depend on tasks
    labels = np.array([langs.index(r["lang"]) for r in found], int)
    examples = [(np.array(r["features"], int), np.array(r["tf"])) for r in found]
    return fit(langs, labels, examples, np.array([r["part"] for r in found]), idf)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (any columns, one of them text) with lang_pred and score, whole texts.

    A text that is null or has no letter, and any text if nothing was learned,
    is undetermined with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        m, langs, scores = shared.value, [], []
        for text in texts:
            if m is None or not has_letter(text):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            p = _softmax(m.logits(text) / m.temperature)
            langs.append(m.langs[int(p.argmax())])
            scores.append(float(p.max()))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    found = fresh(docs, "found")
    return docs.withColumn(found, classify(F.col("text").cast("binary"))).select(
        *(docs[f"`{c}`"] for c in docs.columns), F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, by a model trained on its rows that are not held out."""
    rows = docs.select("doc_id", "text")
    return predict(rows, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language cannot be told."""
    model = train(docs)
    rows = docs.select(whole_row(docs).alias("row"), docs["text"].alias("text"))
    return predict(rows, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
