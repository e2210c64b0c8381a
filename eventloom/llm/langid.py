"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 1- to 3-grams of the lower-cased text, hashed to ``DIM`` places, with
weight log(1 + count) * idf and unit length.  Document frequencies come from every
training document (one distributed pass); weights are fitted by follow-the-regularised-
leader with an elastic net on a sample of ``SAMPLE`` labelled documents, or ``LEAST`` a
language if those are more, alike for every language and chosen by a hash of doc_id, and a temperature is then fitted on
a part of the sample that the weights never saw.  Whole texts are used throughout.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
usable label every document is; rows with a null doc_id are left out; of rows with one
doc_id the greatest text counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow, slices

DIM = 1 << 14
#: Labelled documents that the weights are fitted on, about, and of each language at least, if it has them.
SAMPLE = 4000
LEAST = 10
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: A letter: Unicode category L, which \p{L} is.
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, counts) of the n-grams of each text; an n-gram may reach over the end of its text by blanks only."""
    low = [(t or "").lower() for t in texts]
    chars = np.frombuffer("".join(x + "  " for x in low).encode("utf-32-le", "surrogatepass") + b"\0" * 8, np.uint32)
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    h = a * _MULT[0]
    grams = [h]
    h = (h ^ (h >> np.uint32(15)) ^ b) * _MULT[1]
    grams.append(h)
    grams.append((h ^ (h >> np.uint32(13)) ^ c) * _MULT[2])
    places = [(x >> np.uint32(18)).astype(np.int32) for x in grams]
    out, at = [], 0
    for t in low:
        n = len(t)
        count = np.bincount(np.concatenate([p[at : at + n] for p in places]), minlength=DIM) if n else np.zeros(DIM, np.int64)
        where = np.flatnonzero(count)
        out.append((where, count[where]))
        at += n + 2
    return out


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[where]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[where] + self.weights[DIM]

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> Model:
    """FTRL-proximal: per-coordinate rates, weights from the accumulated gradients under L1 and L2; every fifth row calibrates."""
    labels = sorted({r[2] for r in rows})
    of = {x: i for i, x in enumerate(labels)}
    m = Model(labels, idf, np.zeros((DIM + 1, len(labels))))
    z, n = np.zeros_like(m.weights), np.zeros_like(m.weights)
    data = [(np.append(w, DIM), np.append(m.vector(w, c), 1.0), of[y]) for w, c, y in rows]
    train, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    known = {y for *_, y in train}
    train += [d for d in held if d[2] not in known]  # languages with calibration rows only
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(train)).tolist():
            where, x, y = train[i]
            zi, ni = z[where], n[where]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            n2 = ni + g * g
            z[where] = zi + g - (np.sqrt(n2) - np.sqrt(ni)) / alpha * w
            n[where] = n2
    m.weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    if held and len(labels) > 1:
        zs = np.array([x @ m.weights[w] for w, x, _ in held])
        ys = np.array([y for *_, y in held])

        def loss(log_t: float) -> float:
            s = zs / np.exp(log_t)
            top = s.max(1)
            return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(ys)), ys]).mean())

        a, b = -4.0, 4.0
        g = (5**0.5 - 1) / 2
        for _ in range(50):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        m.temperature = float(np.exp((a + b) / 2))
    return m


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for part in slices(batch):
            for where, _ in features(part.column(1).to_pylist()):
                df[where] += 1
                n += 1
    where = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(where, DIM)), pa.array(np.append(df[where], n))], names=["place", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            f = features(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array([w.astype("<i4").tobytes() for w, _ in f], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in f], pa.binary())], names=["lang", "h", "places", "counts"])


def _fitted(idf: np.ndarray):
    """Fits the weights to all rows (lang, h, places, counts) of a task; a row for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            places, counts = ([np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in batch.column(i)] for i in (2, 3))
            rows += zip(places, counts, batch.column(0).to_pylist(), strict=True)
        if rows:
            m = fit(rows, idf)
            for k, lang in enumerate(m.labels):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([m.weights[:, k].astype("<f8").tobytes()], pa.binary()), pa.array([m.temperature])], names=["lang", "weights", "temperature"])

    return run


def train(labelled: DataFrame) -> Model | None:
    """A model from rows (doc_id, text, lang); rows without text or lang are passed over.

    One task gets the sample and fits the weights; the driver gets the model only.
    """
    rows = labelled.filter("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    # df over all training documents: at most DIM + 1 sums reach the driver
    sums = arrow(rows.select("doc_id", "text"), _frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for place, n in sums:
        df[place] = n
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    each = max(LEAST, SAMPLE // len(counts))
    # a rate of 1.5 of what is wanted, then the least hashes of those
    bounds = [(lang, min(2**63 - 1, int(min(1.0, 1.5 * (each + 50) / n) * 2**64) - 2**63)) for lang, n in counts.items()]
    bounds = rows.sparkSession.createDataFrame(bounds, "lang string, bound long")
    some = rows.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(bounds), "lang").filter("h <= bound")
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("at") <= each)
    sample = arrow(some.select("doc_id", "text", "lang", "h"), _sampled, "lang string, h long, places binary, counts binary").repartition(1).sortWithinPartitions("h")
    got = arrow(sample, _fitted(idf), "lang string, weights binary, temperature double").collect()
    return Model([r.lang for r in got], idf, np.stack([np.frombuffer(r.weights, "<f8") for r in got], axis=1), got[0].temperature)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                texts = part.column(1).to_pylist()
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if m is not None:
                    for i, (t, (where, count)) in enumerate(zip(texts, features(texts), strict=True)):
                        if t and _LETTER.search(t):
                            p = m.probabilities(m.logits(where, m.vector(where, count)))
                            k = int(p.argmax())
                            pred[i], score[i] = m.labels[k], float(p[k])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(pred), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The frame, whose first two columns are an id and the text, with lang_pred and score.

    The model that tasks get is DIM * languages numbers, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow(docs, _predict(shared), schema)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang), one row per non-null doc_id: of several the greatest text, then lang."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null")
    if out.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang")
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents with crc32(doc_id) mod 3 = 1 are held out of training."""
    rows = _rows(docs).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = train(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
