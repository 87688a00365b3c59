"""Operator 10 - language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes lower-case letters with single blanks between; its 1- to 3-grams are hashed to BUCKETS features of
term frequency times inverse document frequency. Document frequencies are counted over all rows to learn from;
weights are learned on a bounded sample by follow-the-regularised-leader with elastic-net penalties, which leaves
most of them zero, and a temperature is fitted on a part of the sample kept apart.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._util import held_out

BUCKETS, NGRAMS = 1 << 15, (1, 2, 3)
#: Rows to learn weights from, at most; every CALIBRATE-th of them fits the temperature.
SAMPLE_ROWS, CALIBRATE, EPOCHS = 6_000, 5, 3
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_KEYS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def grams(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a whole text; None if it has no letter."""
    if not text:
        return None
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    if not any(map(str.isalpha, clean[:64])) and not any(map(str.isalpha, clean)):
        return None
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], np.zeros(len(c), np.uint32)
    for n in NGRAMS:
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * _KEYS[n - 1]
        h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each bucket over all rows (text t), and the number of texts with letters.

    Tasks count by themselves and send one row per bucket they met; the driver gets BUCKETS sums at most."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                g = grams(t)
                if g is not None:
                    mark = np.zeros(BUCKETS, bool)
                    mark[g] = True
                    df += mark
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    out, n = np.zeros(BUCKETS), 0
    for bucket, count in rows.select("t").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            n = int(count)
        else:
            out[bucket] = count
    return out, n


def tfidf(g: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: relative frequencies times idf."""
    at, n = np.unique(g, return_counts=True)
    return at, n / len(g) * idf[at]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights BUCKETS x classes by FTRL-proximal steps; a weight is zero until its gradients outweigh l1."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for (at, x), c in zip(samples, y.tolist()):
            w = weights(at)
            p = softmax(x @ w)
            p[c] -= 1
            g = x[:, None] * p
            n0 = n[at]
            n1 = n0 + g * g
            z[at] += g - (np.sqrt(n1) - np.sqrt(n0)) / alpha * w
            n[at] = n1
    return weights(np.arange(BUCKETS))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / math.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    lo, hi, r = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(60):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    return math.exp((lo + hi) / 2)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> dict:
    """From text and non-null lang of the documents that aren't held out. Sample by a hash of the id, ties by
    lang and the text. Texts without a letter teach nothing. Without any
    row to learn from nothing is learned."""
    use = docs.select("doc_id", F.col("text").cast("string").alias("t"), "lang").where(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out())
    df, n = frequencies(use)
    idf = np.log((1 + n) / (1 + df)) + 1
    cut = use.select(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "lang").distinct().toDF("h", "doc_id", "lang").orderBy("h", "doc_id", "lang").limit(rows)
    picked = use.join(F.broadcast(cut.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"))), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("lang") == F.col("l")))

    def run(batches):
        for b in batches:
            for d, lang, t in zip(*[b.column(c).to_pylist() for c in ("doc_id", "lang", "t")]):
                g = grams(t)
                if g is not None:
                    at, x = tfidf(g, idf)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([lang]), pa.array([at.astype("<u4").tobytes()]), pa.array([x.astype("<f4").tobytes()])], names=["doc_id", "lang", "at", "x"])

    found = picked.select("doc_id", "lang", "t").mapInArrow(run, "doc_id long, lang string, at binary, x binary")
    got = [tuple(r) for r in found.orderBy(F.xxhash64("doc_id", "lang", "at", "x")).limit(rows).collect()]  # ids may repeat
    got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    langs = sorted({r[1] for r in got})
    samples = [(np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<f4").astype(float)) for r in got]
    y = np.array([langs.index(r[1]) for r in got], np.int64)
    apart = np.arange(len(got)) % CALIBRATE == 0
    w = ftrl([s for s, a in zip(samples, apart) if not a], y[~apart], max(1, len(langs)))
    logits = np.array([x @ w[at] for (at, x), a in zip(samples, apart) if a]).reshape(-1, max(1, len(langs)))
    t = temperature(logits, y[apart])
    return {"langs": langs, "table": (idf[:, None] * w / t).astype(np.float32)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: und with score 0 where the text is null or has no letter, or
    nothing was learned. Repeated rows each give a row, null ids are not held out, ties of languages go to the first in order; an
    empty table gives no rows; other columns are ignored, whatever their names."""
    langs, wide = model["langs"], model["table"]

    def run(batches):
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                g = grams(t) if langs else None
                if g is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = softmax(np.take(wide, g, axis=0).sum(axis=0, dtype=np.float64) / len(g))
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
