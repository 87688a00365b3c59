"""Operator 7 - quality classifier by Bradley-Terry pairwise ranking.

Documents of a bounded sample of labelled rows meet in preference pairs (good over bad); the weights of their features
minimise the logistic loss of feature differences. Features are general: shares of kinds of characters, in the whole and in the
worst lines, repetition of words and lines, lengths, and hashed pairs of neighbouring bytes. A document's strength is w . x; the threshold is the quantile of
the sample's strengths at its share of bad documents, and the score is a logistic curve through 0.7 there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._util import held_out

#: Labelled rows that the classifier is fitted on, and pairs made of them, at most.
SAMPLE_ROWS, PAIRS = 20_000, 200_000
PASS = 0.7

#: Class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence sign, 6 bar, 7 exclamation mark,
#: 8 other sign, 9 beyond ASCII, 10 control.
CLASSES = 11
_TABLE = np.full(256, 8, np.uint8)
_TABLE[:32], _TABLE[127], _TABLE[128:] = 10, 10, 9
_TABLE[97:123], _TABLE[65:91], _TABLE[48:58], _TABLE[[32, 9]], _TABLE[[10, 13]] = 0, 1, 2, 3, 4
_TABLE[[ord(c) for c in ".,;:'\"()-?"]], _TABLE[ord("|")], _TABLE[ord("!")] = 5, 6, 7


BIGRAMS = 32  # buckets


def features(text: str | None) -> np.ndarray:
    """Of the whole text; all but the first are 0 if it is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return np.zeros(DIMS)
    kind = _TABLE[np.frombuffer(raw, np.uint8)]
    share = np.bincount(kind, minlength=CLASSES) / size
    ends = np.flatnonzero(kind == 4)
    starts = np.concatenate(([0], ends[ends + 1 < size] + 1))
    lengths = np.diff(np.append(starts, size))
    worst, bad_lines = [], []
    for classes in ((1,), (7, 8), (6,)):
        hit = np.isin(kind, classes) if len(classes) > 1 else kind == classes[0]
        part = np.add.reduceat(hit.astype(np.int64), starts) / lengths
        worst.append(part[lengths >= min(20, lengths.max())].max())
        bad_lines.append((part > (0.4 if classes == (1,) else 0.08)) @ lengths / size)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = raw.split(b"\n")
    twice = 1 - len(set(lines)) / len(lines)
    grams = set(zip(words[::3], words[1::3], words[2::3]))
    repeats = 1 - len(grams) / max(1, n // 3) if n >= 6 else 0.0
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    codes[(codes >= 65) & (codes <= 90)] += 32
    mixed = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(27)
    pairs = np.sqrt(np.bincount(mixed, minlength=BIGRAMS) / size)
    return np.array([
        *share, *worst, *bad_lines, distinct / n, distinct / math.sqrt(n), same, twice, max(0.0, repeats), size / n / 10, math.log1p(n) / 10, math.log1p(n) ** 2 / 100,
        *np.sqrt(share[[1, 6, 7, 8]]), math.sqrt(same), share[1] ** 2, (distinct / n) ** 2, *pairs,
    ])


DIMS = CLASSES + 6 + 8 + 7 + BIGRAMS


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 42, l2: float = 1e-3) -> dict:
    """Weights by Newton steps on the pairs' logistic loss. Without labels of both kinds all scores lie on one
    side: below the threshold if there are only bad ones, else above."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(DIMS), np.ones(DIMS))
    model = {"mean": mean, "scale": scale, "w": np.zeros(DIMS), "cut": 1.0 if len(bad) and not len(good) else -1.0, "slope": 1.0}
    if not len(good) or not len(bad):
        return model
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    each = max(1, pairs // len(bad))
    a, b = rng.integers(0, len(good), len(bad) * each), np.repeat(bad, each)
    d = z[good[a]] - z[b]
    w = np.zeros(DIMS)

    def loss(w):
        return np.logaddexp(0, -(d @ w)).mean() + l2 * (w @ w) / 2

    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        grad = -(d.T @ p) / len(d) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(DIMS)
        step, t = np.linalg.solve(hess, grad), 1.0
        while t > 1e-4 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    s = z @ w
    return model | {"w": w, "cut": float(np.quantile(s, len(bad) / len(y), method="midpoint")), "slope": 4 / max(1e-9, float(s.std()))}


def score(x: np.ndarray, m: dict) -> np.ndarray:
    s = ((x - m["mean"]) / m["scale"]) @ m["w"] - m["cut"]
    return 1 / (1 + np.exp(-np.clip(m["slope"] * s + math.log(PASS / (1 - PASS)), -40, 40)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most that many rows of labels (doc_id, quality 0 or 1), none held out, by a hash of their id.

    Of labels that contradict each other for one id the larger counts; null, other and repeated labels, null ids and null
    texts (as empty ones) are allowed, and rows that share an id share its label. Ties of the hash are settled by the id.
    Only their documents' texts are read for features; the features of the sample come to the driver."""
    use = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(use), "doc_id")

    def run(batches):
        for b in batches:
            t, y = b.column("t").to_pylist(), b.column("y")
            x = [features(v).astype("<f8").tobytes() for v in t]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), y.cast(pa.int32()), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    found = joined.mapInArrow(run, "doc_id long, y int, x binary")
    got = sorted(tuple(r) for r in found.orderBy(F.xxhash64("doc_id", "x")).limit(rows).collect())  # ids may repeat
    x = np.array([np.frombuffer(r[2], "<f8") for r in got]).reshape(len(got), DIMS)
    return fit(x, np.array([r[1] for r in got], np.int64))


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) of every row, repeated rows too. Null texts are scored as empty ones,
    equal texts alike; null ids are not held out; an empty table gives no rows; other columns are ignored, whatever their names."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, DIMS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(x, model))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))


def passing(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns as they are, whatever their names, that the model passes; null texts as empty ones."""
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(text).to_pylist()]).reshape(b.num_rows, DIMS)
            yield b.filter(pa.array(score(x, model) >= PASS))

    return docs.mapInArrow(run, docs.schema)
