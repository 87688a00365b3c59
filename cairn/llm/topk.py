"""Operator 2 - exact top-k by inner product with Fagin's threshold algorithm.

In each block of rows every dimension has a sorted list, made once. A query reads its lists in rounds, from the end that its
component's sign favours and the deeper the larger the component. What it has read of a row, and the present depth of all
lists it hasn't met the row in, bound the row's score; a row that no list has shown has the threshold itself for bound. Rows whose
bound cannot beat the kth score known so far - in this block or in those before it - are never scored. Rounds go deeper
while more than OPEN of the rows are left; then these are scored and the block is done.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks

#: Shares of all list entries that are read by the end of each round, and of the rows that may be scored before a next one.
DEPTHS, OPEN = (0.1, 0.4, 0.55, 0.7, 0.85, 1.0), 0.1
EXACT = 2.0**53


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """Per dimension the row numbers by ascending component."""
    return np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)


def bounds(q: np.ndarray, share: float, order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all rows after reading that share of the lists."""
    n = order.shape[1]
    out, threshold = np.zeros(n), 0.0
    use = np.flatnonzero(q)
    weight = np.sqrt(np.abs(q[use]))
    for d, depth in zip(use.tolist(), (np.minimum(share * weight / weight.mean(), 1.0) * n).astype(int).tolist()):
        if share >= 1.0:
            depth = n
        if q[d] > 0:
            edge, part = values[d, max(0, n - depth - 1)], slice(n - depth, n)
        else:
            edge, part = values[d, min(depth, n - 1)], slice(0, depth)
        out[order[d, part]] += q[d] * (values[d, part] - edge)
        threshold += q[d] * edge
    return out + threshold


def threshold_search(q: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, values: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """best with this block's rows but those with id own, and how many rows were scored."""
    left = ids != own
    scored = 0
    for share in DEPTHS if len(best[0]) < k else DEPTHS[1:]:
        upper = bounds(q, share, order, values)
        upper[~left] = -np.inf
        for last in (False, True):
            floor = best[1][k - 1] if len(best[0]) >= k else -np.inf
            able = np.flatnonzero(left & (upper >= floor))
            if last and (share < 1.0 and len(able) > max(4 * k, OPEN * len(ids))):
                break
            if not last and len(able) > 4 * k:  # the most hopeful ones first, for a higher floor
                able = able[np.argpartition(-upper[able], 4 * k)[: 4 * k]]
            best = blocks.merge(best, ids[able], rows[able] @ q, k)
            left[able] = False
            scored += len(able)
        else:
            break
    return best, scored


def _every_score(q: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, k: int, best):
    """For scores that doubles would round: Python's integers, held at the ends of 64 bits."""
    at = np.flatnonzero(ids != own)
    left = [int(x) for x in q]
    score = [sum(a * int(b) for a, b in zip(left, rows[i].tolist())) for i in at.tolist()]
    held = [min(max(s, -(2**63)), 2**63 - 1) for s in score]
    both = sorted(zip([*map(int, best[1]), *held], [*map(int, best[0]), *ids[at].tolist()]), key=lambda p: (-p[0], p[1]))[:k]
    return np.array([i for _, i in both], np.int64), np.array([s for s, _ in both], np.int64).astype(object)


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", **sizes) -> DataFrame:
    """query_id, rank, vec_id, score: per query (id divisible by every) the k rows with the largest integer inner
    product of components floor(scale * x); ties to smaller ids; fewer where there are fewer rows.

    What blocks.vectors() leaves out takes no part. Rows that repeat an id all take part, each by itself; rows with the
    query's id are its own. Vectors of other lengths count as ending in zeros, empty ones score 0. Scores beyond 64 bits
    are held at their ends. An empty table gives no rows; other columns are ignored."""

    def index(width):
        return lambda m: sorted_lists(np.floor(scale * m))

    def probe(qi, qv, dv, di, order, best):
        qv, dv = np.floor(scale * qv), np.floor(scale * dv)
        if order.shape[0] < dv.shape[1]:  # queries longer than all rows here: their further components meet zeros
            qv, dv = qv[:, : order.shape[0]], dv[:, : order.shape[0]]
        size = max(1.0, np.abs(qv).max(initial=0)) * max(1.0, np.abs(dv).max(initial=0)) * max(1, dv.shape[1])
        order = order.astype(np.intp)
        values = np.take_along_axis(np.ascontiguousarray(dv.T), order, axis=1)
        for r, (own, q) in enumerate(zip(qi.tolist(), qv)):
            if size >= EXACT or best[r][1].dtype == object:
                best[r] = _every_score(q, own, di, dv, k, best[r])
            else:
                best[r], _ = threshold_search(q, own, di, dv, order, values, k, (best[r][0], best[r][1].astype(float)))

    rows = blocks.vectors(df, id_col, vec_col)
    return blocks.search(rows, every, k, index, lambda width: probe, "long", "topk", **sizes).withColumn("rank", F.col("rank").cast("int"))
