"""Operator 6 - approximate nearest neighbours by collision counting on query-centred windows.

Rows are unit vectors. Each of M lines - columns of random orthonormal frames, so that a row's offsets from a query on all
lines add up to their distance - has the rows' projections in an array sorted once. A query's windows are centred at its own
projections; virtual rehashing widens them with the radius, and every row that a window reaches gains a collision. Rows with
at least NEED collisions are verified by their exact cosine: a row at the present radius has that many with probability of
about 0.9, nearer rows more likely, and far rows seldom. A query is done with a block when its kth cosine is nearer than the
radius. In its first block the radius grows from START by WIDEN; in all others it goes at once to the kth distance found.
All rows are indexed; the lines come from a seed, so reruns agree.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from cairn.llm import blocks

#: Lines; half a window's width at radius 1; smallest radius; its growth.
M, WINDOW, START, WIDEN = 64, 1.5, 0.3, 1.05
_P = math.erf(WINDOW / math.sqrt(2))  # how often a row at the radius collides on a line
NEED = math.ceil(M * _P - 1.3 * math.sqrt(M * _P * (1 - _P)))
TINY = 1e-6


@lru_cache(4)
def lines(dims: int, m: int = M, seed: int = 42) -> np.ndarray:
    """dims x m: frames of orthonormal columns, scaled so that offsets have the size of the distance on average."""
    rng, out = np.random.default_rng([seed, dims]), []
    for begin in range(0, m, max(1, dims)):
        frame, r = np.linalg.qr(rng.standard_normal((dims, min(dims, m - begin))))
        out.append(frame * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.concatenate(out, axis=1) * math.sqrt(dims)


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row by itself in one fixed order of sums, so that equal vectors tie exactly."""
    with np.errstate(over="ignore", invalid="ignore"):
        c = (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt((q * q).sum()))
    if np.isfinite(c).all():
        return c
    a, b = q / np.abs(q).max(), rows / np.abs(rows).max(axis=1, keepdims=True)  # squares that overflow or vanish
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * math.sqrt((a * a).sum()))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def reach(best: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """The kth distance, infinite if there is none yet."""
    return math.sqrt(max(0.0, 2 - 2 * float(best[1][k - 1]))) if len(best[0]) >= k else math.inf


def collisions(order: np.ndarray, lo: list[int], hi: list[int]) -> np.ndarray:
    """Of each row, how many lines' windows hold it; of a wide window the rows outside are counted off instead."""
    n = order.shape[1]
    inside, outside, wide = [order[0, :0]], [order[0, :0]], 0
    for j, (x, y) in enumerate(zip(lo, hi)):
        if 2 * (y - x) <= n:
            inside.append(order[j, x:y])
        else:
            wide += 1
            outside += [order[j, :x], order[j, y:]]
    return wide + np.bincount(np.concatenate(inside), minlength=n) - np.bincount(np.concatenate(outside), minlength=n)


def block_search(qi, qv, di, dv, order, width: int, k: int, best: list) -> int:
    """best with this block's rows, and how many pairs were verified."""
    n, verified = len(di), 0
    a = lines(width)[: dv.shape[1]]
    values = np.take_along_axis(np.ascontiguousarray((unit(dv) @ a).T), order.astype(np.int64), axis=1)
    pq = unit(qv) @ a
    order = order.astype(np.int64)
    count = np.zeros((len(qi), n), np.int16)
    done = di == qi[:, None]
    lo, hi = np.zeros((M, len(qi)), np.int64), np.zeros((M, len(qi)), np.int64)
    radius = np.array([min(reach(b, k), 4.0) + TINY if len(b[0]) >= k else START for b in best])
    live, first = np.arange(len(qi)), True
    while len(live):
        w = WINDOW * radius[live]
        lo2, hi2 = lo.copy(), hi.copy()
        for j in range(M):
            lo2[j, live] = np.searchsorted(values[j], pq[live, j] - w, "left")
            hi2[j, live] = np.searchsorted(values[j], pq[live, j] + w, "right")
        if not first:
            lo2, hi2 = np.minimum(lo, lo2), np.maximum(hi, hi2)
        still = []
        for r in live.tolist():
            if first:
                count[r] = collisions(order, lo2[:, r].tolist(), hi2[:, r].tolist())
            else:
                parts = [order[j, x:y] for j, (x, y) in enumerate(zip(lo2[:, r].tolist(), lo[:, r].tolist())) if x < y]
                parts += [order[j, x:y] for j, (x, y) in enumerate(zip(hi[:, r].tolist(), hi2[:, r].tolist())) if x < y]
                if parts:
                    count[r] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            if radius[r] > 2:  # as far as unit vectors can be: whatever is left
                new = np.flatnonzero(~done[r])
            else:
                new = np.flatnonzero((count[r] >= NEED) & ~done[r])
            done[r, new] = True
            verified += len(new)
            best[r] = blocks.merge(best[r], di[new], cosines(qv[r], dv[new]), k)
            if radius[r] <= 2 and reach(best[r], k) > radius[r]:
                radius[r] *= WIDEN
                still.append(r)
        lo, hi, live, first = lo2, hi2, np.array(still, np.int64), False
    return verified


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", **sizes) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each query (id divisible by every), ties to
    smaller ids; all candidates where there are no more than k.

    What blocks.vectors() leaves out, empty and zero vectors among it, takes no part. Rows that repeat an id all take part,
    each by itself; rows with the query's id are its own. Vectors of other lengths count as ending in zeros. An empty table
    gives no rows; other columns are ignored."""

    def index(width):
        return lambda m: np.argsort(unit(m) @ lines(width)[: m.shape[1]], axis=0, kind="stable").T

    def search(width):
        return lambda qi, qv, dv, di, order, best: block_search(qi, qv, di, dv, order, width, k, best)

    return blocks.search(blocks.vectors(df, id_col, vec_col, zero=False), every, k, index, search, "double", "ann", **sizes)
