"""String similarities: Jaro-Winkler on bytes, and ratios on the longest common subsequence."""

from __future__ import annotations

from functools import lru_cache
from math import fma
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Byte-wise; the prefix of up to four bytes counts 0.1 each where the Jaro value is over 0.7; two empty texts: 0.

    Equal to DuckDB's to the last bit, by the same fused product and sum: ranks of the unrounded value tell ties by it."""
    if a == b:
        return 1.0 if a else 0.0
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    taken = bytearray(len(y))
    left = bytearray()
    for i, c in enumerate(x):
        lo, hi = max(0, i - reach), min(len(y), i + reach + 1)
        j = y.find(c, lo, hi)
        while j >= 0 and taken[j]:
            j = y.find(c, j + 1, hi)
        if j >= 0:
            taken[j] = 1
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = bytes(c for c, t in zip(y, taken) if t)
    swaps = sum(p != q for p, q in zip(left, right)) // 2
    jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    if jaro > 0.7:
        prefix = 0
        while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
            prefix += 1
        jaro = fma(0.1 * prefix, 1 - jaro, jaro)
    return jaro


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a bit-parallel in one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common tokens, and these with each side's own; 0 if a side has no token."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    p, q = ((both + " " + " ".join(sorted(z))).strip() for z in (x - y, y - x))
    return max(ratio(p, q), ratio(both, p) if both else 0.0, ratio(both, q) if both else 0.0)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer of at most its length; empty against text: 0."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n, letters, best = len(s), set(s), 0.0
    for i in range(1 - n, len(t)):
        w = t[max(0, i) : i + n]
        if w[0] in letters or w[-1] in letters:
            best = max(best, ratio(s, w))
            if best == 100.0:
                break
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, token and - for lengths that differ by half or more - partial ratios, damped."""
    if not a or not b:
        return 0.0
    rel = max(len(a), len(b)) / min(len(a), len(b))
    best = max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    if rel < 1.5:
        return best
    part = 0.9 if rel <= 8 else 0.6
    return max(ratio(a, b), part * partial_ratio(a, b), 0.95 * part * partial_token_ratio(a, b))


def prefix_share(a: str, b: str) -> float:
    return len(commonprefix([a, b])) / min(len(a), len(b)) if a and b else 0.0


def pairwise(f, a: Column, b: Column) -> Column:
    """f(text, text) -> double as an Arrow UDF; null counts as empty; equal pairs of a batch are computed once."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(x.to_pylist(), y.to_pylist()):
            if p not in seen:
                seen[p] = float(f(p[0] or "", p[1] or ""))
            out.append(seen[p])
        return pa.array(out, pa.float64())

    return run(a, b)


def jw(a: Column, b: Column) -> Column:
    return pairwise(jaro_winkler, a, b)
