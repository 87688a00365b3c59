"""Operator 1 - mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, target / size of its source. Whole parts are kept; fractional
parts are rounded together, in chunks of a source, from the heaviest unit to the lightest: a unit is paired with all lighter
ones of its chunk as one partner, and mass goes from one to the other, in the proportion that keeps the words they take, until
the unit or its whole partner is whole. What is left of a chunk, its lightest unit as a rule, meets the residuals of other
chunks in the next level of a reduction tree, up to one unit per source, which a coin decides. So a source's taken words miss
its target by about its lightest documents, whatever the partitions, and every unit keeps its expectation.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._util import materialize, n_words

KEYS = ["doc_id", "source", "size"]
EPS = 1e-12


def targets(stats: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_ratio: float = 3.0) -> DataFrame:
    """(source, source_size, n) -> the same with target: weights dealt in code-point order (null last) share all
    sizes; targets stop at max_ratio times the source's size and the excess is reshared by weight (water filling).
    One row per source goes through single-partition windows, never documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = stats.withColumn("w", w).withColumn("cap", F.lit(float(max_ratio)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) - before) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    free = F.col("level") * F.col("w")
    return s.select("source", "source_size", "n", F.coalesce(F.least(free, "cap"), F.col("cap")).alias("target"))


def pivot(p: float, w: list[float], u: list[float]) -> list[float]:
    """Round units that all expect p copies (0 to 1), by weights w in descending order and uniform numbers u; all but one at
    most become whole, and sum(w * x) and every expectation stay. Units without weight are decided by themselves.

    Lighter units share alike what their partner gains or loses, so all that wait have one value, v."""
    x, v, left, r = [p] * len(w), p, float(sum(w)), -1  # r: a unit that its partners could not make whole
    for j, wj in enumerate(w):
        if wj <= 0:
            x[j] = float(u[j] < p)
            continue
        left -= wj
        x[j] = v
        if r >= 0 or min(v, 1 - v) < EPS:
            x[j] = float(round(v))
        elif left <= 0:
            r = j
        else:
            up, down = min((1 - v) * wj, v * left), min(v * wj, (1 - v) * left)
            if u[j] * (up + down) < down:
                whole = (1 - v) * wj <= v * left
                x[j], v = (1.0, v - up / left) if whole else (v + up / wj, 0.0)
            else:
                whole = v * wj <= (1 - v) * left
                x[j], v = (0.0, v + down / left) if whole else (v - down / wj, 1.0)
            r = r if whole else j
    return [float(round(y)) if min(y, 1 - y) < EPS else y for y in x]


def pair(x: list[float], w: list[float], u: list[float]) -> list[float]:
    """The same for residuals, whose expectations x differ: two by two, the one that isn't whole yet meets the next."""
    x, r = list(x), -1
    for j, xj in enumerate(x):
        if xj <= 0.0 or xj >= 1.0:
            continue
        if r < 0:
            r = j
            continue
        xi, k = x[r], w[r] / w[j]
        up, down = min(1 - xi, xj / k), min(xi, (1 - xj) / k)
        if u[j] * (up + down) < down:  # r gains
            whole = 1 - xi <= xj / k
            xi, xj = (1.0, xj - up * k) if whole else (xi + up, 0.0)
        else:
            whole = xi <= (1 - xj) / k
            xi, xj = (0.0, xj + down * k) if whole else (xi - down, 1.0)
        x[r], x[j] = xi, min(max(xj, 0.0), 1.0)
        if whole:
            r = j
        if min(x[r], 1 - x[r]) < EPS:
            x[r], r = float(round(x[r])), -1
    return x


def _round(pdf: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """One chunk: the residual stays fractional unless last. At level 0 all of a source expect the same."""
    pdf = pdf.sort_values(["weight", "no_id", "doc_id", "size"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    src = pdf["source"].iloc[0]
    key = 0 if src is None else zlib.crc32(src.encode("utf-8", "surrogatepass")) + 1
    u = np.random.default_rng([seed, level, key, int(pdf["chunk"].iloc[0])]).random(len(pdf) + 1).tolist()
    w, p = pdf["weight"].tolist(), float(pdf["x"].iloc[0])
    if level:
        x = pair(pdf["x"].tolist(), w, u)
    else:
        x = pivot(p, w, u) if 0.0 < p < 1.0 else pdf["x"].tolist()
    pdf["x"] = [float(u[-1] < v) if last and 0.0 < v < 1.0 else v for v in x]
    return pdf


def _rounder(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _round(pdf, seed, level, last)

    return run


def decisions(sized: DataFrame, weights=(5, 2, 1), max_ratio: float = 3.0, seed: int = 42, chunk: int = 4096) -> DataFrame:
    """(doc_id, source, size) rows -> one row per distinct (doc_id, source, size) with source_size, target, copies.

    Rows equal in all three are one unit and get the same copies. Sources of size 0 have target 0; documents of
    size 0 round alone. Chunks are dealt by a hash of the row within its source, so that a hot source is split and
    reruns agree at any partitioning. Ties of weight are settled by the id."""
    units = sized.groupBy(*KEYS).agg(F.count("*").alias("n"))
    stats = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    stats = materialize(targets(stats, weights, max_ratio), "mix-targets")
    most = stats.agg(F.max("n")).first()[0] or 0
    s = stats.select(F.col("source").alias("s_source"), "source_size", "target", F.ceil(F.col("n") / chunk).alias("chunks"))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = units.join(s, F.col("source").eqNullSafe(F.col("s_source")))
    u = u.withColumn("weight", (F.col("size") * F.col("n")).cast("double")).withColumn("base", F.floor(p).cast("long")).withColumn("x", p - F.floor(p))
    u = u.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.col("chunks")))
    null_id = F.col("doc_id").isNull()  # pandas would turn a column of longs with nulls into doubles
    u = u.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), null_id.alias("no_id"), *KEYS[1:], "source_size", "target", "weight", "base", "x", "chunk")
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(most / chunk)), chunk)))
    done, left = [], u
    for level in range(levels):
        last = level == levels - 1
        out = materialize(left.groupBy("source", "chunk").applyInPandas(_rounder(seed, level, last), u.schema), "mix-level")
        done.append(out.where("x = 0 OR x = 1"))
        left = out.where("x > 0 AND x < 1").withColumn("chunk", F.floor(F.col("chunk") / chunk).cast("long"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.select(F.expr("if(no_id, null, doc_id)").alias("doc_id"), *KEYS[1:], "source_size", "target", (F.col("base") + F.col("x")).cast("long").alias("copies"))


def attach(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (doc_id, source, size and others) with their unit's source_size, target, copies.

    Both sides are shuffled by the unit at every size; units are hashed, texts are not sorted."""
    m = made.select(F.struct(*KEYS).alias("unit"), "source_size", "target", "copies")
    same = [F.col(k).eqNullSafe(F.col(f"unit.{k}")) for k in KEYS]
    return rows.join(m.hint("shuffle_hash"), same[0] & same[1] & same[2]).drop("unit")


def mix(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """Decide the mix of docs (doc_id, source, text): doc_id, size, source_size, target, taken, source, copies.

    Null texts have size 0; null ids and sources are values of their own; an empty table gives no rows; repeated
    rows each give a row. Other columns are ignored, whatever their names."""
    sized = materialize(docs.select("doc_id", "source", n_words(text).alias("size")), "mix-sizes")
    rows = attach(sized, materialize(decisions(sized, **params), "mix-made"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def apply_mix(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; the same columns and values, whatever their names.

    Nulls, empty texts and repeats as in mix()."""
    sized = docs.select("doc_id", "source", n_words(text).alias("size"))
    made = materialize(decisions(sized, **params), "mix-made").where("copies > 0")
    rows = attach(docs.select("doc_id", "source", n_words(text).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), made)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
