"""Operator 8 - SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments, a point of {0,1,2}^32. The Manhattan
distance of two points is a lower bound of the Hamming distance. If that is at most r, one half of the segments is
within r // 2, and then the two halves share a cell of the grid when each takes its own cell and all cells within
ceil(r / 4) steps. Rows that meet in a cell and whose points are within r by Manhattan distance are verified bit by bit.
Equal fingerprints are one row before the join, and a cell gives a spanning star of each cluster, not its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._util import components, materialize

SEGMENTS = 16  # segments of two bits in a half


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles (whole sequence if shorter; none if there is no word)."""
    parts = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    norm = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(norm, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(parts) - words + 1].tolist()
    ends = np.concatenate((gaps, [len(norm)]))[words - 1 :].tolist()
    return np.fromiter((h(norm[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles (whole sequence if shorter; 0 if there is no word)."""
    hashes = shingles(text, words, seed)
    if len(hashes) <= 1:
        return int(hashes[0]) if len(hashes) else 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row; null texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _neighbours(steps: int) -> list[list[tuple[int, int]]]:
    """All moves of at most that many steps in a half: lists of (segment, +-1)."""
    one = [(s, d) for s in range(SEGMENTS) for d in (1, -1)]
    return [list(m) for k in range(steps + 1) for m in itertools.combinations_with_replacement(one, k) if not any((s, -d) in m for s, d in m)]


def cells(fps: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of fp): own and neighbour cells of both halves. A cell is half << 32 | counts, two bits each."""
    u = fps.view(np.uint64)
    counts = (u & np.uint64(0x5555555555555555)) + ((u >> np.uint64(1)) & np.uint64(0x5555555555555555))
    every, rows = [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        packed = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for move in _neighbours(steps):
            cell, ok = packed.copy(), np.ones(len(fps), bool)
            for s, d in move:
                level = (cell >> (2 * s)) & 3
                ok &= level < 2 if d > 0 else level > 0
                cell += d << (2 * s)
            every.append(cell[ok] + (half << 32))
            rows.append(index[ok])
    return np.concatenate(every), np.concatenate(rows)


def points(u: np.ndarray) -> np.ndarray:
    """The popcount points of fingerprints, each count in unary (0: 00, 1: 01, 2: 11), so that distances are bit counts."""
    low, high = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    either, both = (u | (u >> np.uint64(1))) & low, (u & (u << np.uint64(1))) & high
    return either | both


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points(); at most the Hamming distance of their fingerprints."""
    return np.bitwise_count(a ^ b)


def near(u: np.ndarray, p: np.ndarray, i, j, r: int) -> np.ndarray:
    """Which of the pairs (i, j) are within r bits: the lower bound by their points p first, then exactly."""
    out = manhattan(p[i], p[j]) <= r
    at = np.flatnonzero(out)
    i, j = (np.broadcast_to(x, out.shape)[at] for x in (i, j))
    out[at] = np.bitwise_count(u[i] ^ u[j]) <= r
    return out


def stars(cell: np.ndarray, fp: np.ndarray, r: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell -> links (from, to): within each cell every row but one of a cluster is linked to that one."""
    u = fp.view(np.uint64)
    p = points(u)
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    run = np.diff(cut)
    start, length = np.repeat(cut[:-1], run), np.repeat(run, run)
    at = np.arange(len(u))
    ends = start + length
    few = length <= small
    x, y = [at[:0]], [at[:0]]
    for d in range(1, small):
        i = np.flatnonzero(few & (at + d < ends))
        if not len(i):
            break
        i = i[near(u, p, i, i + d, r)]
        x.append(i)
        y.append(i + d)
    x, y = np.concatenate(x), np.concatenate(y)
    root = at.copy()
    while len(x):  # the least row that the pairs of a cell connect a row with
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(root != at)
    out_a, out_b = [fp[root[linked]]], [fp[linked]]
    for s, n in zip(cut[:-1][run > small].tolist(), run[run > small].tolist()):  # search from one to all not yet seen
        own = np.unique(u[s : s + n])
        own_p = points(own)
        todo = np.arange(len(own))
        while len(todo):
            first, front, todo = todo[0], [todo[0]], todo[1:]
            got = [todo[:0]]
            while front and len(todo):
                hit = near(own, own_p, todo, front.pop(), r)
                got.append(todo[hit])
                front.extend(todo[hit].tolist())
                todo = todo[~hit]
            got = np.concatenate(got)
            out_a.append(np.full(len(got), own[first]).view(np.int64))
            out_b.append(own[got].view(np.int64))
    return np.concatenate(out_a), np.concatenate(out_b)


def links(fps: DataFrame, r: int = 4) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) that connect all within r bits."""
    steps = -(-(r // 2) // 2)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 8192):
                cell, row = cells(fp[i : i + 8192], steps)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[i : i + 8192][row])], names=["cell", "fp"])

    def meet(batches):
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cell = np.concatenate((cell, b.column(0).to_numpy(zero_copy_only=False)))
                fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False)))
                if not len(cell) or cell[0] == cell[-1]:
                    continue
                end = np.searchsorted(cell, cell[-1])
            else:
                end = len(cell)
            x, y = stars(cell[:end], fp[:end], r)
            cell, fp = cell[end:], fp[end:]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    spread_out = fps.select("fp").mapInArrow(spread, "cell long, fp long")
    met = spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long")
    return met.where("a <> b").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, r: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root) of every distinct fingerprint; both written to the shared folder."""
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    each = materialize(prints.select("fp").distinct(), "simhash-each")
    cc = components(links(each, r), "simhash-cc").withColumnRenamed("node", "fp")
    roots = each.join(cc, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, materialize(roots, "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, r: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id whose fingerprint is reachable over links
    of at most r bits. One row per input row, repeated ones too; an empty table gives no rows.

    Null and blank texts have fingerprint 0 and are linked like any other. Null ids are kept and never are a
    component_id unless all ids of a component are null (then it is null). Other columns are ignored, whatever their names.
    What joins on a root or fingerprint is written first, so that adaptive plans can split a key that holds many rows."""
    prints, roots = grouped(docs, id_col, text_col, words, r)
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    least = each.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(materialize(least, "simhash-components"), "root").select("fp", "component_id")
    out = prints.join(materialize(of, "simhash-of"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, r: int = 4, group: Callable | None = None, name: Callable | None = None) -> DataFrame:
    """docs (doc_id, text and any other columns, which stay, whatever their names) without near-duplicates: one row of each
    component.

    The row with the smallest id stays, null ids last; of rows that share an id and a component, that with the
    smallest fingerprint, then text hash. Texts are shuffled once, by their ids, at every size. group(docs) and name(text)
    stand for other groups than the fingerprints' and for the fp of a text there."""
    name = name or (lambda t: fingerprint(t, words))
    prints, roots = group(docs) if group else grouped(docs, "doc_id", "text", words, r)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("w")
    kept = prints.join(roots, "fp").groupBy("root").agg(first).select(F.col("w.doc_id").alias("w_id"), F.col("w.fp").alias("w_fp"))
    kept = materialize(kept, "simhash-kept")
    shared = materialize(prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("s_id")), "simhash-shared")
    same_id = F.col("doc_id").eqNullSafe(F.col("w_id"))
    dropped = prints.join(kept, same_id & (F.col("fp") == F.col("w_fp")), "left_anti").select(F.col("doc_id").alias("d_id")).distinct()
    dropped = materialize(dropped, "simhash-dropped").hint("shuffle_hash")
    is_shared = F.col("doc_id").eqNullSafe(F.col("s_id"))
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if shared.isEmpty():
        return rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")), "left_anti").select("row.*")
    rest = rows.join(shared.hint("shuffle_hash"), is_shared, "left_anti").join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")), "left_anti")
    again = rows.join(shared.hint("shuffle_hash"), is_shared, "left_semi")  # ids that don't say which row is meant: by fingerprint too
    schema = T.StructType([*again.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((name(t) for t in b.column(1).field("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=schema.names)

    order = Window.partitionBy("doc_id", "fp").orderBy(F.xxhash64("row.text"), "row.text")
    again = again.mapInArrow(run, schema).join(kept, same_id & (F.col("fp") == F.col("w_fp")), "left_semi")
    again = again.withColumn("n", F.row_number().over(order)).where("n = 1")
    return rest.select("row").unionByName(again.select("row")).select("row.*")
