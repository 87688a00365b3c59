"""Vectors in indexed blocks: what the two vector searches (operators 2 and 6) share.

Rows are dealt round robin to blocks of a bounded number of cells; a block is written once to the shared folder, with its
matrix and the row order of each of its sorted lists. Queries, a fixed share of the rows, are packed too and are all that
is shuffled: each goes to every slice of the blocks, and there are at most SLICES of these. A task reads the blocks of its
slice one after the other and carries each query's k best, so that later blocks are searched with the bound that
earlier ones gave. A window keeps the k best of all slices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._util import filesystem, materialize

DATA_ROWS, QUERY_ROWS, CELLS, SLICES = 16_384, 256, 1 << 21, 16


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(id long, v array<double>) of every row that takes part.

    Null ids, null vectors and vectors with null or non-finite components take no part, nor do vectors without a component
    other than zero unless zero. Rows that repeat an id, with equal or other vectors, all stay."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(dims: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows of a ragged list of vectors; shorter ones end in zeros."""
    width = int(dims.max(initial=0))
    if (dims == width).all():
        return flat.reshape(len(dims), width)
    m = np.zeros((len(dims), width))
    m[np.arange(width) < dims[:, None]] = flat
    return m


def pack(rows: DataFrame, n: int, size: int, index: Callable | None, name: str) -> DataFrame:
    """(id, v) -> (ids, dims, data, lists) as binaries, about n blocks of at most size rows, written already.

    index(matrix) -> array of row numbers, one sorted list per line of it."""

    def run(batches):
        ids, dims, data = [], [], []
        for b in batches:
            v = b.column(1)
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            dims.append(np.diff(v.offsets.to_numpy()))
            data.append(v.flatten().to_numpy(zero_copy_only=False))
        if not ids:
            return
        ids, dims, data = np.concatenate(ids).astype("<i8"), np.concatenate(dims).astype("<i4"), np.concatenate(data).astype("<f8")
        ends = np.concatenate(([0], np.cumsum(dims)))
        for i in range(0, len(ids), size):
            d, x = dims[i : i + size], data[ends[i] : ends[min(i + size, len(ids))]]
            lists = index(matrix(d, x)).astype("<u2").tobytes() if index and len(d) else b""
            columns = [ids[i : i + size].tobytes(), d.tobytes(), x.tobytes(), lists]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["ids", "dims", "data", "lists"])

    return materialize(rows.repartition(n).mapInArrow(run, "ids binary, dims binary, data binary, lists binary"), name)


def unpack(ids: bytes, dims: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), matrix(np.frombuffer(dims, "<i4"), np.frombuffer(data, "<f8"))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.ascontiguousarray(np.pad(m, ((0, 0), (0, w - m.shape[1])))) if m.shape[1] < w else m for m in (a, b))


def search(rows: DataFrame, every: int, k: int, index: Callable, probe: Callable, score: str, name: str, data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Queries (ids divisible by every) against all rows with other ids -> query_id, rank, vec_id, score.

    A query is an id: rows with its id are its own, and where several rows share it the k best of all their pairs count.
    index(width of the widest vector) -> the index of pack(); probe(that width) -> a function of (query ids, query matrix, row
    matrix, row ids, lists, best) that brings best, per query (row ids, scores) of the k best so far in order of rank, up to date with one more block."""
    spark = rows.sparkSession
    kept = materialize(rows, name)
    n, n_q, width = kept.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first()
    kind = np.int64 if score == "long" else np.float64
    if not n_q:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    size = min(data_rows, max(64, CELLS // max(1, width)), 65_535)
    n_d = -(-n // size)
    folder = pack(kept, n_d, size, index(width), f"{name}-blocks")._cairn_path
    q = pack(kept.where(F.col("id") % every == 0), -(-n_q // min(size, query_rows)), min(size, query_rows), None, f"{name}-queries")
    slices, meet = min(SLICES, n_d), probe(width)

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, root = filesystem(folder)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
        for b in batches:
            for r in b.to_pylist():
                qi, qv = unpack(r["ids"], r["dims"], r["data"])
                best = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in qi]
                for file in files[r["slice"] :: slices]:
                    for block in pq.ParquetFile(file, filesystem=fs).iter_batches(batch_size=1):
                        (d,) = block.to_pylist()
                        di, dv = unpack(d["ids"], d["dims"], d["data"])
                        lists = np.frombuffer(d["lists"], "<u2").reshape(-1, len(di))
                        meet(qi, *same_width(qv, dv), di, lists, best)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(qi, [len(a) for a, _ in best])),
                    pa.array(np.concatenate([a for a, _ in best])),
                    pa.array(np.concatenate([s for _, s in best]).astype(kind)),
                ], names=["query_id", "vec_id", "score"])

    pairs = q.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "ids", "dims", "data")
    found = pairs.repartition(min(4096, slices * -(-n_q // query_rows))).mapInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def merge(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate((best[0], ids)), np.concatenate((best[1], scores))
    at = top(ids, scores, k)
    return ids[at], scores[at]
