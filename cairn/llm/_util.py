"""Helpers shared by the training-data operators: shared-folder tables, files, folds, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.stages import shared_dir

#: A word, as all operators here count it: a run without blank, tab, line and form feed characters.
WORD = r"[^\x20\x09-\x0D]+"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cairn_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(file system, path) of a folder that every executor can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long) -> (node, root), root being the component's least node.

    Alternates large-star and small-star; every round is two joins on the edges that are left, written to the shared folder.
    Both sides of a join are written tables, so that adaptive plans can split a node with many edges. Nodes without an edge
    don't appear.
    """
    now = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())

    old = mark(now)
    while old[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").selectExpr("stack(2, b, m, a, m) AS (a, b)").where("a <> b").distinct()
        small = small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
        new = materialize(small, name)
        for done in (now, least, large, low):
            release(done)
        now, seen = new, mark(new)
        if seen == old:
            break
        old = seen
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    out = roots.select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return out
