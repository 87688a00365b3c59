"""Readers and writers: tab-separated sources, Parquet, submissions, dictionaries, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import build_keys

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str | None = RAW) -> DataFrame:
    """Tab-separated with a header, no quoting, all strings; schema None infers types (for audits)."""
    r = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, row_number: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.row_index").alias("file_row_number")) if row_number else df


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Zstandard; an existing table stays unless overwrite; the committer makes the result appear whole."""
    df.write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd").parquet(path)


def convert(spark: SparkSession, sources: dict[str, str], out: str, overwrite: bool = False) -> None:
    """Every TSV source to Parquet under its name."""
    for name, path in sources.items():
        write_parquet(read_tsv(spark, path), f"{out}/{name}", overwrite)


def reconcile(spark: SparkSession, text_path: str, table: DataFrame) -> DataFrame:
    """lines (without the header), rows, agree (they differ by one at most)."""
    lines = spark.read.text(text_path).agg((F.count("*") - 1).alias("lines"))
    both = lines.join(table.agg(F.count("*").alias("rows")))
    return both.withColumn("agree", F.abs(F.col("lines") - F.col("rows")) <= 1)


def write_submission(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header and no quoting, rows in order of the id."""
    one = df.orderBy("source1_entity_id").coalesce(1)
    one.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str, key: str, value: str, most: int = 5_000_000) -> dict[str, str]:
    """A mined dictionary for the driver, at most that many entries."""
    rows = spark.read.json(path).select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} entries")
    return {r[0]: r[1] for r in rows}


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, columns of every table, in one job."""
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_bytes(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, files, bytes, rows, columns of every table read from files, in one job."""
    out = None
    for n, df in tables.items():
        f = df.groupBy(F.col("_metadata.file_path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
        one = f.agg(F.lit(n).alias("name"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"), F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def build_keys_table(spark: SparkSession, raw: str, out: str, dictionaries: dict | None = None, overwrite: bool = False) -> bool:
    """Raw records from Parquet to a table of keys, streamed through one Arrow UDF; a table that is there stays unless overwrite.

    Returns whether it was written. The committer makes the table appear whole or not at all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not overwrite and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    write_parquet(build_keys(spark.read.parquet(raw), dictionaries), out, overwrite=True)
    return True


def build_all(spark: SparkSession, sources: list[str], raw_dir: str, out_dir: str, dictionaries: dict | None = None, overwrite: bool = False) -> dict[str, bool]:
    """build_keys_table() of every source; which of them were written."""
    return {n: build_keys_table(spark, f"{raw_dir}/{n}", f"{out_dir}/{n}", dictionaries, overwrite) for n in sources}
