"""Tables between the stages of a job: written once to the folder that all executors share, read back by whoever needs them.

A written table cuts the lineage, survives lost executors and is scanned instead of being computed again. open_stages() gives
all queries of a session over the same input files the same tables; an input that changes gives new ones.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Writes a stage's table under a name and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]


def lazy(df: DataFrame, name: str) -> DataFrame:
    """A Keep that writes nothing: one plan, for small inputs and streams."""
    return df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a local master, as in tests, a temporary folder that goes with the process."""
    if conf := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (own := spark.conf.get("cairn.stages.dir", None)):
        own = tempfile.mkdtemp(prefix="cairn-stages-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("cairn.stages.dir", own := f"file://{own}")
    return own


def input_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


class Stages:
    """The tables of one input, made when first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A Keep. Every table has a folder of its own, so that a write that failed leaves nothing behind that is read."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.write(make(), name)
        return self.made[name]


_OPEN: dict[tuple, Stages] = {}


def open_stages(spark: SparkSession, path: str) -> Stages:
    key = (spark.sparkContext.applicationId, path, input_state(spark, path))
    if key not in _OPEN:
        _OPEN[key] = Stages(spark)
    return _OPEN[key]
