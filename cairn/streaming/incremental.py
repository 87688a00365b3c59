"""An addition for streams: micro-batches of new targets are linked to a static S1 as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cairn.functions.text import build_keys
from cairn.operators.blocking import run_blocking


def link(stream: DataFrame, s1_keys: DataFrame, sink: Callable[[DataFrame, int], None], **blocking) -> DataStreamWriter:
    """A writer, not started, that gives sink(candidates, batch id) of each micro-batch of raw targets.

    Block sizes and token counts are those of the batch. The sink should replace what it wrote for a batch id."""

    def batch(df: DataFrame, number: int) -> None:
        sink(run_blocking(s1_keys, [build_keys(df)], **blocking), number)

    return stream.writeStream.foreachBatch(batch)
