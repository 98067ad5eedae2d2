"""A result log that a stream adds to, and that survives a run that breaks off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import latest


def logged(stream: DataFrame, path: str, each: Callable[[DataFrame], DataFrame] = lambda x: x, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a query that writes what ``each`` makes of a batch below ``path``, and its checkpoint beside it.

    A batch's rows go to a folder of its own number and replace what is there. If a run breaks off between the writing of a
    batch and its commit, the next run gets the same batch under the same number, so its rows are there once. after: called when a
    batch is written, before it is committed.
    """

    def write(rows: DataFrame, number: int) -> None:
        each(rows).write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        if after:
            after(number)

    return stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()


def read_log(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order`` and then by batch; ``batch`` says which wrote it."""
    return latest(spark.read.parquet(f"{path}/log").withColumn("batch", F.col("batch").cast("long")), key, [*order, "batch"])
