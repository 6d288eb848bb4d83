"""Snapshot differences over a stream of file versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factflow.operators import incremental


def changes(spark: SparkSession, versions: DataFrame, location: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call `handle` with the new and changed files of each micro-batch of `versions` (file_path, hash), and keep the
    snapshot at `location`.

    Each batch's snapshot is a folder named by its batch id, written once and read by the next, so a batch that runs
    again after a failure starts from the same state.
    """

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file_path").agg(F.max("hash").alias("hash"))
        old = spark.read.schema(latest.schema).parquet(f"{location}/{number - 1}") if number else latest.limit(0)
        diff = incremental.snapshot_diff(old, latest).where("status in ('new', 'dirty')")
        handle(latest.join(diff, "file_path"), number)
        incremental.upsert(old, latest, ["file_path"]).write.mode("overwrite").parquet(f"{location}/{number}")

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
