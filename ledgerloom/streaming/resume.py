"""Resumable intake of a growing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume_stream(spark: SparkSession, in_dir: str, schema: str, store: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], max_files: int = 1000) -> StreamingQuery:
    """Runs work over the files that are new since the last run and ends. Each micro-batch is
    a folder of its own, written over if the batch runs again, so a restart repeats nothing."""

    def save(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number:010d}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(in_dir)
    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
