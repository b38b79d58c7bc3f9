"""Stage 1 over arriving files: the same DataFrame stages inside Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.sinks import append_batches


def stream_stage(
    spark: SparkSession, source: str, schema: T.StructType, stage: Callable[[DataFrame], DataFrame],
    out: str, checkpoint: str, files_per_trigger: int = 64, available_now: bool = True,
) -> StreamingQuery:
    """Run `stage` on each micro-batch of new Parquet files and append it under its batch number.

    A micro-batch that runs again after a failure replaces its own partition, so
    the output holds every row once; the checkpoint is where a rerun resumes.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_batches(stage(batch).withColumn("batch_num", F.lit(number + 1).cast("long")), out, group=1)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
