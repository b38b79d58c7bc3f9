"""Helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docmill.session import materialise

__all__ = ["materialise", "read_file", "spread", "table", "write_file"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the input has fewer files than that; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any file system the session knows; None if it is not there."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside its place and renamed, so that no reader meets a part of it."""
    at, fs = _file(spark, path)
    part, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not fs.rename(part, at):
        fs.delete(part, False)  # another writer was first
