"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "docmill", cpus: int | str = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.speculation", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where it is unset on a local master (tests) is a temporary folder
    taken; on a cluster an unset folder is an error, because a machine-local
    folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="docmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_WRITTEN: list[str] = []


def place(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder, removed by `clear`."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    The folder stays until `clear`, since results are read from it lazily.
    """
    spark = df.sparkSession
    path = place(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the folders this program has written so far, once no result is read from them any more; returns how many."""
    done = 0
    while _WRITTEN:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return done
