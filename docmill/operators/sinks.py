"""Sinks: idempotent batch append, data-frame shaped CSV, run ledger, resume, object names."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.session import materialise

LEDGER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("start_row", T.LongType()),
        T.StructField("end_row", T.LongType()),
        T.StructField("time_elapsed", T.DoubleType()),
        T.StructField("started_at", T.TimestampType()),
    ]
)


#: Batches that lie in one folder, and files a folder's rows are spread over.
GROUP, FILES = 256, 8


def append_batches(df: DataFrame, path: str, batch: str = "batch_num", group: int = GROUP, key: str | None = None) -> None:
    """Write rows into folders of `group` batches each and replace what is written again.

    Rows of a batch (or, with `key`, of a key) that is in `df` replace those written before;
    all other rows of its folder stay. A rerun after a lost job therefore neither repeats
    nor loses rows. A null batch has a folder of its own. Rows are spread over FILES tasks per
    folder, so that no large batch is one task and no folder is many small files. The
    column `part`, the folder's number, is added; batches are numbered from 1.
    """
    spark, by = df.sparkSession, key or batch
    part = F.floor((F.col(batch) - 1) / group).cast("long")
    new = df.withColumn("part", part)
    if _there(spark, path):
        new = materialise(new, "append")
        schema = T.StructType([f for f in new.schema.fields])
        old = spark.read.schema(schema).parquet(path)
        folders, rows = new.select(F.col("part").alias("__p")).distinct(), new.select(F.col(by).alias("__k")).distinct()
        kept = old.join(F.broadcast(folders) if group > 1 and folders.count() <= 10_000 else folders, F.col("part").eqNullSafe(F.col("__p")), "left_semi")
        kept = kept.join(rows, F.col(by).eqNullSafe(F.col("__k")), "left_anti")
        new = materialise(kept.select(*new.columns), "append").unionByName(new)
    spread = F.pmod(F.xxhash64(F.col(by), F.monotonically_increasing_id() if key is None else F.lit(0)), F.lit(FILES))
    new.repartition("part", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and any(s.isDirectory() and s.getPath().getName().startswith("part=") for s in fs.listStatus(at))


def pending(df: DataFrame, done: DataFrame, batch: str = "batch_num") -> DataFrame:
    """Rows of the batches that are not in `done`; a null batch counts as pending."""
    return df.join(done.select(batch).distinct(), batch, "left_anti")


def pending_rows(df: DataFrame, ledger: DataFrame, pos: str = "pos", block: int = 1 << 16) -> DataFrame:
    """Rows whose position no logged range covers; ranges are half-open, runs without a time did not end.

    Ranges are merged to disjoint ones first (one row per run, not per data row), then
    laid out over blocks of positions, so that the check is an equi-join on the block.
    """
    runs = ledger.filter(F.col("time_elapsed").isNotNull() & (F.col("start_row") < F.col("end_row"))).select("start_row", "end_row").distinct()
    w = Window.orderBy("start_row", "end_row")
    before = F.max("end_row").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = (
        runs.withColumn("__new", F.when(before >= F.col("start_row"), 0).otherwise(1))
        .withColumn("__island", F.sum("__new").over(w))
        .groupBy("__island")
        .agg(F.min("start_row").alias("__s"), F.max("end_row").alias("__e"))
        .select("__s", "__e", F.explode(F.sequence(F.floor(F.col("__s") / block), F.floor((F.col("__e") - 1) / block))).alias("__b"))
    )
    inside = (F.col("__b") == F.floor(F.col(pos) / block)) & (F.col("__s") <= F.col(pos)) & (F.col(pos) < F.col("__e"))
    return df.join(ranges, inside, "left_anti")


def log_runs(runs: DataFrame, path: str) -> None:
    """Append runs to the ledger."""
    runs.select(*(F.col(f.name).cast(f.dataType) for f in LEDGER.fields)).coalesce(1).write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, start: int, end: int, elapsed: float, started: dt.datetime | None = None, run_id: str | None = None) -> str:
    """Append one run to the ledger and return its id."""
    run_id = run_id or str(uuid.uuid4())
    row = [(run_id, start, end, float(elapsed), started or dt.datetime.now(dt.UTC))]
    log_runs(spark.createDataFrame(row, LEDGER), path)
    return run_id


def latest_runs(ledger: DataFrame) -> DataFrame:
    """One row per run id: repeated log lines fold into the one that has a time."""
    return ledger.groupBy("id").agg(
        F.min("start_row").alias("start_row"),
        F.max("end_row").alias("end_row"),
        F.max("time_elapsed").alias("time_elapsed"),
    )


def export_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV files in the shape data-frame tools write: True/False, doubled quotes, an unnamed index column first."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        cols.append(c.alias("Unnamed: 0" if f.name == index else f.name))
    if index:
        cols.insert(0, cols.pop(df.columns.index(index)))
    df.select(*cols).write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


#: Letters of the default zone by its hours from UTC.
ZONE, LETTERS = "America/Chicago", {-5: "CDT", -6: "CST"}


def object_key(kind: str, ts: Column, zone: str = ZONE, letters: Mapping[int, str] | None = None) -> Column:
    """`<kind>_<local time> <zone letters>.csv` for an instant; hours without letters are written as a number."""
    letters = LETTERS if letters is None and zone == ZONE else letters or {}
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    local = F.from_utc_timestamp(utc, zone)
    hours = F.floor((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 3600).cast("int")
    name = F.concat(F.lit("UTC"), F.when(hours < 0, "").otherwise("+"), hours.cast("string"))
    for h, text in letters.items():
        name = F.when(hours == h, text).otherwise(name)
    return F.concat(F.lit(f"{kind}_"), F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), name, F.lit(".csv"))


def object_name(kind: str, at: dt.datetime, zone: str = ZONE) -> str:
    """The same name of one instant, made on the driver."""
    return f"{kind}_{at.astimezone(ZoneInfo(zone)):%Y-%m-%d %H:%M:%S %Z}.csv"


def _outcome(uri: str, put: Callable[[], object]) -> dict[str, object]:
    try:
        put()
        return {"uri": uri, "ok": True, "error": None}
    except Exception as e:  # reported to the caller, never swallowed
        return {"uri": uri, "ok": False, "error": f"{type(e).__name__}: {e}"}


def upload(df: DataFrame, uri: str) -> dict[str, object]:
    """Write to an object store address and report what really happened."""
    return _outcome(uri, lambda: df.write.mode("errorifexists").parquet(uri))


def copy_to(spark: SparkSession, source: str, uri: str) -> dict[str, object]:
    """Copy a file or folder of any file system to another; an existing target is an error."""

    def put() -> None:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        a, b = fs.Path(source), fs.Path(uri)
        if not fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, False, conf):
            raise OSError("the copy failed")

    return _outcome(uri, put)


def upload_run(spark: SparkSession, source: str, output: str, input_store: str, output_store: str, at: dt.datetime | None = None) -> list[dict[str, object]]:
    """Copy a run's input and output to two stores under names of one instant; each outcome is reported, none stops the other."""
    at = at or dt.datetime.now(dt.UTC)
    pairs = ((source, input_store, "input"), (output, output_store, "output"))
    return [copy_to(spark, path, f"{store.rstrip('/')}/{object_name(kind, at)}") for path, store, kind in pairs]
