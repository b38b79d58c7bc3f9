"""A run: read a CSV, take a slice, work through its batches, write, log, export, and upload.

Batches are worked through in waves of several, each one Spark job whose rows are written before
the next begins. What is already written for a position is not done again, so a run that was
killed goes on where it stopped, and its rows are there once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import select, sinks
from docmill.session import materialise
from docmill.sources.csvsource import read_csv
from docmill.spec import RunSpec

Stage = Callable[[DataFrame], DataFrame]
#: Batches of a wave.
WAVE = 1024


@dataclass(frozen=True)
class Outcome:
    """What a run did: its slice, batches, rows worked on and rows that were there already."""

    run_id: str
    start_row: int
    end_row: int
    batches: int
    rows: int
    skipped: int
    seconds: float
    finished: bool


def store_of(spec: RunSpec) -> str:
    """Folder of the rows written so far."""
    return spec.output_path + ".batches"


def ledger_of(spec: RunSpec) -> str:
    return spec.output_path + ".runs"


def run(spark: SparkSession, spec: RunSpec, stage: Stage, order: str | None = None, wave: int = WAVE, waves: int | None = None) -> Outcome:
    """Run `stage` over the slice of the input and write its rows with `pos` and `batch_num`.

    Rows are in file order, which one file has, or in the order of the whole numbers in column `order`.
    At most `waves` waves are worked through; a run that is cut short is not logged
    and exports nothing. An empty slice writes nothing but its log line.
    """
    began = time.time()
    rows = read_csv(spark, spec.input_path, ordinal="__ordinal")
    if spec.url_column not in rows.columns:
        raise ValueError(f"no column {spec.url_column} in {spec.input_path}")
    if order is not None:
        rows = rows.withColumn("__ordinal", F.col(order).cast("long"))
    n = rows.count()
    lo, hi = spec.bounds(n)
    store = store_of(spec)
    placed = select.slice_rows(rows, "__ordinal", lo, hi).drop("__ordinal").withColumn("batch_num", (F.floor((F.col("pos") - lo) / spec.batch_size) + 1).cast("long"))
    placed = materialise(placed, "run")
    todo = placed
    if sinks._there(spark, store):
        todo = materialise(placed.join(spark.read.parquet(store).select("pos").distinct(), "pos", "left_anti"), "run-todo")
    left = todo.count()
    numbers = [r[0] for r in todo.select(F.floor((F.col("batch_num") - 1) / wave).alias("w")).distinct().orderBy("w").collect()]
    for w in numbers if waves is None else numbers[:waves]:
        part = todo.filter((F.col("batch_num") > w * wave) & (F.col("batch_num") <= (w + 1) * wave))
        out = stage(part)
        out = out.withColumn("__place", F.col("pos") + 1)  # places count from 1, as batches do
        sinks.append_batches(out, store, "__place", group=spec.batch_size * wave, key="pos")
    finished = waves is None or len(numbers) <= waves
    run_id = str(uuid.uuid4())
    if finished:
        sinks.log_run(spark, ledger_of(spec), lo, hi, time.time() - began, run_id=run_id)
        if hi > lo:
            sinks.export_csv(written(spark, spec), spec.output_path)
    return Outcome(run_id, lo, hi, spec.batches(n), left, (hi - lo) - left, time.time() - began, finished)


def written(spark: SparkSession, spec: RunSpec) -> DataFrame:
    """All rows written so far."""
    got = spark.read.parquet(store_of(spec)).drop("part", "__place")
    return got.filter(F.col("is_annual_report")) if spec.annual_only and "is_annual_report" in got.columns else got
