"""Row order and batches without a global single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _blocks(df: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, blocks with the position of their first row, their rows and the rows of all)."""
    keyed = df.withColumn("__block", F.floor(F.col(key) / F.lit(block)))
    counts = keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(F.col("__block").asc_nulls_first())
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return keyed, counts.select(F.col("__block").alias("__b"), before.alias("__offset"), "__n", total.alias("__total"))


def _ranked(keyed: DataFrame, blocks: DataFrame, key: str, out: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(F.col(key).asc_nulls_first()))
    met = keyed.join(blocks, F.col("__block").eqNullSafe(F.col("__b")))
    return met.withColumn(out, (F.col("__offset") + rank - 1).cast("long")).drop("__block", "__b", "__offset", "__n", "__total")


def with_position(df: DataFrame, key: str, out: str = "pos", block: int = BLOCK) -> DataFrame:
    """Add the 0-based rank of a unique long key as column `out`.

    Two levels: rows are counted per key block, the block counts are summed up
    (one row per block: a billionth of 100 TB of rows), and each block is ranked by
    itself. A task sees `block` rows of a unique key at most; null keys, and the rows of
    a key that is not unique, are ranked together. Null keys come first; repeated keys are ranked in
    arbitrary order. A clash of `out` overwrites.
    """
    return _ranked(*_blocks(df, key, block), key, out)


def slice_rows(df: DataFrame, key: str, start: int | None, end: int | None, out: str = "pos", block: int = BLOCK) -> DataFrame:
    """Rows `start:end` in the order of key, with Python's slice rules; negatives count from the end.

    The counts choose the blocks that the slice touches; only their rows are shuffled and ranked.
    """
    keyed, blocks = _blocks(df, key, block)
    from_end = lambda k: F.col("__total") + k if k < 0 else F.lit(k)
    lo = F.greatest(from_end(start or 0), F.lit(0))
    hi = F.col("__total") if end is None else from_end(end)
    touched = blocks.withColumns({"__lo": lo, "__hi": hi}).filter((F.col("__offset") < F.col("__hi")) & (F.col("__offset") + F.col("__n") > F.col("__lo")))
    inside: Column = (F.col(out) >= F.col("__lo")) & (F.col(out) < F.col("__hi"))
    return _ranked(keyed, touched, key, out).filter(inside).drop("__lo", "__hi")


def with_batch(df: DataFrame, size: int, pos: str = "pos", out: str = "batch_num") -> DataFrame:
    """1-based batch number of each position."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    return df.withColumn(out, (F.floor(F.col(pos) / size) + 1).cast("long"))


def batch_count(df: DataFrame, size: int) -> DataFrame:
    """One row: rows and the batches they fill."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), F.ceil(n / size).cast("long").alias("n_batches"))
