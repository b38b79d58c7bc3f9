"""All-text CSV scan with the header and missing-value rules users of data frames expect."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts read as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_OVER, _ABSENT = "__overflow", "\x01"


def header_names(cells: list[str | None]) -> list[str]:
    """Unnamed cells become `Unnamed: i`, repeated names get `.1`, `.2`, ..."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        base = cell or f"Unnamed: {i}"
        tries = itertools.chain([base], (f"{base}.{k}" for k in itertools.count(1)))
        out.append(next(t for t in tries if t not in out))
    return out


def read_csv(
    spark: SparkSession, path: str, na: tuple[str, ...] = NA_VALUES, on_long: str = "fail",
    drop_index: bool = True, ordinal: str | None = "row_ordinal",
) -> DataFrame:
    """Every column as text; quoted line breaks and doubled quotes are read; blank lines are skipped.

    Short rows are filled with null. A row longer than the header fails the job
    (`on_long="fail"`), or is dropped ("drop") or kept alone ("only"), which gives
    a quarantine. `drop_index` removes an unnamed first column. `ordinal` adds a
    unique key that rises in file order (dense in a single file read by one task;
    `operators.select.with_position` makes it dense at any size).
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"no header in {path}")
    names = header_names([c.lstrip("﻿") if c else c for c in first[0]])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(_OVER, T.StringType())])
    df = spark.read.options(**options, header=True, nullValue=_ABSENT, emptyValue="", enforceSchema=True, mode="PERMISSIVE").schema(schema).csv(path)
    is_long = F.col(_OVER).isNotNull()
    if on_long == "fail":
        df = df.filter(F.when(~is_long, F.lit(True)).otherwise(F.raise_error(F.lit("a row is longer than the header"))))
    else:
        df = df.filter(is_long if on_long == "only" else ~is_long)
    skip = 1 if drop_index and names[0] == "Unnamed: 0" else 0
    cols = [F.when(~F.col(f"c{i}").isin(*na), F.col(f"c{i}")).alias(n) for i, n in enumerate(names)][skip:]
    key = [F.monotonically_increasing_id().alias(ordinal)] if ordinal else []
    return df.select(*key, *(c for c, n in zip(cols, names[skip:]) if n != ordinal))


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of the files under a folder, for documents that are already stored."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
