"""Stage 1: label each row; no row is removed."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import reply as R
from docmill.functions.template import CLASSIFY_URL, classify_prompt
from docmill.operators.provider import CallPolicy, ModelProvider, row_stage

VERDICT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("is_annual_report", T.BooleanType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("classification_reason", T.StringType()),
    ]
)


def verdict(raw: str | None) -> dict[str, Any]:
    """The columns of a raw reply: defaults for absent keys, markers for a failed reply."""
    return _verdict(*R.decode(raw))


def _verdict(status: str, got: dict[str, Any] | None) -> dict[str, Any]:
    if got is not None:
        label, sure, why = got.get("is_annual_report", False), got.get("confidence", "unknown"), got.get("reason", "")
        if isinstance(label, bool | None) and isinstance(sure, str | None) and isinstance(why, str | None):
            return {"status": status, "is_annual_report": label, "confidence": sure, "classification_reason": why}
        status = R.BAD_TYPE
    return {"status": status, "is_annual_report": None, "confidence": "failed", "classification_reason": "API call failed"}


def classify(
    df: DataFrame,
    provider: ModelProvider,
    url: str = "pdf_url",
    text: str | None = "pdf_text",
    policy: CallPolicy = CallPolicy(),
    hints: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Append status and the verdict columns. text=None judges by address alone.

    `hints` are further columns the provider reads; they, the prompt and the text
    are not passed on, but for those in `keep`. A null address is judged like any other. A reply that is no JSON is
    asked for again like a failed call.
    """
    prompt: Column = classify_prompt(F.col(url), F.col(text)) if text else CLASSIFY_URL.column(url=F.col(url))
    needs = ("__prompt", *hints)

    def call(row: Mapping[str, Any]) -> Mapping[str, Any]:
        return _verdict(*policy.ask(provider, row["__prompt"], "classify", row, R.decode, R.unreadable))

    asked = df.withColumn("__prompt", prompt)
    return row_stage(asked, VERDICT, call, needs, drop=tuple(c for c in (*needs, *([text] if text else [])) if c not in keep), threads=policy.threads, at_once=policy.at_once)


def annual_only(df: DataFrame) -> DataFrame:
    """Rows labelled as annual reports; null labels are dropped."""
    return df.filter(F.col("is_annual_report"))
