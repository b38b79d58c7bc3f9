"""Stage 2: a chain of questions to several models, one result row per model."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import reply as R
from docmill.functions import template as P
from docmill.operators.provider import CallPolicy, ModelProvider, row_stage

#: The answerers in output order, and the one that answers the first question.
PROVIDERS = ("DeepSeek", "GPT", "Gemini")
LEADER = "GPT"
FAILED, ABSENT = "API failed", " "
NO_TEXT = "no_text"

_Y1 = T.StructType([T.StructField("y1_status", T.StringType()), T.StructField("y1", T.StringType())])
_CHAIN = T.StructType(
    [T.StructField(f"y{k}_status", T.StringType()) for k in (2, 3, 4)]
    + [
        T.StructField("y2", T.IntegerType()),
        T.StructField("y3", T.ArrayType(T.StringType())),
        T.StructField("y4", T.IntegerType()),
        T.StructField("calls", T.IntegerType()),
    ]
)


def group_key(run_id: str, ordinal: Column) -> Column:
    """One id per source row, the same for each provider's row and on every retry."""
    return F.sha2(F.concat(F.lit(run_id + ":"), ordinal.cast("string")), 256)


def fan_out(df: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """One row per provider, with `llm` and its order `provider_ord`."""
    items = F.array(*(F.lit(p) for p in providers))
    return df.select("*", F.posexplode(items).alias("provider_ord", "llm"))


def _integer(value: Any) -> bool:
    return value is None or (isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31)


def _texts(value: Any) -> bool:
    return value is None or (isinstance(value, list) and all(isinstance(x, str | None) for x in value))


_FITS = {"Y1": lambda v: isinstance(v, str | None), "Y2": _integer, "Y3": _texts, "Y4": _integer}


def _ask(policy: CallPolicy, provider: ModelProvider, prompt: str, key: str, row: Mapping[str, Any]) -> tuple[str, Any]:
    """(status, value) of one question; stage 2 removes fences by their characters."""
    status, got = policy.ask(provider, prompt, key, row, lambda raw: R.decode(raw, charset=True), R.unreadable)
    if got is None:
        return status, None
    value = got.get(key)
    return (status, value) if _FITS[key](value) else (R.BAD_TYPE, None)


def _skips(row: Mapping[str, Any], text: str, skip_null_text: bool) -> bool:
    return skip_null_text and row[text] is None


def shared_first_answer(
    df: DataFrame, provider: ModelProvider, url: str = "pdf_url", text: str = "pdf_text",
    policy: CallPolicy = CallPolicy(), hints: tuple[str, ...] = (), skip_null_text: bool = False,
) -> DataFrame:
    """Ask the first question once per source row, before the fan-out.

    With `skip_null_text` a row without text is not asked about: its status is `no_text`.
    """
    needs = ("__prompt", text, *hints)

    def call(row: Mapping[str, Any]) -> Mapping[str, Any]:
        if _skips(row, text, skip_null_text):
            return {"y1_status": NO_TEXT, "y1": None}
        status, value = _ask(policy, provider, row["__prompt"], "Y1", row)
        return {"y1_status": status, "y1": value}

    asked = df.withColumn("__prompt", P.Y1.column(url=F.col(url), text=F.col(text)))
    return row_stage(asked, _Y1, call, needs, drop=("__prompt",), threads=policy.threads, at_once=policy.at_once)


def _questions(policy: CallPolicy, provider: ModelProvider, row: Mapping[str, Any], url: str, text: str, short_circuit: bool) -> dict[str, Any]:
    """Y2, then Y3 with both answers, then Y4."""
    out: dict[str, Any] = {f"y{k}_status": R.CALL_FAILED for k in (2, 3, 4)} | {"calls": 0}
    if row["y1_status"] == NO_TEXT or short_circuit and row["y1_status"] != R.OK:
        return out
    base = {"url": row[url], "text": row[text], "y1": row["y1"], "y2": None}
    for k, template in (("Y2", P.Y2), ("Y3", P.Y3), ("Y4", P.Y4)):
        out["calls"] += 1
        out[f"{k.lower()}_status"], out[k.lower()] = _ask(policy, provider, template.render(**base), k, row)
        base["y2"] = out.get("y2")
    return out


def chain(
    df: DataFrame, providers: Mapping[str, ModelProvider], url: str = "pdf_url", text: str = "pdf_text",
    policy: CallPolicy = CallPolicy(), hints: tuple[str, ...] = (), short_circuit: bool = True,
) -> DataFrame:
    """Ask Y2, then Y3 with both answers, then Y4, of the row's own provider, for rows that are already fanned out.

    With `short_circuit` nothing is asked after a failed Y1, since the gate would
    discard it; `calls` counts the questions asked. A null text is asked about as unknown.
    """
    needs = (url, text, "llm", "y1", "y1_status", *hints)
    call = lambda row: _questions(policy, providers[row["llm"]], row, url, text, short_circuit)
    return row_stage(df, _CHAIN, call, needs, drop=(text, *hints), threads=policy.threads, at_once=policy.at_once)


def chain_all(
    df: DataFrame, providers: Mapping[str, ModelProvider], url: str = "pdf_url", text: str = "pdf_text",
    policy: CallPolicy = CallPolicy(), hints: tuple[str, ...] = (), short_circuit: bool = True,
) -> DataFrame:
    """As `chain`, with the fan-out behind it: each row's text is read once for all providers, and answers are fanned out.

    `llm` and `provider_ord` come in the order of `providers`.
    """
    each = T.StructType([T.StructField("provider_ord", T.IntegerType()), T.StructField("llm", T.StringType()), *_CHAIN.fields])
    needs = (url, text, "y1", "y1_status", *hints)

    def call(row: Mapping[str, Any]) -> Mapping[str, Any]:
        return {"__answers": [{"provider_ord": i, "llm": llm} | _questions(policy, p, row, url, text, short_circuit) for i, (llm, p) in enumerate(providers.items())]}

    gone = (text, *hints, *each.names)
    asked = row_stage(df, T.StructType([T.StructField("__answers", T.ArrayType(each))]), call, needs, drop=gone, threads=policy.threads, at_once=policy.at_once)
    return asked.select(*(F.col(f"`{c}`") for c in asked.columns if c != "__answers"), F.inline("__answers"))


def gate(df: DataFrame) -> DataFrame:
    """All or nothing: where any of the four answers failed, all four are null and `status` says which failed first."""
    status = F.coalesce(
        *(F.when(F.col(f"y{k}_status") != R.OK, F.concat(F.lit(f"y{k}_"), F.col(f"y{k}_status"))) for k in range(1, 5)),
        F.lit(R.OK),
    )
    good = status == R.OK
    return df.withColumns(
        {"status": status} | {f"y{k}": F.when(good, F.col(f"y{k}")) for k in range(1, 5)}
    ).drop(*(f"y{k}_status" for k in range(1, 5)))


def to_legacy_text(df: DataFrame) -> DataFrame:
    """Typed answers as text: the failure marker, or a blank where a good reply lacked the key."""
    bad = F.col("status") != R.OK
    text = {f"y{k}": F.col(f"y{k}").cast("string") for k in (1, 2, 4)} | {"y3": F.to_json("y3")}
    return df.withColumns({k: F.when(bad, FAILED).otherwise(F.coalesce(c, F.lit(ABSENT))) for k, c in text.items()})


def analyse(
    df: DataFrame, providers: Mapping[str, ModelProvider], run_id: str, ordinal: str,
    url: str = "pdf_url", text: str = "pdf_text", policy: CallPolicy = CallPolicy(), hints: tuple[str, ...] = (), skip_null_text: bool = False,
) -> DataFrame:
    """Y1 once per row, chains of all providers, fan-out and gate: a row per provider and source row."""
    keyed = df.withColumn("id", group_key(run_id, F.col(ordinal)))
    first = shared_first_answer(keyed, providers[LEADER], url, text, policy, hints, skip_null_text)
    return gate(chain_all(first, providers, url, text, policy, hints))
