"""Provider health, displayed prices, and the back-off schedule."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.provider import ModelProvider

#: Provider, US dollars per million tokens in and out.
PRICES = (("DeepSeek", 0.028, 0.42), ("GPT", 3.0, 0.75), ("Gemini", 1.25, 12.0))


def provider_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, usd_in double, usd_out double")


def probe(provider: ModelProvider, row: Mapping[str, object] | None = None) -> Callable[[], str]:
    """A trivial question to a provider; an empty reply counts as none."""

    def ask() -> str:
        reply = provider.complete("Reply with the word ok.", "probe", row or {})
        if not reply:
            raise ValueError("an empty reply")
        return reply

    return ask


def provider_health(spark: SparkSession, probes: Mapping[str, Callable[[], object]]) -> DataFrame:
    """Run each probe on the driver; any exception means offline."""

    def online(probe: Callable[[], object]) -> bool:
        try:
            probe()
            return True
        except Exception:
            return False

    return spark.createDataFrame([(n, online(p)) for n, p in probes.items()], "provider string, online boolean")


def retry_schedule(spark: SparkSession, tries: int = 8, base: int = 2) -> DataFrame:
    """Seconds waited after each failed try but the last, and their running total."""
    n = F.col("attempt")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(float(base)), k))
    return spark.range(1, tries).select(F.col("id").cast("int").alias("attempt")).select(
        "attempt", F.pow(F.lit(float(base)), n).cast("long").alias("wait_s"), total.cast("long").alias("total_s")
    )
