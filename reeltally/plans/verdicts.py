"""Verdict rows: one ``(ok, reason)`` per key instead of a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(*rules: tuple[Column, str]) -> Column:
    """Text of the first rule that is true, else null."""
    out = F.lit(None).cast("string")
    for bad, text in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(text)).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """Comma-joined texts of every rule that is true, in order; empty when none is."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(t)) for bad, t in rules])), ",")


def with_verdict(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    return df.withColumn("reason", reason(*rules)).withColumn("ok", F.col("reason").isNull())


def strict(verdicts: DataFrame) -> DataFrame:
    """Aborts the job on the first failed verdict, as a single-file tool would."""
    return verdicts.withColumn(
        "ok", F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(F.coalesce(F.col("reason"), F.lit("rejected"))).cast("boolean"))
    )
