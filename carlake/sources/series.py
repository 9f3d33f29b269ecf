"""Time-series payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carlake.functions.cleaning import to_number


def parse_observations(df: DataFrame, payload: str, series_id: str) -> DataFrame:
    """(date, value, series_id) per observation of a JSON payload; values that are no numbers are dropped."""
    parsed = F.from_json(payload, "observations array<struct<date string, value string>>")
    rows = df.select(F.col(series_id).alias("series_id"), F.explode(parsed["observations"]).alias("o"))
    rows = rows.select(F.col("o.date").alias("date"), to_number(F.col("o.value")).alias("value"), "series_id")
    return rows.filter(F.col("date").isNotNull() & F.col("value").isNotNull())
