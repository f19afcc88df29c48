"""Streams: analysis is stateless and works on a streaming DataFrame as it is; counts of findings need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyze import analyze, explode


def windowed_counts(df: DataFrame, ts: str, text: str, window: str = "10 minutes", late: str = "10 minutes", **options) -> DataFrame:
    """Findings per event-time window and entity type; rows later than ``late`` are left out."""
    rows = explode(analyze(df.select(ts, text), text, **options), text=text)
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), "entity_type").agg(F.count("*").alias("n"))
