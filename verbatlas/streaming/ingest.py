"""Cleaning and counting of verbatims as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import CleaningOptions, clean


def clean_stream(verbatims: DataFrame, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """A stream of verbatims with `full_text_clean`; stateless."""
    return verbatims.withColumn("full_text_clean", clean(F.col("full_text"), options))


def first_deliveries(verbatims: DataFrame, key: str = "verbatim_id", time: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """The first row of each key, for rows that come again within `lateness`; state is bounded by it."""
    return verbatims.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def volumes(verbatims: DataFrame, time: str = "created_at", window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Verbatims by project and window of arrival."""
    w = verbatims.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), "project_id").agg(F.count("*").alias("verbatims"))
    return w.select(F.col("w.start").alias("from_time"), "project_id", "verbatims")
