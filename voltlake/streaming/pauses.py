"""Streaming twins of the batch operators: pauses as session gaps, and live cycle summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(samples: DataFrame, gap: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Stretches of testing of each run without a gap longer than ``gap``: run_id, started, ended, samples. Works on batches and streams."""
    rows = samples.withWatermark("date_time", lateness) if samples.isStreaming else samples
    found = rows.groupBy("run_id", F.session_window("date_time", gap).alias("s")).agg(F.count("*").alias("samples"), F.min("date_time").alias("started"), F.max("date_time").alias("ended"))
    return found.select("run_id", "started", "ended", "samples")


def live_summary(samples: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Extremes of each run's cycles by window of time, updated as samples arrive."""
    rows = samples.withWatermark("date_time", lateness) if samples.isStreaming else samples
    return (
        rows.groupBy("run_id", "cycle_index", F.window("date_time", window).alias("w"))
        .agg(F.max("charge_capacity").alias("charge_capacity"), F.max("discharge_capacity").alias("discharge_capacity"), F.max("temperature").alias("temperature_maximum"), F.count("*").alias("samples"))
        .select("run_id", "cycle_index", F.col("w.start").alias("window_start"), "charge_capacity", "discharge_capacity", "temperature_maximum", "samples")
    )
