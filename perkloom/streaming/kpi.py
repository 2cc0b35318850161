"""Interaction counts over a stream, in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.operators.kpi import kpi_counts, with_ratio


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind of event, final once the watermark has passed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window))
        .agg(*kpi_counts())
        .select(
            F.col("window.start").alias("start"), "notifications_sent", "notifications_opened",
            "redeemed", "share_resolved", "share_unmatched",
        )
    )


def read_ratios(counts: DataFrame) -> DataFrame:
    """The ratio is taken on read: it does not add up over windows."""
    return with_ratio(counts)
