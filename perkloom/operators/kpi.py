"""Interaction log: retention and the decision-impact figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V


def recent_events(events: DataFrame, keep: int = V.EVENT_RETENTION) -> DataFrame:
    """The latest ``keep`` events of each user (kept before the shuffle, too)."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        events.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
    )


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def kpi_counts() -> list[Column]:
    return [
        _count("notification_sent").alias("notifications_sent"),
        _count("notification_opened").alias("notifications_opened"),
        _count("benefit_redeemed").alias("redeemed"),
        _count("share_resolved").alias("share_resolved"),
        _count("share_unmatched").alias("share_unmatched"),
    ]


def with_ratio(counts: DataFrame) -> DataFrame:
    """Opened plus redeemed per notification sent; null when none was sent."""
    acted = F.col("notifications_opened") + F.col("redeemed")
    return counts.withColumn(
        "decision_impact_ratio",
        acted.cast("double") / F.nullif(F.col("notifications_sent"), F.lit(0)),
    )


def kpis(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures per group with a grand total where every group column is null."""
    by = by or []
    grouped = events.rollup(*by) if by else events.groupBy()
    return with_ratio(grouped.agg(*kpi_counts()))


def against_target(kpi: DataFrame, target: float = V.KPI_TARGET) -> DataFrame:
    ratio = F.col("decision_impact_ratio")
    filled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))
    met = F.coalesce(ratio, F.lit(0.0)) >= target
    return kpi.withColumns(
        {
            "met": met,
            "fill": filled,
            "points_below": F.when(
                ratio.isNotNull() & ~met, F.floor((F.lit(target) - filled) * 100 + 0.5)
            ).cast("bigint"),
        }
    )
