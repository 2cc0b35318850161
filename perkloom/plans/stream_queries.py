"""The same questions asked of streams: the event table is read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkloom.functions.timefn import utc_instant
from perkloom.plans import benefit_queries, place_queries
from perkloom.plans.domain import Domain
from perkloom.plans.fixture_views import duckdb_cte
from perkloom.streaming import kpi, visits
from perkloom.streaming.run import drain


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .withColumn("ts", utc_instant(F.col("ts")))
    )


def _fence_events(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", "user_id", "ts",
        F.concat(F.lit("v"), (F.col("user_id") % 10).cast("string")).alias("fence_id"),
        F.when(F.col("event_type") == "error", "exit").otherwise("enter").alias("kind"),
        (F.col("event_id") % 5).alias("match_count"),
    )


def notify_stream(spark, sf_dir):
    decided = drain(visits.visit_decisions(_fence_events(spark, sf_dir)), "append")
    return decided.select("event_id", "user_id", "fence_id", "decision")


def enter_stream(spark, sf_dir):
    """Enter events of a stream, decided by what the place offers the user at that time."""
    d = Domain(spark, sf_dir)
    events = visits.with_matches(
        _fence_events(spark, sf_dir).drop("match_count"), place_queries.places_of(d), d.owned, d.muted, d.benefits
    )
    return drain(visits.visit_decisions(events), "append").select(
        "event_id", "user_id", "fence_id", "match_count", "decision"
    )


def notification_log(spark, sf_dir):
    """Notifications sent to customers at known venues, as log events."""
    d = Domain(spark, sf_dir)
    profiles = d.owned.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_programs")).withColumn(
        "notifications_enabled", F.col("user_id") % 4 != 0
    )
    places = d.venues.select(F.col("id").alias("fence_id"))
    able = visits.eligible_events(_fence_events(spark, sf_dir), places, profiles)
    sent = visits.notification_events(visits.visit_decisions(able))
    return drain(sent, "append").select("event_id", "user_id", "kind")


def kpi_stream(spark, sf_dir):
    kinds = {
        "view": "notification_sent", "click": "notification_opened",
        "purchase": "benefit_redeemed", "signup": "share_resolved",
    }
    kind = F
    for event, name in kinds.items():
        kind = kind.when(F.col("event_type") == event, name)
    events = _events(spark, sf_dir).select("ts", kind.otherwise("share_unmatched").alias("kind"))
    counts = drain(kpi.windowed_counts(events), "update", ["start"])
    return kpi.read_ratios(counts).select(
        F.unix_seconds("start").alias("start_s"), "notifications_sent", "notifications_opened",
        "redeemed", "share_resolved", "share_unmatched",
        F.round("decision_impact_ratio", 9).alias("ratio"),
    )


QUERIES = {f.__name__: f for f in (notify_stream, enter_stream, notification_log, kpi_stream)}

_WALK = place_queries.ORACLE["notify_fold"]
ORACLE = {
    "notify_stream": _WALK,
    "enter_stream": place_queries.ORACLE["enter_decisions"],
    "notification_log": _WALK.replace(
        "WITH RECURSIVE ",
        "WITH RECURSIVE " + duckdb_cte(["fx_program", "fx_owned"]) + ",\n" + benefit_queries._OWNED + ",\n",
        1,
    ).replace(
        "SELECT event_id, user_id, fence_id, decision FROM walk WHERE kind = 'enter'",
        "SELECT event_id, user_id, 'notification_sent' AS kind FROM walk WHERE decision = 'notify' "
        "AND user_id % 4 <> 0 AND user_id IN (SELECT user_id FROM owned)",
    ),
    "kpi_stream": "WITH "
    + duckdb_cte(["fx_interaction"])
    + """,
c AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start_s,
  count(*) FILTER (kind = 'notification_sent') AS notifications_sent,
  count(*) FILTER (kind = 'notification_opened') AS notifications_opened,
  count(*) FILTER (kind = 'benefit_redeemed') AS redeemed,
  count(*) FILTER (kind = 'share_resolved') AS share_resolved,
  count(*) FILTER (kind = 'share_unmatched') AS share_unmatched
  FROM fx_interaction GROUP BY ALL)
SELECT *, CAST(round(CAST(notifications_opened + redeemed AS DOUBLE) / nullif(notifications_sent, 0), 9)
  AS DOUBLE) AS ratio FROM c""",
}
