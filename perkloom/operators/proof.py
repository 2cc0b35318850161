"""Link proof: what is known to work, what to check next, what to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators.ingest import last_per, spread_by
from perkloom.operators.numbering import row_numbers
from perkloom.operators.skew import skew_lookup


def _age_limit(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def keep_verification(records: DataFrame, previous: DataFrame, **bounds) -> DataFrame:
    """Carry ``verified_at`` to a re-crawled record only when both its address and
    its text are unchanged (the last proven line of the previous file counts)."""
    proven = last_per(
        previous.where("verified_at IS NOT NULL").select(
            "offer_url", "content_hash", F.col("verified_at").alias("_at"), "line_no"
        ),
        ["offer_url", "content_hash"],
        "line_no",
    ).drop("line_no")
    keys = ["offer_url", "content_hash"]
    return (
        skew_lookup(records, proven, keys, spread_by(records, "line_no"), **bounds)
        .withColumn("verified_at", F.coalesce("_at", "verified_at"))
        .drop("_at")
    )


def proven_urls(records: DataFrame, now: Column, days: int = V.LINK_MAX_AGE_DAYS) -> DataFrame:
    """(offer_url, proven_at): the latest proof on any copy, if recent enough."""
    return (
        records.where(F.col("verified_at") > _age_limit(now, days))
        .groupBy("offer_url")
        .agg(F.max("verified_at").alias("proven_at"))
    )


def settled_verdicts(verdicts: DataFrame, now: Column, days: int = V.LINK_MAX_AGE_DAYS) -> DataFrame:
    """The latest verdict per address among those that settle it and are not too old."""
    recent = verdicts.where(F.col("state").isin("live", "gone")).where(
        F.col("checked_at") > _age_limit(now, days)
    )
    latest = recent.groupBy("offer_url").agg(
        F.max_by("state", "checked_at").alias("state"), F.max("checked_at").alias("checked_at")
    )
    return latest


def links_to_check(
    records: DataFrame, verdicts: DataFrame, now: Column, days: int = V.LINK_MAX_AGE_DAYS
) -> DataFrame:
    """Distinct addresses neither freshly proven nor settled by a verdict."""
    return (
        records.select("offer_url")
        .distinct()
        .join(proven_urls(records, now, days), "offer_url", "left_anti")
        .join(settled_verdicts(verdicts, now, days), "offer_url", "left_anti")
    )


def apply_verdicts(
    records: DataFrame, verdicts: DataFrame, now: Column, days: int = V.LINK_MAX_AGE_DAYS, **bounds
) -> DataFrame:
    """Records after a pass, with ``outcome``: a gone link removes its records, a
    live one stamps them with the time it was checked, otherwise proof is borrowed
    from another copy of the address, otherwise the record stays as it was."""
    facts = proven_urls(records, now, days).join(
        settled_verdicts(verdicts, now, days), "offer_url", "full_outer"
    )
    state, proven = F.col("state"), F.col("proven_at")
    return (
        skew_lookup(records, facts, ["offer_url"], spread_by(records, "line_no"), **bounds)
        .withColumn(
            "outcome",
            F.when(state == "gone", "removed")
            .when(state == "live", "live")
            .when(proven.isNotNull(), "proven")
            .otherwise("unproven"),
        )
        .withColumn(
            "verified_at",
            F.when(state == "live", F.col("checked_at")).otherwise(
                F.coalesce(proven, F.col("verified_at"))
            ),
        )
        .drop("state", "proven_at", "checked_at")
    )


def coverage(records: DataFrame, by: str = "category") -> DataFrame:
    """Proof per list and overall: never rounded up, with the passes still needed."""
    total, verified = F.col("total"), F.col("verified")
    return (
        records.rollup(by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("verified_at").alias("verified"),
            F.min("verified_at").alias("oldest"),
        )
        .withColumns(
            {
                "percent": F.floor(F.lit(100) * verified / total).cast("bigint"),
                "passes_left": F.ceil((total - verified) / V.LINK_CHECKS_PER_PASS).cast("bigint"),
            }
        )
    )


def pass_verdict(applied: DataFrame) -> DataFrame:
    """Totals of a pass; ``failed`` when rows exist and none could be verified."""
    n = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    kept, unproven = n("live", "proven"), n("unproven")
    return applied.agg(
        kept.alias("verified"),
        n("removed").alias("removed"),
        unproven.alias("unproven"),
        F.coalesce(
            F.floor(F.lit(100) * kept / F.nullif(kept + unproven, F.lit(0))).cast("bigint"),
            F.lit(0).cast("bigint"),
        ).alias("coverage"),
        ((kept == 0) & (F.count(F.lit(1)) > 0)).alias("failed"),
    )


def crawl_batches(listed: DataFrame, fetched: DataFrame, size: int = V.CRAWL_BATCH) -> DataFrame:
    """(list, id, batch): ids listed but not fetched, in request batches per list."""
    missing = listed.join(fetched.select("list", "id"), ["list", "id"], "left_anti")
    numbered = row_numbers(missing, ["list"], ["id"])
    return numbered.select(
        "list", "id", F.floor((F.col("n") - 1) / size).cast("bigint").alias("batch")
    )


def merge_merchants(sightings: DataFrame) -> DataFrame:
    """One row per business id: every list it was seen on, all else from the latest."""
    fields = [c for c in sightings.columns if c not in ("easy_id", "lists", "seq")]
    latest = sightings.groupBy("easy_id").agg(F.max_by(F.struct(*fields), F.col("seq")).alias("row"))
    # Each list once per business before anything is gathered.
    seen = (
        sightings.select("easy_id", F.explode("lists").alias("list")).distinct()
        .groupBy("easy_id").agg(F.array_sort(F.collect_list("list")).alias("lists"))
    )
    none = F.array().cast("array<string>")
    return latest.join(seen, "easy_id", "left").select(
        "easy_id", "row.*", F.coalesce("lists", none).alias("lists")
    )
