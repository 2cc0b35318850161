"""Fixture views as the typed tables the operators take."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.timefn import utc_instant
from perkloom.operators import ownership
from perkloom.plans.fixture_views import view
from perkloom.schemas import CONDITIONS
from perkloom.session import SPREAD_KEY


def at(seconds: str) -> Column:
    return F.timestamp_seconds(F.col(seconds))


def csv_list(column: str, element: str = "string") -> Column:
    return F.split(F.col(column), ",").cast(f"array<{element}>")


# Tables that carry per-row work, and a column that tells their rows apart.
SPREAD_BY = {
    "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id",
}


# A part becomes five wide offers, so a file of many short rows would be one task's whole catalog: it is
# dealt out in pieces of this many rows in every session.
PIECE_ROWS = {"part": 10_000}


def spread(df: DataFrame, key: str, piece_rows: int | None = None) -> DataFrame:
    """Use every core on tables that are one small file each, in sessions that ask for it
    (local ones: benchmark and tests); elsewhere tables stay as they are read, but for those that are
    dealt out in pieces of ``piece_rows``."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism if spark.conf.get(SPREAD_KEY, "false") == "true" else 1
    if piece_rows is not None:
        n = max(n, -(-df.count() // piece_rows))
    return df.repartition(n, key) if n > 1 else df


class Domain:
    """Lazy access to the domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cache
    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df, SPREAD_BY[name], PIECE_ROWS.get(name)) if name in SPREAD_BY else df

    @cache
    def raw(self, name: str) -> DataFrame:
        return view(self.spark, name, self.table)

    @cached_property
    def programs(self) -> DataFrame:
        return self.raw("fx_program")

    @cached_property
    def declared(self) -> DataFrame:
        return self.raw("fx_owned")

    @cached_property
    def owned(self) -> DataFrame:
        return ownership.owned_programs(self.declared, self.programs)

    @cached_property
    def merchants(self) -> DataFrame:
        return self.raw("fx_merchant").withColumn(
            "categories", F.array_compact(F.array("category"))
        )

    @cached_property
    def branches(self) -> DataFrame:
        return self.raw("fx_branch")

    @cached_property
    def venues(self) -> DataFrame:
        return self.raw("fx_venue").withColumn("radius_m", F.col("radius_m").cast("int"))

    @cached_property
    def venue_members(self) -> DataFrame:
        return self.raw("fx_venue_member")

    @cached_property
    def benefits(self) -> DataFrame:
        b = self.raw("fx_benefit")
        hours = F.when(
            F.col("hours_from").isNotNull(),
            F.struct(F.col("hours_from").alias("from"), F.col("hours_to").alias("to")),
        )
        fields = {
            "valid_days": csv_list("valid_days_csv", "int"),
            "valid_hours": hours,
            "exclusions": csv_list("exclusions_csv"),
            "raw_text_summary": F.concat(F.lit("terms of "), F.col("id")),
        }
        conditions = F.struct(
            *[(fields[f.name] if f.name in fields else F.col(f.name)).alias(f.name)
              for f in CONDITIONS.fields]
        )
        return b.select(
            "seq", "id", "program_id", "merchant_id",
            F.col("merchant_id").alias("merchant_name"),
            "type", "value", conditions.cast(CONDITIONS).alias("conditions"),
            at("valid_from_s").alias("valid_from"),
            at("valid_until_s").alias("valid_until"),
            F.concat(F.lit("https://offers.example/"), F.col("id")).alias("source_url"),
            at("last_verified_s").alias("last_verified_at"),
            "confidence_score", "reviewed_by_human",
        )

    @cached_property
    def contexts(self) -> DataFrame:
        return self.raw("fx_context").withColumn("now", at("now_s")).drop("now_s")

    @cached_property
    def muted(self) -> DataFrame:
        return self.raw("fx_muted")

    @cached_property
    def viewed(self) -> DataFrame:
        """(ctx_id, benefit_id): the benefits opened from a cart."""
        return self.raw("fx_viewed")

    @cached_property
    def interactions(self) -> DataFrame:
        return self.raw("fx_interaction").withColumn("ts", utc_instant(F.col("ts")))

    @cached_property
    def fence_events(self) -> DataFrame:
        return self.raw("fx_fence_event").withColumn("ts", utc_instant(F.col("ts")))

    @cached_property
    def positions(self) -> DataFrame:
        return self.raw("fx_position").withColumn("ts", utc_instant(F.col("ts")))

    @cached_property
    def collected(self) -> DataFrame:
        c = self.raw("fx_collected")
        return c.select(
            "line_no", "category", "offer_url", "terms_text",
            F.sha2("terms_text", 256).alias("content_hash"),
            at("verified_s").alias("verified_at"),
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        return self.raw("fx_verdict").withColumn("checked_at", at("checked_s")).drop("checked_s")

    @cached_property
    def headlines(self) -> DataFrame:
        return self.raw("fx_headline")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.raw("fx_candidate").withColumn("lists", F.array("list"))

    @cached_property
    def extracted(self) -> DataFrame:
        e = self.raw("fx_extracted")
        given = {"min_spend", "raw_text_summary"}
        conditions = F.struct(
            *[(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in CONDITIONS.fields]
        )
        return e.select(
            "line_no", "program_id", "merchant_name", "type", "value",
            F.lit(None).cast("string").alias("valid_from"),
            F.col("valid_until_text").alias("valid_until"),
            "confidence_score", "confidence_reason", "source_url",
            conditions.alias("conditions"),
        )

    @cached_property
    def domains(self) -> DataFrame:
        return self.raw("fx_domain")

    @cached_property
    def shares(self) -> DataFrame:
        return self.raw("fx_share").withColumn("now", at("now_s")).drop("now_s")


NOW_S = 1706781600
UNIVERSAL = V.UNIVERSAL_MERCHANT
