"""One-line deals to extracted offers, and the audit of those without a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import offers as fn
from perkloom.functions.text import trim_all
from perkloom.functions.timefn import utc_text
from perkloom.schemas import CONDITIONS


def read_headlines(rows: DataFrame, headline: str = "headline") -> DataFrame:
    """Adds ``type, value, confidence_score, confidence_reason, valid_until, channel,
    requires_voucher, summary``; ``type`` is null where no value can be read.

    Each step is a column of its own, so a pattern is matched once per row.
    Conditions the line does not state stay null.
    """
    c = F.lit
    col = F.col
    steps = (
        rows.withColumn("summary", trim_all(F.coalesce(headline, c(""))))
        .withColumn("_deal", F.when(col("summary") != "", fn.deal_segment(col("summary"))))
        .withColumn("_plain", fn.plain_text(col("_deal")))
        .withColumns(
            {
                "_percent": fn.percent_figure(col("_plain")),
                "_shekel": fn.shekel_figure(col("_plain")),
                "_up_to": fn.says(col("_plain"), V.UP_TO_WORDS),
                "_cashback": fn.says(col("_deal"), V.CASHBACK_WORDS),
                "_bogo": fn.says(col("summary"), V.BOGO_WORDS),
                "_vague": fn.several_sums(col("summary")),
                "requires_voucher": F.when(fn.says(col("summary"), V.VOUCHER_WORDS), True),
                "channel": F.when(fn.says(col("summary"), V.ONLINE_WORDS), "online"),
                "valid_until": fn.stated_end(col("summary")),
            }
        )
        .withColumn("_rate", col("_percent").cast("double"))
        .withColumn(
            "_kind",
            F.when(col("_deal").isNull(), None)
            .when(col("_bogo"), "bogo")
            .when((col("_rate") <= 0) | (col("_rate") > 100), "implausible")
            .when(col("_rate").isNotNull() & col("_up_to"), "up_to")
            .when(col("_rate").isNotNull(), "rate")
            .when(col("_shekel").isNotNull() & col("_vague"), "vague")
            .when(col("_shekel").isNotNull(), "sum"),
        )
    )
    rate_type = F.when(col("_cashback"), "cashback").otherwise("percent")
    flat_type = F.when(col("requires_voucher"), "gift_card").otherwise("fixed")

    def by_kind(**values: Column) -> Column:
        out = F
        for kind, value in values.items():
            out = out.when(col("_kind") == kind, value)
        return out

    read = {
        "type": by_kind(
            bogo=c("bogo"), implausible=c("percent"), up_to=rate_type, rate=rate_type,
            vague=flat_type, sum=flat_type,
        ),
        "value": by_kind(
            bogo=c(0.0), implausible=c(0.0), up_to=col("_rate"), rate=col("_rate"),
            vague=col("_shekel"), sum=col("_shekel"),
        ),
        "confidence_score": by_kind(
            bogo=c(V.CONF_BOGO), implausible=c(V.CONF_IMPLAUSIBLE), up_to=c(V.CONF_UP_TO),
            rate=c(V.CONF_PERCENT), vague=c(V.CONF_AMBIGUOUS), sum=c(V.CONF_SHEKEL),
        ),
        "confidence_reason": by_kind(
            bogo=c(V.REASON_BOGO),
            implausible=F.format_string(V.REASON_IMPLAUSIBLE, col("_percent")),
            up_to=F.format_string(V.REASON_UP_TO, col("_percent")),
            rate=F.when(col("_cashback"), V.REASON_CASHBACK).otherwise(V.REASON_PERCENT),
            vague=c(V.REASON_AMBIGUOUS),
            sum=c(V.REASON_SHEKEL),
        ),
    }
    # Unpacked from a one-row array: a filter on the outcome then stays above the
    # steps instead of repeating them.
    out = F.inline(F.array(F.struct(*[value.alias(name) for name, value in read.items()])))
    return steps.select(
        *rows.columns, "summary", "requires_voucher", "channel", "valid_until", out
    )


def extracted_offers(read: DataFrame) -> DataFrame:
    """Legible rows in the shape of an extraction result."""
    stated = {
        "channel": F.col("channel"),
        "requires_voucher": F.col("requires_voucher"),
        "raw_text_summary": F.col("summary"),
    }
    conditions = F.struct(
        *[
            (stated[f.name] if f.name in stated else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in CONDITIONS.fields
        ]
    )
    until = utc_text(F.col("valid_until"))
    return (
        read.where("type IS NOT NULL")
        .withColumns(
            {
                "conditions": conditions,
                "valid_from": F.lit(None).cast("string"),
                "valid_until": until,
            }
        )
        .drop("channel", "requires_voucher", "summary")
    )


def skipped_offers(read: DataFrame) -> DataFrame:
    """Real offers that state no number, with the reason they were left out."""
    return read.where("type IS NULL").withColumn("reason", F.lit(V.REASON_NO_VALUE))
