"""Long strings of structured data stay unless a length is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkloom.functions import pages


def test_long_strings_stay_unless_a_length_is_asked_for(spark):
    long = "terms " * 100 + "end"
    html = f'<script type="application/ld+json">{{"name": "Deal", "description": "{long}"}}</script>'
    row = spark.createDataFrame([(html,)], "html string").select(
        pages.json_ld_text(F.col("html")).alias("whole"),
        pages.json_ld_text(F.col("html"), longest=399).alias("short"),
    ).first()
    assert row["whole"] == f"Deal · {long}" and row["short"] == "Deal"
