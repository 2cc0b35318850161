"""Builders for small tables in the catalog's shape."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from perkloom.schemas import BENEFIT
from pyspark.sql.types import LongType, StructField, StructType

CATALOG = StructType([*BENEFIT.fields, StructField("seq", LongType())])
EMPTY = {f.name: None for f in BENEFIT["conditions"].dataType.fields}


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


def benefit(seq: int = 1, conditions: dict | None = None, **over) -> dict:
    row = {
        "id": f"b{seq}", "program_id": "riders", "merchant_id": "tea_leaf",
        "merchant_name": "Tea Leaf", "google_place_id": None, "type": "percent", "value": 10.0,
        "conditions": {**EMPTY, "raw_text_summary": "תנאים", **(conditions or {})},
        "valid_from": None, "valid_until": None, "source_url": "https://example.com/benefit",
        "last_verified_at": utc("2026-08-01T10:00:00Z"), "confidence_score": 0.95,
        "reviewed_by_human": False, "seq": seq,
    }
    return {**row, **over}


def catalog(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in CATALOG.fields) for r in rows], CATALOG)


def pairs(spark, rows, now="2026-08-02T10:00:00Z", channel=None, cart=None, owned=True, muted=False):
    """Every benefit against one context."""
    return (
        catalog(spark, *rows)
        .withColumnsRenamed({"id": "benefit_id", "seq": "benefit_seq"})
        .withColumns(
            {
                "ctx_id": F.lit(1), "now": F.lit(utc(now)), "channel": F.lit(channel).cast("string"),
                "cart_amount": F.lit(cart).cast("double"), "owned": F.lit(owned),
                "muted": F.lit(muted),
            }
        )
    )
