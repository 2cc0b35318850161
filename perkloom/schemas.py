"""Table schemas. Null in a condition means "not stated", never "no limit"."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STR, DBL, INT, BIG, FLAG, TS = (
    StringType(), DoubleType(), IntegerType(), LongType(), BooleanType(), TimestampType(),
)
STRS = ArrayType(STR)


def _struct(required: tuple[str, ...] = (), **fields: DataType) -> StructType:
    return StructType([StructField(n, t, n not in required) for n, t in fields.items()])


HOURS = StructType([StructField("from", STR), StructField("to", STR)])
CONDITIONS = _struct(
    min_spend=DBL, max_discount=DBL, valid_days=ArrayType(INT), valid_hours=HOURS, channel=STR,
    stacks_with_club=FLAG, exclusions=STRS, raw_text_summary=STR, usage_limit=STR,
    requires_voucher=FLAG,
)
BENEFIT = _struct(
    id=STR, program_id=STR, merchant_id=STR, merchant_name=STR, google_place_id=STR, type=STR,
    value=DBL, conditions=CONDITIONS, valid_from=TS, valid_until=TS, source_url=STR,
    last_verified_at=TS, confidence_score=DBL, reviewed_by_human=FLAG,
)
PROGRAM = _struct(id=STR, name=STR, category=STR, catalog_url=STR, hint=STR, parent_id=STR)
MERCHANT = _struct(
    id=STR, name=STR, domains=STRS, venue_ids=STRS,
    branches=ArrayType(_struct(lat=DBL, lng=DBL)), categories=STRS,
)
VENUE = _struct(id=STR, name=STR, city=STR, lat=DBL, lng=DBL, radius_m=INT)
PROFILE = _struct(
    user_id=BIG, program_ids=STRS, muted_benefit_ids=STRS, notifications_enabled=FLAG,
    onboarded_at=TS,
)
COLLECTED = _struct(
    site=STR, category=STR, offer_url=STR, merchant_name=STR, listing_headline=STR,
    sections=MapType(STR, STR), terms_text=STR, content_hash=STR, warning=STR, verified_at=TS,
)
EXTRACTED = _struct(
    merchant_name=STR, type=STR, value=DBL, source_url=STR, valid_from=STR, valid_until=STR,
    confidence_score=DBL, confidence_reason=STR, conditions=CONDITIONS,
)
EXTRACTION_RESULT = _struct(page_summary=STR, benefits=ArrayType(EXTRACTED))
CANDIDATE = _struct(
    easy_id=STR, name=STR, easy_category=STR, address=STR, city=STR, lat=DBL, lng=DBL, lists=STRS
)
REVIEW_ITEM = _struct(benefit=BENEFIT, reason=STR, queued_at=TS)
INTERACTION = _struct(event_id=BIG, user_id=BIG, ts=TS, kind=STR)
FENCE_EVENT = _struct(
    event_id=BIG, user_id=BIG, ts=TS, fence_id=STR, kind=STR, match_count=BIG
)
