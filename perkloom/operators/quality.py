"""Catalog validation: one frame of violations; an empty one is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V


def _found(df: DataFrame, table: str, rule: str, detail: Column | str, id_: str = "id") -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return df.select(
        F.lit(table).alias("table"), F.col(id_).alias("id"), F.lit(rule).alias("rule"),
        text.alias("detail"),
    )


def _rows(df: DataFrame, table: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Row rules as one pass: rule -> (SQL test, SQL detail)."""
    faults = ", ".join(
        f"CASE WHEN {test} THEN named_struct('rule', '{rule}', 'detail', CAST({detail} AS STRING)) END"
        for rule, (test, detail) in rules.items()
    )
    return df.select(
        F.lit(table).alias("table"), "id", F.expr(f"inline(array_compact(array({faults})))")
    )


def _outside(lat: str, lng: str) -> str:
    return (
        f"NOT COALESCE({lat} BETWEEN {V.LAT_MIN} AND {V.LAT_MAX} "
        f"AND {lng} BETWEEN {V.LNG_MIN} AND {V.LNG_MAX}, FALSE)"
    )


def _not_in(column: str, allowed: list[str]) -> str:
    return f"{column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in allowed)})"


def duplicate_ids(**tables: DataFrame) -> DataFrame:
    parts = [
        _found(
            df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"),
            name, "duplicate_id", F.col("_n"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_rules(benefits: DataFrame, programs: DataFrame, venues: DataFrame) -> DataFrame:
    c = "conditions."
    benefit = _rows(
        benefits,
        "benefits",
        {
            "percent_over_100": ("type = 'percent' AND value > 100", "value"),
            "source_url": ("NOT COALESCE(source_url RLIKE '^https?://', FALSE)", "source_url"),
            "last_verified_at": ("last_verified_at IS NULL", "'missing'"),
            "type": (_not_in("type", V.BENEFIT_TYPES), "type"),
            "value": ("value IS NULL OR value < 0", "value"),
            "confidence": ("NOT COALESCE(confidence_score BETWEEN 0 AND 1, FALSE)", "confidence_score"),
            "min_spend": (f"{c}min_spend < 0", f"{c}min_spend"),
            "max_discount": (f"{c}max_discount <= 0", f"{c}max_discount"),
            "valid_days": (
                f"size({c}valid_days) = 0 OR exists({c}valid_days, d -> d NOT BETWEEN 1 AND 7)",
                f"array_join({c}valid_days, ',')",
            ),
            "valid_hours": (
                f"{c}valid_hours IS NOT NULL AND NOT COALESCE({c}valid_hours.from RLIKE "
                f"'{V.TIME_OF_DAY}' AND {c}valid_hours.to RLIKE '{V.TIME_OF_DAY}', FALSE)",
                f"concat({c}valid_hours.from, '-', {c}valid_hours.to)",
            ),
            "channel": (f"{c}channel NOT IN ('in_store', 'online', 'both')", f"{c}channel"),
            "summary": (f"COALESCE({c}raw_text_summary, '') = ''", "'missing'"),
        },
    )
    program = _rows(
        programs, "programs", {"category": (_not_in("category", V.PROGRAM_CATEGORIES), "category")}
    )
    venue = _rows(
        venues,
        "venues",
        {
            "lat": (f"NOT COALESCE(lat BETWEEN {V.LAT_MIN} AND {V.LAT_MAX}, FALSE)", "lat"),
            "lng": (f"NOT COALESCE(lng BETWEEN {V.LNG_MIN} AND {V.LNG_MAX}, FALSE)", "lng"),
            "radius": (
                f"NOT COALESCE(radius_m BETWEEN {V.RADIUS_MIN_M} AND {V.RADIUS_MAX_M}, FALSE)",
                "radius_m",
            ),
        },
    )
    return benefit.unionByName(program).unionByName(venue)


def _blank(*columns: str) -> dict[str, tuple[str, str]]:
    return {f"{c}_missing": (f"COALESCE({c}, '') = ''", "'missing'") for c in columns}


def load_rules(
    benefits: DataFrame, programs: DataFrame, merchants: DataFrame, venues: DataFrame
) -> DataFrame:
    """What makes a catalog unreadable, as opposed to doubtful (``row_rules``): required texts,
    closed vocabularies and the bounds of the data model."""
    c = "conditions."
    url = r"RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:'"
    branches = "exists(branches, b -> b.lat IS NULL OR b.lng IS NULL)"
    allowed = ", ".join(repr(v) for v in V.MERCHANT_CATEGORIES)
    parts = [
        _rows(benefits, "benefits", _blank("id", "program_id", "merchant_id", "merchant_name") | {
            "type": (_not_in("type", V.BENEFIT_TYPES), "type"),
            "value": ("value IS NULL OR isnan(value) OR value < 0", "value"),
            "source_url": (f"NOT COALESCE(source_url {url}, FALSE)", "source_url"),
            "last_verified_at": ("last_verified_at IS NULL", "'missing'"),
            "confidence": ("NOT COALESCE(confidence_score BETWEEN 0 AND 1, FALSE)", "confidence_score"),
            "min_spend": (f"{c}min_spend < 0", f"{c}min_spend"),
            "max_discount": (f"{c}max_discount <= 0", f"{c}max_discount"),
            "valid_days": (
                f"size({c}valid_days) NOT BETWEEN 1 AND 7 OR exists({c}valid_days, d -> d NOT BETWEEN 1 AND 7)",
                f"array_join({c}valid_days, ',')",
            ),
            "valid_hours": (
                f"{c}valid_hours IS NOT NULL AND NOT COALESCE({c}valid_hours.from RLIKE "
                f"'{V.TIME_OF_DAY}' AND {c}valid_hours.to RLIKE '{V.TIME_OF_DAY}', FALSE)",
                f"concat({c}valid_hours.from, '-', {c}valid_hours.to)",
            ),
            "channel": (f"{c}channel NOT IN ('in_store', 'online', 'both')", f"{c}channel"),
            "summary": (f"COALESCE({c}raw_text_summary, '') = ''", "'missing'"),
        }),
        _rows(programs, "programs", _blank("id", "name") | {
            "category": (_not_in("category", V.PROGRAM_CATEGORIES), "category"),
            "catalog_url": (f"NOT catalog_url {url}", "catalog_url"),
            "parent_id": ("parent_id = ''", "'empty'"),
        }),
        _rows(merchants, "merchants", _blank("id", "name") | {
            "categories": (f"exists(categories, x -> x IS NULL OR x NOT IN ({allowed}))", "array_join(categories, ',')"),
            "branches": (branches, "'incomplete'"),
        }),
        _rows(venues, "venues", _blank("id", "name", "city") | {
            "lat": ("NOT COALESCE(lat BETWEEN -90 AND 90, FALSE)", "lat"),
            "lng": ("NOT COALESCE(lng BETWEEN -180 AND 180, FALSE)", "lng"),
            "radius": ("NOT COALESCE(radius_m > 0, FALSE)", "radius_m"),
        }),
    ]
    return reduce(DataFrame.unionByName, parts)


def date_rules(raw_benefits: DataFrame) -> DataFrame:
    """Instants that cannot be read, told from their wording: a cast would have lost it."""
    unread = lambda c: (f"{c} IS NOT NULL AND try_to_timestamp({c}) IS NULL", c)
    return _rows(raw_benefits, "benefits", {
        "last_verified_at": ("try_to_timestamp(last_verified_at) IS NULL", "COALESCE(last_verified_at, 'missing')"),
        "valid_from": unread("valid_from"),
        "valid_until": unread("valid_until"),
    })


def references(
    benefits: DataFrame, programs: DataFrame, merchants: DataFrame, venues: DataFrame,
    members: DataFrame,
) -> DataFrame:
    ids = lambda df, name: df.select(F.col("id").alias(name)).distinct()
    no_program = benefits.join(ids(programs, "program_id"), "program_id", "left_anti")
    mapped = benefits.where(~F.col("merchant_id").startswith(V.UNMAPPED_PREFIX))
    no_merchant = mapped.join(ids(merchants, "merchant_id"), "merchant_id", "left_anti")
    no_venue = members.join(ids(venues, "venue_id"), "venue_id", "left_anti")
    return (
        _found(no_program, "benefits", "unknown_program", F.col("program_id"))
        .unionByName(_found(no_merchant, "benefits", "unknown_merchant", F.col("merchant_id")))
        .unionByName(
            _found(no_venue, "merchants", "unknown_venue", F.col("venue_id"), "merchant_id")
        )
    )


def merchant_reach(
    merchants: DataFrame, members: DataFrame, branches: DataFrame, domains: DataFrame,
    benefits: DataFrame,
) -> DataFrame:
    """Per merchant: has it a domain, a place, a benefit? The universal one is exempt."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("merchant_id").alias("id")).distinct().withColumn(name, F.lit(True))

    places = members.select("merchant_id").unionByName(branches.select("merchant_id"))
    out = merchants.where(F.col("id") != V.UNIVERSAL_MERCHANT).select("id")
    for df, name in ((places, "has_place"), (domains, "has_domain"), (benefits, "has_benefit")):
        out = out.join(flag(df, name), "id", "left").withColumn(
            name, F.coalesce(name, F.lit(False))
        )
    return out


def catalog_coverage(reach: DataFrame, benefits: DataFrame) -> DataFrame:
    """One row of the counts a catalog owner watches."""
    n = lambda test, name: F.count_if(F.expr(test)).alias(name)
    unmapped = benefits.select(
        F.count_if(F.col("merchant_id").startswith(V.UNMAPPED_PREFIX))
    ).scalar()
    return reach.agg(
        F.count(F.lit(1)).alias("merchants"),
        n("has_domain", "with_domain"),
        n("NOT has_domain", "without_domain"),
        n("NOT has_place", "without_place"),
        n("NOT has_place AND NOT has_domain AND has_benefit", "list_only"),
        n("NOT has_place AND has_benefit", "benefits_without_place"),
    ).withColumn("unmapped_benefits", unmapped)


def violations(
    benefits: DataFrame, programs: DataFrame, merchants: DataFrame, venues: DataFrame,
    members: DataFrame, branches: DataFrame, domains: DataFrame,
) -> DataFrame:
    """(table, id, rule, detail). ``domains``: (merchant_id, domain)."""
    bad_domain = domains.where(r"domain RLIKE '^https?://' OR contains(domain, '/')")
    reach = merchant_reach(merchants, members, branches, domains, benefits)
    unreachable = reach.where("NOT has_domain AND NOT has_place AND NOT has_benefit")
    astray = branches.where(_outside("lat", "lng"))
    parts = [
        duplicate_ids(benefits=benefits, programs=programs, merchants=merchants, venues=venues),
        row_rules(benefits, programs, venues),
        references(benefits, programs, merchants, venues, members),
        _found(bad_domain, "merchants", "domain", F.col("domain"), "merchant_id"),
        _found(unreachable, "merchants", "unreachable", "no domain, place or benefit"),
        _found(astray, "merchants", "branch_outside", F.concat_ws(",", "lat", "lng"), "merchant_id"),
    ]
    return reduce(DataFrame.unionByName, parts)
