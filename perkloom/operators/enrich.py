"""Filling the catalog from collected businesses: branches, venues, merchants,
programs and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.text import list_program_id, name_key
from perkloom.operators import geo
from perkloom.operators.numbering import row_numbers
from perkloom.operators.spacing import keep_spaced


def last_by_name(merchants: DataFrame) -> DataFrame:
    """(key, merchant_id, merchant_name): the later of two equal names wins."""
    return merchants.groupBy(name_key(F.col("name")).alias("key")).agg(
        F.max_by(F.col("id"), F.col("seq")).alias("merchant_id"),
        F.max_by(F.col("name"), F.col("seq")).alias("merchant_name"),
    )


def attach_branches(
    merchants: DataFrame, branches: DataFrame, candidates: DataFrame, **spacing
) -> DataFrame:
    """(merchant_id, branch_no, lat, lng) after matching candidates by exact
    normalised name. Merchants that match nothing keep what they had."""
    matched = (
        candidates.where("lat IS NOT NULL AND lng IS NOT NULL")
        .withColumn("key", name_key(F.col("name")))
        .join(last_by_name(merchants), "key")
        .select("merchant_id", "seq", "lat", "lng")
    )
    found = keep_spaced(matched, "merchant_id", **spacing).select(
        "merchant_id", F.col("seq").alias("branch_no"), "lat", "lng"
    )
    kept = branches.join(found.select("merchant_id").distinct(), "merchant_id", "left_anti")
    return found.unionByName(
        kept.select("merchant_id", F.col("branch_no").cast("bigint").alias("branch_no"), "lat", "lng")
    )


def _in_venues(candidates: DataFrame, venues: DataFrame, **bounds) -> DataFrame:
    return geo.within(
        candidates, geo.venue_circles(venues), ["seq"], ["venue_id"], **bounds
    ).withColumn("metres", F.floor(F.col("distance_m") + 0.5).cast("bigint"))


def venue_proposals(
    candidates: DataFrame, merchants: DataFrame, members: DataFrame, venues: DataFrame, **bounds
) -> tuple[DataFrame, DataFrame]:
    """(venues known merchants would gain, unknown businesses inside a venue).

    The first output has one row per (merchant, venue) with the evidence of the
    earliest sighting; the second one row per sighting and venue.
    """
    hits = _in_venues(candidates, venues, **bounds).withColumn("key", name_key(F.col("name")))
    known = last_by_name(merchants)
    evidence = F.concat(
        F.col("venue_id"), F.lit(": "), F.coalesce("address", F.lit("?")), F.lit(" — "),
        F.col("metres").cast("string"), F.lit("m from centroid"),
    )
    gains = (
        hits.join(known, "key")
        .join(members.select("merchant_id", "venue_id"), ["merchant_id", "venue_id"], "left_anti")
        .groupBy("merchant_id", "merchant_name", "venue_id")
        .agg(F.min_by(evidence, F.col("seq")).alias("evidence"))
    )
    unknown = hits.join(known, "key", "left_anti").select(
        "seq", "name", "venue_id", "easy_category", "address"
    )
    return gains, unknown


def category_of(text: Column) -> Column:
    """Merchant category of a source category text; the first rule wins."""
    rules = F
    for pattern, category in V.CATEGORY_RULES:
        rules = rules.when(text.rlike(pattern), category)
    return rules


def mint_merchants(
    approved: DataFrame,
    merchants: DataFrame,
    candidates: DataFrame,
    venues: DataFrame,
    **bounds,
) -> tuple[DataFrame, DataFrame]:
    """(new merchants, (merchant_id, venue_id) of the new ones).

    One per approved benefit name still on an ``unmapped_`` id that no merchant
    carries. The name's first candidate supplies id, category and place; without
    coordinates there the name is left alone. ``approved``: seq, merchant_id,
    merchant_name.
    """
    wanted = (
        approved.where(F.col("merchant_id").startswith(V.UNMAPPED_PREFIX))
        .withColumn("key", name_key(F.col("merchant_name")))
        .groupBy("key")
        .agg(F.min(F.struct("seq", "merchant_name")).alias("w"))
    )
    known = merchants.select(name_key(F.col("name")).alias("key")).distinct()
    sources = (
        candidates.withColumn("key", name_key(F.col("name")))
        .groupBy("key")
        .agg(F.min(F.struct("seq", "easy_id", "easy_category", "lat", "lng")).alias("c"))
    )
    found = (
        wanted.join(known, "key", "left_anti")
        .join(sources, "key")
        .where("c.lat IS NOT NULL")
        .select(
            F.col("w.seq").alias("seq"), F.col("w.merchant_name").alias("name"),
            F.concat(F.lit("easy_"), F.col("c.easy_id")).alias("base"),
            category_of(F.col("c.easy_category")).alias("category"),
            F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"),
        )
    )
    minted = _free_ids(found, merchants)
    inside = _in_venues(minted, venues, **bounds).select(
        F.col("id").alias("merchant_id"), "venue_id"
    )
    return minted.select(
        "id", "name", F.array_compact(F.array("category")).alias("categories"), "lat", "lng"
    ), inside


def _free_ids(found: DataFrame, merchants: DataFrame) -> DataFrame:
    """``id`` = base plus as many ``_x`` as it takes to be free, in order."""
    taken = merchants.select(
        F.regexp_replace("id", "(_x)+$", "").alias("base"),
        ((F.length("id") - F.length(F.regexp_replace("id", "(_x)+$", ""))) / 2)
        .cast("int")
        .alias("x"),
    ).groupBy("base").agg(F.collect_set("x").alias("taken"))
    used = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.filter(
        F.sequence(F.lit(0), F.col("_n") + F.size(used)), lambda i: ~F.array_contains(used, i)
    )
    return (
        row_numbers(found, ["base"], ["seq"], "_n")
        .withColumn("_n", (F.col("_n") - 1).cast("int"))
        .join(taken, "base", "left")
        .withColumn("id", F.concat("base", F.repeat(F.lit("_x"), F.get(free, F.col("_n")))))
        .drop("taken", "_n", "base")
    )


def program_class(slug: Column, title: Column) -> tuple[Column, Column]:
    """(category, sure): what a list title says about the kind of club."""
    override = F.create_map(
        *[F.lit(x) for pair in V.CATEGORY_BY_PROGRAM.items() for x in pair]
    )[list_program_id(slug)]
    text = F.concat_ws(" ", slug, title)
    by_rule = (
        F.when(slug.isin(*V.PARENT_BY_LIST), "credit_card")
        .when(text.rlike(V.CARD_WORDS), "credit_card")
        .when(text.rlike(V.EMPLOYER_WORDS), "employer_club")
    )
    known = F.coalesce(override, by_rule)
    return F.coalesce(known, F.lit("retail_club")), known.isNotNull()


def mint_programs(titles: DataFrame, programs: DataFrame) -> DataFrame:
    """New programs from (slug, title) of discount lists that have none.

    Deal-type lists and lists already mapped are left out whatever their case;
    two lists with the same program id give the first by ``seq``.
    """
    left_out = [s.lower() for s in V.LISTS_NOT_CLUBS + V.LISTS_ALREADY_MAPPED]
    slug, title = F.col("slug"), F.col("title")
    category, sure = program_class(slug, title)
    parent = F.create_map(*[F.lit(x) for pair in V.PARENT_BY_LIST.items() for x in pair])[slug]
    new = (
        titles.where(~F.lower(slug).isin(left_out))
        .withColumn("id", list_program_id(slug))
        .join(programs.select("id"), "id", "left_anti")
    )
    first = new.groupBy("id").agg(F.min(F.struct("seq", "slug", "title")).alias("t"))
    return first.select("id", "t.slug", "t.title").select(
        "id",
        title.alias("name"),
        category.alias("category"),
        F.concat(F.lit(V.LIST_URL), slug).alias("catalog_url"),
        F.format_string(V.PROGRAM_HINT, title).alias("hint"),
        parent.alias("parent_id"),
        sure.alias("sure"),
    )
