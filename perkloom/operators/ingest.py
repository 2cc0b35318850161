"""From extracted offers to catalog rows: identity, validation, cache, gate, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import text, timefn
from perkloom.operators.skew import skew_lookup


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last-write-wins. The limited row number is applied before the shuffle too,
    so a key with very many rows sends one row per task."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def spread_by(df: DataFrame, preferred: str) -> list[str]:
    """Columns that tell rows of one key apart."""
    if preferred in df.columns:
        return [preferred]
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


# --- identity -----------------------------------------------------------------
NAMES_SENT = 100_000  # merchant names that rows meet where they are; more are dealt out with the rows


def merchant_names(merchants: DataFrame) -> DataFrame:
    """The merchant of each normalised name, the first one of a name."""
    return merchants.groupBy(text.name_key(F.col("name")).alias("_key")).agg(
        F.min_by(F.col("id"), F.col("seq")).alias("_known")
    )


def resolve_merchants(
    rows: DataFrame, merchants: DataFrame, names: DataFrame | None = None, **bounds
) -> DataFrame:
    """``merchant_id`` by normalised name (the first merchant of a name wins), or
    ``unmapped_<slug>``. ``names``: ``merchant_names`` as a written table. Its size is known before the join is
    planned, so rows with all their wording need not be dealt out by name to meet a few names."""
    unmapped = F.concat(F.lit(V.UNMAPPED_PREFIX), text.slug(F.col("merchant_name")))
    keyed = rows.withColumn("_key", text.name_key(F.col("merchant_name")))
    if names is not None and names.count() <= NAMES_SENT:
        found = keyed.join(names, "_key", "left")
    else:
        by_name = merchant_names(merchants) if names is None else names
        found = skew_lookup(keyed, by_name, ["_key"], spread_by(rows, "line_no"), **bounds)
    return found.withColumn("merchant_id", F.coalesce("_known", unmapped)).drop("_key", "_known")


def to_benefits(
    extracted: DataFrame, merchants: DataFrame, now: Column, names: DataFrame | None = None
) -> DataFrame:
    """Catalog rows from extracted offers.

    ``extracted`` carries ``program_id`` and optionally ``run_url``, the address of
    the run, which a per-offer ``source_url`` overrides. Approval is never taken
    from an extraction. ``names`` as in ``resolve_merchants``.
    """
    resolved = resolve_merchants(extracted, merchants, names)
    run_url = F.col("run_url") if "run_url" in extracted.columns else F.lit(None)
    return resolved.withColumns(
        {
            "id": text.benefit_id(
                F.col("program_id"), F.col("merchant_id"), F.col("type"), F.col("value")
            ),
            "google_place_id": F.lit(None).cast("string"),
            "valid_from": timefn.to_instant(F.col("valid_from"), "start"),
            "valid_until": timefn.to_instant(F.col("valid_until"), "end"),
            "source_url": F.coalesce("source_url", run_url),
            "last_verified_at": now,
            "reviewed_by_human": F.lit(False),
        }
    ).drop("run_url")


# --- validation ---------------------------------------------------------------
def extraction_faults() -> Column:
    """Array of the rules an extracted offer breaks."""
    c = "conditions."
    rules = {
        "merchant_name": "merchant_name IS NULL OR merchant_name = ''",
        "type": "type IS NULL OR type NOT IN ({})".format(
            ", ".join(f"'{t}'" for t in V.BENEFIT_TYPES)
        ),
        "value": "value IS NULL OR isnan(value) OR value < 0",
        "percent_over_100": "type IN ('percent', 'cashback') AND value > 100",
        "confidence_score": "confidence_score IS NULL OR NOT confidence_score BETWEEN 0 AND 1",
        "confidence_reason": "confidence_reason IS NULL OR confidence_reason = ''",
        "source_url": r"NOT source_url RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:'",
        "min_spend": f"{c}min_spend < 0",
        "max_discount": f"{c}max_discount <= 0",
        "valid_days": f"size({c}valid_days) = 0 OR exists({c}valid_days, d -> d NOT BETWEEN 1 AND 7)",
        "valid_hours": (
            f"{c}valid_hours IS NOT NULL AND NOT COALESCE({c}valid_hours.from RLIKE '{V.TIME_OF_DAY}'"
            f" AND {c}valid_hours.to RLIKE '{V.TIME_OF_DAY}', FALSE)"
        ),
        "channel": f"{c}channel NOT IN ('in_store', 'online', 'both')",
        "raw_text_summary": f"{c}raw_text_summary IS NULL OR {c}raw_text_summary = ''",
        "valid_from": "valid_from IS NOT NULL AND try_to_timestamp(valid_from) IS NULL",
        "valid_until": "valid_until IS NOT NULL AND try_to_timestamp(valid_until) IS NULL",
    }
    found = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())
    return F.expr(f"array_compact(array({found}))")


def split_valid(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``faults``)."""
    checked = extracted.withColumn("faults", extraction_faults())
    return checked.where("size(faults) = 0").drop("faults"), checked.where("size(faults) > 0")


# --- extraction cache -----------------------------------------------------------
def split_cached(
    records: DataFrame, cache: DataFrame, refresh: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(records whose exact text was already read, records still to read)."""
    hashes = cache.select("content_hash").distinct()
    if refresh:
        hashes = hashes.limit(0)
    return (
        records.join(hashes, "content_hash", "left_semi"),
        records.join(hashes, "content_hash", "left_anti"),
    )


def next_to_extract(fresh: DataFrame, limit: int = V.EXTRACT_LIMIT, order: str = "line_no") -> DataFrame:
    """The next ``limit`` records to read; cache hits do not count against it."""
    return fresh.orderBy(order).limit(limit)


def expand_cached(records: DataFrame, cache: DataFrame, **bounds) -> DataFrame:
    """One row per record and offer of its text. ``cache``: (content_hash, result)."""
    latest = cache.groupBy("content_hash").agg(F.any_value("result").alias("result"))
    texts = records.select("line_no", "offer_url", "content_hash")
    return (
        # Copies of one text share one hash, and one text may be most of the records.
        skew_lookup(texts, latest, ["content_hash"], ["line_no"], "inner", **bounds)
        .select("line_no", "offer_url", F.posexplode("result").alias("item_no", "item"))
        .select("line_no", "offer_url", "item_no", "item.*")
    )


# --- gate -----------------------------------------------------------------------
def gate(candidates: DataFrame, threshold: float = V.MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(publish, review)."""
    sure = F.col("confidence_score") >= threshold
    return candidates.where(sure), candidates.where(~sure)


def terms() -> Column:
    """A mark of the wording a human approves, comparable with null equal to absent: as long as a
    hash, however long the wording, so that comparing does not carry the wording about once more."""
    return F.sha2(F.to_json(F.struct("conditions", "value", "type")), 256)


def approved_terms(stored: DataFrame) -> DataFrame:
    """(id, _terms, _approved) of what a human approved."""
    found = stored.where("reviewed_by_human").select("id", terms().alias("_terms"))
    return found.distinct().withColumn("_approved", F.lit(True))


def mark_approved(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """Adds ``_approved``: already approved with the same terms. ``approved``: of ``approved_terms``;
    where that is a written table its size is known, and candidates stay where they are to meet a small one."""
    marked = candidates.withColumn("_terms", terms()).join(approved, ["id", "_terms"], "left")
    return marked.withColumn("_approved", F.col("_approved").isNotNull()).drop("_terms")


def split_marked(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(already approved with the same terms, to be gated)."""
    return marked.where("_approved").drop("_approved"), marked.where("NOT _approved").drop("_approved")


def split_approved(candidates: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(already approved with the same terms, to be gated)."""
    return split_marked(mark_approved(candidates, approved_terms(stored)))


# --- merge ----------------------------------------------------------------------
def merge_benefits(stored: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert by id; the last incoming row wins.

    An approval outlives the merge only when every row of the id, from the stored
    one (or the first incoming, if none is stored) to the last, has the same terms.
    One aggregation over both tables: no join, and rows of a much repeated id are
    combined before the shuffle.
    """
    columns = [c for c in stored.columns if c != order]
    both = stored.select(*columns, F.lit(-1).cast("bigint").alias("_at")).unionByName(
        incoming.select(*columns, F.col(order).cast("bigint").alias("_at"))
    ).withColumn("_terms", terms())
    merged = both.groupBy("id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "id"]), F.col("_at")).alias("row"),
        F.min_by("reviewed_by_human", "_at").alias("_flag"),
        (F.min("_terms") == F.max("_terms")).alias("_same"),
    )
    kept = [F.col(f"row.{c}") for c in columns if c not in ("id", "reviewed_by_human")]
    return merged.select(
        "id", *kept, (F.col("_flag") & F.col("_same")).alias("reviewed_by_human")
    ).select(*columns)


def merge_queue(
    queue: DataFrame, review: DataFrame, touched: DataFrame, published: DataFrame, order: str = "seq"
) -> DataFrame:
    """Old entries this run did not touch plus the new ones, one per id (the last),
    and never an id that is already published."""
    columns = queue.columns
    kept = queue.join(touched.select("id"), "id", "left_anti").select(
        *columns, F.lit(-1).cast("bigint").alias("_at")
    )
    fresh = review.select(*columns, F.col(order).cast("bigint").alias("_at"))
    return (
        last_per(kept.unionByName(fresh), ["id"], "_at")
        .drop("_at")
        .join(published.select("id"), "id", "left_anti")
        .select(*columns)
    )


def run_report(outcomes: DataFrame, by: str = "program_id") -> DataFrame:
    """Counts, token use and failures per program with a grand total.

    ``outcomes``: one row per page or offer with ``kind`` (scraped, extracted,
    published, queued, failed), ``input_tokens`` and ``output_tokens``.
    """
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return outcomes.rollup(by).agg(
        count("scraped"), count("extracted"), count("published"), count("queued"), count("failed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
