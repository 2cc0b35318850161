"""Queries about collecting, merging, reviewing and publishing, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators import ingest, proof, quality, review
from perkloom.plans.catalog_run import ingest_offers
from perkloom.plans.domain import NOW_S, Domain
from perkloom.plans.fixture_views import duckdb_cte
from perkloom.session import written
from perkloom.sources import collected as sources

LATER = 10_000_000


def _now():
    return F.timestamp_seconds(F.lit(NOW_S))


def _ms(column: str):
    return F.unix_millis(column)


# --- collecting -----------------------------------------------------------------
def collected_dedupe(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return sources.dedupe_collected(d.collected).select("offer_url", "line_no", "content_hash")


def list_records(spark, sf_dir):
    """Records of mapped lists only, with the program of their list."""
    d = Domain(spark, sf_dir)
    programs = d.programs.select(
        F.concat(F.lit("src"), F.substring("id", 2, 9)).alias("list"),
        F.col("id").alias("program_id"),
    ).where("id LIKE 'r%'")
    records = d.collected.withColumnRenamed("category", "list")
    return sources.with_program(records, programs).select("line_no", "list", "program_id")


def listing_records(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return sources.from_listing(d.raw("fx_listing")).select(
        "category", "offer_url", "merchant_name", "listing_headline", "content_hash"
    )


def _cache(d: Domain) -> DataFrame:
    return d.collected.where("line_no % 3 = 0").select("content_hash")


def cache_split(spark, sf_dir):
    d = Domain(spark, sf_dir)
    known, fresh = ingest.split_cached(d.collected, _cache(d))
    mark = lambda df, flag: df.select("line_no", F.lit(flag).alias("cached"))
    return mark(known, True).unionByName(mark(fresh, False))


def extract_limit(spark, sf_dir):
    d = Domain(spark, sf_dir)
    _, fresh = ingest.split_cached(d.collected, _cache(d))
    return ingest.next_to_extract(fresh).select("line_no", "offer_url")


def expand_cached(spark, sf_dir):
    d = Domain(spark, sf_dir)
    offers = d.extracted.select(
        "line_no", F.struct("merchant_name", "type", "value").alias("offer")
    ).join(d.collected.select("line_no", "content_hash"), "line_no")
    # What was read from the copies of a text, each offer once.
    cache = offers.groupBy("content_hash").agg(
        F.array_sort(F.collect_set("offer")).alias("result")
    )
    return ingest.expand_cached(d.collected, cache).select(
        "line_no", "item_no", "merchant_name", "type", "value"
    )


# --- identity and gate ------------------------------------------------------------
def _rows(d: Domain, names: DataFrame | None = None) -> DataFrame:
    return ingest.to_benefits(d.extracted, d.merchants, _now(), names)


def quarantine(spark, sf_dir):
    _, bad = ingest.split_valid(Domain(spark, sf_dir).extracted)
    return bad.select("line_no", F.array_join("faults", ",").alias("faults"))


def benefit_ids(spark, sf_dir):
    return _rows(Domain(spark, sf_dir)).select("line_no", "id")


def merchant_resolution(spark, sf_dir):
    return _rows(Domain(spark, sf_dir)).select(
        "line_no", "merchant_id", _ms("valid_until").alias("valid_until_ms"), "source_url"
    )


def _stored(d: Domain, rows: DataFrame | None = None) -> DataFrame:
    """What an earlier run left: every fourth line, half of it approved by a human."""
    earlier = (_rows(d) if rows is None else rows).where("line_no % 4 = 0").withColumn(
        "reviewed_by_human", F.col("line_no") % 8 == 0
    )
    return ingest.last_per(earlier, ["id"], "line_no")


def confidence_gate(spark, sf_dir):
    d = Domain(spark, sf_dir)
    rows = written(_rows(d), "rows")
    approved, to_gate = ingest.split_approved(rows, _stored(d, rows))
    publish, unsure = ingest.gate(to_gate)
    mark = lambda df, name: df.select("line_no", "id", F.lit(name).alias("outcome"))
    return (
        mark(approved, "approved").unionByName(mark(publish, "publish")).unionByName(mark(unsure, "review"))
    )


def _ingest(d: Domain):
    # What an earlier run left is made of these lines only.
    names = written(ingest.merchant_names(d.merchants), "merchant-names")
    rows = written(_rows(d, names).where("line_no % 4 = 0 OR line_no % 9 = 0"), "rows")
    stored = _stored(d, rows).drop("line_no", "confidence_reason")
    queue = ingest.last_per(rows.where("line_no % 9 = 0"), ["id"], "line_no").drop("line_no")
    # A page is read in one call; what that takes goes by its length.
    calls = d.table("documents").select(
        F.col("source").alias("program_id"), F.expr("n_chars div 4 + 200").alias("input_tokens"),
        F.expr("n_chars % 90 + 10").alias("output_tokens"),
    )
    return ingest_offers(
        d.extracted, d.merchants, stored,
        queue.withColumnRenamed("confidence_reason", "reason"), _now(), calls=calls,
    )


def ingest_report(spark, sf_dir):
    """What a run did with the offers of each program, and what reading them took."""
    return ingest.run_report(_ingest(Domain(spark, sf_dir)).outcomes)


def catalog_run(spark, sf_dir):
    run = _ingest(Domain(spark, sf_dir))
    done = run.benefits.select(
        "id", F.lit("catalog").alias("place"), "reviewed_by_human", "confidence_score"
    )
    left = run.queue.select(
        "id", F.lit("queue").alias("place"), "reviewed_by_human", "confidence_score"
    )
    return done.unionByName(left).withColumn("confidence_score", F.round("confidence_score", 4))


def _incoming(d: Domain) -> DataFrame:
    b = d.benefits.withColumn("last_verified_at", _now())
    seq = F.col("seq")
    same = b.where("seq % 3 = 0").withColumn("reviewed_by_human", F.lit(False))
    changed = b.where("seq % 6 = 0").withColumns(
        {"value": F.col("value") + 5, "seq": seq + LATER, "reviewed_by_human": F.lit(False)}
    )
    new = b.where("seq % 50 = 0").withColumns(
        {"id": F.concat(F.lit("n"), "id"), "reviewed_by_human": seq % 100 == 0}
    )
    return same.unionByName(changed).unionByName(new)


def merge_catalog(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ingest.merge_benefits(d.benefits, _incoming(d)).select(
        "id", "value", "reviewed_by_human", _ms("last_verified_at").alias("verified_ms")
    )


def _queue(d: Domain) -> DataFrame:
    return d.benefits.where("seq % 4 = 0").withColumn("reason", F.lit("old"))


def merge_queue(spark, sf_dir):
    d = Domain(spark, sf_dir)
    incoming = _incoming(d)
    publish, unsure = ingest.gate(incoming)
    merged = ingest.merge_benefits(d.benefits.where("seq % 5 = 0"), publish)
    out = ingest.merge_queue(
        _queue(d).drop("seq"), unsure.withColumn("reason", F.lit("new")), incoming, merged
    )
    return out.select("id", "reason", "value")


def run_report(spark, sf_dir):
    d = Domain(spark, sf_dir)
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("scraped", "extracted", "published", "queued", "failed")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    outcomes = d.table("documents").select(
        F.col("source").alias("program_id"), kind.alias("kind"),
        F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 100).alias("output_tokens"),
    )
    return ingest.run_report(outcomes)


# --- review and publish -------------------------------------------------------------
RULE = review.Rule(type="percent", min_value=10, min_confidence=0.75)


def review_rule(spark, sf_dir):
    d = Domain(spark, sf_dir)
    catalog, left = review.apply_rule(d.benefits.where("seq % 3 = 0"), _queue(d), RULE)
    return catalog.select("id", F.lit("catalog").alias("place"), "reviewed_by_human").unionByName(
        left.select("id", F.lit("queue").alias("place"), "reviewed_by_human")
    )


def review_preview(spark, sf_dir):
    counts, _ = review.preview(_queue(Domain(spark, sf_dir)), RULE)
    return counts


def review_sample(spark, sf_dir):
    _, first = review.preview(_queue(Domain(spark, sf_dir)), RULE)
    return first.select("id", "merchant_name", "type", "value")


def review_decisions(spark, sf_dir):
    d = Domain(spark, sf_dir)
    queue = _queue(d)
    answer = (
        F.when(F.col("seq") == 9 * F.floor(F.lit(LATER) / 9), "q")
        .when(F.col("seq") % 5 == 0, "a")
        .when(F.col("seq") % 5 == 1, "s")
        .when(F.col("seq") % 5 == 2, "r")
        .when(F.col("seq") % 1996 == 0, "q")
    )
    decisions = queue.select("id", answer.alias("answer"))
    return review.decided(queue, decisions).select("id", "outcome")


def review_export(spark, sf_dir):
    return review.review_sheet(_queue(Domain(spark, sf_dir)))


def _publish(d: Domain) -> DataFrame:
    b = d.benefits
    shipped = b.where("seq % 2 = 0").withColumn(
        "value", F.when(F.col("seq") % 10 == 0, F.col("value") + 1).otherwise(F.col("value"))
    )
    return review.publish(b.where("seq % 3 <> 0"), b.where("seq % 7 = 0"), shipped)


def publish_catalog(spark, sf_dir):
    live = review.shipped_after(_publish(Domain(spark, sf_dir)))
    return live.select("id", "value", "action")


def publish_report(spark, sf_dir):
    return review.publish_report(_publish(Domain(spark, sf_dir)))


# --- link proof ---------------------------------------------------------------------
def keep_verification(spark, sf_dir):
    d = Domain(spark, sf_dir)
    previous = d.collected
    crawled = d.collected.withColumns(
        {
            "verified_at": F.lit(None).cast("timestamp"),
            "content_hash": F.when(F.col("line_no") % 5 == 0, F.sha2("offer_url", 256)).otherwise(
                F.col("content_hash")
            ),
        }
    )
    return proof.keep_verification(crawled, previous).select(
        "line_no", "offer_url", _ms("verified_at").alias("verified_ms")
    )


def apply_verdicts(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return proof.apply_verdicts(d.collected, d.verdicts, _now()).select(
        "line_no", "outcome", _ms("verified_at").alias("verified_ms")
    )


def pass_verdict(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return proof.pass_verdict(proof.apply_verdicts(d.collected, d.verdicts, _now()))


def link_coverage(spark, sf_dir):
    d = Domain(spark, sf_dir)
    left = proof.apply_verdicts(d.collected, d.verdicts, _now()).where("outcome <> 'removed'")
    return proof.coverage(left).withColumn("oldest", _ms("oldest"))


def check_frontier(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return proof.links_to_check(d.collected, d.verdicts, _now())


def crawl_batches(spark, sf_dir):
    d = Domain(spark, sf_dir)
    listed = d.collected.select(F.col("category").alias("list"), F.col("line_no").alias("id"))
    return proof.crawl_batches(listed, listed.where("id % 6 = 0"))


def merge_merchants(spark, sf_dir):
    d = Domain(spark, sf_dir)
    sightings = d.candidates.select("seq", "easy_id", "name", "easy_category", "address", "lists")
    return proof.merge_merchants(sightings).withColumn("lists", F.array_join("lists", ","))


# --- quality ------------------------------------------------------------------------
def _quality_tables(d: Domain) -> dict[str, DataFrame]:
    """The catalog with faults planted at fixed places."""
    b = d.benefits
    bad = b.withColumns(
        {
            "value": F.when(F.col("seq") % 211 == 0, F.lit(150.0)).otherwise(F.col("value")),
            "source_url": F.when(F.col("seq") % 307 == 0, F.lit("ftp://x")).otherwise(F.col("source_url")),
            "program_id": F.when(F.col("seq") % 401 == 0, F.lit("nobody")).otherwise(F.col("program_id")),
            "merchant_id": F.when(F.col("seq") % 503 == 0, F.lit("s-gone"))
            .when(F.col("seq") % 499 == 0, F.lit("unmapped_x"))
            .otherwise(F.col("merchant_id")),
        }
    )
    universal = d.spark.range(1).select(
        F.lit(-1).cast("bigint").alias("seq"), F.lit(V.UNIVERSAL_MERCHANT).alias("id"),
        F.lit("everywhere").alias("name"),
    )
    merchants = d.merchants.select("seq", "id", "name").unionByName(universal)
    return {
        "benefits": bad.unionByName(bad.where("seq % 601 = 0")),
        "programs": d.programs,
        "merchants": merchants,
        "venues": d.venues,
        "members": d.venue_members.unionByName(
            d.venue_members.select("merchant_id", F.lit("v-gone").alias("venue_id")).where(
                "merchant_id LIKE '%2'"
            )
        ),
        "branches": d.branches,
        "domains": d.domains.select(
            "merchant_id",
            F.when(F.col("seq") % 20 == 0, F.concat("domain", F.lit("/shop"))).otherwise(
                F.col("domain")
            ).alias("domain"),
        ),
    }


def violations(spark, sf_dir):
    found = quality.violations(**_quality_tables(Domain(spark, sf_dir)))
    return found.select("table", "id", "rule")


def catalog_coverage(spark, sf_dir):
    t = _quality_tables(Domain(spark, sf_dir))
    reach = quality.merchant_reach(
        t["merchants"], t["members"], t["branches"], t["domains"], t["benefits"]
    )
    return quality.catalog_coverage(reach, t["benefits"])


QUERIES = {
    f.__name__: f
    for f in (
        collected_dedupe, list_records, listing_records, cache_split, extract_limit, expand_cached,
        quarantine, benefit_ids, merchant_resolution, confidence_gate, catalog_run, ingest_report, merge_catalog,
        merge_queue, run_report, review_rule, review_preview, review_sample, review_decisions,
        review_export, publish_catalog, publish_report, keep_verification, apply_verdicts,
        pass_verdict, link_coverage, check_frontier, crawl_batches, merge_merchants, violations,
        catalog_coverage,
    )
}


# --- SQL twins ---------------------------------------------------------------------
def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_COLLECTED = duckdb_cte(["fx_collected", "fx_verdict"]) + """,
col AS (SELECT *, sha256(terms_text) AS content_hash FROM fx_collected)"""
_CACHED = "cache AS (SELECT DISTINCT content_hash FROM col WHERE line_no % 3 = 0)"
_ROWS = duckdb_cte(["fx_extracted", "fx_merchant"]) + r""",
keyed AS (SELECT *, regexp_replace(lower(merchant_name), '[\s''"׳״־-]+', '', 'g') AS key,
  CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE CAST(value AS VARCHAR) END AS vt FROM fx_extracted),
names AS (SELECT regexp_replace(lower(name), '[\s''"׳״־-]+', '', 'g') AS key, min_by(id, seq) AS mid
  FROM fx_merchant GROUP BY ALL),
resolved AS (SELECT k.*, COALESCE(mid, 'unmapped_' || regexp_replace(regexp_replace(
    lower(trim(merchant_name)), '[^\p{L}\p{N}]+', '_', 'g'), '^_|_$', '', 'g')) AS merchant_id
  FROM keyed k LEFT JOIN names n ON n.key = k.key),
rows AS (SELECT *, program_id || '_' || merchant_id || '_' || substr(sha256(program_id || '|'
    || merchant_id || '|' || type || '|' || vt), 1, 12) AS id,
  hash(type, value, COALESCE(min_spend, -1), raw_text_summary) AS terms FROM resolved)"""
_GATED = """stored AS (SELECT *, line_no % 8 = 0 AS flag FROM rows WHERE line_no % 4 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1),
gated AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.flag AND s.id = r.id
      AND s.terms = r.terms) THEN 'approved'
    WHEN confidence_score >= 0.85 THEN 'publish' ELSE 'review' END AS outcome FROM rows r)"""
_B = duckdb_cte(["fx_benefit"])
_INCOMING = f"""inc AS (SELECT id, seq, value, FALSE AS flag, 0 AS chg, * EXCLUDE (id, seq, value)
  FROM fx_benefit WHERE seq % 3 = 0
  UNION ALL SELECT id, seq + {LATER}, value + 5, FALSE, 1, * EXCLUDE (id, seq, value)
  FROM fx_benefit WHERE seq % 6 = 0
  UNION ALL SELECT 'n' || id, seq, value, seq % 100 = 0, 0, * EXCLUDE (id, seq, value)
  FROM fx_benefit WHERE seq % 50 = 0)"""
_PROOF = f"""proven AS (SELECT offer_url, max(verified_s) AS ord FROM col
  WHERE verified_s > {NOW_S} - 7 * 86400 GROUP BY ALL),
verdict AS (SELECT DISTINCT offer_url, state FROM fx_verdict WHERE state IN ('live', 'gone')),
applied AS (SELECT c.line_no, c.category, CASE WHEN v.state = 'gone' THEN 'removed'
    WHEN v.state = 'live' THEN 'live' WHEN p.ord IS NOT NULL THEN 'proven' ELSE 'unproven' END AS outcome,
    CASE WHEN v.state = 'live' THEN {NOW_S} ELSE COALESCE(p.ord, c.verified_s) END * 1000 AS verified_ms
  FROM col c LEFT JOIN proven p USING (offer_url) LEFT JOIN verdict v USING (offer_url))"""
_QUALITY = duckdb_cte(
    ["fx_benefit", "fx_program", "fx_merchant", "fx_venue", "fx_venue_member", "fx_branch", "fx_domain"]
) + """,
b0 AS (SELECT seq, id, type, CASE WHEN seq % 211 = 0 THEN 150 ELSE value END AS value,
    CASE WHEN seq % 307 = 0 THEN 'ftp://x' ELSE 'https://offers.example/' || id END AS source_url,
    CASE WHEN seq % 401 = 0 THEN 'nobody' ELSE program_id END AS program_id,
    CASE WHEN seq % 503 = 0 THEN 's-gone' WHEN seq % 499 = 0 THEN 'unmapped_x'
      ELSE merchant_id END AS merchant_id, last_verified_s, max_discount FROM fx_benefit),
bb AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE seq % 601 = 0),
mm AS (SELECT id FROM fx_merchant UNION ALL SELECT 'any_merchant'),
mem AS (SELECT merchant_id, venue_id FROM fx_venue_member
  UNION ALL SELECT merchant_id, 'v-gone' FROM fx_venue_member WHERE merchant_id LIKE '%2'),
dom AS (SELECT merchant_id, CASE WHEN seq % 20 = 0 THEN domain || '/shop' ELSE domain END AS domain
  FROM fx_domain),
reach AS (SELECT id, id IN (SELECT merchant_id FROM mem UNION SELECT merchant_id FROM fx_branch) AS place,
    id IN (SELECT merchant_id FROM dom) AS web, id IN (SELECT merchant_id FROM bb) AS offers
  FROM mm WHERE id <> 'any_merchant')"""

ORACLE = {
    "collected_dedupe": _with(
        _COLLECTED,
        select="""SELECT offer_url, line_no, content_hash FROM col
WHERE offer_url <> '' AND terms_text <> ''
QUALIFY row_number() OVER (PARTITION BY offer_url ORDER BY line_no DESC) = 1""",
    ),
    "list_records": _with(
        _COLLECTED, duckdb_cte(["fx_program"]),
        select="""SELECT line_no, c.category AS list, p.id AS program_id
FROM col c JOIN fx_program p ON p.id LIKE 'r%' AND c.category = 'src' || substr(p.id, 2)""",
    ),
    "listing_records": _with(
        duckdb_cte(["fx_listing"]),
        """t AS (SELECT *, COALESCE(bestsubcat, '') AS h, concat_ws(chr(10), 'בית העסק: ' || bizname,
    'קטגוריה: ' || COALESCE(category, ''), 'ההטבה כפי שמופיעה באיזי: ' || COALESCE(bestsubcat, ''),
    CASE WHEN address <> '' THEN 'כתובת: ' || address END) AS terms FROM fx_listing)""",
        select=r"""SELECT list AS category, 'https://easy.co.il/page/' || CAST(id AS VARCHAR) AS offer_url,
  bizname AS merchant_name, h AS listing_headline, sha256(terms) AS content_hash FROM t
WHERE regexp_matches(h, 'הנחה|%|מבצע|1\s*\+\s*1|הטבה|מתנה|קופון')""",
    ),
    "cache_split": _with(
        _COLLECTED, _CACHED,
        select="SELECT line_no, content_hash IN (SELECT content_hash FROM cache) AS cached FROM col",
    ),
    "extract_limit": _with(
        _COLLECTED, _CACHED,
        select="""SELECT line_no, offer_url FROM col
WHERE content_hash NOT IN (SELECT content_hash FROM cache) ORDER BY line_no LIMIT 25""",
    ),
    "expand_cached": _with(
        _COLLECTED, duckdb_cte(["fx_extracted"]),
        """offers AS (SELECT DISTINCT content_hash, merchant_name, type, value
  FROM col JOIN fx_extracted USING (line_no)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY content_hash
    ORDER BY merchant_name, type, value) - 1 AS INT) AS item_no FROM offers)""",
        select="""SELECT c.line_no, item_no, merchant_name, type, value FROM col c
JOIN numbered USING (content_hash)""",
    ),
    "quarantine": _with(
        duckdb_cte(["fx_extracted"]),
        select="""SELECT line_no, concat_ws(',',
    CASE WHEN type IN ('percent', 'cashback') AND value > 100 THEN 'percent_over_100' END,
    CASE WHEN confidence_score > 1 THEN 'confidence_score' END,
    CASE WHEN raw_text_summary = '' THEN 'raw_text_summary' END) AS faults
FROM fx_extracted WHERE (type IN ('percent', 'cashback') AND value > 100) OR confidence_score > 1
  OR raw_text_summary = ''""",
    ),
    "benefit_ids": _with(_ROWS, select="SELECT line_no, id FROM rows"),
    "merchant_resolution": _with(
        _ROWS,
        select="""SELECT line_no, merchant_id, epoch_ms(timezone('Asia/Jerusalem',
  CAST(valid_until_text AS TIMESTAMP) + INTERVAL 1 DAY)) - 1 AS valid_until_ms, source_url FROM rows""",
    ),
    "confidence_gate": _with(_ROWS, _GATED, select="SELECT line_no, id, outcome FROM gated"),
    "ingest_report": _with(
        _ROWS,
        """stored AS (SELECT *, line_no % 8 = 0 AS flag FROM rows WHERE line_no % 4 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1),
gated AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.flag AND s.id = r.id
      AND s.terms = r.terms) THEN 'approved'
    WHEN confidence_score >= 0.85 THEN 'publish' ELSE 'review' END AS outcome FROM rows r
  WHERE NOT (type IN ('percent', 'cashback') AND value > 100) AND confidence_score <= 1
    AND raw_text_summary <> ''),
kinds AS (SELECT r.program_id, CASE WHEN g.line_no IS NULL THEN 'failed' WHEN outcome = 'review' THEN 'queued'
    ELSE 'published' END AS kind, 0 AS tin, 0 AS tout FROM rows r LEFT JOIN gated g USING (line_no)
  UNION ALL SELECT source, 'scraped', n_chars // 4 + 200, n_chars % 90 + 10 FROM documents)""",
        select="""SELECT program_id, count(*) FILTER (kind = 'scraped') AS scraped,
  count(*) FILTER (kind IN ('published', 'queued')) AS extracted,
  count(*) FILTER (kind = 'published') AS published, count(*) FILTER (kind = 'queued') AS queued,
  count(*) FILTER (kind = 'failed') AS failed, CAST(sum(tin) AS BIGINT) AS input_tokens,
  CAST(sum(tout) AS BIGINT) AS output_tokens FROM kinds GROUP BY ROLLUP (program_id)""",
    ),
    "catalog_run": _with(
        _ROWS,
        """stored AS (SELECT *, line_no % 8 = 0 AS flag FROM rows WHERE line_no % 4 = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1),
gated AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.flag AND s.id = r.id
      AND s.terms = r.terms) THEN 'approved'
    WHEN confidence_score >= 0.85 THEN 'publish' ELSE 'review' END AS outcome FROM rows r
  WHERE NOT (type IN ('percent', 'cashback') AND value > 100) AND confidence_score <= 1
    AND raw_text_summary <> ''),
both_ AS (SELECT id, -1 AS ord, flag, terms, confidence_score FROM stored
  UNION ALL SELECT id, line_no, FALSE, terms, confidence_score FROM gated WHERE outcome <> 'review'),
catalog AS (SELECT id, min_by(flag, ord) AND min(terms) = max(terms) AS reviewed_by_human,
  max_by(confidence_score, ord) AS confidence_score FROM both_ GROUP BY id),
q AS (SELECT id, -1 AS ord, FALSE AS flag, confidence_score FROM rows WHERE line_no % 9 = 0
    AND id NOT IN (SELECT id FROM gated WHERE outcome <> 'approved')
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1
  UNION ALL SELECT id, line_no, FALSE, confidence_score FROM gated WHERE outcome = 'review')""",
        select="""SELECT id, 'catalog' AS place, reviewed_by_human, round(confidence_score, 4) AS confidence_score
FROM catalog
UNION ALL SELECT id, 'queue', FALSE, round(max_by(confidence_score, ord), 4) FROM q
WHERE id NOT IN (SELECT id FROM catalog) GROUP BY id""",
    ),
    "merge_catalog": _with(
        _B, _INCOMING,
        f"""u AS (SELECT id, -1 AS ord, value, reviewed_by_human AS flag, last_verified_s AS v, 0 AS chg
  FROM fx_benefit UNION ALL SELECT id, seq, value, flag, {NOW_S}, chg FROM inc)""",
        select="""SELECT id, max_by(value, ord) AS value, min_by(flag, ord) AND max(chg) = 0 AS reviewed_by_human,
  CASE WHEN count(*) = 1 THEN any_value(v) ELSE arg_max(v, ord) END * 1000 AS verified_ms
FROM u GROUP BY id""",
    ),
    "merge_queue": _with(
        _B, _INCOMING,
        """published AS (SELECT id FROM fx_benefit WHERE seq % 5 = 0
  UNION SELECT id FROM inc WHERE confidence_score >= 0.85),
q AS (SELECT id, 'old' AS reason, value, -1 AS ord FROM fx_benefit
    WHERE seq % 4 = 0 AND id NOT IN (SELECT id FROM inc)
  UNION ALL SELECT id, 'new', value, seq FROM inc WHERE confidence_score < 0.85)""",
        select="""SELECT id, max_by(reason, ord) AS reason, max_by(value, ord) AS value FROM q
WHERE id NOT IN (SELECT id FROM published) GROUP BY id""",
    ),
    "run_report": """SELECT source AS program_id, count(*) FILTER (doc_id % 5 = 0) AS scraped,
  count(*) FILTER (doc_id % 5 = 1) AS extracted, count(*) FILTER (doc_id % 5 = 2) AS published,
  count(*) FILTER (doc_id % 5 = 3) AS queued, count(*) FILTER (doc_id % 5 = 4) AS failed,
  CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(doc_id % 100) AS BIGINT) AS output_tokens
FROM documents GROUP BY ROLLUP (source)""",
    "review_rule": _with(
        _B,
        """q AS (SELECT *, type = 'percent' AND value >= 10 AND confidence_score >= 0.75 AS hit
  FROM fx_benefit WHERE seq % 4 = 0)""",
        select="""SELECT id, 'queue' AS place, reviewed_by_human FROM q WHERE NOT hit
UNION ALL SELECT id, 'catalog', reviewed_by_human FROM fx_benefit WHERE seq % 3 = 0
UNION ALL SELECT id, 'catalog', TRUE FROM q WHERE hit AND seq % 3 <> 0""",
    ),
    "review_preview": _with(
        _B,
        select="""SELECT count(*) FILTER (type = 'percent' AND value >= 10 AND confidence_score >= 0.75)
  AS matching, count(*) AS queued FROM fx_benefit WHERE seq % 4 = 0""",
    ),
    "review_sample": _with(
        _B,
        select="""SELECT id, merchant_id AS merchant_name, type, value FROM fx_benefit
WHERE seq % 4 = 0 AND type = 'percent' AND value >= 10 AND confidence_score >= 0.75
ORDER BY seq LIMIT 10""",
    ),
    "review_decisions": _with(
        _B,
        f"""q AS (SELECT id, seq, CASE WHEN seq = 9 * floor({LATER} / 9) THEN 'q' WHEN seq % 5 = 0 THEN 'a'
    WHEN seq % 5 = 1 THEN 's' WHEN seq % 5 = 2 THEN 'r' WHEN seq % 1996 = 0 THEN 'q' END AS answer
  FROM fx_benefit WHERE seq % 4 = 0),
e AS (SELECT min(seq) AS stop FROM q WHERE answer = 'q')""",
        select="""SELECT id, CASE WHEN seq >= stop THEN 'kept' WHEN answer = 'a' THEN 'approved'
  WHEN answer = 's' THEN 'kept' ELSE 'dropped' END AS outcome FROM q, e""",
    ),
    "review_export": _with(
        _B,
        select="""SELECT program_id AS program, merchant_id AS merchant, 'yes' AS merchant_mapped, type, value,
  confidence_score AS confidence, 'old' AS why,
  COALESCE(strftime(make_timestamp(valid_until_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), '') AS valid_until,
  COALESCE(CAST(min_spend AS VARCHAR), '') AS min_spend, COALESCE(channel, '') AS channel,
  COALESCE(CAST(requires_voucher AS VARCHAR), '') AS requires_voucher,
  'terms of ' || id AS source_text, 'https://offers.example/' || id AS source_url
FROM fx_benefit WHERE seq % 4 = 0""",
    ),
    "publish_catalog": _with(
        _B,
        select="""SELECT id, CASE WHEN seq % 3 = 0 AND seq % 10 = 0 THEN value + 1 ELSE value END AS value,
  CASE WHEN seq % 3 = 0 THEN 'kept' WHEN seq % 2 <> 0 THEN 'added'
    WHEN seq % 10 = 0 THEN 'updated' ELSE 'unchanged' END AS action
FROM fx_benefit WHERE seq % 7 <> 0 AND (seq % 3 <> 0 OR seq % 2 = 0)""",
    ),
    "publish_report": _with(
        _B,
        """s AS (SELECT seq % 3 <> 0 AS g, seq % 2 = 0 AS o, seq % 7 = 0 AS q, seq % 10 = 0 AS c
  FROM fx_benefit)""",
        select="""SELECT count(*) FILTER (g) AS generated, count(*) FILTER (q) AS in_review,
  count(*) FILTER (q AND g) AS blocked, count(*) FILTER (g AND NOT o AND NOT q) AS added,
  count(*) FILTER (g AND o AND c AND NOT q) AS updated,
  count(*) FILTER (g AND o AND NOT c AND NOT q) AS unchanged,
  count(*) FILTER (q AND o) AS withdrawn, count(*) FILTER (o) AS "before",
  count(*) FILTER (NOT q AND (g OR o)) AS "after" FROM s""",
    ),
    "keep_verification": _with(
        _COLLECTED,
        """prev AS (SELECT offer_url, content_hash, verified_s FROM col WHERE verified_s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY offer_url, content_hash ORDER BY line_no DESC) = 1),
cur AS (SELECT line_no, offer_url, CASE WHEN line_no % 5 = 0 THEN sha256(offer_url)
  ELSE content_hash END AS content_hash FROM col)""",
        select="""SELECT line_no, c.offer_url, verified_s * 1000 AS verified_ms
FROM cur c LEFT JOIN prev p ON p.offer_url = c.offer_url AND p.content_hash = c.content_hash""",
    ),
    "apply_verdicts": _with(
        _COLLECTED, _PROOF, select="SELECT line_no, outcome, verified_ms FROM applied"
    ),
    "pass_verdict": _with(
        _COLLECTED, _PROOF,
        select="""SELECT count(*) FILTER (outcome IN ('live', 'proven')) AS verified,
  count(*) FILTER (outcome = 'removed') AS removed, count(*) FILTER (outcome = 'unproven') AS unproven,
  CAST(floor(100 * count(*) FILTER (outcome IN ('live', 'proven'))
    / count(*) FILTER (outcome <> 'removed')) AS BIGINT) AS coverage,
  count(*) FILTER (outcome IN ('live', 'proven')) = 0 AS failed FROM applied""",
    ),
    "link_coverage": _with(
        _COLLECTED, _PROOF,
        select="""SELECT category, count(*) AS total, count(verified_ms) AS verified, min(verified_ms) AS oldest,
  CAST(floor(100 * count(verified_ms) / count(*)) AS BIGINT) AS percent,
  CAST(ceil((count(*) - count(verified_ms)) / 500) AS BIGINT) AS passes_left
FROM applied WHERE outcome <> 'removed' GROUP BY ROLLUP (category)""",
    ),
    "check_frontier": _with(
        _COLLECTED, _PROOF,
        select="""SELECT DISTINCT offer_url FROM col WHERE offer_url NOT IN (SELECT offer_url FROM proven)
  AND offer_url NOT IN (SELECT offer_url FROM verdict)""",
    ),
    "crawl_batches": _with(
        _COLLECTED,
        select="""SELECT category AS list, line_no AS id,
  CAST(floor((row_number() OVER (PARTITION BY category ORDER BY line_no) - 1) / 25) AS BIGINT) AS batch
FROM col WHERE line_no % 6 <> 0""",
    ),
    "merge_merchants": _with(
        duckdb_cte(["fx_candidate"]),
        select="""SELECT easy_id, max_by(name, seq) AS name, arg_max_null(easy_category, seq) AS easy_category,
  max_by(address, seq) AS address, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists
FROM fx_candidate GROUP BY easy_id""",
    ),
    "violations": _with(
        _QUALITY,
        select="""SELECT 'benefits' AS "table", id, 'duplicate_id' AS rule FROM bb GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'benefits', id, 'percent_over_100' FROM bb WHERE type = 'percent' AND value > 100
UNION ALL SELECT 'benefits', id, 'source_url' FROM bb WHERE source_url NOT LIKE 'http%'
UNION ALL SELECT 'benefits', id, 'last_verified_at' FROM bb WHERE last_verified_s IS NULL
UNION ALL SELECT 'benefits', id, 'unknown_program' FROM bb
  WHERE program_id NOT IN (SELECT id FROM fx_program)
UNION ALL SELECT 'benefits', id, 'unknown_merchant' FROM bb
  WHERE merchant_id NOT LIKE 'unmapped%' AND merchant_id NOT IN (SELECT id FROM mm)
UNION ALL SELECT 'merchants', merchant_id, 'unknown_venue' FROM mem
  WHERE venue_id NOT IN (SELECT id FROM fx_venue)
UNION ALL SELECT 'merchants', merchant_id, 'domain' FROM dom WHERE domain LIKE '%/%'
UNION ALL SELECT 'merchants', id, 'unreachable' FROM reach WHERE NOT place AND NOT web AND NOT offers
UNION ALL SELECT 'merchants', merchant_id, 'branch_outside' FROM fx_branch
  WHERE NOT (lat BETWEEN 29.4 AND 33.4 AND lng BETWEEN 34.2 AND 35.9)""",
    ),
    "catalog_coverage": _with(
        _QUALITY,
        select="""SELECT count(*) AS merchants, count(*) FILTER (web) AS with_domain,
  count(*) FILTER (NOT web) AS without_domain, count(*) FILTER (NOT place) AS without_place,
  count(*) FILTER (NOT place AND NOT web AND offers) AS list_only,
  count(*) FILTER (NOT place AND offers) AS benefits_without_place,
  (SELECT count(*) FROM bb WHERE merchant_id LIKE 'unmapped%') AS unmapped_benefits FROM reach""",
    ),
}
