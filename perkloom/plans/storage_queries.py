"""Readers and writers: every query writes the tables of the data folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators import quality, review
from perkloom.plans import ingest_queries
from perkloom.plans.domain import Domain
from perkloom.plans.fixture_views import duckdb_cte
from perkloom.schemas import BENEFIT
from perkloom.session import ensure_checkpoint_dir, keep_track
from perkloom.sources import catalog, collected, commits, store


def _folder(spark) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    keep_track(path)
    return path


def _cities(df: DataFrame) -> DataFrame:
    return df.withColumn("city", F.lit("city"))


def _merchants(d: Domain) -> DataFrame:
    """Merchants with their branches, domains and venues inside, as the catalog keeps them."""
    listed = lambda df, what, name: df.groupBy("merchant_id").agg(
        F.array_sort(F.collect_list(what)).alias(name)
    )
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    m = d.merchants.withColumnRenamed("id", "merchant_id")
    for part in (
        listed(d.branches, F.struct("branch_no", "lat", "lng"), "branches"),
        listed(d.venue_members, "venue_id", "venue_ids"),
        listed(d.domains, "domain", "domains"),
    ):
        m = m.join(part, "merchant_id", "left")
    return m.select(
        F.col("merchant_id").alias("id"), "name", none("domains", "string"), none("venue_ids", "string"),
        F.transform(F.coalesce("branches", F.array().cast("array<struct<branch_no:int,lat:double,lng:double>>")),
                    lambda b: F.struct(b["lat"].alias("lat"), b["lng"].alias("lng"))).alias("branches"),
        none("categories", "string"),
    )


def catalog_load(spark, sf_dir):
    """The four tables as JSON, read strictly; merchants by what is inside them."""
    d, folder = Domain(spark, sf_dir), _folder(spark)
    tables = {
        "programs": d.programs, "venues": _cities(d.venues.drop("seq")), "merchants": _merchants(d),
        "benefits": d.benefits.drop("seq").where("last_verified_at IS NOT NULL"),
    }
    for name, df in tables.items():
        df.write.json(f"{folder}/{name}.json")
    loaded = catalog.read_catalog(spark, folder, lines=True)
    m = loaded["merchants"]
    counted = lambda df, name: df.groupBy("merchant_id").agg(F.count(F.lit(1)).alias(name))
    parts = m.select(F.col("id").alias("merchant_id"), "name")
    for df, name in (
        (catalog.branches_of(m), "branches"), (catalog.domains_of(m), "domains"),
        (catalog.members_of(m), "venues"), (loaded["benefits"], "benefits"),
    ):
        parts = parts.join(counted(df, name), "merchant_id", "left").fillna(0, [name])
    return parts


def catalog_faults(spark, sf_dir):
    """A catalog with faults planted in every table."""
    d = Domain(spark, sf_dir)
    at = lambda n: F.col("seq") % 40 == n
    benefits = d.benefits.withColumns({
        "program_id": F.when(at(1), "").otherwise(F.col("program_id")),
        "merchant_name": F.when(at(2), None).otherwise(F.col("merchant_name")),
        "type": F.when(at(3), "nonsense").otherwise(F.col("type")),
        "value": F.when(at(4), -1.0).otherwise(F.col("value")),
        "source_url": F.when(at(5), "no address").otherwise(F.col("source_url")),
        "conditions": F.when(at(6), F.col("conditions").withField("raw_text_summary", F.lit("")))
        .otherwise(F.col("conditions")),
    })
    programs = d.programs.withColumns({
        "name": F.when(F.col("id") == "n3", "").otherwise(F.col("name")),
        "catalog_url": F.lit("https://clubs.example/"),
    })
    merchants = _merchants(d).withColumns({
        "categories": F.when(F.col("id").endswith("7"), F.array(F.lit("nonsense"))).otherwise(F.col("categories")),
    })
    venues = _cities(d.venues).withColumn("lat", F.when(F.col("id") == "v2", 91.0).otherwise(F.col("lat")))
    return quality.load_rules(benefits, programs, merchants, venues).select("table", "id", "rule")


def date_faults(spark, sf_dir):
    """Instants as they are written in a catalog, some of them no instants."""
    raw = Domain(spark, sf_dir).raw("fx_benefit_dates")
    return quality.date_rules(raw).select("id", "rule", "detail")


def collected_lines(spark, sf_dir):
    """Collected records as JSON lines among lines that are none, one address twice."""
    d, folder = Domain(spark, sf_dir), _folder(spark)
    records = d.collected.withColumn("verified_at", F.date_format("verified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct("offer_url", "terms_text", "content_hash", "category"))
    broken = (
        F.when(F.col("line_no") % 11 == 3, F.lit("{not json"))
        .when(F.col("line_no") % 11 == 5, F.lit("   "))
        .when(F.col("line_no") % 11 == 7, F.lit('{"offer_url":"https://offers.example/x"}'))
        .otherwise(line)
    )
    # Sorted parts: their numbers and the places in them give the order of the lines.
    records.orderBy("line_no").select(broken.alias("value")).write.text(f"{folder}/deals")
    got = collected.read_collected(spark, f"{folder}/deals", parts=True)
    return got.select("offer_url", "content_hash", F.length("terms_text").alias("chars"))


def extraction_files(spark, sf_dir):
    """Extraction results of each document source, as JSON lines of up to fifty offers."""
    d, folder = Domain(spark, sf_dir), _folder(spark)
    offers = d.extracted.select(
        "program_id", "line_no",
        F.struct("merchant_name", "type", "value", "source_url", "valid_from", "valid_until",
                 "confidence_score", "confidence_reason", "conditions").alias("offer"),
    )
    results = offers.groupBy("program_id", F.expr("line_no div 50").alias("slice")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "offer"))).alias("rows")
    ).select(
        F.col("program_id").alias("page_summary"), F.transform("rows", lambda r: r["offer"]).alias("benefits")
    )
    results.write.json(f"{folder}/results")
    got = collected.read_extraction(spark, f"{folder}/results", lines=True)
    return got.groupBy("merchant_name", "type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"),
        F.count("valid_until").alias("dated"),
    )


def program_sources(spark, sf_dir):
    """The sources of one program; asking for one that is not there is an error."""
    sources = Domain(spark, sf_dir).collected.select("line_no", F.col("category").alias("program_id"))
    try:
        collected.select_program(sources, "nobody")
    except ValueError:
        return collected.select_program(sources, "src3")
    raise AssertionError("an unknown program was accepted")


def table_versions(spark, sf_dir):
    """A catalog table replaced by a version that is computed from it."""
    d, root = Domain(spark, sf_dir), f"{_folder(spark)}/benefits"
    empty = store.read_table(spark, root, BENEFIT)
    rows = d.benefits.withColumn("google_place_id", F.lit(None).cast("string"))
    store.replace_table(empty.unionByName(rows.where("seq % 2 = 0").drop("seq")), root)
    first = store.read_table(spark, root, BENEFIT)
    more = first.withColumn("value", F.col("value") + 1).unionByName(rows.where("seq % 2 = 1").drop("seq"))
    store.replace_table(more, root)
    return store.read_table(spark, root, BENEFIT).select("id", "value")


def joint_commit(spark, sf_dir):
    """Catalog and queue committed together; a writer who read an older commit changes nothing."""
    d, root = Domain(spark, sf_dir), f"{_folder(spark)}/catalog"
    rows = d.benefits.select("id", "value", "seq")
    start = commits.latest(spark, root)
    first = commits.commit(spark, root, start, {"benefits": rows.where("seq % 2 = 0"), "queue": rows.where("seq % 2 = 1")})
    live, left = (commits.read(spark, root, first, t, rows.schema) for t in ("benefits", "queue"))
    good = F.col("seq") % 3 == 0
    second = commits.commit(spark, root, first, {"benefits": live.unionByName(left.where(good)), "queue": left.where(~good)})
    try:
        commits.commit(spark, root, first, {"queue": left.limit(0)})
    except commits.ConflictError:
        last = commits.latest(spark, root)
        if last != second:
            raise AssertionError("a refused commit was seen") from None
        named = [commits.read(spark, root, last, t, rows.schema).withColumn("place", F.lit(t)) for t in ("benefits", "queue")]
        return named[0].unionByName(named[1]).select("id", "value", "place")
    raise AssertionError("a commit from an old one was accepted")


def list_overwrite(spark, sf_dir):
    """Lists crawled twice; a crawl cut short and an empty one replace nothing."""
    d, root = Domain(spark, sf_dir), f"{_folder(spark)}/lists"
    rows = d.collected.select(F.col("category").alias("list"), "offer_url", "line_no")
    everything = rows.select("list").distinct().withColumn("complete", F.lit(True))
    store.write_lists(rows.where("line_no % 2 = 0"), everything, root, file_rows=100)
    number = F.regexp_extract("list", "[0-9]+$", 0).cast("int")
    cut = everything.withColumn("complete", number % 3 != 0)
    store.write_lists(rows.where((F.col("line_no") % 2 == 1) & (number % 5 != 0)), cut, root, file_rows=100)
    return spark.read.parquet(root).select(F.col("list").cast("string").alias("list"), "offer_url", "line_no")


def review_file(spark, sf_dir):
    """The review sheet as CSV."""
    path = f"{_folder(spark)}/sheet"
    store.write_review_sheet(review.review_sheet(ingest_queries._queue(Domain(spark, sf_dir))), path)
    sheet = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return sheet.groupBy("program", "type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("value")
    )


def event_log(spark, sf_dir):
    """Interactions appended in two parts, by day."""
    d, root = Domain(spark, sf_dir), f"{_folder(spark)}/events"
    for part in (0, 1):
        store.append_events(d.interactions.where(F.col("event_id") % 2 == part), root)
    return spark.read.parquet(root).groupBy(F.col("day").cast("string").alias("day"), "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        catalog_load, catalog_faults, date_faults, collected_lines, extraction_files, program_sources,
        table_versions, joint_commit, list_overwrite, review_file, event_log,
    )
}


# --- SQL twins ---------------------------------------------------------------------
def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_MERCHANT_PARTS = duckdb_cte(["fx_merchant", "fx_branch", "fx_domain", "fx_venue_member", "fx_benefit"])
_NAMES = ", ".join(f"'{c}'" for c in V.MERCHANT_CATEGORIES)
ORACLE = {
    "catalog_load": _with(
        _MERCHANT_PARTS,
        select="""SELECT m.id AS merchant_id, name,
  (SELECT count(*) FROM fx_branch b WHERE b.merchant_id = m.id) AS branches,
  (SELECT count(*) FROM fx_domain b WHERE b.merchant_id = m.id) AS domains,
  (SELECT count(*) FROM fx_venue_member b WHERE b.merchant_id = m.id) AS venues,
  (SELECT count(*) FROM fx_benefit b WHERE b.merchant_id = m.id AND last_verified_s IS NOT NULL) AS benefits
FROM fx_merchant m""",
    ),
    "catalog_faults": _with(
        duckdb_cte(["fx_merchant", "fx_benefit", "fx_program", "fx_venue"]),
        select="""SELECT 'benefits' AS "table", id, CASE seq % 40 WHEN 1 THEN 'program_id_missing'
    WHEN 2 THEN 'merchant_name_missing' WHEN 3 THEN 'type' WHEN 4 THEN 'value' WHEN 5 THEN 'source_url'
    ELSE 'summary' END AS rule FROM fx_benefit WHERE seq % 40 BETWEEN 1 AND 6
UNION ALL SELECT 'benefits', id, 'last_verified_at' FROM fx_benefit WHERE last_verified_s IS NULL
UNION ALL SELECT 'programs', id, 'name_missing' FROM fx_program WHERE id = 'n3'
UNION ALL SELECT 'merchants', id, 'categories' FROM fx_merchant WHERE id LIKE '%7'
UNION ALL SELECT 'venues', id, 'lat' FROM fx_venue WHERE id = 'v2'""",
    ),
    "date_faults": _with(
        duckdb_cte(["fx_benefit_dates"]),
        select="""SELECT id, 'last_verified_at' AS rule, coalesce(last_verified_at, 'missing') AS detail
FROM fx_benefit_dates WHERE last_verified_at IS NULL
UNION ALL SELECT id, 'valid_from', valid_from FROM fx_benefit_dates WHERE valid_from = 'soon'
UNION ALL SELECT id, 'valid_until', valid_until FROM fx_benefit_dates WHERE valid_until = '2024-02-31'""",
    ),
    "collected_lines": _with(
        ingest_queries._COLLECTED,
        select="""SELECT offer_url, max_by(content_hash, line_no) AS content_hash,
  CAST(max_by(length(terms_text), line_no) AS INT) AS chars
FROM col WHERE line_no % 11 NOT IN (3, 5, 7) AND terms_text <> '' GROUP BY ALL""",
    ),
    "extraction_files": _with(
        duckdb_cte(["fx_extracted"]),
        select="""SELECT merchant_name, type, count(*) AS n, round(sum(value), 4) AS value,
  count(valid_until_text) AS dated FROM fx_extracted GROUP BY ALL""",
    ),
    "program_sources": "SELECT doc_id AS line_no, source AS program_id FROM documents WHERE source = 'src3'",
    "table_versions": _with(
        duckdb_cte(["fx_benefit"]),
        select="SELECT id, CASE WHEN seq % 2 = 0 THEN value + 1 ELSE value END AS value FROM fx_benefit",
    ),
    "joint_commit": _with(
        duckdb_cte(["fx_benefit"]),
        select="""SELECT id, value, CASE WHEN seq % 2 = 0 OR seq % 3 = 0 THEN 'benefits' ELSE 'queue' END AS place
FROM fx_benefit""",
    ),
    "list_overwrite": """WITH r AS (SELECT source AS list, CAST(regexp_extract(source, '[0-9]+$') AS INT) AS n,
  'https://offers.example/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS VARCHAR)
    AS offer_url, doc_id AS line_no FROM documents),
second AS (SELECT * FROM r WHERE line_no % 2 = 1 AND n % 5 <> 0 AND n % 3 <> 0)
SELECT list, offer_url, line_no FROM second
UNION ALL SELECT list, offer_url, line_no FROM r
WHERE line_no % 2 = 0 AND list NOT IN (SELECT list FROM second)""",
    "review_file": (
        "WITH sheet AS (" + ingest_queries.ORACLE["review_export"] + ")\n"
        "SELECT program, type, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS value FROM sheet GROUP BY ALL"
    ),
    "event_log": _with(
        duckdb_cte(["fx_interaction"]),
        select="""SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n FROM fx_interaction GROUP BY ALL""",
    ),
}
