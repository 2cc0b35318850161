"""The benefit domain projected out of the driver tables.

Each view is one SQL text used by Spark and by the checking engine alike; the
only engine-specific piece is how the benefit keys are spread over regions.
``{table}`` names a driver table. Instants are epoch seconds (``*_s``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
BASE_S = 1706781600  # 2024-02-01T10:00:00Z

BENEFIT_KEYS = {
    "spark": (
        "SELECT CAST(p_partkey AS BIGINT) * 5 + r AS k FROM (SELECT p_partkey, "
        "explode((SELECT collect_list(r_regionkey) FROM {region})) AS r FROM {part})"
    ),
    "duckdb": (
        "SELECT CAST(p_partkey AS BIGINT) * 5 + r AS k FROM (SELECT p_partkey, "
        "unnest((SELECT list(r_regionkey) FROM {region})) AS r FROM {part})"
    ),
}

VIEWS = {
    "fx_program": """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'credit_card' AS category,
  CAST(NULL AS STRING) AS parent_id
FROM {region}
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), n_name,
  CASE n_nationkey % 3 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'employer_club'
    ELSE 'retail_club' END,
  'r' || CAST(n_regionkey AS STRING)
FROM {nation}""",
    "fx_owned": """
SELECT c_custkey AS user_id, 'n' || CAST(c_nationkey AS STRING) AS program_id
FROM {customer}
UNION SELECT c_custkey, 'n' || CAST((c_custkey * 7) % 25 AS STRING)
FROM {customer} WHERE c_custkey % 3 <> 0""",
    # Chains of fifty programs; the last of a chain has no parent or closes a cycle.
    "fx_deep_program": """
SELECT 'p' || CAST(p_partkey AS STRING) AS id,
  CASE WHEN p_partkey % 50 <> 49 THEN 'p' || CAST(p_partkey + 1 AS STRING)
    WHEN p_partkey % 200 = 199 THEN 'p' || CAST(p_partkey - 10 AS STRING) END AS parent_id
FROM {part}""",
    "fx_deep_owned": """
SELECT c_custkey AS user_id,
  'p' || CAST(c_custkey % (SELECT COUNT(*) FROM {part}) AS STRING) AS program_id
FROM {customer}""",
    "fx_merchant": """
SELECT s_suppkey AS seq, 's' || CAST(s_suppkey AS STRING) AS id, s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'grocery' WHEN 1 THEN 'dining' WHEN 2 THEN 'fuel'
    ELSE NULL END AS category
FROM {supplier}""",
    "fx_branch": """
SELECT 's' || CAST(s_suppkey AS STRING) AS merchant_id, 0 AS branch_no,
  CAST(CASE WHEN s_suppkey % 5 = 0
    THEN 29.6 + (s_suppkey % 10) * 0.37 + (s_suppkey % 40) * 0.0001
    ELSE 29.5 + ((s_suppkey * 7919) % 38000) / 10000.0 END AS DOUBLE) AS lat,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN 34.4 + (s_suppkey % 10) * 0.14
    ELSE 34.3 + ((s_suppkey * 6101) % 15000) / 10000.0 END AS DOUBLE) AS lng
FROM {supplier} WHERE s_suppkey % 17 <> 1
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 1,
  CAST(29.5 + ((s_suppkey * 7919 + 104729) % 38000) / 10000.0 AS DOUBLE),
  CAST(34.3 + ((s_suppkey * 6101 + 7993) % 15000) / 10000.0 AS DOUBLE)
FROM {supplier} WHERE s_suppkey % 3 >= 1 AND s_suppkey % 17 <> 1
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 2,
  CAST(29.5 + ((s_suppkey * 7919 + 2 * 104729) % 38000) / 10000.0 AS DOUBLE),
  CAST(34.3 + ((s_suppkey * 6101 + 2 * 7993) % 15000) / 10000.0 AS DOUBLE)
FROM {supplier} WHERE s_suppkey % 3 >= 2 AND s_suppkey % 17 <> 1""",
    "fx_venue": """
SELECT 'v' || CAST(n_nationkey AS STRING) AS id, n_name AS name, n_nationkey AS seq,
  CAST(29.6 + (n_nationkey % 10) * 0.37 + CAST(floor(n_nationkey / 10) AS BIGINT) * 0.002 AS DOUBLE) AS lat,
  CAST(34.4 + (n_nationkey % 10) * 0.14 + CAST(floor(n_nationkey / 10) AS BIGINT) * 0.001 AS DOUBLE) AS lng,
  200 + (n_nationkey % 3) * 100 AS radius_m
FROM {nation}""",
    "fx_venue_member": """
SELECT 's' || CAST(s_suppkey AS STRING) AS merchant_id,
  'v' || CAST(s_suppkey % 10 AS STRING) AS venue_id
FROM {supplier} WHERE s_suppkey % 11 = 0""",
    "fx_benefit": """
SELECT k AS seq, 'b' || CAST(k AS STRING) AS id,
  CASE WHEN k % 10 = 0 THEN 'r' || CAST((k * 3) % 5 AS STRING)
    ELSE 'n' || CAST((k * 13) % 25 AS STRING) END AS program_id,
  CASE WHEN k % 997 = 0 THEN 'any_merchant'
    ELSE 's' || CAST((k * 31 + CAST(floor(k / 100) AS BIGINT)) % ns AS STRING) END AS merchant_id,
  CASE (k * 7) % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'fixed' WHEN 2 THEN 'bogo'
    WHEN 3 THEN 'cashback' ELSE 'gift_card' END AS type,
  CAST(CASE (k * 7) % 5 WHEN 0 THEN 1.0 + k % 40 WHEN 3 THEN 1.0 + k % 12 WHEN 2 THEN 0.0
    ELSE 10.0 * (1 + k % 30) END AS DOUBLE) AS value,
  CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE 50.0 * ((k * 11) % 23) END AS DOUBLE) AS min_spend,
  CAST(CASE WHEN k % 4 = 0 THEN 25.0 * (1 + k % 6) ELSE NULL END AS DOUBLE) AS max_discount,
  CASE (k * 5) % 13 WHEN 0 THEN '1,2,3,4,5' WHEN 1 THEN '6,7' WHEN 2 THEN '1,3,5'
    ELSE NULL END AS valid_days_csv,
  CASE (k * 3) % 11 WHEN 0 THEN '09:00' WHEN 1 THEN '22:00' ELSE NULL END AS hours_from,
  CASE (k * 3) % 11 WHEN 0 THEN '17:00' WHEN 1 THEN '02:00' ELSE NULL END AS hours_to,
  CASE (k * 17) % 7 WHEN 0 THEN 'in_store' WHEN 1 THEN 'online' WHEN 2 THEN 'both'
    ELSE NULL END AS channel,
  CASE (k * 19) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS stacks_with_club,
  CASE WHEN (k * 23) % 8 = 0 THEN 'tobacco,medicine' ELSE NULL END AS exclusions_csv,
  CASE WHEN (k * 29) % 9 = 0 THEN 'once a month' ELSE NULL END AS usage_limit,
  CASE WHEN (k * 37) % 6 = 0 THEN TRUE ELSE NULL END AS requires_voucher,
  CASE WHEN (k * 41) % 14 = 0 THEN 1706781600 + (((k * 43) % 20) - 10) * 86400
    ELSE NULL END AS valid_from_s,
  CASE WHEN (k * 47) % 5 = 0 THEN 1706781600 + (((k * 53) % 40) - 10) * 86400
    ELSE NULL END AS valid_until_s,
  CASE WHEN k % 501 = 0 THEN NULL ELSE 1706781600 - ((k * 59) % 61) * 86400
    END AS last_verified_s,
  CAST(0.70 + ((k * 61) % 30) / 100.0 AS DOUBLE) AS confidence_score,
  ((k * 67) % 9) = 0 AS reviewed_by_human
FROM (SELECT k, (SELECT COUNT(*) FROM {supplier}) AS ns FROM (%BENEFIT_KEYS%) q0) q""",
    # Instants in the wording of a catalog file.
    "fx_benefit_dates": """
SELECT 'b' || CAST(p_partkey AS STRING) AS id,
  CASE WHEN p_partkey % 50 = 7 THEN 'soon' WHEN p_partkey % 3 = 0 THEN '2024-02-01T10:00:00Z' END
    AS valid_from,
  CASE WHEN p_partkey % 50 = 9 THEN '2024-02-31' WHEN p_partkey % 4 = 0 THEN '2024-03-31T21:59:00.000Z' END
    AS valid_until,
  CASE WHEN p_partkey % 50 <> 11 THEN '2024-01-15T08:30:00Z' END AS last_verified_at
FROM {part}""",
    "fx_context": """
SELECT o_orderkey AS ctx_id, o_custkey AS user_id,
  's' || CAST((o_orderkey * 17) % (SELECT COUNT(*) FROM {supplier}) AS STRING) AS merchant_id,
  1706781600 + (o_orderkey % 168) * 3600 AS now_s,
  CASE o_orderkey % 3 WHEN 0 THEN 'in_store' WHEN 1 THEN 'online' ELSE NULL END AS channel,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL
    ELSE ROUND(o_totalprice / 400, 0) END AS DOUBLE) AS cart_amount
FROM {orders}""",
    "fx_muted": """
SELECT o_custkey AS user_id,
  'b' || CAST((o_orderkey * 71) % (SELECT COUNT(*) * 5 FROM {part}) AS STRING) AS benefit_id
FROM {orders} WHERE o_orderkey % 50 = 0""",
    "fx_viewed": """
SELECT DISTINCT l_orderkey AS ctx_id,
  'b' || CAST(l_partkey * 5 + l_suppkey % 5 AS STRING) AS benefit_id
FROM {lineitem}""",
    "fx_interaction": """
SELECT event_id, user_id, ts,
  CASE event_type WHEN 'view' THEN 'notification_sent' WHEN 'click' THEN 'notification_opened'
    WHEN 'purchase' THEN 'benefit_redeemed' WHEN 'signup' THEN 'share_resolved'
    ELSE 'share_unmatched' END AS kind
FROM {events}""",
    "fx_fence_event": """
SELECT event_id, user_id, ts, 'v' || CAST(user_id % 10 AS STRING) AS fence_id,
  CASE WHEN event_type = 'error' THEN 'exit' ELSE 'enter' END AS kind,
  event_id % 5 AS match_count
FROM {events}""",
    "fx_position": """
SELECT event_id AS pos_id, user_id, ts,
  CAST(29.6 + (event_id % 10) * 0.37 + ((event_id * 37) % 50) * 0.0001 AS DOUBLE) AS lat,
  CAST(34.4 + (event_id % 10) * 0.14 + ((event_id * 41) % 30) * 0.0001 AS DOUBLE) AS lng
FROM {events}""",
    "fx_collected": """
SELECT doc_id AS line_no, source AS category,
  'https://offers.example/'
    || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS STRING) AS offer_url,
  text AS terms_text,
  CASE WHEN doc_id % 7 = 0 THEN 1706781600 - (doc_id % 12) * 86400 ELSE NULL END AS verified_s
FROM {documents}""",
    "fx_verdict": """
SELECT 'https://offers.example/' || CAST(doc_id AS STRING) AS offer_url,
  CASE WHEN doc_id % 20 = 3 THEN 'gone' WHEN doc_id % 4 = 1 THEN 'live'
    ELSE 'unreachable' END AS state,
  1706781600 AS checked_s
FROM {documents} WHERE doc_id % 3 <> 0""",
    "fx_headline": """
SELECT p_partkey AS line_no, p_name AS merchant_name,
  CASE p_partkey % 8 WHEN 0 THEN 'חנות • ' || CAST(p_size AS STRING) || '% הנחה'
    WHEN 1 THEN 'חנות • ' || CAST(p_size AS STRING) || '% החזר כספי'
    WHEN 2 THEN 'חנות • 1+1 על הכל'
    WHEN 3 THEN 'חנות • 100% טבעוני • ' || CAST(p_size AS STRING) || '% הנחה'
    WHEN 4 THEN 'חנות • עד ' || CAST(p_size AS STRING) || '% הנחה בתוקף עד 31/12/2027'
    WHEN 5 THEN 'חנות • ' || CAST(p_size AS STRING) || ' ש״ח הנחה באתר'
    WHEN 6 THEN 'חנות • שובר בשווי 200₪ ב-' || CAST(p_size AS STRING) || '₪'
    ELSE 'חנות • כשר' END AS headline
FROM {part}""",
    # Businesses seen on discount lists: one sighting per event, names drawn from
    # the merchants plus strangers, coordinates as in fx_position, some missing.
    "fx_candidate": """
SELECT event_id AS seq, CAST(event_id % 977 AS STRING) AS easy_id,
  CASE WHEN event_id % 3 = 0 THEN 'Stranger ' || CAST(event_id % 977 AS STRING)
    ELSE (CASE WHEN event_id % 2 = 0 THEN ' supplier#' ELSE 'Supplier #' END)
      || LPAD(CAST(event_id % (SELECT COUNT(*) FROM {supplier}) AS STRING), 9, '0') END AS name,
  CASE event_id % 5 WHEN 0 THEN 'בית קפה' WHEN 1 THEN 'תחנת דלק' WHEN 2 THEN 'חנות ספרים'
    WHEN 3 THEN 'שונות' ELSE NULL END AS easy_category,
  'street ' || CAST(event_id % 50 AS STRING) AS address,
  CAST(CASE WHEN event_id % 13 = 0 THEN NULL
    ELSE 29.6 + (event_id % 10) * 0.37 + ((event_id * 37) % 50) * 0.0001 END AS DOUBLE) AS lat,
  CAST(CASE WHEN event_id % 13 = 0 THEN NULL
    ELSE 34.4 + (event_id % 10) * 0.14 + ((event_id * 41) % 30) * 0.0001 END AS DOUBLE) AS lng,
  'list' || CAST(event_id % 7 AS STRING) AS list
FROM {events}""",
    # Extraction results per collected text, one or two offers per line.
    "fx_extracted": """
SELECT doc_id AS line_no, source AS program_id,
  CASE WHEN doc_id % 4 = 3 THEN 'New Shop ' || CAST(doc_id % 37 AS STRING)
    ELSE 'supplier #' || LPAD(CAST(doc_id % (SELECT COUNT(*) FROM {supplier}) AS STRING), 9, '0')
    END AS merchant_name,
  CASE doc_id % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'fixed' ELSE 'cashback' END AS type,
  CAST(CASE WHEN doc_id % 29 = 0 THEN 140.0 ELSE 1 + (doc_id % 9) * 2.5 END AS DOUBLE) AS value,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 100.0 + doc_id % 3 ELSE NULL END AS DOUBLE) AS min_spend,
  CASE WHEN doc_id % 6 = 0 THEN '2024-03-31' WHEN doc_id % 6 = 1 THEN '2024-02-10'
    ELSE NULL END AS valid_until_text,
  CAST(0.6 + (doc_id % 40) / 100.0 AS DOUBLE) AS confidence_score,
  'reason ' || CAST(doc_id % 4 AS STRING) AS confidence_reason,
  'https://offers.example/' || CAST(doc_id AS STRING) AS source_url,
  text AS raw_text_summary
FROM {documents}""",
    "fx_domain": """
SELECT seq, 's' || CAST(seq % (SELECT COUNT(*) FROM {supplier}) AS STRING) AS merchant_id,
  CASE WHEN seq % 5 = 0 THEN host ELSE regexp_extract(host, '([^.]+[.][^.]+)$', 1) END AS domain
FROM (SELECT page_id AS seq, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host
  FROM {pages}) q
WHERE seq % 10 = 2 OR seq % 5 = 0""",
    # Links as people share them: one in four is not a plain one.
    "fx_share": """
SELECT page_id AS ctx_id, page_id % 150 AS user_id, 1706781600 + (page_id % 168) * 3600 AS now_s,
  CASE page_id % 4 WHEN 0 THEN 'look: ' || url || ' !' WHEN 1 THEN upper(url) WHEN 2 THEN url
    ELSE CASE page_id % 11
      WHEN 0 THEN 'half: https://' || host || '/100%-off?x={{1}}|2 now'
      WHEN 1 THEN 'https://user:p@ss@' || host || ':8443/sale[1]'
      WHEN 2 THEN ' ' || host || '/sale 50% off'
      WHEN 3 THEN 'https://' || host || chr(92) || 'x'
      WHEN 4 THEN 'https://' || replace(host, '.', '%2E') || '/%D7%90'
      WHEN 5 THEN 'https://' || host || ':99999/'
      WHEN 6 THEN 'https://חנות.' || host || '/x'
      WHEN 7 THEN 'https://1.2.' || CAST(page_id AS STRING) || '/x'
      WHEN 8 THEN 'https:' || chr(92) || '/' || host || ' and https://www.' || upper(host) || '?a@b'
      WHEN 9 THEN 'https://my_shop.' || host || '#/x'
      ELSE 'no link here' END END AS text
FROM (SELECT page_id, url, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host FROM {pages}) p""",
    # Discount lists as named by their site, one per document source and case.
    "fx_list_title": """
SELECT doc_id AS seq, CASE doc_id % 8 WHEN 0 THEN 'Fly-Card' WHEN 1 THEN 'HAPPY-hour'
    WHEN 2 THEN 'My-MAX' WHEN 3 THEN 'TAU' WHEN 4 THEN 'Yours-Club'
    WHEN 5 THEN 'shopClub' || CAST(doc_id % 40 AS STRING)
    WHEN 6 THEN 'Teachers-' || source ELSE 'Behatsdaa' END AS slug,
  CASE doc_id % 8 WHEN 2 THEN 'My MAX' WHEN 6 THEN 'מורים ' || source
    ELSE 'List ' || CAST(doc_id % 40 AS STRING) END AS title
FROM {documents}""",
    "fx_listing": """
SELECT doc_id AS id, source AS list, 'biz ' || CAST(doc_id % 300 AS STRING) AS bizname,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS category,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN text
    WHEN 2 THEN CAST(doc_id % 60 AS STRING) || '% off' WHEN 3 THEN 'חנות • 1 + 1'
    ELSE 'מתנה לחברים' END AS bestsubcat,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'street ' || CAST(doc_id % 90 AS STRING) END AS address
FROM {documents}""",
}


def view_sql(name: str, engine: str) -> str:
    return VIEWS[name].replace("%BENEFIT_KEYS%", BENEFIT_KEYS[engine]).strip()


def view(spark: SparkSession, name: str, table: Callable[[str], DataFrame]) -> DataFrame:
    text = view_sql(name, "spark")
    used = {t: table(t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb_cte(names: list[str]) -> str:
    """``name AS (...)`` list for the checking engine, in dependency-free order."""
    tables = {t: t for t in TABLES}
    return ",\n".join(f"{n} AS ({view_sql(n, 'duckdb').format(**tables)})" for n in names)
