"""Queries about shared links, one-line deals, pages and programs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import pages as page_fn
from perkloom.functions.share import shared_host
from perkloom.operators import enrich, offers, pages, share
from perkloom.plans import benefit_queries as bq
from perkloom.plans.domain import Domain
from perkloom.plans.fixture_views import duckdb_cte


# --- shares ---------------------------------------------------------------------
def share_host(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return d.shares.select("ctx_id", shared_host(F.col("text")).alias("host"))


def share_merchant(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return share.resolve_shares(d.shares, d.domains).select("ctx_id", "host", "merchant_id")


def share_outcome(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return share.share_outcomes(d.shares, d.domains, d.owned, d.muted, d.benefits)


# --- one-line deals ---------------------------------------------------------------
def headline_offers(spark, sf_dir):
    read = offers.read_headlines(Domain(spark, sf_dir).headlines)
    return read.where("type IS NOT NULL").select(
        "line_no", "type", "value", "confidence_score", "confidence_reason",
        F.unix_millis("valid_until").alias("valid_until_ms"), "channel", "requires_voucher",
    )


def headline_skipped(spark, sf_dir):
    read = offers.read_headlines(Domain(spark, sf_dir).headlines)
    return offers.skipped_offers(read).select("line_no", "merchant_name", "headline", "reason")


def headline_report(spark, sf_dir):
    """Counts per kind of offer read, over the extraction rows themselves."""
    read = offers.extracted_offers(offers.read_headlines(Domain(spark, sf_dir).headlines))
    return read.groupBy("type", F.col("conditions.channel").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.max("valid_until").alias("latest_end"),
    )


# --- pages ------------------------------------------------------------------------
def page_text(spark, sf_dir):
    html = Domain(spark, sf_dir).table("pages")
    text = page_fn.html_to_text(F.col("html"))
    return html.select("page_id", text.alias("text")).select(
        "page_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars")
    )


def _refined(spark, sf_dir):
    """Pages whose head carries the page title as structured data."""
    d = Domain(spark, sf_dir)
    return pages.refine(d.table("pages"))


def page_quality(spark, sf_dir):
    return _refined(spark, sf_dir).select(
        "page_id", "html_chars", "text_chars", F.round("text_ratio", 9).alias("text_ratio"), "offer_terms"
    )


def page_diagnosis(spark, sf_dir):
    return _refined(spark, sf_dir).select("page_id", "problem")


def page_accepted(spark, sf_dir):
    """Pages worth reading on, whole."""
    out = pages.accepted(_refined(spark, sf_dir))
    return out.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def page_decoded(spark, sf_dir):
    """Pages stored as bytes in three charsets, read back."""
    d = Domain(spark, sf_dir)
    html = F.col("html")
    latin = F.concat(F.lit('<meta charset="windows-1252">'), html)
    raw = d.table("pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.lit("text/html; charset=UTF-8"))
        .when(F.col("page_id") % 3 == 1, F.lit("text/html"))
        .alias("content_type"),
        F.when(F.col("page_id") % 3 == 2, F.encode(F.regexp_replace(latin, "[^\\x00-\\x7f]", "e"), "US-ASCII"))
        .otherwise(F.encode(html, "UTF-8"))
        .alias("body"),
    )
    return pages.decode_pages(raw).select("page_id", "charset", F.md5("html").alias("html_md5"))


def json_ld(spark, sf_dir):
    """Structured data built from each page's own title and address."""
    d = Domain(spark, sf_dir)
    title = F.regexp_replace(
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), '["\\\\&]', " "
    )
    block = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Offer","name":"'), title,
        F.lit('","url":"'), F.col("url"), F.lit('","seller":[{"name":"'), F.concat(F.lit("site "), F.col("url")),
        F.lit('"}]}</script>'),
    )
    html = F.concat(block, F.col("html"))
    return d.table("pages").select("page_id", page_fn.json_ld_text(html, longest=V.JSON_LD_MAX).alias("text"))


def entity_text(spark, sf_dir):
    """Document text with every third letter class written as references, decoded."""
    d = Domain(spark, sf_dir)
    written = F.col("text")
    for plain, reference in (("a", "&#x61;"), ("e", "&#101;"), ("é", "&#xE9;"), (" ", "&nbsp;")):
        written = F.replace(written, F.lit(plain), F.lit(reference))
    return d.table("documents").select(
        "doc_id", F.md5(page_fn.decode_entities(written)).alias("text_md5")
    )


def offer_page_text(spark, sf_dir):
    d = Domain(spark, sf_dir)
    records = d.collected.withColumns(
        {
            "merchant_name": F.when(F.col("line_no") % 3 != 0, F.col("category")),
            "listing_headline": F.when(F.col("line_no") % 4 == 1, F.col("offer_url")),
            "sections": F.when(
                F.col("line_no") % 2 == 0,
                F.create_map(
                    F.lit("about"), F.col("category"),
                    F.lit("חשוב לדעת"), F.col("terms_text"),
                ),
            ),
        }
    )
    return pages.offer_page_text(records).select(
        "line_no", F.md5("page_text").alias("text_md5"), F.length("page_text").alias("chars")
    )


# --- programs -----------------------------------------------------------------------
def mint_programs(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return enrich.mint_programs(d.raw("fx_list_title"), d.programs)


def program_class(spark, sf_dir):
    d = Domain(spark, sf_dir)
    category, sure = enrich.program_class(F.col("slug"), F.col("title"))
    return d.raw("fx_list_title").select("seq", category.alias("category"), sure.alias("sure"))


QUERIES = {
    f.__name__: f
    for f in (
        share_host, share_merchant, share_outcome, headline_offers, headline_skipped,
        headline_report, page_text, page_quality, page_diagnosis, page_accepted, page_decoded, json_ld,
        entity_text, offer_page_text, mint_programs, program_class,
    )
}


# --- SQL twins ----------------------------------------------------------------------
def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_SHARES = duckdb_cte(["fx_share", "fx_domain"]) + r""",
links AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)https?://[^\s"''<>]')
    THEN regexp_extract(text, '(?i)https?://[^\s"''<>]+') ELSE 'https://' || trim(text) END AS link FROM fx_share),
places AS (SELECT *, url_decode(regexp_replace(regexp_extract(link, '^[^:]+:[/\\]*([^/\\?#]*)', 1), '^.*@', '')) AS place
  FROM links),
cut AS (SELECT *, lower(regexp_replace(place, ':[0-9]*$', '')) AS name,
  COALESCE(TRY_CAST(regexp_extract(place, ':([0-9]+)$', 1) AS BIGINT), 0) AS port FROM places),
hosts AS (SELECT ctx_id, user_id, now_s, text, CASE WHEN port > 65535 OR name = '' OR contains(name, ' ') THEN NULL
    WHEN regexp_matches(name, '^1\.2\.[0-9]+$') THEN '1.2.' || CAST(CAST(name[5:] AS BIGINT) // 256 AS VARCHAR)
      || '.' || CAST(CAST(name[5:] AS BIGINT) % 256 AS VARCHAR)
    ELSE regexp_replace(replace(name, 'חנות.', 'xn--9dbd1a4b.'), '^www\.', '') END AS host FROM cut),
owners AS (SELECT regexp_replace(lower(domain), '^www\.', '') AS bare,
  min_by(merchant_id, struct_pack(a := -length(domain), b := seq)) AS merchant_id,
  max(length(domain)) AS len, min_by(seq, struct_pack(a := -length(domain), b := seq)) AS seq
  FROM fx_domain GROUP BY ALL),
found AS (SELECT h.host, min_by(o.merchant_id, struct_pack(a := -len, b := o.seq)) AS merchant_id
  FROM (SELECT DISTINCT host FROM hosts WHERE host IS NOT NULL) h
  JOIN owners o ON h.host = o.bare OR suffix(h.host, '.' || o.bare) GROUP BY ALL),
resolved AS (SELECT h.ctx_id, h.user_id, h.now_s, h.host, f.merchant_id
  FROM hosts h LEFT JOIN found f ON f.host = h.host)"""
_SHARE_PAIRS = f"""p0 AS (
  SELECT {bq._PAIR_COLUMNS}, TRUE AS is_owned, m.benefit_id IS NOT NULL AS is_muted
  FROM (SELECT ctx_id, user_id, now_s, merchant_id, 'online' AS channel,
      CAST(NULL AS DOUBLE) AS cart_amount FROM resolved WHERE merchant_id IS NOT NULL) c
  JOIN owned o ON o.user_id = c.user_id
  JOIN fx_benefit b ON b.program_id = o.program_id AND b.merchant_id = c.merchant_id
  LEFT JOIN (SELECT DISTINCT user_id, benefit_id FROM fx_muted) m
    ON m.user_id = c.user_id AND m.benefit_id = b.id)"""

_DISCOUNT = "(?i)הנחה|החזר|קאשבק|צובר|cashback|מבצע|הטבה|זיכוי|שובר|תו קנייה|תו קניה|גיפט|קופון"
_SUM = r"""(\d+(?:\.\d+)?)\s*(?:₪|ש["״'']?ח|שקלים|שקל)|₪\s*(\d+(?:\.\d+)?)"""
_HEADLINES = duckdb_cte(["fx_headline"]) + rf""",
seg AS (SELECT *, list_filter(list_transform(string_split(headline, '•'), lambda s: trim(s)),
    lambda s: s <> '') AS parts FROM fx_headline),
deals AS (SELECT *, COALESCE(
    list_filter(parts, lambda s: regexp_matches(s, '{_DISCOUNT}') AND regexp_matches(s, '\d'))[1],
    list_filter(parts, lambda s: (regexp_matches(s, '[%₪]') OR regexp_matches(s, '{_SUM}'))
      AND regexp_matches(s, '\d') AND NOT regexp_matches(s, 'טבעוני|צמחוני|כשר|חלאל|אורגני'))[1],
    CASE WHEN len(parts) <= 1 AND regexp_matches(headline, '{_DISCOUNT}') THEN headline END,
    CASE WHEN regexp_matches(headline, '1\s*\+\s*1|אחד\s*\+\s*אחד') THEN headline END) AS deal
  FROM seg),
figures AS (SELECT *, nullif(regexp_extract(deal, '(\d+(?:\.\d+)?)\s*%', 1), '') AS pt,
    COALESCE(nullif(regexp_extract(deal, '{_SUM}', 1), ''), nullif(regexp_extract(deal, '{_SUM}', 2), ''))
      AS st, regexp_matches(headline, '1\s*\+\s*1|אחד\s*\+\s*אחד') AS bogo,
    regexp_matches(deal, 'עד\s*-?\s*(?:\d+(?:\.\d+)?\s*(?:[%₪]|ש["״'']?ח|שקל)|₪\s*\d)') AS up_to,
    regexp_matches(deal, '(?i)החזר|קאשבק|צובר|cashback') AS cash,
    regexp_matches(headline, '(?i)שובר|תו קנייה|תו קניה|גיפט|gift') AS voucher,
    len(regexp_extract_all(headline, '\d+(?:\.\d+)?\s*(?:₪|ש["״'']?ח|שקלים|שקל)')) > 1
      OR contains(headline, 'החל מ') AS vague,
    regexp_extract(headline, 'עד\s*[-:]?\s*(\d{{1,2}})[./](\d{{1,2}})[./](\d{{2,4}})',
      ['d', 'm', 'y']) AS dmy
  FROM deals),
kinds AS (SELECT *, CAST(pt AS DOUBLE) AS p, CASE WHEN deal IS NULL THEN NULL WHEN bogo THEN 'bogo'
    WHEN CAST(pt AS DOUBLE) <= 0 OR CAST(pt AS DOUBLE) > 100 THEN 'odd'
    WHEN pt IS NOT NULL AND up_to THEN 'upto' WHEN pt IS NOT NULL THEN 'rate'
    WHEN st IS NOT NULL AND vague THEN 'vague' WHEN st IS NOT NULL THEN 'sum' END AS kind FROM figures),
read AS (SELECT line_no, merchant_name, headline, kind,
    CASE WHEN kind = 'bogo' THEN 'bogo' WHEN kind = 'odd' THEN 'percent'
      WHEN kind IN ('upto', 'rate') THEN CASE WHEN cash THEN 'cashback' ELSE 'percent' END
      WHEN kind IS NOT NULL THEN CASE WHEN voucher THEN 'gift_card' ELSE 'fixed' END END AS type,
    CASE WHEN kind IN ('bogo', 'odd') THEN 0.0 WHEN kind IN ('upto', 'rate') THEN p
      ELSE CAST(st AS DOUBLE) END AS value,
    CAST(CASE kind WHEN 'bogo' THEN 0.72 WHEN 'odd' THEN 0.3 WHEN 'upto' THEN 0.5 WHEN 'rate' THEN 0.8
      WHEN 'vague' THEN 0.45 ELSE 0.75 END AS DOUBLE) AS confidence_score,
    CASE kind WHEN 'bogo' THEN 'הטבת 1+1 ברורה מהכותרת, אך התנאים אינם מופיעים באיזי.'
      WHEN 'odd' THEN 'אחוז לא סביר (' || pt || '%) — צריך בדיקה ידנית.'
      WHEN 'upto' THEN 'הכותרת אומרת "עד ' || pt || '%" — זו תקרה ולא שיעור מובטח.'
      WHEN 'rate' THEN CASE WHEN cash
        THEN 'שיעור ההחזר ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם.'
        ELSE 'שיעור ההנחה ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם.' END
      WHEN 'vague' THEN 'הכותרת מציינת יותר מסכום אחד — לא ברור מה שווי ההטבה בפועל.'
      ELSE 'סכום ההטבה ברור מהכותרת באיזי; התנאים המלאים אינם מפורסמים שם.' END AS confidence_reason,
    CASE WHEN dmy.d <> '' THEN epoch_ms(make_timestamp(TRY_CAST(dmy.y AS BIGINT), TRY_CAST(dmy.m AS BIGINT),
      TRY_CAST(dmy.d AS BIGINT), 20, 59, 0.0)) END AS valid_until_ms,
    CASE WHEN regexp_matches(headline, '(?i)אונליין|באתר|online') THEN 'online' END AS channel,
    CASE WHEN voucher THEN TRUE END AS requires_voucher
  FROM kinds)"""


def _html_text(column: str) -> str:
    out = column
    for tag in ("script", "style", "noscript"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = (
        rf"regexp_replace({out}, '(?i)</(p|div|li|tr|h[1-6]|section|article|br)\s*>', chr(10), 'g')"
    )
    out = rf"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    names = [n for n in V.NAMED_ENTITIES if n != "amp"] + ["amp"]
    for name in names:
        mark = V.NAMED_ENTITIES[name].replace("'", "''")
        out = f"regexp_replace({out}, '(?i)&{name};', '{mark}', 'g')"
    out = rf"regexp_replace({out}, '[ \t\x{{00a0}}]+', ' ', 'g')"
    out = (
        f"array_to_string(list_transform(string_split({out}, chr(10)), "
        r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10))"
    )
    out = rf"regexp_replace({out}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


_TERMS = "הנחה|הנחות|מבצע|מבצעים|הטבה|הטבות|קופון|שובר|זיכוי|קאשבק|החזר|מועדון|%|₪"
_PAGES = f"""t AS (SELECT page_id, html, {_html_text('html')} AS text FROM pages),
m AS (SELECT page_id, text, length(html) AS hc, length(text) AS tc,
  len(regexp_extract_all(text, '{_TERMS}')) AS terms FROM t)"""

ORACLE = {
    "share_host": _with(_SHARES, select="SELECT ctx_id, host FROM hosts"),
    "share_merchant": _with(_SHARES, select="SELECT ctx_id, host, merchant_id FROM resolved"),
    "share_outcome": _with(
        _SHARES, duckdb_cte(["fx_program", "fx_owned", "fx_benefit", "fx_muted"]), bq._OWNED,
        _SHARE_PAIRS, bq.EVAL, bq.RANKED,
        """c AS (SELECT ctx_id, count(*) AS n, min_by(benefit_id, position) AS best FROM ranked
  GROUP BY ALL)""",
        select="""SELECT r.ctx_id, user_id, host, merchant_id, CASE WHEN merchant_id IS NULL THEN 'no_merchant'
    WHEN n IS NULL THEN 'no_benefits' ELSE 'match' END AS outcome, COALESCE(n, 0) AS n_benefits,
  best AS best_id, CASE WHEN n > 0 THEN 'share_resolved' ELSE 'share_unmatched' END AS kind
FROM resolved r LEFT JOIN c ON c.ctx_id = r.ctx_id""",
    ),
    "headline_offers": _with(
        _HEADLINES,
        select="""SELECT line_no, type, value, confidence_score, confidence_reason, valid_until_ms, channel,
  requires_voucher FROM read WHERE type IS NOT NULL""",
    ),
    "headline_skipped": _with(
        _HEADLINES,
        select="""SELECT line_no, merchant_name, headline, 'no numeric benefit value stated' AS reason
FROM read WHERE type IS NULL""",
    ),
    "headline_report": _with(
        _HEADLINES,
        select="""SELECT type, channel, count(*) AS n, CAST(round(avg(value), 6) AS DOUBLE) AS mean_value,
  strftime(max(make_timestamp(valid_until_ms * 1000)), '%Y-%m-%dT%H:%M:%S.000Z') AS latest_end
FROM read WHERE type IS NOT NULL GROUP BY ALL""",
    ),
    "page_text": _with(
        _PAGES, select="SELECT page_id, md5(text) AS text_md5, CAST(tc AS INT) AS chars FROM m"
    ),
    "page_quality": _with(
        _PAGES,
        select="""SELECT page_id, CAST(hc AS INT) AS html_chars, CAST(tc AS INT) AS text_chars,
  CAST(round(tc / hc, 9) AS DOUBLE) AS text_ratio, CAST(terms AS INT) AS offer_terms FROM m""",
    ),
    "page_diagnosis": _with(
        _PAGES,
        select="""SELECT page_id, CASE
  WHEN tc < 800 THEN 'only ' || CAST(tc AS VARCHAR) || ' chars of text — likely JS-rendered or an error page'
  WHEN hc > 200000 AND tc / hc < 0.01 AND tc < 5000 THEN CAST(hc AS VARCHAR) || ' chars of HTML but only '
    || CAST(tc AS VARCHAR) || ' of text — a client-rendered shell'
  WHEN terms < 3 THEN 'no offer vocabulary in ' || CAST(tc AS VARCHAR)
    || ' chars — wrong page for this program' END AS problem FROM m""",
    ),
    "page_accepted": _with(
        _PAGES,
        """c AS (SELECT page_id, text AS t FROM m
  WHERE tc >= 800 AND NOT (hc > 200000 AND tc / hc < 0.01 AND tc < 5000) AND terms >= 3)""",
        select="SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS chars FROM c",
    ),
    "json_ld": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html,
    '(?s)<title>(.*?)</title>', 1), '["\\&]', ' ', 'g')) AS name, 'site ' || url AS seller
  FROM pages)
SELECT page_id, concat_ws(' · ', CASE WHEN length(name) BETWEEN 3 AND 399
    AND NOT regexp_matches(name, '^(https?:|/|#|\{)') THEN name END,
  CASE WHEN length(seller) >= 3 AND seller <> name AND NOT regexp_matches(seller, '^(https?:|/|#|\{)')
    THEN seller END) AS text FROM t""",
    "page_decoded": """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'windows-1252' ELSE 'utf-8' END AS charset,
  md5(CASE WHEN page_id % 3 = 2 THEN '<meta charset="windows-1252">'
    || regexp_replace(html, '[^\\x00-\\x7f]', 'e', 'g') ELSE html END) AS html_md5
FROM pages""",
    "entity_text": """SELECT doc_id, md5(replace(text, ' ', ' ')) AS text_md5 FROM documents""",
    "offer_page_text": _with(
        duckdb_cte(["fx_collected"]),
        """t AS (SELECT line_no, concat_ws(chr(10) || chr(10),
    CASE WHEN line_no % 3 <> 0 THEN 'בית העסק: ' || category END,
    CASE WHEN line_no % 4 = 1 THEN 'כותרת ההטבה: ' || offer_url END,
    CASE WHEN line_no % 2 = 0 THEN 'חשוב לדעת:' || chr(10) || terms_text END,
    CASE WHEN line_no % 2 = 0 THEN 'about:' || chr(10) || category END,
    'טקסט מלא של העמוד:' || chr(10) || terms_text) AS page_text FROM fx_collected)""",
        select="SELECT line_no, md5(page_text) AS text_md5, CAST(length(page_text) AS INT) AS chars FROM t",
    ),
    "mint_programs": _with(
        duckdb_cte(["fx_list_title", "fx_program"]),
        r"""n AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(slug, '([a-z0-9])([A-Z])',
    '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) AS id FROM fx_list_title
  WHERE lower(slug) NOT IN ('happy-hour', 'behatsdaa')),
f AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM fx_program)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)""",
        select="""SELECT id, title AS name, CASE id WHEN 'tau' THEN 'employer_club' WHEN 'yours_club'
    THEN 'retail_club' WHEN 'my_max' THEN 'credit_card' WHEN 'fly_card' THEN 'credit_card'
    ELSE CASE WHEN title LIKE 'מורים%' THEN 'employer_club' ELSE 'retail_club' END END AS category,
  'https://easy.co.il/list/' || slug AS catalog_url,
  'הטבות ' || title || ' — כפי שמופיעות באיזי' AS hint,
  CASE WHEN slug = 'My-MAX' THEN 'max' END AS parent_id,
  id IN ('tau', 'yours_club', 'my_max', 'fly_card') OR title LIKE 'מורים%' AS sure FROM f""",
    ),
    "program_class": _with(
        duckdb_cte(["fx_list_title"]),
        select="""SELECT seq, CASE WHEN slug IN ('My-MAX', 'Fly-Card') THEN 'credit_card'
    WHEN slug = 'TAU' OR title LIKE 'מורים%' THEN 'employer_club' ELSE 'retail_club' END AS category,
  slug IN ('My-MAX', 'Fly-Card', 'TAU', 'Yours-Club') OR title LIKE 'מורים%' AS sure
FROM fx_list_title""",
    ),
}
