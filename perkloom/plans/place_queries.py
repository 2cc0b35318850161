"""Queries about places, positions and fences, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import spherefn, timefn
from perkloom.operators import enrich, fences, geo, nearest, openings, rank, spacing
from perkloom.plans import benefit_queries as bq
from perkloom.plans.domain import Domain
from perkloom.plans.fixture_views import duckdb_cte
from perkloom.session import written

ROUNDING = 3  # millimetres


def _m(column: str = "distance_m"):
    return F.round(column, ROUNDING).alias(column)


def haversine_pairs(spark, sf_dir):
    d = Domain(spark, sf_dir)
    hop = d.positions.alias("p").join(
        d.raw("fx_venue").select(
            F.substring("id", 2, 9).cast("bigint").alias("home"),
            F.col("lat").cast("double").alias("v_lat"), F.col("lng").cast("double").alias("v_lng"),
        ),
        F.col("user_id") % 10 == F.col("home"),
    )
    distance = spherefn.haversine_m(F.col("lat"), F.col("lng"), F.col("v_lat"), F.col("v_lng"))
    return hop.select("pos_id", distance.alias("distance_m")).select("pos_id", _m())


def venues_containing(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return geo.venues_containing(d.positions, d.venues, "pos_id").select(
        "pos_id", "venue_id", _m(), "position"
    )


def merchants_near(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return geo.merchants_near(d.positions, d.branches, d.merchants, 1_500.0, "pos_id").select(
        "pos_id", "merchant_id", _m(), "position"
    )


def benefits_near(spark, sf_dir):
    d = Domain(spark, sf_dir)
    found = geo.benefit_counts_near(d.positions, d.branches, d.benefits, "pos_id")
    return found.select("pos_id", "n", "first_id")


def _at_venues(d: Domain):
    places = geo.venue_merchants(d.venues, d.venue_members, d.branches)
    return geo.benefits_at(places, d.benefits, ["venue_id"])


def benefits_at_venue(spark, sf_dir):
    return _at_venues(Domain(spark, sf_dir)).select("venue_id", "merchant_id", "benefit_id")


def venue_counts(spark, sf_dir):
    d = Domain(spark, sf_dir)
    usable = rank.candidates(d.contexts, d.owned, d.benefits, muted=d.muted)
    return geo.venue_counts(usable, geo.venue_merchants(d.venues, d.venue_members, d.branches), ["user_id"])


def nearest_fences(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return nearest.nearest_fences(
        d.positions, d.venues, d.merchants, d.branches, "pos_id"
    ).select("pos_id", "fence_id", "radius_m", _m(), "position")


def fences_to_monitor(spark, sf_dir):
    """Last known position per user; every seventh user has none."""
    d = Domain(spark, sf_dir)
    last = d.positions.groupBy("user_id").agg(
        F.max_by(F.struct("lat", "lng"), F.col("pos_id")).alias("at")
    )
    known = F.col("user_id") % 7 != 0
    positions = last.select(
        "user_id", F.when(known, F.col("at.lat")).alias("lat"), F.when(known, F.col("at.lng")).alias("lng")
    )
    return nearest.fences_to_monitor(positions, d.venues, d.merchants, d.branches, "user_id")


def fence_place(spark, sf_dir):
    """What each fence named in the event log refers to."""
    d = Domain(spark, sf_dir)
    ids = d.fence_events.select(
        F.when(F.col("user_id") % 2 == 0, F.col("fence_id"))
        .otherwise(F.concat(F.lit("shop:s"), F.col("user_id").cast("string")))
        .alias("fence_id")
    ).distinct()
    places = geo.fence_places(ids, d.merchants, d.venues, d.venue_members, d.branches)
    return geo.benefits_at(places, d.benefits, ["fence_id"]).select(
        "fence_id", "place_name", "benefit_id"
    )


def fence_refresh(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return fences.fence_refreshes(d.positions).select("pos_id", "user_id", "refresh")


def notify_fold(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return fences.visit_decisions(d.fence_events).select(
        "event_id", "user_id", "fence_id", "decision"
    )


def places_of(d: Domain):
    """(fence_id, merchant_id) of the venues."""
    inside = geo.venue_merchants(d.venues, d.venue_members, d.branches)
    return inside.withColumnRenamed("venue_id", "fence_id")


def _entering(d: Domain):
    """Fence events with the number of benefits usable at the place."""
    events = d.fence_events.drop("match_count")
    rows = openings.match_rows(events, places_of(d), d.owned, d.muted, d.benefits)
    counts = rows.groupBy("event_id").agg(F.sum("match_count").alias("match_count"))
    return events.join(counts, "event_id", "left").withColumn(
        "match_count", F.coalesce("match_count", F.lit(0).cast("bigint"))
    )


def enter_decisions(spark, sf_dir):
    """Enter events decided by what the place offers the user at that time."""
    events = _entering(Domain(spark, sf_dir))
    return fences.visit_decisions(events).select("event_id", "user_id", "fence_id", "match_count", "decision")


def enter_messages(spark, sf_dir):
    d = Domain(spark, sf_dir)
    decided = fences.visit_decisions(_entering(d)).where(F.col("decision") == fences.NOTIFY)
    notified = written(decided.select("event_id", "user_id", "fence_id", "ts", "decision"), "notified")
    matches = openings.best_matches(notified, places_of(d), d.owned, d.muted, d.benefits, V.NOTIFY_TOP)
    return fences.enter_messages(notified, matches, d.venues, d.programs)


def dwell_clock(spark, sf_dir):
    """Minutes inside at each event, were the user's previous event an entry."""
    d = Domain(spark, sf_dir)
    visits = d.interactions.groupBy("user_id").agg(
        F.min("ts").alias("entered"), F.max("ts").alias("now")
    )
    entered = F.when(F.col("user_id") % 5 != 0, F.col("entered"))
    return visits.select(
        "user_id", timefn.dwell_minutes(entered, F.col("now")).cast("bigint").alias("minutes"),
        timefn.verified_label(F.col("entered"), F.col("now")).alias("label"),
    )


def venue_notification(spark, sf_dir):
    d = Domain(spark, sf_dir)
    top = rank.rank(rank.candidates(d.contexts, d.owned, d.benefits, muted=d.muted))
    named = top.withColumn("place_name", F.concat(F.lit("mall of "), F.col("merchant_id")))
    return fences.notifications(named, d.programs, ["ctx_id"])


def branch_dedupe(spark, sf_dir):
    d = Domain(spark, sf_dir)
    points = d.candidates.select(
        F.concat(F.lit("m"), (F.col("seq") % 97).cast("string")).alias("merchant_id"),
        "seq", "lat", "lng",
    )
    return spacing.keep_spaced(points, "merchant_id").select("merchant_id", "seq")


def attach_branches(spark, sf_dir):
    d = Domain(spark, sf_dir)
    out = enrich.attach_branches(d.merchants, d.branches, d.candidates)
    return out.select("merchant_id", "branch_no", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def venue_proposals(spark, sf_dir):
    d = Domain(spark, sf_dir)
    gains, _ = enrich.venue_proposals(d.candidates, d.merchants, d.venue_members, d.venues)
    return gains.select("merchant_id", "venue_id", "evidence")


def unknown_in_venue(spark, sf_dir):
    d = Domain(spark, sf_dir)
    _, unknown = enrich.venue_proposals(d.candidates, d.merchants, d.venue_members, d.venues)
    return unknown


def _minted(d: Domain):
    approved = d.raw("fx_candidate").select(
        "seq", F.lit("unmapped_x").alias("merchant_id"),
        F.concat(F.lit("Stranger "), (F.col("seq") % 1500).cast("string")).alias("merchant_name"),
    )
    return enrich.mint_merchants(approved, d.merchants, d.candidates, d.venues)


def mint_merchants(spark, sf_dir):
    minted, _ = _minted(Domain(spark, sf_dir))
    return minted.select("id", "name", F.array_join("categories", ",").alias("categories"))


def mint_merchant_venues(spark, sf_dir):
    _, inside = _minted(Domain(spark, sf_dir))
    return inside


def category_rules(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return d.candidates.select(
        "seq", enrich.category_of(F.col("easy_category")).alias("category")
    )


QUERIES = {
    "haversine_pairs": haversine_pairs,
    "venues_containing": venues_containing,
    "merchants_near": merchants_near,
    "benefits_near": benefits_near,
    "benefits_at_venue": benefits_at_venue,
    "venue_counts": venue_counts,
    "nearest_fences": nearest_fences,
    "fences_to_monitor": fences_to_monitor,
    "fence_place": fence_place,
    "fence_refresh": fence_refresh,
    "notify_fold": notify_fold,
    "enter_decisions": enter_decisions,
    "enter_messages": enter_messages,
    "dwell_clock": dwell_clock,
    "venue_notification": venue_notification,
    "branch_dedupe": branch_dedupe,
    "attach_branches": attach_branches,
    "venue_proposals": venue_proposals,
    "unknown_in_venue": unknown_in_venue,
    "mint_merchants": mint_merchants,
    "mint_merchant_venues": mint_merchant_venues,
    "category_rules": category_rules,
}


# --- SQL twins ---------------------------------------------------------------
def meters(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a, b = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lng2} - {lng1}) / 2)"
    return (
        f"(2 * 6371000.0 * asin(least(1.0, sqrt({a} * {a} + {b} * {b} * cos(radians({lat1}))"
        f" * cos(radians({lat2}))))))"
    )


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


_GEO = duckdb_cte(["fx_position", "fx_venue", "fx_branch", "fx_merchant", "fx_venue_member"])
_D = f"CAST(round(d, {ROUNDING}) AS DOUBLE) AS distance_m"
_PV = f"""pv AS (SELECT p.pos_id, v.id AS venue_id, v.seq, v.radius_m,
  {meters('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS d FROM fx_position p, fx_venue v)"""
_PB = f"""pb AS (SELECT p.pos_id, b.merchant_id, min({meters('p.lat', 'p.lng', 'b.lat', 'b.lng')}) AS d
  FROM fx_position p, fx_branch b GROUP BY ALL)"""
_VM = f"""vm AS (SELECT venue_id, merchant_id FROM fx_venue_member
  UNION SELECT v.id, b.merchant_id FROM fx_venue v, fx_branch b
  WHERE {meters('b.lat', 'b.lng', 'v.lat', 'v.lng')} <= v.radius_m)"""
_SITES = """sites AS (SELECT id AS fence_id, 0 AS kind, seq, 0 AS branch_no, lat, lng,
    CAST(radius_m AS INT) AS radius_m FROM fx_venue
  UNION ALL SELECT 'shop:' || b.merchant_id, 1, m.seq, b.branch_no, b.lat, b.lng, 150
  FROM fx_branch b JOIN fx_merchant m ON m.id = b.merchant_id)"""


def _nearest(points: str, key: str, k: int) -> str:
    return f"""sd AS (SELECT p.{key}, s.fence_id, s.kind, s.seq, s.radius_m,
    min({meters('p.lat', 'p.lng', 's.lat', 's.lng')}) AS d
  FROM {points} p, sites s GROUP BY ALL),
nf AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, kind, seq) AS position FROM sd
  QUALIFY position <= {k})"""


_CAND = duckdb_cte(["fx_candidate"])
_KEY = r"regexp_replace(lower(name), '[\s''\"׳״־-]+', '', 'g')"
_HITS = f"""hits AS (SELECT c.*, v.id AS venue_id, {_KEY.replace('name', 'c.name')} AS key,
  floor({meters('c.lat', 'c.lng', 'v.lat', 'v.lng')} + 0.5) AS m
  FROM fx_candidate c, fx_venue v
  WHERE {meters('c.lat', 'c.lng', 'v.lat', 'v.lng')} <= v.radius_m),
known AS (SELECT {_KEY} AS key, max_by(id, seq) AS merchant_id FROM fx_merchant GROUP BY ALL)"""


def _spaced(points: str, key: str) -> str:
    """Fold each group's points in order, keeping the list of points kept."""
    near = meters("q.lat", "q.lng", "n.lat", "n.lng")
    return f"""pts AS ({points}),
num AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM pts
  WHERE lat IS NOT NULL),
walk AS (
  SELECT {key}, rn, [{{'seq': seq, 'lat': lat, 'lng': lng}}] AS kept FROM num WHERE rn = 1
  UNION ALL
  SELECT n.{key}, n.rn, CASE WHEN len(list_filter(w.kept, lambda q: {near} < 50)) > 0 THEN w.kept
      ELSE list_append(w.kept, {{'seq': n.seq, 'lat': n.lat, 'lng': n.lng}}) END
  FROM walk w JOIN num n ON n.{key} = w.{key} AND n.rn = w.rn + 1),
spaced AS (SELECT {key}, unnest(kept) AS k FROM walk
  QUALIFY rn = max(rn) OVER (PARTITION BY {key}))"""


_RULES = """CASE easy_category WHEN 'בית קפה' THEN 'dining' WHEN 'תחנת דלק' THEN 'fuel'
  WHEN 'חנות ספרים' THEN 'books' END"""
_MINT = f"""src AS (SELECT {_KEY} AS key, min_by({{'easy_id': easy_id, 'easy_category': easy_category,
    'lat': lat, 'lng': lng}}, seq) AS c FROM fx_candidate GROUP BY ALL),
wanted AS (SELECT 'stranger' || CAST(seq % 1500 AS VARCHAR) AS key, min(seq) AS seq,
    'Stranger ' || CAST(seq % 1500 AS VARCHAR) AS name FROM fx_candidate GROUP BY ALL),
minted AS (SELECT w.seq, w.name, c.easy_category AS easy_category, c.lat AS lat, c.lng AS lng,
    'easy_' || c.easy_id || repeat('_x', CAST(row_number() OVER (PARTITION BY c.easy_id ORDER BY w.seq)
      - 1 AS INT)) AS id
  FROM wanted w JOIN src USING (key) WHERE c.lat IS NOT NULL)"""
_BENEFIT = duckdb_cte(["fx_benefit"])
_CART = duckdb_cte(["fx_program", "fx_owned", "fx_benefit", "fx_context", "fx_muted"])
_PLACES = duckdb_cte(["fx_venue", "fx_branch", "fx_venue_member"])

_WALK = """num AS (SELECT *, epoch_ms(ts) AS at_ms,
    timezone('Asia/Jerusalem', timezone('UTC', ts)) AS here,
    row_number() OVER (PARTITION BY user_id, fence_id ORDER BY ts, event_id) AS rn FROM fx_fence_event),
timed AS (SELECT *, hour(here) >= 22 OR hour(here) < 8 AS quiet FROM num),
walk AS (
  SELECT user_id, fence_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id,
    CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS decision,
    CAST(NULL AS BIGINT) AS entered, CAST(NULL AS BIGINT) AS notified
  FROM num WHERE rn = 1
  UNION ALL
  SELECT user_id, fence_id, rn, event_id, kind, decision,
    CASE WHEN kind = 'enter' THEN inside END,
    CASE WHEN decision = 'notify' THEN at_ms ELSE notified END
  FROM (SELECT *, CASE WHEN kind = 'exit' THEN NULL WHEN match_count <= 0 THEN 'nothing_to_show'
        WHEN at_ms - inside < 180000 THEN 'dwell_too_short'
        WHEN at_ms - notified < 43200000 THEN 'cooldown'
        WHEN quiet THEN 'quiet_hours' ELSE 'notify' END AS decision
    FROM (SELECT n.user_id, n.fence_id, n.rn, n.event_id, n.kind, n.match_count, n.at_ms, n.quiet,
        w.notified, COALESCE(w.entered, n.at_ms) AS inside
      FROM walk w JOIN timed n ON n.user_id = w.user_id AND n.fence_id = w.fence_id
        AND n.rn = w.rn + 1) q1) q2)"""
_LINES = """lines AS (SELECT r.*, CASE type
      WHEN 'percent' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '% הנחה'
      WHEN 'cashback' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '% זיכוי'
      WHEN 'fixed' THEN '₪' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' הנחה'
      WHEN 'gift_card' THEN '₪' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' מתנה'
      ELSE '1+1' END || ' ב' || r.merchant_id || ' (' || COALESCE(p.name, r.program_id) || ')' AS line
  FROM ranked r LEFT JOIN fx_program p ON p.id = r.program_id)"""
_ENTERING = (
    _CART, duckdb_cte(["fx_venue", "fx_branch", "fx_venue_member", "fx_fence_event"]), bq._OWNED, _VM,
    f"""p0 AS (SELECT {bq._PAIR_COLUMNS}, c.fence_id, TRUE AS is_owned, m.benefit_id IS NOT NULL AS is_muted
  FROM (SELECT event_id AS ctx_id, user_id, fence_id, epoch(ts) AS now_s, vm.merchant_id,
      CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS DOUBLE) AS cart_amount
    FROM fx_fence_event e JOIN vm ON vm.venue_id = e.fence_id WHERE kind = 'enter') c
  JOIN owned o ON o.user_id = c.user_id
  JOIN fx_benefit b ON b.program_id = o.program_id AND b.merchant_id = c.merchant_id
  LEFT JOIN (SELECT DISTINCT user_id, benefit_id FROM fx_muted) m
    ON m.user_id = c.user_id AND m.benefit_id = b.id)""",
    bq.EVAL, bq.RANKED,
    """entering AS (SELECT e.* EXCLUDE (match_count), coalesce(n, 0) AS match_count
  FROM fx_fence_event e LEFT JOIN (SELECT ctx_id, count(*) AS n FROM ranked GROUP BY ALL) r
    ON r.ctx_id = e.event_id)""",
    _WALK.replace("FROM fx_fence_event)", "FROM entering)"),
)

ORACLE = {
    "haversine_pairs": _with(
        _GEO,
        select=f"""SELECT pos_id, {_D} FROM (SELECT p.pos_id,
  {meters('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS d
  FROM fx_position p JOIN fx_venue v ON v.id = 'v' || CAST(p.user_id % 10 AS VARCHAR)) q""",
    ),
    "venues_containing": _with(
        _GEO, _PV,
        select=f"""SELECT pos_id, venue_id, {_D},
  row_number() OVER (PARTITION BY pos_id ORDER BY d, seq) AS position FROM pv WHERE d <= radius_m""",
    ),
    "merchants_near": _with(
        _GEO, _PB,
        select=f"""SELECT pos_id, merchant_id, {_D},
  row_number() OVER (PARTITION BY pos_id ORDER BY d, m.seq) AS position
FROM pb JOIN fx_merchant m ON m.id = pb.merchant_id WHERE d <= 1500""",
    ),
    "benefits_near": _with(
        _GEO, _BENEFIT, _PB,
        select="""SELECT pos_id, count(*) AS n, min(b.id) AS first_id
FROM pb JOIN fx_benefit b USING (merchant_id) WHERE d <= 500 GROUP BY ALL""",
    ),
    "benefits_at_venue": _with(
        _PLACES, _BENEFIT, _VM,
        select="""SELECT venue_id, merchant_id, b.id AS benefit_id
FROM vm JOIN fx_benefit b USING (merchant_id)""",
    ),
    "venue_counts": _with(
        _CART, _PLACES, bq._OWNED, bq.at_merchant(False), bq.EVAL, _VM,
        select="""SELECT user_id, venue_id, count(DISTINCT benefit_id) AS here,
  count(DISTINCT CASE WHEN n_actions = 0 THEN benefit_id END) AS ready_here
FROM ev JOIN vm USING (merchant_id) WHERE status <> 'blocked' GROUP BY ALL""",
    ),
    "nearest_fences": _with(
        _GEO, _SITES, _nearest("fx_position", "pos_id", 20),
        select=f"SELECT pos_id, fence_id, radius_m, {_D}, position FROM nf",
    ),
    "fences_to_monitor": _with(
        _GEO, _SITES,
        """last AS (SELECT user_id, max_by({'lat': lat, 'lng': lng}, pos_id) AS a FROM fx_position
  GROUP BY ALL),
lp AS (SELECT user_id, a.lat AS lat, a.lng AS lng FROM last WHERE user_id % 7 <> 0)""",
        _nearest("lp", "user_id", V.MAX_FENCES),
        select="""SELECT user_id, fence_id, radius_m FROM nf
UNION ALL SELECT user_id, v.id, CAST(v.radius_m AS INT) FROM last, fx_venue v WHERE user_id % 7 = 0""",
    ),
    "fence_place": _with(
        duckdb_cte(["fx_fence_event", "fx_merchant"]), _PLACES, _BENEFIT, _VM,
        """ids AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN fence_id
    ELSE 'shop:s' || CAST(user_id AS VARCHAR) END AS fence_id FROM fx_fence_event)""",
        select="""SELECT i.fence_id, m.name AS place_name, b.id AS benefit_id
FROM ids i JOIN fx_merchant m ON i.fence_id = 'shop:' || m.id JOIN fx_benefit b ON b.merchant_id = m.id
UNION ALL
SELECT i.fence_id, v.name, b.id FROM ids i JOIN fx_venue v ON v.id = i.fence_id
JOIN vm ON vm.venue_id = v.id JOIN fx_benefit b ON b.merchant_id = vm.merchant_id""",
    ),
    "fence_refresh": _with(
        _GEO,
        "num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, pos_id) AS rn "
        "FROM fx_position)",
        f"""walk AS (SELECT user_id, rn, pos_id, lat AS o_lat, lng AS o_lng, TRUE AS refresh
  FROM num WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, pos_id, CASE WHEN far THEN lat ELSE o_lat END,
    CASE WHEN far THEN lng ELSE o_lng END, far
  FROM (SELECT n.user_id, n.rn, n.pos_id, n.lat, n.lng, w.o_lat, w.o_lng,
      {meters('w.o_lat', 'w.o_lng', 'n.lat', 'n.lng')} >= 5000 AS far
    FROM walk w JOIN num n ON n.user_id = w.user_id AND n.rn = w.rn + 1) q)""",
        select="SELECT pos_id, user_id, refresh FROM walk",
    ),
    "notify_fold": _with(
        duckdb_cte(["fx_fence_event"]), _WALK,
        select="SELECT event_id, user_id, fence_id, decision FROM walk WHERE kind = 'enter'",
    ),
    "enter_decisions": _with(
        *_ENTERING,
        select="""SELECT w.event_id, w.user_id, w.fence_id, e.match_count, decision
FROM walk w JOIN entering e USING (event_id) WHERE w.kind = 'enter'""",
    ),
    "enter_messages": _with(
        *_ENTERING, _LINES,
        """told AS (SELECT l.* FROM lines l JOIN walk w ON w.event_id = l.ctx_id
  WHERE w.decision = 'notify' AND position <= 5)""",
        select="""SELECT ctx_id AS event_id, 'אתה ב' || any_value(v.name) || '?' AS title,
  concat_ws(' • ', max(line) FILTER (position = 1), max(line) FILTER (position = 2))
    || CASE WHEN count(*) > 2 THEN ' ועוד ' || CAST(count(*) - 2 AS VARCHAR) ELSE '' END AS body
FROM told JOIN fx_venue v ON v.id = told.fence_id GROUP BY ctx_id""",
    ),
    "dwell_clock": _with(
        duckdb_cte(["fx_interaction"]),
        """v AS (SELECT user_id, epoch_ms(min(ts)) AS entered, epoch_ms(max(ts)) AS now
  FROM fx_interaction GROUP BY ALL),
w AS (SELECT *, CAST(floor((now - entered) / 86400000.0) AS BIGINT) AS days FROM v)""",
        select="""SELECT user_id,
  CASE WHEN user_id % 5 <> 0 THEN CAST(floor((now - entered) / 60000.0) AS BIGINT) END AS minutes,
  CASE WHEN days <= 0 THEN 'אומת היום' WHEN days = 1 THEN 'אומת אתמול'
    ELSE 'אומת לפני ' || CAST(days AS VARCHAR) || ' ימים' END AS label FROM w""",
    ),
    "venue_notification": _with(
        _CART, bq._OWNED, bq.at_merchant(False), bq.EVAL, bq.RANKED,
        _LINES,
        select="""SELECT ctx_id, 'אתה בmall of ' || any_value(merchant_id) || '?' AS title,
  concat_ws(' • ', max(line) FILTER (position = 1), max(line) FILTER (position = 2))
    || CASE WHEN count(*) > 2 THEN ' ועוד ' || CAST(least(count(*), 5) - 2 AS VARCHAR) ELSE '' END AS body
FROM lines GROUP BY ctx_id""",
    ),
    "branch_dedupe": _with(
        _CAND,
        _spaced(
            "SELECT 'm' || CAST(seq % 97 AS VARCHAR) AS merchant_id, seq, lat, lng FROM fx_candidate",
            "merchant_id",
        ),
        select="SELECT merchant_id, k.seq AS seq FROM spaced",
    ),
    "attach_branches": _with(
        _CAND, _GEO,
        f"known AS (SELECT {_KEY} AS key, max_by(id, seq) AS merchant_id FROM fx_merchant GROUP BY ALL)",
        _spaced(
            f"SELECT k.merchant_id, c.seq, c.lat, c.lng FROM fx_candidate c "
            f"JOIN known k ON k.key = {_KEY.replace('name', 'c.name')}",
            "merchant_id",
        ),
        select="""SELECT merchant_id, k.seq AS branch_no, CAST(round(k.lat, 6) AS DOUBLE) AS lat,
  CAST(round(k.lng, 6) AS DOUBLE) AS lng FROM spaced
UNION ALL SELECT merchant_id, branch_no, CAST(round(CAST(lat AS DOUBLE), 6) AS DOUBLE),
  CAST(round(CAST(lng AS DOUBLE), 6) AS DOUBLE)
FROM fx_branch WHERE merchant_id NOT IN (SELECT merchant_id FROM spaced)""",
    ),
    "venue_proposals": _with(
        _CAND, _GEO, _HITS,
        select="""SELECT merchant_id, venue_id, min_by(venue_id || ': ' || address || ' — '
  || CAST(CAST(m AS BIGINT) AS VARCHAR) || 'm from centroid', seq) AS evidence
FROM hits JOIN known USING (key)
WHERE (merchant_id, venue_id) NOT IN (SELECT (merchant_id, venue_id) FROM fx_venue_member)
GROUP BY ALL""",
    ),
    "unknown_in_venue": _with(
        _CAND, _GEO, _HITS,
        select="""SELECT seq, name, venue_id, easy_category, address FROM hits
WHERE key NOT IN (SELECT key FROM known)""",
    ),
    "mint_merchants": _with(
        _CAND, _MINT,
        select=f"SELECT id, name, COALESCE({_RULES}, '') AS categories FROM minted",
    ),
    "mint_merchant_venues": _with(
        _CAND, duckdb_cte(["fx_venue"]), _MINT,
        select=f"""SELECT m.id AS merchant_id, v.id AS venue_id FROM minted m, fx_venue v
WHERE {meters('m.lat', 'm.lng', 'v.lat', 'v.lng')} <= v.radius_m""",
    ),
    "category_rules": _with(_CAND, select=f"SELECT seq, {_RULES} AS category FROM fx_candidate"),
}
