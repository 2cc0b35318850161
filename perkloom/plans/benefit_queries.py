"""Queries about benefits, carts and users, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import money
from perkloom.operators import combos, conditions, kpi, ownership, rank
from perkloom.plans.domain import Domain
from perkloom.plans.fixture_views import duckdb_cte

TOP_PER_CART = 3
COMBOS_LISTED = 10


def _opened_catalog(d: Domain) -> DataFrame:
    """The catalog, sorted to meet the benefits opened: it is made of a few short rows, so its size is
    taken for far too small before it runs and every task would be sent the whole of it."""
    return rank.catalog_side(d.benefits).hint("merge")


def _viewed_pairs(d: Domain) -> DataFrame:
    """Every benefit opened from a cart, with ownership and mute flags."""
    # What a user holds and has muted comes with the cart, so pairs are not shuffled for it.
    held = d.owned.groupBy("user_id").agg(F.collect_set("program_id").alias("_held"))
    silent = d.muted.groupBy("user_id").agg(F.collect_set("benefit_id").alias("_muted"))
    carts = d.contexts.withColumnRenamed("merchant_id", "ctx_merchant").join(
        held.join(silent, "user_id", "full"), "user_id", "left"
    )
    pairs = d.viewed.join(carts, "ctx_id").join(_opened_catalog(d), "benefit_id")
    return pairs.withColumns({
        "owned": F.coalesce(F.array_contains("_held", F.col("program_id")), F.lit(False)),
        "muted": F.coalesce(F.array_contains("_muted", F.col("benefit_id")), F.lit(False)),
    }).drop("_held", "_muted")


def _codes(column: str):
    return F.array_join(F.transform(column, lambda n: n.code), ",").alias(column)


def eval_status(spark, sf_dir):
    d = Domain(spark, sf_dir)
    out = conditions.explain(conditions.verdict(_viewed_pairs(d)))
    return out.select(
        "ctx_id", "benefit_id", "status", _codes("blockers"), _codes("requirements"),
        "saving", "is_estimate", "age_days",
    )


def eval_gates(spark, sf_dir):
    d = Domain(spark, sf_dir)
    out = conditions.gate_counts(conditions.explain(_viewed_pairs(d)))
    gate = F.transform("gates", lambda g: F.concat_ws(":", g.code, g.state, g.label))
    return out.select(
        "ctx_id", "benefit_id", F.array_join(gate, "|").alias("gates"),
        F.array_join(F.transform("actions_required", lambda g: g.code), ",").alias("actions"),
        "summary", "n_gates", "n_blocked", "n_pending_actions", "n_met",
    )


def condition_lines(spark, sf_dir):
    d = Domain(spark, sf_dir)
    lines = conditions.condition_lines(
        conditions.explain(_viewed_pairs(d)), ["ctx_id", "benefit_id"]
    )
    return lines.select("ctx_id", "benefit_id", "line_no", "tone", "code")


def saving_estimate(spark, sf_dir):
    d = Domain(spark, sf_dir)
    pairs = d.viewed.join(d.contexts.drop("merchant_id"), "ctx_id").join(_opened_catalog(d), "benefit_id")
    type_, value, cart = F.col("type"), F.col("value"), F.col("cart_amount")
    spend, cap = F.col("conditions.min_spend"), F.col("conditions.max_discount")
    return pairs.select(
        "ctx_id", "benefit_id",
        money.saving_estimate(type_, value, spend, cap, cart).alias("saving"),
        money.saving_is_estimate(type_, cart).alias("is_estimate"),
        money.headline(type_, value).alias("headline"),
    )


def owned_closure(spark, sf_dir):
    return Domain(spark, sf_dir).owned


def owned_deep_closure(spark, sf_dir):
    """Chains of fifty programs, every fourth of which ends in a cycle."""
    d = Domain(spark, sf_dir)
    return ownership.owned_programs(d.raw("fx_deep_owned"), d.raw("fx_deep_program"))


def offered_programs(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ownership.offered_programs(d.programs, d.benefits).select(
        "section", "category", "id", "name"
    )


def profile_from_toggles(spark, sf_dir):
    d = Domain(spark, sf_dir)
    taps = d.table("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("program_id"),
    )
    return ownership.toggled(taps, ["user_id", "program_id"])


def _ranked(d: Domain, limit: int) -> DataFrame:
    return rank.top_benefits(d.contexts, d.owned, d.muted, d.benefits, limit)


def top_benefits_per_cart(spark, sf_dir):
    d = Domain(spark, sf_dir)
    top = conditions.explain(_ranked(d, TOP_PER_CART))
    return top.select(
        "ctx_id", "position", "benefit_id", "merchant_id", "program_id", "status", "saving",
        "is_estimate", "age_days",
        F.array_join(F.transform("actions_required", lambda g: g.code), ",").alias("actions"),
    )


def ready_split(spark, sf_dir):
    d = Domain(spark, sf_dir)
    ready, conditional = rank.split_ready(
        rank.candidates(d.contexts, d.owned, d.benefits, muted=d.muted)
    )
    count = lambda df, name: df.groupBy("ctx_id").agg(
        F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")
    )
    return count(ready, "ready").unionByName(count(conditional, "conditional"))


def _combos(d: Domain, limit: int) -> DataFrame:
    return combos.top_combos(d.contexts, d.owned, d.muted, d.benefits, limit)


def combo_list(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return _combos(d, COMBOS_LISTED).select(
        "ctx_id", "position", "first_id", "second_id", "merchant_name",
        F.round("combo_saving", 6).alias("saving"), "confirmed",
        F.size("caveats").cast("int").alias("n_caveats"),
    )


def combo_best(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return _combos(d, 2).select(
        "ctx_id", "position", "first_id", "second_id",
        F.round("combo_saving", 6).alias("saving"), "confirmed",
        F.array_join("caveats", "|").alias("caveats"),
    )


def kpi_by_user(spark, sf_dir):
    return kpi.kpis(Domain(spark, sf_dir).interactions, ["user_id"])


def kpi_target(spark, sf_dir):
    scored = kpi.against_target(kpi.kpis(Domain(spark, sf_dir).interactions, ["user_id"]))
    return scored.select(
        "user_id", "met", F.round("fill", 9).alias("fill"), "points_below"
    )


def recent_events(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return kpi.recent_events(d.interactions).select("user_id", "event_id", "kind")


def candidate_export(spark, sf_dir):
    d = Domain(spark, sf_dir)
    out = rank.describe(_ranked(d, 25), d.merchants, d.programs)
    return out.select(
        "ctx_id", "position", "benefit_id", "merchant", F.array_join("categories", ",").alias("categories"),
        "club", "offer", "estimated_saving_ils", "is_estimate", "ready_now", "terms",
        F.size("conditions").alias("n_conditions"),
    )


def answer_guard(spark, sf_dir):
    d = Domain(spark, sf_dir)
    sent = _ranked(d, 25).select("ctx_id", "benefit_id", "position")
    at = lambda n: F.max(F.when(F.col("position") == n, F.col("benefit_id")))
    answers = sent.groupBy("ctx_id").agg(at(1).alias("one"), at(2).alias("two")).select(
        "ctx_id",
        F.when(F.col("ctx_id") % 2 == 0, F.col("one")).otherwise(F.lit("b1")).alias("best_benefit_id"),
        F.when(F.col("ctx_id") % 3 == 0, F.col("one")).otherwise(F.col("two")).alias("runner_up_id"),
    )
    return rank.guard_answers(answers, sent)


QUERIES = {
    "top_benefits_per_cart": top_benefits_per_cart,
    "eval_status": eval_status,
    "eval_gates": eval_gates,
    "condition_lines": condition_lines,
    "saving_estimate": saving_estimate,
    "owned_closure": owned_closure,
    "owned_deep_closure": owned_deep_closure,
    "offered_programs": offered_programs,
    "profile_from_toggles": profile_from_toggles,
    "ready_split": ready_split,
    "combos": combo_list,
    "combo_best": combo_best,
    "kpi": kpi_by_user,
    "kpi_target": kpi_target,
    "recent_events": recent_events,
    "candidate_export": candidate_export,
    "answer_guard": answer_guard,
}

# --- SQL twins ---------------------------------------------------------------
_OWNED = """owned_x AS (
  SELECT DISTINCT o.user_id, unnest([o.program_id, p.parent_id]) AS program_id
  FROM fx_owned o LEFT JOIN fx_program p ON p.id = o.program_id),
owned AS (SELECT DISTINCT user_id, program_id FROM owned_x WHERE program_id IS NOT NULL)"""

_PAIR_COLUMNS = """c.ctx_id, c.user_id, c.now_s, c.channel AS c_channel, c.cart_amount,
  b.id AS benefit_id, b.seq, b.program_id, b.merchant_id, b.type, b.value, b.min_spend,
  b.max_discount, b.valid_days_csv, b.hours_from, b.hours_to, b.channel AS b_channel,
  b.stacks_with_club, b.exclusions_csv, b.usage_limit, b.requires_voucher, b.valid_from_s,
  b.valid_until_s, b.last_verified_s, b.confidence_score, b.reviewed_by_human"""

# Pairs of the carts with the benefits opened from them.
_VIEWED = f"""p0 AS (
  SELECT {_PAIR_COLUMNS}, o.program_id IS NOT NULL AS is_owned, m.benefit_id IS NOT NULL AS is_muted
  FROM fx_viewed v JOIN fx_context c ON c.ctx_id = v.ctx_id JOIN fx_benefit b ON b.id = v.benefit_id
  LEFT JOIN owned o ON o.user_id = c.user_id AND o.program_id = b.program_id
  LEFT JOIN (SELECT DISTINCT user_id, benefit_id FROM fx_muted) m
    ON m.user_id = c.user_id AND m.benefit_id = b.id)"""


def at_merchant(universal: bool) -> str:
    extra = " OR b.merchant_id = 'any_merchant'" if universal else ""
    return f"""p0 AS (
  SELECT {_PAIR_COLUMNS}, TRUE AS is_owned, m.benefit_id IS NOT NULL AS is_muted
  FROM fx_context c JOIN owned o ON o.user_id = c.user_id
  JOIN fx_benefit b ON b.program_id = o.program_id
    AND (b.merchant_id = c.merchant_id{extra})
  LEFT JOIN (SELECT DISTINCT user_id, benefit_id FROM fx_muted) m
    ON m.user_id = c.user_id AND m.benefit_id = b.id)"""


EVAL = """p1 AS (
  SELECT *, (now_s - last_verified_s) / 86400.0 AS age, (valid_until_s - now_s) / 86400.0 AS days_left,
    timezone('Asia/Jerusalem', to_timestamp(now_s)) AS local_at,
    CAST(substr(hours_from, 1, 2) AS INT) * 60 + CAST(substr(hours_from, 4, 2) AS INT) AS lo,
    CAST(substr(hours_to, 1, 2) AS INT) * 60 + CAST(substr(hours_to, 4, 2) AS INT) AS hi
  FROM p0),
p2 AS (
  SELECT *, hour(local_at) * 60 + minute(local_at) AS mins, dayofweek(local_at) + 1 AS wd FROM p1),
p3 AS (
  SELECT *,
    NOT is_owned AS b1, is_muted AS b2, confidence_score < 0.85 AND NOT reviewed_by_human AS b3,
    age IS NULL OR age > 45 AS b4, COALESCE(valid_from_s > now_s, FALSE) AS b5,
    COALESCE(valid_until_s < now_s, FALSE) AS b6,
    COALESCE(NOT list_contains(string_split(valid_days_csv, ','), CAST(wd AS VARCHAR)), FALSE) AS b7,
    COALESCE(NOT (lo = hi OR (lo < hi AND mins BETWEEN lo AND hi)
      OR (lo > hi AND (mins >= lo OR mins <= hi))), FALSE) AS b8,
    COALESCE(b_channel IN ('in_store', 'online') AND c_channel <> b_channel, FALSE) AS b9,
    COALESCE(min_spend > 0 AND cart_amount < min_spend, FALSE) AS b10,
    COALESCE(age > 14 AND age <= 45, FALSE) AS r1,
    COALESCE(valid_until_s >= now_s AND days_left <= 7, FALSE) AS r2,
    COALESCE(b_channel IN ('in_store', 'online') AND c_channel IS NULL, FALSE) AS r3,
    COALESCE(min_spend > 0 AND cart_amount IS NULL, FALSE) AS r4,
    max_discount IS NOT NULL AS r5, COALESCE(requires_voucher, FALSE) AS r6,
    exclusions_csv IS NOT NULL AS r7, COALESCE(NOT stacks_with_club, FALSE) AS r8,
    stacks_with_club IS NULL AS r9, usage_limit IS NOT NULL AS r10
  FROM p2),
ev AS (
  SELECT *,
    CASE WHEN b1 OR b2 OR b3 OR b4 OR b5 OR b6 OR b7 OR b8 OR b9 OR b10 THEN 'blocked'
      WHEN r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9 OR r10 THEN 'conditional'
      ELSE 'eligible' END AS status,
    CAST(r4 AS INT) + CAST(r6 AS INT) AS n_actions,
    floor(CASE WHEN type IN ('percent', 'cashback') THEN
          CASE WHEN max_discount IS NULL THEN basket * value / 100
            ELSE LEAST(basket * value / 100, max_discount) END
        WHEN type IN ('fixed', 'gift_card') THEN value
        WHEN type = 'bogo' THEN basket / 2 ELSE 0 END * 100 + 0.5) / 100 AS saving,
    CASE WHEN type IN ('fixed', 'gift_card') THEN FALSE WHEN type = 'bogo' THEN TRUE
      ELSE cart_amount IS NULL END AS is_estimate,
    COALESCE(CAST(floor(age) AS BIGINT), -1) AS age_days
  FROM (SELECT *, COALESCE(cart_amount, GREATEST(COALESCE(min_spend, 0), 250)) AS basket FROM p3) q)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY CASE WHEN n_actions > 0 THEN 1 ELSE 0 END,
    saving DESC, age_days, seq) AS position
  FROM ev WHERE status <> 'blocked')"""

_BLOCKER_CODES = """concat_ws(',', CASE WHEN b1 THEN 'program_not_owned' END,
  CASE WHEN b2 THEN 'muted' END, CASE WHEN b3 THEN 'low_confidence' END,
  CASE WHEN b4 THEN 'stale_data' END, CASE WHEN b5 THEN 'not_yet_valid' END,
  CASE WHEN b6 THEN 'expired' END, CASE WHEN b7 THEN 'wrong_day' END,
  CASE WHEN b8 THEN 'wrong_hours' END, CASE WHEN b9 THEN 'wrong_channel' END,
  CASE WHEN b10 THEN 'below_min_spend' END)"""
_REQUIREMENT_CODES = """concat_ws(',', CASE WHEN r1 THEN 'aging_data' END,
  CASE WHEN r2 THEN 'ends_soon' END, CASE WHEN r3 THEN 'channel_restricted' END,
  CASE WHEN r4 THEN 'min_spend_unknown' END, CASE WHEN r5 THEN 'max_discount_cap' END,
  CASE WHEN r6 THEN 'requires_voucher' END, CASE WHEN r7 THEN 'has_exclusions' END,
  CASE WHEN r8 THEN 'no_stacking' END, CASE WHEN r9 THEN 'stacking_unknown' END,
  CASE WHEN r10 THEN 'usage_limited' END)"""
_DAYS = """CASE valid_days_csv WHEN '1,2,3,4,5' THEN 'א׳-ה׳' WHEN '6,7' THEN 'ו׳, שבת'
  WHEN '1,3,5' THEN 'א׳, ג׳, ה׳' END"""
_UNTIL = "strftime(timezone('Asia/Jerusalem', to_timestamp(valid_until_s)), '%-d.%-m.%Y')"
_WHERE = "CASE b_channel WHEN 'online' THEN 'באונליין' ELSE 'בסניפים' END"
_SPEND = "'₪' || CAST(CAST(min_spend AS BIGINT) AS VARCHAR) || '+'"
_GATE_LISTS = {
    "blocked": f"""concat_ws('|', CASE WHEN b4 THEN 'freshness:blocked:לא אומת' END,
      CASE WHEN b5 THEN 'validity:blocked:טרם החל' END,
      CASE WHEN b6 THEN 'validity:blocked:פג תוקף' END,
      CASE WHEN b7 THEN 'day:blocked:' || {_DAYS} END,
      CASE WHEN b8 THEN 'hours:blocked:' || hours_from || '-' || hours_to END,
      CASE WHEN b9 THEN 'channel:blocked:' || {_WHERE} END,
      CASE WHEN b10 THEN 'min_spend:blocked:' || {_SPEND} END)""",
    "pending": f"""concat_ws('|', CASE WHEN r1 THEN 'freshness:pending:אימות ישן' END,
      CASE WHEN r2 THEN 'validity:pending:עד ' || {_UNTIL} END,
      CASE WHEN r3 THEN 'channel:pending:' || {_WHERE} END,
      CASE WHEN r4 THEN 'min_spend:pending:' || {_SPEND} END,
      CASE WHEN r5 THEN 'cap:pending:עד ₪' || CAST(CAST(max_discount AS BIGINT) AS VARCHAR) END,
      CASE WHEN r6 THEN 'voucher:pending:שובר מראש' END,
      CASE WHEN r7 THEN 'exclusions:pending:החרגות' END,
      CASE WHEN r8 THEN 'stacking:pending:ללא כפל' END,
      CASE WHEN r9 THEN 'stacking:pending:כפל?' END,
      CASE WHEN r10 THEN 'usage:pending:הגבלת שימוש' END)""",
    "met": f"""concat_ws('|', CASE WHEN NOT b4 AND NOT r1 THEN 'freshness:met:מאומת' END,
      CASE WHEN valid_until_s IS NOT NULL AND NOT b6 AND NOT r2 THEN 'validity:met:בתוקף' END,
      CASE WHEN valid_days_csv IS NOT NULL AND NOT b7 THEN 'day:met:' || {_DAYS} END,
      CASE WHEN hours_from IS NOT NULL AND NOT b8
        THEN 'hours:met:' || hours_from || '-' || hours_to END,
      CASE WHEN b_channel IN ('in_store', 'online') AND NOT b9 AND NOT r3
        THEN 'channel:met:' || {_WHERE} END,
      CASE WHEN min_spend > 0 AND NOT b10 AND NOT r4 THEN 'min_spend:met:' || {_SPEND} END,
      CASE WHEN stacks_with_club THEN 'stacking:met:כפל מותר' END)""",
}

_VIEW_CTES = duckdb_cte(["fx_program", "fx_owned", "fx_benefit", "fx_context", "fx_muted", "fx_viewed"])
_CART_CTES = duckdb_cte(["fx_program", "fx_owned", "fx_benefit", "fx_context", "fx_muted"])
_KPI = """k AS (SELECT user_id, count(*) FILTER (kind = 'notification_sent') AS notifications_sent,
  count(*) FILTER (kind = 'notification_opened') AS notifications_opened,
  count(*) FILTER (kind = 'benefit_redeemed') AS redeemed,
  count(*) FILTER (kind = 'share_resolved') AS share_resolved,
  count(*) FILTER (kind = 'share_unmatched') AS share_unmatched
  FROM fx_interaction GROUP BY ROLLUP (user_id)),
kr AS (SELECT *, CAST(notifications_opened + redeemed AS DOUBLE) / nullif(notifications_sent, 0)
  AS decision_impact_ratio FROM k)"""


def _with(ctes: str, *more: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([ctes, *more]) + "\n" + select


def _saving_on(kind: str, amount: str) -> str:
    return f"""(CASE WHEN {amount} <= 0 THEN 0.0
      WHEN {kind}.type IN ('percent', 'cashback') THEN CASE WHEN {kind}.max_discount IS NULL
        THEN {amount} * {kind}.value / 100
        ELSE LEAST({amount} * {kind}.value / 100, {kind}.max_discount) END
      WHEN {kind}.type IN ('fixed', 'gift_card') THEN LEAST({kind}.value, {amount}) ELSE 0.0 END)"""


def _in_order(first: str, second: str) -> str:
    one = _saving_on(first, "a.basket2")
    return f"({one} + {_saving_on(second, f'GREATEST(0.0, a.basket2 - {one})')})"


_COMBOS = f"""cand AS (SELECT *, COALESCE(cart_amount, 250.0) AS basket2 FROM ranked
  WHERE type <> 'bogo' AND stacks_with_club IS DISTINCT FROM FALSE),
pairs AS (
  SELECT a.ctx_id, a.position AS pa, b.position AS pb, a.benefit_id AS ia, b.benefit_id AS ib,
    a.saving AS sa, b.saving AS sb, a.merchant_id AS ma, b.merchant_id AS mb,
    a.stacks_with_club AS ka, b.stacks_with_club AS kb,
    a.stacks_with_club IS NOT NULL AND b.stacks_with_club IS NOT NULL AS confirmed,
    LEAST({_in_order('a', 'b')}, {_in_order('b', 'a')}) AS s
  FROM cand a JOIN cand b ON a.ctx_id = b.ctx_id AND a.position < b.position
    AND a.program_id <> b.program_id AND (a.merchant_id = b.merchant_id
      OR a.merchant_id = 'any_merchant' OR b.merchant_id = 'any_merchant')),
best AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY confirmed DESC, s DESC, pa, pb)
    AS pos FROM pairs WHERE s > 0)"""
_COMBO_IDS = """ctx_id, pos AS position, CASE WHEN sa >= sb THEN ia ELSE ib END AS first_id,
  CASE WHEN sa >= sb THEN ib ELSE ia END AS second_id, round(s, 6) AS saving, confirmed"""

ORACLE = {
    "top_benefits_per_cart": _with(
        _CART_CTES, _OWNED, at_merchant(False), EVAL, RANKED,
        select=f"""SELECT ctx_id, position, benefit_id, merchant_id, program_id, status, saving,
  is_estimate, age_days, concat_ws(',', CASE WHEN r4 THEN 'min_spend' END,
    CASE WHEN r6 THEN 'voucher' END) AS actions
FROM ranked WHERE position <= {TOP_PER_CART}""",
    ),
    "eval_status": _with(
        _VIEW_CTES, _OWNED, _VIEWED, EVAL,
        select=f"""SELECT ctx_id, benefit_id, status, {_BLOCKER_CODES} AS blockers,
  {_REQUIREMENT_CODES} AS requirements, saving, is_estimate, age_days FROM ev""",
    ),
    "eval_gates": _with(
        _VIEW_CTES, _OWNED, _VIEWED, EVAL,
        f"""g AS (SELECT *, {_GATE_LISTS['blocked']} AS gb, {_GATE_LISTS['pending']} AS gp,
  {_GATE_LISTS['met']} AS gm FROM ev),
h AS (SELECT *, CASE WHEN gb = '' THEN 0 ELSE len(string_split(gb, '|')) END AS nb,
  CASE WHEN gp = '' THEN 0 ELSE len(string_split(gp, '|')) END AS np,
  CASE WHEN gm = '' THEN 0 ELSE len(string_split(gm, '|')) END AS nm FROM g)""",
        select="""SELECT ctx_id, benefit_id,
  concat_ws('|', nullif(gb, ''), nullif(gp, ''), nullif(gm, '')) AS gates,
  concat_ws(',', CASE WHEN r4 THEN 'min_spend' END, CASE WHEN r6 THEN 'voucher' END) AS actions,
  concat_ws(' · ', CAST(nb + np + nm AS VARCHAR) || ' תנאים',
    CASE WHEN nb > 0 THEN CAST(nb AS VARCHAR) || ' חוסמים' END,
    CASE WHEN n_actions > 0 THEN CAST(n_actions AS VARCHAR) || ' עליך' END,
    CASE WHEN nm > 0 THEN CAST(nm AS VARCHAR) || ' מתקיימים' END) AS summary,
  nb + np + nm AS n_gates, nb AS n_blocked, n_actions AS n_pending_actions, nm AS n_met FROM h""",
    ),
    "condition_lines": _with(
        _VIEW_CTES, _OWNED, _VIEWED, EVAL,
        f"""l AS (SELECT ctx_id, benefit_id,
    list_filter(string_split({_BLOCKER_CODES}, ','), lambda x: x <> '') AS bl,
    list_filter(string_split({_REQUIREMENT_CODES}, ','), lambda x: x <> '') AS rl FROM ev),
m AS (SELECT ctx_id, benefit_id, len(bl) AS nb, list_concat(bl, rl) AS cl FROM l),
n AS (SELECT ctx_id, benefit_id, nb, unnest(cl) AS code, generate_subscripts(cl, 1) - 1 AS line_no
  FROM m)""",
        select="""SELECT ctx_id, benefit_id, CAST(line_no AS INT) AS line_no,
  CASE WHEN line_no < nb THEN 'blocked' ELSE 'note' END AS tone, code FROM n""",
    ),
    "saving_estimate": _with(
        _VIEW_CTES, _OWNED, _VIEWED, EVAL,
        select="""SELECT ctx_id, benefit_id, saving, is_estimate,
  CASE type WHEN 'percent' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '% הנחה'
    WHEN 'cashback' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '% זיכוי'
    WHEN 'fixed' THEN '₪' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' הנחה'
    WHEN 'gift_card' THEN '₪' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' מתנה'
    ELSE '1+1' END AS headline FROM ev""",
    ),
    "owned_closure": _with(
        duckdb_cte(["fx_program", "fx_owned"]), _OWNED, select="SELECT user_id, program_id FROM owned"
    ),
    "owned_deep_closure": _with(
        duckdb_cte(["fx_deep_program", "fx_deep_owned"]),
        """up AS (SELECT id AS program_id, id AS ancestor_id FROM fx_deep_program
  UNION SELECT up.program_id, p.parent_id FROM up JOIN fx_deep_program p ON p.id = up.ancestor_id
  WHERE p.parent_id IS NOT NULL)""",
        select="""SELECT DISTINCT user_id, coalesce(ancestor_id, program_id) AS program_id
FROM fx_deep_owned LEFT JOIN up USING (program_id)""",
    ),
    "offered_programs": _with(
        duckdb_cte(["fx_program", "fx_benefit"]),
        select="""SELECT CAST(list_position(['credit_card', 'employer_club', 'retail_club'], category)
  AS INT) AS section, category, id, name FROM fx_program
WHERE id IN (SELECT program_id FROM fx_benefit)
  OR parent_id IN (SELECT program_id FROM fx_benefit)""",
    ),
    "profile_from_toggles": """SELECT o_custkey AS user_id,
  'n' || CAST(o_orderkey % 25 AS VARCHAR) AS program_id
FROM orders GROUP BY ALL HAVING count(*) % 2 = 1""",
    "ready_split": _with(
        _CART_CTES, _OWNED, at_merchant(False), EVAL,
        select="""SELECT ctx_id, CASE WHEN n_actions = 0 THEN 'ready' ELSE 'conditional' END AS kind,
  count(*) AS n FROM ev WHERE status <> 'blocked' GROUP BY ALL""",
    ),
    "combos": _with(
        _CART_CTES, _OWNED, at_merchant(True), EVAL, RANKED, _COMBOS,
        select=f"""SELECT {_COMBO_IDS}, CASE WHEN ma = 'any_merchant' THEN mb ELSE ma END AS merchant_name,
  CAST(ka IS NULL AS INT) + CAST(kb IS NULL AS INT) AS n_caveats
FROM best WHERE pos <= {COMBOS_LISTED}""",
    ),
    "combo_best": _with(
        _CART_CTES, _OWNED, at_merchant(True), EVAL, RANKED, _COMBOS,
        select=f"""SELECT {_COMBO_IDS}, concat_ws('|',
    CASE WHEN ka IS NULL THEN 'התקנון של ' || ma || ' לא אומר אם מותר כפל' END,
    CASE WHEN kb IS NULL THEN 'התקנון של ' || mb || ' לא אומר אם מותר כפל' END) AS caveats
FROM best WHERE pos <= 2""",
    ),
    "kpi": _with(duckdb_cte(["fx_interaction"]), _KPI, select="SELECT * FROM kr"),
    "kpi_target": _with(
        duckdb_cte(["fx_interaction"]), _KPI,
        """f AS (SELECT user_id, decision_impact_ratio AS r, COALESCE(decision_impact_ratio, 0) >= 0.3
  AS met, GREATEST(0.0, LEAST(1.0, COALESCE(decision_impact_ratio, 0.0))) AS fill FROM kr)""",
        select="""SELECT user_id, met, CAST(round(fill, 9) AS DOUBLE) AS fill,
  CASE WHEN r IS NOT NULL AND NOT met
    THEN CAST(floor((CAST(0.3 AS DOUBLE) - fill) * 100 + 0.5) AS BIGINT) END AS points_below FROM f""",
    ),
    "recent_events": _with(
        duckdb_cte(["fx_interaction"]),
        select="""SELECT user_id, event_id, kind FROM fx_interaction
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 500""",
    ),
    "candidate_export": _with(
        _CART_CTES, duckdb_cte(["fx_merchant"]), _OWNED, at_merchant(False), EVAL, RANKED,
        select="""SELECT r.ctx_id, position, benefit_id, r.merchant_id AS merchant,
  COALESCE(m.category, '') AS categories, COALESCE(p.name, r.program_id) AS club,
  CAST(CAST(value AS BIGINT) AS VARCHAR)
    || CASE WHEN type IN ('percent', 'cashback') THEN '%' ELSE ' ₪' END AS offer,
  CAST(floor(saving + 0.5) AS BIGINT) AS estimated_saving_ils, is_estimate,
  n_actions = 0 AS ready_now, 'terms of ' || benefit_id AS terms,
  CAST(1 + CAST(r5 AS INT) + CAST(r6 AS INT) + CAST(r7 AS INT) + CAST(r10 AS INT) + 1
    + CAST(valid_until_s IS NOT NULL AS INT) + CAST(valid_days_csv IS NOT NULL AS INT)
    + CAST(hours_from IS NOT NULL AS INT) + CAST(COALESCE(b_channel IN ('in_store', 'online'), FALSE) AS INT)
    + CAST(COALESCE(min_spend > 0, FALSE) AS INT) AS INT) AS n_conditions
FROM ranked r LEFT JOIN fx_merchant m ON m.id = r.merchant_id
LEFT JOIN fx_program p ON p.id = r.program_id WHERE position <= 25""",
    ),
    "answer_guard": _with(
        _CART_CTES, _OWNED, at_merchant(False), EVAL, RANKED,
        """sent AS (SELECT ctx_id, benefit_id, position FROM ranked WHERE position <= 25),
answers AS (SELECT ctx_id, CASE WHEN ctx_id % 2 = 0 THEN one ELSE 'b1' END AS best,
    CASE WHEN ctx_id % 3 = 0 THEN one ELSE two END AS second
  FROM (SELECT ctx_id, max(benefit_id) FILTER (position = 1) AS one,
    max(benefit_id) FILTER (position = 2) AS two FROM sent GROUP BY ctx_id) q),
checked AS (SELECT ctx_id, second,
    CASE WHEN EXISTS (SELECT 1 FROM sent s WHERE s.ctx_id = a.ctx_id AND s.benefit_id = a.best)
      THEN best END AS best_benefit_id,
    EXISTS (SELECT 1 FROM sent s WHERE s.ctx_id = a.ctx_id AND s.benefit_id = a.second) AS ok
  FROM answers a)""",
        select="""SELECT ctx_id, best_benefit_id,
  CASE WHEN ok AND second IS DISTINCT FROM best_benefit_id THEN second END AS runner_up_id
FROM checked""",
    ),
}
