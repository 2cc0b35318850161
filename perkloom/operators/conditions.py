"""Condition evaluation: one benefit against one context, as pure projections.

Input rows are (context, benefit) pairs. Context columns: ``now``, ``channel``,
``cart_amount`` (null = unknown), ``owned``, ``muted``. Benefit columns are those
of the catalog with ``benefit_id`` for the id. Nothing here shuffles: ``verdict``
adds the cheap columns ranking needs, ``explain`` adds the notes and gates and is
meant for the rows that survive ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import money


@dataclass(frozen=True)
class Policy:
    zone: str = V.LOCAL_ZONE
    aging_days: int = V.AGING_DAYS
    stale_days: int = V.STALE_DAYS
    min_confidence: float = V.MIN_CONFIDENCE


DEFAULT_POLICY = Policy()

AGE = "((unix_millis(now) - unix_millis(last_verified_at)) / 86400000.0D)"
DAYS_LEFT = "((unix_millis(valid_until) - unix_millis(now)) / 86400000.0D)"


def _local(instant: str, policy: Policy) -> str:
    return f"convert_timezone(current_timezone(), '{policy.zone}', CAST({instant} AS TIMESTAMP_NTZ))"


def _minutes(text: str) -> str:
    return f"(CAST(split_part({text}, ':', 1) AS INT) * 60 + CAST(split_part({text}, ':', 2) AS INT))"


def _clock(policy: Policy) -> tuple[str, str]:
    """Weekday and minute of the day, where the benefit is used, as SQL."""
    here = _local("now", policy)
    return f"dayofweek({here})", f"(hour({here}) * 60 + minute({here}))"


def timed(contexts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """With the local weekday and minute, which ``usable`` then need not work out for every pair."""
    weekday, minute = _clock(policy)
    return contexts.withColumns({"_weekday": F.expr(weekday), "_minute": F.expr(minute)})


def findings(policy: Policy = DEFAULT_POLICY, is_timed: bool = False) -> dict[str, str]:
    """Every check as SQL that is true or false, never null. ``is_timed``: contexts come from ``timed``.

    An unknown is not resolved in the benefit's favour: what cannot be checked
    here becomes a requirement, and a missing verification date counts as stale.
    """
    weekday, at = ("_weekday", "_minute") if is_timed else _clock(policy)
    lo, hi = _minutes("conditions.valid_hours.from"), _minutes("conditions.valid_hours.to")
    open_now = (
        f"CASE WHEN {lo} = {hi} THEN TRUE WHEN {lo} < {hi} THEN {at} BETWEEN {lo} AND {hi} "
        f"ELSE {at} >= {lo} OR {at} <= {hi} END"
    )
    one_channel = "COALESCE(conditions.channel IN ('in_store', 'online'), FALSE)"
    spend = "COALESCE(conditions.min_spend > 0, FALSE)"
    stale = f"COALESCE({AGE} > {policy.stale_days}, TRUE)"
    expired = "COALESCE(valid_until < now, FALSE)"
    return {
        "not_owned": "NOT COALESCE(owned, FALSE)",
        "muted": "COALESCE(muted, FALSE)",
        "low_confidence": (
            f"(confidence_score < {policy.min_confidence}D AND NOT COALESCE(reviewed_by_human, FALSE))"
        ),
        "stale": stale,
        "aging": f"(NOT {stale} AND {AGE} > {policy.aging_days})",
        "not_yet": "COALESCE(valid_from > now, FALSE)",
        "has_end": "(valid_until IS NOT NULL)",
        "expired": expired,
        "ends_soon": f"(NOT {expired} AND COALESCE({DAYS_LEFT} <= {V.ENDS_SOON_DAYS}, FALSE))",
        "has_days": "(conditions.valid_days IS NOT NULL)",
        "wrong_day": (
            "(conditions.valid_days IS NOT NULL AND "
            f"NOT array_contains(conditions.valid_days, {weekday}))"
        ),
        "has_hours": "(conditions.valid_hours IS NOT NULL)",
        "wrong_hours": f"(conditions.valid_hours IS NOT NULL AND NOT ({open_now}))",
        "has_channel": one_channel,
        "channel_unknown": f"({one_channel} AND channel IS NULL)",
        "wrong_channel": f"({one_channel} AND COALESCE(channel <> conditions.channel, FALSE))",
        "has_spend": spend,
        "spend_unknown": f"({spend} AND cart_amount IS NULL)",
        "below_spend": f"({spend} AND COALESCE(cart_amount < conditions.min_spend, FALSE))",
        "capped": "(conditions.max_discount IS NOT NULL)",
        "voucher": "COALESCE(conditions.requires_voucher, FALSE)",
        "excludes": "COALESCE(size(conditions.exclusions) > 0, FALSE)",
        "no_stacking": "COALESCE(NOT conditions.stacks_with_club, FALSE)",
        "stacking_unknown": "(conditions.stacks_with_club IS NULL)",
        "usage": "COALESCE(conditions.usage_limit <> '', FALSE)",
    }


BLOCKERS = [
    "low_confidence", "not_owned", "muted", "stale", "not_yet", "expired", "wrong_channel",
    "below_spend", "wrong_day", "wrong_hours",
]
REQUIREMENTS = [
    "aging", "ends_soon", "channel_unknown", "spend_unknown", "capped", "voucher", "excludes",
    "no_stacking", "stacking_unknown", "usage",
]
# What the user can still settle before paying.
ACTIONS = ["spend_unknown", "voucher"]


def _any(found: dict[str, str], names: list[str]) -> str:
    return "(" + " OR ".join(found[n] for n in names) + ")"


def _figures(found: dict[str, str]) -> dict[str, Column]:
    type_, cart = F.col("type"), F.col("cart_amount")
    return {
        "n_actions": F.expr(" + ".join(f"CAST({found[n]} AS INT)" for n in ACTIONS)),
        "saving": money.saving_estimate(
            type_, F.col("value"), F.col("conditions.min_spend"),
            F.col("conditions.max_discount"), cart,
        ),
        "is_estimate": money.saving_is_estimate(type_, cart),
        "age_days": F.expr(f"COALESCE(CAST(floor({AGE}) AS BIGINT), -1L)"),
    }


def verdict(pairs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``status, n_actions, readiness, saving, is_estimate, age_days``."""
    found = findings(policy)
    blocked, required = _any(found, BLOCKERS), _any(found, REQUIREMENTS)
    actions = _any(found, ACTIONS)
    return pairs.withColumns(
        {
            "status": F.expr(
                f"CASE WHEN {blocked} THEN 'blocked' WHEN {required} THEN 'conditional' "
                "ELSE 'eligible' END"
            ),
            "readiness": F.expr(f"CASE WHEN {blocked} THEN 2 WHEN {actions} THEN 1 ELSE 0 END"),
            **_figures(found),
        }
    )


def unblocked(policy: Policy = DEFAULT_POLICY, is_timed: bool = False) -> Column:
    """True where nothing rules the benefit out."""
    return F.expr(f"NOT {_any(findings(policy, is_timed), BLOCKERS)}")


def usable(pairs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The verdict with blocked rows hidden, which is the default everywhere.

    The blockers run as one short-circuiting filter, so nothing else is computed
    for the many rows they remove.
    """
    found = findings(policy)
    return pairs.where(unblocked(policy, "_minute" in pairs.columns)).drop("_weekday", "_minute").withColumns(
        {
            "status": F.expr(
                f"CASE WHEN {_any(found, REQUIREMENTS)} THEN 'conditional' ELSE 'eligible' END"
            ),
            "readiness": F.expr(f"CASE WHEN {_any(found, ACTIONS)} THEN 1 ELSE 0 END"),
            **_figures(found),
        }
    )


def placed(pairs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``readiness`` and ``saving`` of pairs that nothing blocks, which no time changes."""
    found = findings(policy)
    return pairs.withColumns({
        "readiness": F.expr(f"CASE WHEN {_any(found, ACTIONS)} THEN 1 ELSE 0 END"),
        "saving": _figures(found)["saving"],
    })


def _quote(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _text(pattern: str, *args: str) -> str:
    return f"format_string({', '.join([_quote(pattern), *args])})"


def _shekels(amount: str) -> str:
    whole = f"CAST(CAST({amount} AS DECIMAL(38,0)) AS STRING)"
    return (
        f"concat('₪', CASE WHEN {amount} = floor({amount}) THEN {whole} "
        f"ELSE format_string('%.2f', {amount}) END)"
    )


def days_label(days: str = "conditions.valid_days") -> str:
    """Weekday list with runs of three or more written as a range, as SQL."""
    names = "array(" + ", ".join(_quote(n) for n in V.DAY_NAMES) + ")"
    listed = f"array_sort(array_distinct({days}))"
    starts = f"filter({listed}, d -> NOT array_contains({days}, d - 1))"
    end = f"array_min(filter({days}, e -> e >= s AND NOT array_contains({days}, e + 1)))"
    run = (
        f"CASE WHEN {end} - s >= 2 THEN concat(get({names}, s - 1), '-', get({names}, {end} - 1)) "
        f"ELSE array_join(slice({names}, s, {end} - s + 1), ', ') END"
    )
    return f"array_join(transform({starts}, s -> {run}), ', ')"


def _note(condition: str, code: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN named_struct('code', '{code}', 'message', {message}) END"


def _gate(condition, code, state, label, detail, actionable="FALSE") -> str:
    return (
        f"CASE WHEN {condition} THEN named_struct('code', '{code}', 'label', {label}, "
        f"'detail', {detail}, 'state', '{state}', 'actionable', {actionable}) END"
    )


def _found(items: list[str]) -> Column:
    return F.expr(f"array_compact(array({', '.join(items)}))")


def explain(pairs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``blockers, requirements, gates, actions_required``."""
    f = findings(policy)
    q = _quote
    until = f"date_format({_local('valid_until', policy)}, 'd.M.yyyy')"
    days = days_label()
    lo, hi = "conditions.valid_hours.from", "conditions.valid_hours.to"
    hours = f"concat({lo}, '-', {hi})"
    where = (
        f"CASE WHEN conditions.channel = 'online' THEN {q(V.LABEL_ONLINE)} "
        f"ELSE {q(V.LABEL_IN_STORE)} END"
    )
    spend, cap = _shekels("conditions.min_spend"), _shekels("conditions.max_discount")
    missing = _shekels("(conditions.min_spend - cart_amount)")
    aged = _text(V.MSG_AGING, f"CAST(floor({AGE}) AS INT)")
    stale = q(V.MSG_STALE % policy.stale_days)
    excluded = _text(V.MSG_EXCLUDES, "array_join(conditions.exclusions, ', ')")
    channel_only = _text(V.MSG_CHANNEL_ONLY, where)
    spend_over, spend_label = _text(V.MSG_SPEND_OVER, spend), f"concat({spend}, '+')"

    blockers = [
        _note(f["not_owned"], "program_not_owned", q(V.MSG_NOT_OWNED)),
        _note(f["muted"], "muted", q(V.MSG_MUTED)),
        _note(f["low_confidence"], "low_confidence", q(V.MSG_LOW_CONFIDENCE)),
        _note(f["stale"], "stale_data", stale),
        _note(f["not_yet"], "not_yet_valid", q(V.MSG_NOT_YET)),
        _note(f["expired"], "expired", q(V.MSG_EXPIRED)),
        _note(f["wrong_day"], "wrong_day", _text(V.MSG_DAYS_ONLY, days)),
        _note(f["wrong_hours"], "wrong_hours", _text(V.MSG_HOURS_ONLY, lo, hi)),
        _note(f["wrong_channel"], "wrong_channel", channel_only),
        _note(f["below_spend"], "below_min_spend", _text(V.MSG_SPEND_BLOCKED, spend, missing)),
    ]
    requirements = [
        _note(f["aging"], "aging_data", aged),
        _note(f["ends_soon"], "ends_soon", _text(V.MSG_VALID_UNTIL, until)),
        _note(f["channel_unknown"], "channel_restricted", channel_only),
        _note(f["spend_unknown"], "min_spend_unknown", spend_over),
        _note(f["capped"], "max_discount_cap", _text(V.MSG_CAP, cap)),
        _note(f["voucher"], "requires_voucher", q(V.MSG_VOUCHER)),
        _note(f["excludes"], "has_exclusions", excluded),
        _note(f["no_stacking"], "no_stacking", q(V.MSG_NO_STACKING)),
        _note(f["stacking_unknown"], "stacking_unknown", q(V.MSG_STACKING_UNKNOWN)),
        _note(f["usage"], "usage_limited", "conditions.usage_limit"),
    ]
    gates = {
        "blocked": [
            ("stale", "freshness", q(V.LABEL_STALE), stale),
            ("not_yet", "validity", q(V.LABEL_NOT_YET), q(V.MSG_NOT_YET)),
            ("expired", "validity", q(V.LABEL_EXPIRED), _text(V.MSG_EXPIRED_ON, until)),
            ("wrong_day", "day", days, _text(V.MSG_DAYS_BLOCKED, days)),
            ("wrong_hours", "hours", hours, _text(V.MSG_HOURS_BLOCKED, lo, hi)),
            ("wrong_channel", "channel", where, channel_only),
            ("below_spend", "min_spend", spend_label, _text(V.MSG_SPEND_MISSING, missing)),
        ],
        "pending": [
            ("aging", "freshness", q(V.LABEL_AGING), aged),
            ("ends_soon", "validity", _text(V.LABEL_UNTIL, until), _text(V.MSG_ENDS_SOON, until)),
            ("channel_unknown", "channel", where, channel_only),
            ("spend_unknown", "min_spend", spend_label, spend_over),
            ("capped", "cap", _text(V.LABEL_CAP, cap), _text(V.MSG_CAP_DETAIL, cap)),
            ("voucher", "voucher", q(V.LABEL_VOUCHER), q(V.MSG_VOUCHER_DETAIL)),
            ("excludes", "exclusions", q(V.LABEL_EXCLUDES), excluded),
            ("no_stacking", "stacking", q(V.LABEL_NO_STACKING), q(V.MSG_NO_STACKING)),
            ("stacking_unknown", "stacking", q(V.LABEL_STACKING_UNKNOWN),
             q(V.MSG_STACKING_UNKNOWN_DETAIL)),
            ("usage", "usage", q(V.LABEL_USAGE), "conditions.usage_limit"),
        ],
        "met": [
            (f"NOT {f['stale']} AND NOT {f['aging']}", "freshness", q(V.LABEL_FRESH), q(V.MSG_FRESH)),
            (f"{f['has_end']} AND NOT {f['expired']} AND NOT {f['ends_soon']}", "validity",
             q(V.LABEL_VALID), _text(V.MSG_VALID_UNTIL, until)),
            (f"{f['has_days']} AND NOT {f['wrong_day']}", "day", days, _text(V.MSG_DAYS_MET, days)),
            (f"{f['has_hours']} AND NOT {f['wrong_hours']}", "hours", hours,
             _text(V.MSG_HOURS_MET, lo, hi)),
            (f"{f['has_channel']} AND NOT {f['wrong_channel']} AND NOT {f['channel_unknown']}",
             "channel", where, _text(V.MSG_CHANNEL_MET, where)),
            (f"{f['has_spend']} AND NOT {f['spend_unknown']} AND NOT {f['below_spend']}",
             "min_spend", spend_label, _text(V.MSG_SPEND_MET, spend)),
            ("COALESCE(conditions.stacks_with_club, FALSE)", "stacking", q(V.LABEL_STACKING_MET),
             q(V.MSG_STACKING_MET)),
        ],
    }
    # A topped-up basket and an issued voucher are errands; the rest is information.
    errands = {"below_spend", "spend_unknown", "voucher"}
    # Blocked first, then what is open, then the reassurance; stable inside each.
    ordered = [
        _gate(f.get(test, test), code, state, label, detail, "TRUE" if test in errands else "FALSE")
        for state, rows in gates.items()
        for test, code, label, detail in rows
    ]
    return pairs.withColumns(
        {"blockers": _found(blockers), "requirements": _found(requirements), "gates": _found(ordered)}
    ).withColumn(
        "actions_required", F.expr("filter(gates, g -> g.state = 'pending' AND g.actionable)")
    )


def gate_counts(explained: DataFrame) -> DataFrame:
    """Counts per state and the one-line summary shown above the list."""
    def count(test) -> Column:
        return F.size(F.filter(F.col("gates"), test))

    out = explained.withColumns(
        {
            "n_gates": F.size("gates"),
            "n_blocked": count(lambda g: g.state == "blocked"),
            "n_pending_actions": count(lambda g: (g.state == "pending") & g.actionable),
            "n_met": count(lambda g: g.state == "met"),
        }
    )
    def part(column: str, pattern: str) -> Column:
        return F.when(F.col(column) > 0, F.format_string(pattern, F.col(column)))

    return out.withColumn(
        "summary",
        F.when(F.col("n_gates") == 0, F.lit(V.GATES_NONE)).otherwise(
            F.concat_ws(
                " · ",
                part("n_gates", V.GATES_TOTAL),
                part("n_blocked", V.GATES_BLOCKED),
                part("n_pending_actions", V.GATES_ACTIONS),
                part("n_met", V.GATES_MET),
            )
        ),
    )


def condition_lines(explained: DataFrame, keys: list[str]) -> DataFrame:
    """One row per condition line: blockers first, then requirements."""
    def lines(column: str, tone: str) -> Column:
        return F.transform(
            F.col(column),
            lambda n: F.struct(F.lit(tone).alias("tone"), n.code.alias("code"), n.message.alias("text")),
        )

    both = F.concat(lines("blockers", "blocked"), lines("requirements", "note"))
    return explained.select(*keys, F.posexplode(both).alias("line_no", "line")).select(
        *keys, "line_no", "line.tone", "line.code", "line.text"
    )
