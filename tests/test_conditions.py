from __future__ import annotations

import pytest

from perkloom.operators import conditions
from tests.helpers import benefit, pairs, utc

SUNDAY_NOON = "2026-08-02T10:00:00Z"


def evaluate(spark, conditions_=None, over=None, **ctx):
    df = conditions.explain(
        conditions.verdict(pairs(spark, [benefit(1, conditions_, **(over or {}))], **ctx))
    )
    r = df.first()
    return r, [b.code for b in r.blockers], [q.code for q in r.requirements]


STACKS = {"stacks_with_club": True}


def test_silence_on_stacking_is_a_requirement(spark):
    r, blockers, required = evaluate(spark)
    assert (r.status, blockers, required) == ("conditional", [], ["stacking_unknown"])


def test_everything_stated_and_met_is_eligible(spark):
    r, _, _ = evaluate(spark, {**STACKS, "valid_days": [1, 2, 3, 4, 5]})
    assert r.status == "eligible"
    day = [g for g in r.gates if g.code == "day"][0]
    assert (day.label, day.state) == ("א׳-ה׳", "met")


def test_blockers_of_ownership_mute_confidence(spark):
    r, blockers, _ = evaluate(
        spark, over={"confidence_score": 0.6}, owned=False, muted=True
    )
    assert blockers == ["program_not_owned", "muted", "low_confidence"]
    assert r.status == "blocked"
    _, blockers, _ = evaluate(spark, over={"confidence_score": 0.6, "reviewed_by_human": True})
    assert blockers == []


def test_weekday_is_local(spark):
    _, blockers, _ = evaluate(spark, {"valid_days": [7]})
    assert blockers == ["wrong_day"]
    r, blockers, _ = evaluate(spark, {"valid_days": [1]}, now="2026-08-02T21:30:00Z")
    assert (r.status, blockers) == ("blocked", ["wrong_day"])


def test_hours_wrap_midnight(spark):
    night = {"valid_hours": {"from": "22:00", "to": "02:00"}}
    assert evaluate(spark, night, now="2026-08-02T21:30:00Z")[1] == []
    assert evaluate(spark, night)[1] == ["wrong_hours"]
    assert evaluate(spark, {"valid_hours": {"from": "13:00", "to": "13:00"}})[1] == []


def test_channel_blocks_only_when_known(spark):
    online = {"channel": "online"}
    assert evaluate(spark, online, channel="in_store")[1] == ["wrong_channel"]
    _, blockers, required = evaluate(spark, online)
    assert blockers == [] and "channel_restricted" in required
    assert "channel_restricted" not in evaluate(spark, {"channel": "both"})[2]


def test_minimum_spend(spark):
    spend = {**STACKS, "min_spend": 150.0}
    r, _, required = evaluate(spark, spend)
    assert (r.status, required, r.n_actions) == ("conditional", ["min_spend_unknown"], 1)
    assert [g.code for g in r.actions_required] == ["min_spend"]
    r, _, _ = evaluate(spark, spend, cart=100.0)
    assert r.status == "blocked" and "חסרים ₪50" in r.blockers[0].message
    blocked = [g for g in r.gates if g.code == "min_spend"][0]
    assert blocked.actionable and r.actions_required == []
    assert evaluate(spark, spend, cart=200.0)[0].status == "eligible"


@pytest.mark.parametrize(
    "verified, expect",
    [
        ("2026-05-01T10:00:00Z", "stale_data"), ("2026-07-10T10:00:00Z", "aging_data"),
        ("2026-06-18T10:00:00Z", "aging_data"), ("2026-07-19T10:00:00Z", None), (None, "stale_data"),
    ],
)
def test_freshness(spark, verified, expect):
    r, blockers, required = evaluate(
        spark, STACKS, {"last_verified_at": utc(verified) if verified else None}
    )
    assert blockers + required == ([expect] if expect else [])
    if verified is None:
        assert r.age_days == -1


def test_validity(spark):
    assert evaluate(spark, STACKS, {"valid_until": utc("2026-07-01T00:00:00Z")})[1] == ["expired"]
    r, _, required = evaluate(spark, STACKS, {"valid_until": utc("2026-08-05T00:00:00Z")})
    assert required == ["ends_soon"]
    assert r.requirements[0].message == "בתוקף עד 5.8.2026"
    assert evaluate(spark, STACKS, {"valid_from": utc("2026-08-03T00:00:00Z")})[1] == ["not_yet_valid"]


def test_caveats_and_gate_order(spark):
    r, _, required = evaluate(
        spark,
        {
            "max_discount": 37.5, "requires_voucher": True, "exclusions": ["טבק", "תרופות"],
            "stacks_with_club": False, "usage_limit": "פעם בחודש", "valid_days": [6, 7],
        },
    )
    assert required == [
        "max_discount_cap", "requires_voucher", "has_exclusions", "no_stacking", "usage_limited",
    ]
    assert [g.state for g in r.gates] == ["blocked"] + ["pending"] * 5 + ["met"]
    text = {g.code: g.detail for g in r.gates}
    assert text["cap"] == "ההנחה מוגבלת ל-₪37.50"
    assert text["exclusions"] == "לא כולל: טבק, תרופות"
    assert text["day"] == "תקף בימים ו׳, שבת בלבד — לא היום"
    assert [g.code for g in r.actions_required] == ["voucher"]


def test_status_of_usable_agrees_with_verdict(spark):
    rows = [
        benefit(1), benefit(2, STACKS), benefit(3, {"min_spend": 150.0}),
        benefit(4, {"valid_days": [7]}), benefit(5, {"requires_voucher": True}),
    ]
    df = pairs(spark, rows)
    keep = ["benefit_id", "status", "readiness", "n_actions", "saving", "is_estimate", "age_days"]
    full = conditions.verdict(df).where("status <> 'blocked'").select(keep).orderBy("benefit_id")
    assert conditions.usable(df).select(keep).orderBy("benefit_id").collect() == full.collect()


@pytest.mark.parametrize(
    "days, label",
    [
        ([1, 2, 3, 4, 5], "א׳-ה׳"), ([1, 3, 5], "א׳, ג׳, ה׳"), ([1, 2], "א׳, ב׳"),
        ([7, 1, 2, 3], "א׳-ג׳, שבת"), ([5, 6, 7], "ה׳-שבת"),
    ],
)
def test_days_label(spark, days, label):
    r, _, _ = evaluate(spark, {"valid_days": days})
    assert [g.label for g in r.gates if g.code == "day"] == [label]


def test_gate_counts_and_lines(spark):
    df = conditions.explain(pairs(spark, [benefit(1, {"valid_days": [7], "requires_voucher": True})]))
    r = conditions.gate_counts(df).first()
    assert (r.n_gates, r.n_blocked, r.n_pending_actions, r.n_met) == (4, 1, 1, 1)
    assert r.summary == "4 תנאים · 1 חוסמים · 1 עליך · 1 מתקיימים"
    lines = conditions.condition_lines(df, ["benefit_id"]).orderBy("line_no").collect()
    assert [(x.tone, x.code) for x in lines] == [
        ("blocked", "wrong_day"), ("note", "requires_voucher"), ("note", "stacking_unknown"),
    ]
