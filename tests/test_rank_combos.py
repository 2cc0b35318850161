from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from perkloom.operators import combos, conditions, fences, ownership, rank
from tests.helpers import benefit, catalog, pairs, utc

STACKS = {"stacks_with_club": True}


def test_owned_programs_walk_parents_and_survive_cycles(spark):
    programs = spark.createDataFrame(
        [("cal", None), ("pro", "cal"), ("gold", "pro"), ("a", "b"), ("b", "a")],
        "id string, parent_id string",
    )
    declared = spark.createDataFrame(
        [(1, "gold"), (2, "a"), (3, "unknown"), (4, "cal")], "user_id bigint, program_id string"
    )
    got = ownership.owned_programs(declared, programs).collect()
    assert {(r.user_id, r.program_id) for r in got} == {
        (1, "gold"), (1, "pro"), (1, "cal"), (2, "a"), (2, "b"), (3, "unknown"), (4, "cal"),
    }
    assert len(got) == 7


def test_toggles(spark):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "user_id int, program_id string")
    got = {tuple(r) for r in ownership.toggled(log, ["user_id", "program_id"]).collect()}
    assert got == {(1, "b"), (2, "a")}


def test_rank_order_and_limit(spark):
    rows = [
        benefit(1, {**STACKS, "min_spend": 150.0}, value=30.0),  # an errand is left
        benefit(2, STACKS, value=10.0),
        benefit(3, STACKS, value=20.0, last_verified_at=utc("2026-07-25T10:00:00Z")),
        benefit(4, STACKS, value=20.0),
        benefit(5, {**STACKS, "valid_days": [7]}, value=90.0),  # blocked
        benefit(6, STACKS, value=20.0),
    ]
    usable = conditions.usable(pairs(spark, rows))
    order = [r.benefit_id for r in rank.rank(usable).orderBy("position").collect()]
    assert order == ["b4", "b6", "b3", "b2", "b1"]
    assert rank.rank(usable, 2).count() == 2


def _combos(spark, rows, cart=None, limit=10):
    return combos.best_combos(conditions.usable(pairs(spark, rows, cart=cart)), limit).orderBy(
        "position"
    ).collect()


def offer(seq, program, **over):
    return benefit(seq, over.pop("conditions", STACKS), program_id=program, merchant_id=over.pop("at", "castro"),
                   merchant_name=over.pop("named", "קסטרו"), **over)


def test_worse_of_two_orders(spark):
    got = _combos(
        spark, [offer(1, "max", value=30.0), offer(2, "riders", type="gift_card", value=150.0)], 500.0
    )
    assert len(got) == 1 and got[0].combo_saving == pytest.approx(255)
    assert got[0].confirmed and got[0].caveats == []
    assert (got[0].first_id, got[0].second_id) == ("b1", "b2")


def test_pairs_that_are_not_offered(spark):
    card = offer(1, "max", value=30.0)
    assert _combos(spark, [card, offer(2, "max", type="fixed", value=50.0)]) == []
    assert _combos(spark, [card, offer(2, "x", type="bogo", value=0.0)]) == []
    assert _combos(spark, [card, offer(2, "x", at="fox", type="fixed", value=50.0)]) == []
    forbids = offer(2, "x", type="fixed", value=50.0, conditions={"stacks_with_club": False})
    assert _combos(spark, [card, forbids]) == []


def test_universal_offer_names_the_shop_and_silence_is_unconfirmed(spark):
    silent = offer(2, "cal", at="any_merchant", named="כל בית עסק", type="cashback", value=1.0,
                   conditions={})
    got = _combos(spark, [offer(1, "max", value=30.0), silent], 500.0)
    assert got[0].merchant_name == "קסטרו" and not got[0].confirmed
    assert got[0].caveats == ["התקנון של כל בית עסק לא אומר אם מותר כפל"]


def _saving_on(b, amount):
    if amount <= 0:
        return 0.0
    if b["type"] in ("percent", "cashback"):
        raw = amount * b["value"] / 100
        cap = b["conditions"]["max_discount"]
        return raw if cap is None else min(raw, cap)
    return min(b["value"], amount)


def _brute(rows, ranked, basket, limit):
    """Every pair, in ranked order."""
    by_id = {b["id"]: b for b in rows}
    usable = [
        by_id[i] for i in ranked
        if by_id[i]["type"] != "bogo" and by_id[i]["conditions"]["stacks_with_club"] is not False
    ]
    found = []
    for n, (a, b) in enumerate(itertools.combinations(usable, 2)):
        shops = {a["merchant_id"], b["merchant_id"]}
        if len(shops) == 2 and "any_merchant" not in shops or a["program_id"] == b["program_id"]:
            continue
        totals = []
        for x, y in ((a, b), (b, a)):
            first = _saving_on(x, basket)
            totals.append(first + _saving_on(y, max(0.0, basket - first)))
        sure = all(o["conditions"]["stacks_with_club"] for o in (a, b))
        if min(totals) > 0:
            found.append((not sure, -min(totals), n, frozenset((a["id"], b["id"]))))
    return [f[3] for f in sorted(found)[:limit]]


@pytest.mark.parametrize("seed, limit", [(1, 1), (2, 2), (3, 3), (4, 7)])
def test_thinning_keeps_the_best_pairs(spark, seed, limit):
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, 90):
        type_ = rnd.choice(["percent", "cashback", "fixed", "gift_card", "bogo"])
        rate = type_ in ("percent", "cashback")
        rows.append(
            offer(
                seq, rnd.choice("pqrs"), at=rnd.choice(["s1", "s1", "s2", "any_merchant"]), type=type_,
                value=float(rnd.choice([5, 10, 20, 60]) if rate else rnd.choice([20, 50, 80, 300])),
                conditions={
                    "stacks_with_club": rnd.choice([True, None, None, False]),
                    "max_discount": rnd.choice([None, 25.0, 60.0]),
                    "requires_voucher": rnd.choice([None, True]),
                },
                last_verified_at=utc(f"2026-07-{rnd.randint(20, 31)}T10:00:00Z"),
            )
        )
    for cart in (None, 120.0):
        usable = conditions.usable(pairs(spark, rows, cart=cart))
        ranked = [r.benefit_id for r in rank.rank(usable).orderBy("position").collect()]
        got = combos.best_combos(usable, limit).orderBy("position").collect()
        expect = _brute(rows, ranked, cart or 250.0, limit)
        assert [frozenset((r.first_id, r.second_id)) for r in got] == expect


@pytest.mark.parametrize("seed, limit", [(11, 1), (12, 2), (13, 4)])
def test_many_prices_of_a_program_do_not_all_pair(spark, seed, limit):
    """Every offer at a price of its own, with caps, at carts and without one."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, 140):
        cap = rnd.choice([None, float(rnd.randrange(5, 60)), float(rnd.randrange(5, 60))])
        rows.append(
            offer(
                seq, rnd.choice("pqr"), at="s1", value=round(rnd.uniform(1, 100), rnd.choice([0, 2, 5])),
                type=rnd.choice(["percent", "cashback"]), conditions={
                    "stacks_with_club": rnd.choice([True, None]), "max_discount": cap,
                    "min_spend": rnd.choice([None, None, 20.0, 400.0]),
                },
            )
        )
    for cart in (None, 100.0, 433.33):
        evaluated = conditions.usable(pairs(spark, rows, cart=cart))
        ranked = [r.benefit_id for r in rank.rank(evaluated).orderBy("position").collect()]
        got = combos.best_combos(evaluated, limit).orderBy("position").collect()
        assert [frozenset((r.first_id, r.second_id)) for r in got] == _brute(rows, ranked, cart or 250.0, limit)


def test_thinning_leaves_steps_of_rate_and_cap(spark):
    rows = [offer(s, "p", at="s1", value=float(s) / 4, type="percent") for s in range(1, 400)]
    rows += [
        offer(s, "q", at="s1", value=float(s) / 8, type="percent", conditions={"max_discount": float(s % 50 + 1)})
        for s in range(400, 800)
    ]
    evaluated = conditions.usable(pairs(spark, rows, cart=100.0))
    left = combos._thin(combos._combinable(evaluated), 3, "merchant_id").groupBy("program_id").count().collect()
    counts = {r.program_id: r["count"] for r in left}
    assert counts["p"] == 3 and counts["q"] <= 3 * 50 / 2


def test_candidates_are_the_same_with_every_merchant_split(spark):
    rnd = random.Random(5)
    rows = [
        offer(s, rnd.choice("pq"), at=rnd.choice(["s1", "s1", "s1", "s2"]), value=float(s % 30 + 1))
        for s in range(1, 60)
    ]
    b = catalog(spark, *rows)
    contexts = spark.range(200).select(
        F.col("id").alias("ctx_id"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "s2").otherwise("s1").alias("merchant_id"),
        F.lit(utc("2026-08-02T10:00:00Z")).alias("now"), F.lit(None).cast("string").alias("channel"),
        F.lit(100.0).alias("cart_amount"),
    )
    owned = spark.createDataFrame(
        [(u, p) for u in range(7) for p in "pq"[: 1 + u % 2]], "user_id bigint, program_id string"
    )
    plain = rank.candidates(contexts, owned, b).select("ctx_id", "benefit_id")
    split = rank.candidates(contexts, owned, b, piece_rows=2).select("ctx_id", "benefit_id")
    assert plain.count() == split.count() > 1000
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_describe_and_guard(spark):
    ranked = rank.rank(conditions.usable(pairs(spark, [benefit(1, STACKS), benefit(2, {"min_spend": 50.0})])))
    merchants = spark.createDataFrame([("tea_leaf", ["pharmacy"])], "id string, categories array<string>")
    programs = spark.createDataFrame([("other", "x")], "id string, name string")
    rows = {r.benefit_id: r for r in rank.describe(ranked, merchants, programs).collect()}
    assert rows["b1"].offer == "10%" and rows["b1"].categories == ["pharmacy"] and rows["b1"].ready_now
    assert rows["b1"].club == "riders" and rows["b1"].estimated_saving_ils == 25
    assert "₪50+: בקנייה מעל ₪50 [pending]" in rows["b2"].conditions
    answers = spark.createDataFrame(
        [(1, "b1", "b1"), (1, "made-up", "b2"), (1, "b2", None)],
        "ctx_id int, best_benefit_id string, runner_up_id string",
    )
    got = {tuple(r)[1:] for r in rank.guard_answers(answers, ranked).collect()}
    assert got == {("b1", None), (None, "b2"), ("b2", None)}


def test_notification_text(spark):
    ranked = rank.rank(
        conditions.usable(pairs(spark, [benefit(i, STACKS, value=float(i)) for i in (1, 2, 3)]))
    ).withColumn("place_name", F.lit("צפון"))
    programs = spark.createDataFrame([("riders", "חבר")], "id string, name string")
    r = fences.notifications(ranked, programs, ["ctx_id"]).first()
    assert r.title == "אתה בצפון?"
    assert r.body == "3% הנחה בTea Leaf (חבר) • 2% הנחה בTea Leaf (חבר) ועוד 1"



def test_a_long_chain_of_programs_and_cycles(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("p40", None)]
    loop = [("a", "b"), ("b", "c"), ("c", "b"), ("self", "self"), ("gone", "nowhere")]
    programs = spark.createDataFrame(chain + loop, "id string, parent_id string")
    declared = spark.createDataFrame(
        [(1, "p0"), (2, "a"), (3, "self"), (4, "unknown"), (5, "gone")], "user_id int, program_id string"
    )
    held = {}
    for r in ownership.owned_programs(declared, programs).collect():
        held.setdefault(r.user_id, set()).add(r.program_id)
    assert held == {
        1: {f"p{i}" for i in range(41)}, 2: {"a", "b", "c"}, 3: {"self"}, 4: {"unknown"}, 5: {"gone", "nowhere"},
    }
