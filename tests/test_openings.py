"""What a place offers, looked up in steps over time, against pairing every event with every offer."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from helpers import benefit, catalog, utc
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators import fences, openings, rank

CHANGE = utc("2026-03-27T00:00:00Z")  # clocks go forward in Jerusalem


def tables(spark, seed, copies=1):
    rnd = random.Random(seed)
    moments = [CHANGE + timedelta(hours=rnd.randrange(-40, 60), milliseconds=rnd.choice([0, 0, 1])) for _ in range(12)]
    rows = []
    for i in range(60):
        hours = rnd.choice([None, None, {"from": "22:00", "to": "02:00"}, {"from": "09:00", "to": "17:00"}])
        days = rnd.choice([None, None, [1, 2, 3], [5, 6], []])
        shared = dict(
            merchant_id=f"s{rnd.randrange(4)}", program_id=rnd.choice(["p", "q"]), value=float(rnd.choice([5, 10, 20])),
            valid_from=rnd.choice([None, rnd.choice(moments)]), valid_until=rnd.choice([None, rnd.choice(moments)]),
            last_verified_at=rnd.choice([None, *[m - timedelta(days=rnd.choice([3, V.STALE_DAYS])) for m in moments]]),
            confidence_score=rnd.choice([0.2, 0.95, 0.95]),
            conditions={"valid_days": days, "valid_hours": hours, "requires_voucher": rnd.random() < 0.3},
        )
        rows += [benefit(seq=i * copies + c, **shared) for c in range(copies)]
    offers = catalog(spark, *rows)
    times = [*moments, *[m + timedelta(milliseconds=1) for m in moments], *[m + timedelta(hours=7, minutes=59) for m in moments]]
    events = spark.createDataFrame(
        [(i, i % 3, rnd.choice(["v0", "v1"]), rnd.choice(["enter"] * 5 + ["exit"]), at) for i, at in enumerate(times)],
        "event_id bigint, user_id bigint, fence_id string, kind string, ts timestamp")
    places = spark.createDataFrame([("v0", "s0"), ("v0", "s1"), ("v0", "s1"), ("v1", "s1"), ("v1", "s2")], "fence_id string, merchant_id string")
    owned = spark.createDataFrame([(0, "p"), (0, "q"), (1, "p")], "user_id bigint, program_id string")
    muted = spark.createDataFrame([(0, f"b{i * copies}") for i in range(0, 60, 7)] + [(1, "b3"), (2, "b4")], "user_id bigint, benefit_id string")
    return events, places, owned, muted, offers


@pytest.mark.parametrize("seed", range(4))
def test_steps_count_what_pairs_count(spark, seed):
    given = tables(spark, seed)
    want = {r.event_id: r.match_count for r in fences.with_match_counts(given[0], fences.enter_matches(*given)).collect()}
    rows = openings.match_rows(*given).groupBy("event_id").agg(F.sum("match_count").alias("n"))
    assert {r.event_id: r.n for r in rows.collect()} == want and any(want.values())


def test_rows_do_not_grow_with_the_offers(spark):
    few, many = (openings.match_rows(*tables(spark, 1, copies)).count() for copies in (1, 20))
    assert few == many


def test_the_catalog_is_not_sent_whole(spark, tmp_path):
    _, places, _, _, offers = tables(spark, 1)
    offers.write.parquet(f"{tmp_path}/offers")  # a size is known, however small
    offers = spark.read.parquet(f"{tmp_path}/offers")
    plan = openings.usable_steps(places, offers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_the_best_are_kept(spark, seed):
    events, *rest = tables(spark, seed, 30)
    entered = events.where("kind = 'enter'")

    def best(matches):
        top = rank.rank(matches, 3, ["event_id"])
        return sorted((r.event_id, r.position, r.benefit_id, r.saving, r.age_days) for r in top.collect())

    every, kept = fences.enter_matches(entered, *rest), openings.best_matches(entered, *rest, 3)
    assert best(kept) == best(every) and kept.count() < every.count()
