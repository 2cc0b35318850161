from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from perkloom.operators import fences
from perkloom.operators.fences import decide, refresh_step, visit_step
from perkloom.streaming import visits
from perkloom.streaming.run import drain

START = datetime(2024, 2, 1, 6, 0, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "after_min, quiet, matches, notified_ago_min, expect",
    [
        (4, False, 3, None, "notify"), (0.5, False, 3, None, "dwell_too_short"),
        (10, False, 3, 1, "cooldown"), (10, True, 3, None, "quiet_hours"),
        (10, False, 0, None, "nothing_to_show"), (10, False, 3, 12 * 60, "notify"),
        (10, True, 3, 1, "cooldown"), (0.5, True, 0, 1, "nothing_to_show"),
    ],
)
def test_first_reason_wins(spark, after_min, quiet, matches, notified_ago_min, expect):
    now = 1_000_000_000 + round(after_min * 60_000)
    notified = None if notified_ago_min is None else now - notified_ago_min * 60_000
    assert decide(now, quiet, matches, 1_000_000_000, notified) == expect
    column = fences.notify_decision(
        F.lit(now), F.lit(1_000_000_000), F.lit(notified).cast("bigint"), F.lit(quiet), F.lit(matches)
    )
    assert spark.range(1).select(column).first()[0] == expect


def test_quiet_hours_wrap(spark):
    minutes = [0, 479, 480, 720, 1319, 1320, 1439]
    df = spark.createDataFrame([(m,) for m in minutes], "m int")
    got = [r[0] for r in df.select(fences.in_quiet_hours(F.col("m"))).collect()]
    assert got == [True, True, False, False, False, True, True]


def _events(seed, n, users):
    rnd = random.Random(seed)
    at, rows = START, []
    for i in range(n):
        at += timedelta(minutes=rnd.choice([1, 1, 2, 40, 200]))
        user = 0 if rnd.random() < 0.6 else rnd.randrange(users)
        rows.append((i, user, at, f"v{user % 2}", rnd.choice(["enter", "enter", "enter", "exit"]), rnd.randrange(4)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(
        rows, "event_id bigint, user_id bigint, ts timestamp, fence_id string, kind string, match_count bigint"
    )


def _walk(spark, rows):
    """Every key in one piece, in this process."""
    pdf = fences.with_clock(_frame(spark, rows)).toPandas().sort_values(["ts", "event_id"])
    out = {}
    for _, group in pdf.groupby(["user_id", "fence_id"]):
        decisions, _ = visit_step(group, None)
        out.update(zip(group["event_id"], decisions))
    return {k: v for k, v in out.items() if v is not None}


@pytest.mark.parametrize("pieces", [1, 5, 23])
def test_a_history_cut_in_pieces_decides_the_same(spark, pieces):
    rows = _events(4, 400, 6)
    got = fences.visit_decisions(_frame(spark, rows), pieces)
    expect = _walk(spark, rows)
    assert {r.event_id: r.decision for r in got.collect()} == expect
    assert {"notify", "cooldown", "dwell_too_short", "quiet_hours", "nothing_to_show"} <= set(expect.values())


def test_long_memory_is_carried_through_whole_pieces(spark):
    """One user, one notification early on, everything after it within the cooldown:
    its effect must travel through pieces that hold nothing else."""
    rows = [
        (i, 1, START + timedelta(minutes=3 * i), "v1", "enter", 1) for i in range(230)
    ]
    got = fences.visit_decisions(_frame(spark, rows), 12)
    decided = {r.event_id: r.decision for r in got.collect()}
    assert decided == _walk(spark, rows)
    assert [i for i, d in decided.items() if d == "notify"] == [1]


def test_refresh_follows_the_last_accepted_origin(spark):
    rnd = random.Random(8)
    rows, lat = [], 32.0
    for i in range(300):
        lat += rnd.choice([0.0, 0.01, 0.02, -0.015])
        rows.append((i, 1 if i % 4 else 2, START + timedelta(minutes=i), lat, 34.8))
    df = spark.createDataFrame(rows, "pos_id bigint, user_id bigint, ts timestamp, lat double, lng double")
    got = {r.pos_id: r.refresh for r in fences.fence_refreshes(df, 9).collect()}
    pdf = df.toPandas().sort_values("ts")
    expect = {}
    for _, group in pdf.groupby("user_id"):
        out, _ = refresh_step(group, None)
        expect.update(zip(group["pos_id"], out))
    assert got == expect and 20 < sum(expect.values()) < 200


def test_stream_in_many_batches_equals_the_batch_walk(spark, tmp_path):
    rows = _events(6, 160, 4)
    for n in range(4):
        _frame(spark, rows[n * 40 : n * 40 + 40]).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    schema = _frame(spark, rows[:1]).schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    )
    got = drain(visits.visit_decisions(stream), "update")
    assert {r.event_id: r.decision for r in got.collect()} == _walk(spark, rows)


def test_only_able_users_at_known_places(spark):
    events = _frame(spark, _events(7, 30, 4))
    places = spark.createDataFrame([("v0",)], "fence_id string")
    profiles = spark.createDataFrame(
        [(0, True, 2), (1, True, 1), (2, False, 3), (3, True, 0)],
        "user_id bigint, notifications_enabled boolean, n_programs int",
    )
    left = visits.eligible_events(events, places, profiles)
    assert {r.user_id for r in left.collect()} == {0}


def test_null_keys_do_not_touch_the_others(spark):
    """A user who never moves, after rows without a user, read in small batches."""
    rows = [(i, None, START + timedelta(minutes=i), 32.0, 34.8) for i in range(3)]
    rows += [(i, 1, START + timedelta(minutes=i), 32.0, 34.8) for i in range(3, 43)]
    df = spark.createDataFrame(rows, "pos_id bigint, user_id bigint, ts timestamp, lat double, lng double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r.pos_id: (r.user_id, r.refresh) for r in fences.fence_refreshes(df, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i for i, (_, refresh) in got.items() if refresh} == {0, 3}
    assert {user for user, _ in got.values()} == {None, 1}


def _jobs_of(spark, monkeypatch, rows, pieces):
    """Which rows re-pick, and how many readings that took."""
    df = spark.createDataFrame(rows, "pos_id bigint, user_id bigint, ts timestamp, lat double, lng double")
    readings = []
    real = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: readings.append(1) or real(self, *a, **k))
    got = {r.pos_id: r.refresh for r in fences.fence_refreshes(df, pieces).collect()}
    monkeypatch.undo()
    out, _ = refresh_step(df.toPandas().sort_values(["ts", "pos_id"]), None)
    assert got == dict(enumerate(out))
    return sum(out), len(readings)


def test_a_steady_mover_is_read_twice(spark, monkeypatch):
    """Every accepted origin depends on the one before, through all pieces."""
    rows = [(i, 1, START + timedelta(minutes=i), 32.0 + i * 0.019, 34.8) for i in range(1_500)]
    accepted, readings = _jobs_of(spark, monkeypatch, rows, 64)
    assert accepted > 300 and readings == 2


def test_someone_who_stays_is_read_twice(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, 1, START + timedelta(minutes=i), 32.0 + rnd.uniform(-1e-3, 1e-3), 34.8) for i in range(1_500)]
    accepted, readings = _jobs_of(spark, monkeypatch, rows, 64)
    assert accepted == 1 and readings == 2


def test_someone_who_wanders_is_walked_where_summaries_cannot_tell(spark, monkeypatch):
    rnd = random.Random(10)
    rows = [(i, 1, START + timedelta(minutes=i), 32.0 + rnd.uniform(-0.04, 0.04), 34.8) for i in range(600)]
    accepted, readings = _jobs_of(spark, monkeypatch, rows, 8)
    assert accepted > 20 and readings <= 2 + 8


def test_summaries_of_moves_compose():
    import pandas as pd

    for seed in range(12):
        rnd = random.Random(seed)
        lat, lng, rows = 32.0, 34.8, []
        for _ in range(500):
            far = rnd.choice([1e-4, 1e-3, 0.02, 0.02, 0.3])
            lat, lng = lat + rnd.uniform(-far, far), lng + rnd.uniform(-far, far)
            rows.append((lat, lng))
        pdf = pd.DataFrame(rows, columns=["lat", "lng"])
        cuts = [0, *sorted(rnd.sample(range(1, 500), 15)), 500]
        state, told = None, 0
        for a, b in zip(cuts, cuts[1:]):
            made = fences.RefreshSummary()
            made.add(pdf.iloc[a:b])
            got = fences.RefreshSummary.follow(made.done(), state)
            _, state = refresh_step(pdf.iloc[a:b], state)
            if got is not fences.UNKNOWN:
                told += 1
                assert list(got) == list(state)
        assert told > 5


def test_a_stream_without_input_is_an_empty_table(spark, tmp_path):
    schema = _frame(spark, _events(1, 1, 1)).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = drain(stream.select("event_id", "user_id"), "append")
    assert got.columns == ["event_id", "user_id"] and got.count() == 0
