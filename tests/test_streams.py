"""The enter pipeline as a query that runs on."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from perkloom.operators import fences
from perkloom.plans import place_queries
from perkloom.plans.domain import Domain
from perkloom.streaming import visits
from perkloom.streaming.run import results, run_to_table

START = datetime(2024, 2, 1, 6, 0, tzinfo=timezone.utc)
SCHEMA = "event_id bigint, user_id bigint, ts timestamp, fence_id string, kind string, match_count bigint"


def made(seed, n, users=3):
    rnd, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(minutes=rnd.choice([1, 1, 2, 5, 40, 300]))
        rows.append((i, rnd.randrange(users), at, f"v{rnd.randrange(2)}", rnd.choice(["enter", "enter", "exit"]), rnd.randrange(3)))
    return rows


def write(spark, rows, folder, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={n}")


def stream_of(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def walked(spark, rows):
    decided = fences.visit_decisions(spark.createDataFrame(rows, SCHEMA), 1).collect()
    return sorted((r.event_id, r.decision) for r in decided)


def told(spark, folder, stream):
    return sorted((r.event_id, r.decision) for r in results(spark, folder, stream.schema).collect())


def test_a_running_query_stops_and_goes_on(spark, tmp_path):
    rows = made(1, 120)
    os.makedirs(f"{tmp_path}/in")
    for n in range(2):
        write(spark, rows[n * 30 : n * 30 + 30], tmp_path, n)
    stream = visits.visit_decisions(stream_of(spark, tmp_path))
    query = run_to_table(stream, f"{tmp_path}/q", processingTime="200 milliseconds")
    query.processAllAvailable()
    assert told(spark, f"{tmp_path}/q", stream) == walked(spark, rows[:60])
    write(spark, rows[60:90], tmp_path, 2)
    query.processAllAvailable()
    query.stop()
    assert told(spark, f"{tmp_path}/q", stream) == walked(spark, rows[:90])
    write(spark, rows[90:], tmp_path, 3)
    stream = visits.visit_decisions(stream_of(spark, tmp_path))
    run_to_table(stream, f"{tmp_path}/q", availableNow=True).awaitTermination()
    assert told(spark, f"{tmp_path}/q", stream) == walked(spark, rows)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    rows = made(2, 80)
    for n in range(4):
        write(spark, rows[n * 20 : n * 20 + 20], tmp_path, n)
    write(spark, rows[10:40], tmp_path, 4)  # read once more from the source
    stream = visits.visit_decisions(stream_of(spark, tmp_path))
    run_to_table(stream, f"{tmp_path}/q", availableNow=True).awaitTermination()
    want = walked(spark, rows)
    assert told(spark, f"{tmp_path}/q", stream) == want
    commits = f"{tmp_path}/q/state/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the driver was lost before it noted the end
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    run_to_table(stream, f"{tmp_path}/q", availableNow=True).awaitTermination()
    assert told(spark, f"{tmp_path}/q", stream) == want


def test_late_events_fall_into_place(spark, tmp_path):
    rows = made(3, 120)
    rnd = random.Random(3)
    late = sorted(rows, key=lambda r: r[2] + timedelta(hours=rnd.uniform(0, 10)))
    end = (999, 9, rows[-1][2] + timedelta(hours=11), "v0", "exit", 0)
    for n in range(4):
        write(spark, late[n * 30 : n * 30 + 30], tmp_path, n)
    write(spark, [end], tmp_path, 4)
    stream = visits.visit_decisions(stream_of(spark, tmp_path), "10 hours")
    run_to_table(stream, f"{tmp_path}/q", availableNow=True).awaitTermination()
    assert told(spark, f"{tmp_path}/q", stream) == walked(spark, rows)


def test_events_of_one_batch_twice_count_once(spark, tmp_path):
    rows = made(4, 30)
    write(spark, rows + rows[5:20], tmp_path, 0)
    stream = visits.visit_decisions(stream_of(spark, tmp_path))
    run_to_table(stream, f"{tmp_path}/q", availableNow=True).awaitTermination()
    assert told(spark, f"{tmp_path}/q", stream) == walked(spark, rows)
    counts = {r.event_id: r.match_count for r in results(spark, f"{tmp_path}/q", stream.schema).collect()}
    assert counts == {r[0]: r[5] for r in rows if r[4] == "enter"}


def test_visits_are_forgotten(spark, tmp_path):
    day = timedelta(days=1)
    rows = [(0, 1, START, "v0", "enter", 1), (1, 2, START + 3 * day, "v0", "enter", 1), (2, 2, START + 4 * day, "v0", "exit", 0),
            (3, 1, START + 5 * day, "v0", "enter", 1), (4, 2, START + 9 * day, "v0", "exit", 0)]
    for n, row in enumerate(rows):
        write(spark, [row], tmp_path, n)
    for forget, want in ((2 * day, "dwell_too_short"), (30 * day, "notify")):
        stream = visits.visit_decisions(stream_of(spark, tmp_path), forget_ms=forget // timedelta(milliseconds=1))
        folder = f"{tmp_path}/{forget.days}"
        run_to_table(stream, folder, availableNow=True).awaitTermination()
        assert dict(told(spark, folder, stream))[3] == want


class Calls:
    """A processor's handle and state that count the calls to them."""

    def __init__(self):
        self.n, self.map, self.value, self.timers = 0, {}, None, set()

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def get(self):
                outer.n += 1
                return outer.value

            def exists(self):
                outer.n += 1
                return outer.value is not None

            def update(self, value):
                outer.n += 1
                outer.value = value

            def clear(self):
                outer.n += 1
                outer.value = None

        return Value()

    def getMapState(self, name, key, value):
        outer = self

        class Map:
            def getValue(self, k):
                outer.n += 1
                return outer.map.get(k)

            def containsKey(self, k):
                outer.n += 1
                return k in outer.map

            def updateValue(self, k, v):
                outer.n += 1
                outer.map[k] = v

            def removeKey(self, k):
                outer.n += 1
                outer.map.pop(k, None)

        return Map()

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)


def decided(n, minutes, forget_ms=visits.FORGET_MS):
    """Events of one key, noted and decided at once: what was told and the calls to the state."""
    from types import SimpleNamespace

    calls, start = Calls(), int(START.timestamp() * 1000)
    made = visits.VisitProcessor(forget_ms)
    made.init(calls)
    rows = [SimpleNamespace(event_id=i, kind="enter", at_ms=start + i * minutes * 60_000, quiet=False, is_match=0, match_count=1)
            for i in range(n)]
    list(made.handleInputRows((1, "v"), iter(rows), None))
    largest = max(len(v[0]) for v in calls.map.values())
    mark = SimpleNamespace(getCurrentWatermarkInMs=lambda: rows[-1].at_ms + 100 * 24 * 3_600_000)
    told = []
    while calls.timers:
        at = min(calls.timers)
        calls.timers.remove(at)
        told += made.handleExpiredTimer((1, "v"), mark, SimpleNamespace(getExpiryTimeInMs=lambda: at))
    assert not calls.map and calls.value is None
    return [(r.event_id, r.decision) for r in told], calls.n, largest


def test_a_key_calls_the_state_less_than_once_per_event():
    told, calls, _ = decided(70, 600)
    assert [i for i, _ in told] == list(range(70)) and calls < 70


def test_a_busy_key_is_cut_into_smaller_pieces():
    told, _, largest = decided(12_000, 1)
    assert [i for i, _ in told] == list(range(12_000)) and largest < 100 * visits.PIECE_EVENTS


def test_a_visit_is_forgotten_within_a_piece():
    told, _, _ = decided(3, 3 * 24 * 60, forget_ms=2 * 24 * 3_600_000)
    assert [d for _, d in told] == ["dwell_too_short"] * 3


def test_matches_of_a_stream_are_those_of_the_batch(spark, sf_dir):
    d = Domain(spark, sf_dir)
    events, places = d.fence_events.drop("match_count"), place_queries.places_of(d)
    found = fences.enter_matches(events, places, d.owned, d.muted, d.benefits)
    want = {r.event_id: r.match_count for r in fences.with_match_counts(events, found).collect()}
    rows = visits.with_matches(events, places, d.owned, d.muted, d.benefits)
    got = {r.event_id: r.n for r in rows.groupBy("event_id").agg({"match_count": "sum"}).toDF("event_id", "n").collect()}
    assert got == want and any(want.values())


def test_a_micro_batch_plans_joins_with_written_tables_and_sends_none(spark, sf_dir):
    d = Domain(spark, sf_dir)
    events = d.fence_events.drop("match_count")
    rows = visits.with_matches(events, place_queries.places_of(d), d.owned, d.muted, d.benefits)
    run = rows._jdf.queryExecution()
    assert "Aggregate" not in run.optimizedPlan().toString()
    assert "Broadcast" not in run.executedPlan().toString() and "SortMergeJoin" in run.executedPlan().toString()


@pytest.mark.parametrize("seed", range(8))
def test_summaries_of_pieces_compose(spark, seed):
    """A history cut anywhere gives the states of the whole walk."""
    import pandas as pd

    rnd = random.Random(seed)
    at, rows = 1_000_000_000_000, []
    for _ in range(400):
        at += rnd.choice([0, 30_000, 60_000, 600_000, 3_600_000, 20_000_000])
        rows.append((rnd.choice(["enter"] * rnd.choice([3, 30]) + ["exit"]), at, rnd.random() < 0.3, rnd.randrange(3)))
    pdf = pd.DataFrame(rows, columns=["kind", "at_ms", "quiet", "match_count"])
    cuts = [0, *sorted(rnd.sample(range(1, 400), 12)), 400]
    state = None
    for a, b in zip(cuts, cuts[1:]):
        made = fences.VisitSummary()
        middle = rnd.randrange(a, b)
        for part in (pdf.iloc[a:middle], pdf.iloc[middle:b]):
            if len(part):
                made.add(part)
        got = fences.VisitSummary.follow(made.done(), state)
        _, state = fences.visit_step(pdf.iloc[a:b], state)
        assert got == state
