"""Fence events as a stream that runs on: one small state per (user, fence).

The decision code is the batch walk's; only where the state lives differs. Events wait in the
state, in the order of their own time, until the watermark says that none before them is still to
come; then an event-time timer decides them. So late events fall into place, however micro-batches
were cut, and a batch that is run again changes nothing. A key holds what its lateness allows, in
pieces of time of which one is in memory at a time: a piece is four weeks, a day where those hold more
than ``PIECE_EVENTS``, an hour where the day does. So an ordinary key costs a few calls to the state, not some
per event, and a key that is busy has an hour in memory at most; a crowded fence is many keys because
the user is part of the key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from perkloom.operators.conditions import DEFAULT_POLICY, Policy
from perkloom.operators.fences import NOTIFY, visit, with_clock
from perkloom.operators.openings import match_tables, matched
from perkloom.session import ROCKSDB, STATE_STORE_KEY, written

PIECES_MS = (28 * 24 * 3_600_000, 24 * 3_600_000, 3_600_000)
PIECE_EVENTS = 1_000  # in a piece that could be cut
CUT = "cut"  # stands for the events of a piece that are in smaller ones
NOTED = 1_000  # events noted before they go to the state
STATE = StructType([StructField(name, LongType()) for name in ("entered", "notified", "last")])
PIECE = StructType([StructField("size_ms", LongType()), StructField("piece", LongType())])
WAITING = StructType([StructField("events", StringType())])
OUTPUT = StructType(
    [
        StructField("event_id", LongType()),
        StructField("user_id", LongType()),
        StructField("fence_id", StringType()),
        StructField("at_ms", LongType()),
        StructField("match_count", LongType()),
        StructField("decision", StringType()),
    ]
)


def _whole(value) -> int | None:
    return None if value is None else int(value)


class VisitProcessor(StatefulProcessor):
    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", STATE)
        self.waiting = handle.getMapState("waiting", PIECE, WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Note events by the piece of time they are in; nothing is decided yet."""
        noted: dict[str, tuple] = {}
        n = 0
        for r in rows:
            # An event read twice, and its matches with it, counts once: both are divided.
            kind, at_ms, quiet, times, matches = noted.get(str(r.event_id), (r.kind, r.at_ms, r.quiet, 0, 0))
            noted[str(r.event_id)] = (kind, at_ms, quiet, times + 1 - r.is_match, matches + r.match_count)
            n += 1
            if n % NOTED == 0:
                self._keep(noted)
                noted = {}
        self._keep(noted)
        return iter(())

    def _keep(self, noted: dict[str, tuple], sizes: tuple = PIECES_MS) -> None:
        pieces: dict[int, dict] = {}
        for event_id, event in noted.items():
            pieces.setdefault(event[1] // sizes[0], {})[event_id] = event
        for piece, events in pieces.items():
            held = self._held(sizes[0], piece)
            if held == CUT:
                self._keep(events, sizes[1:])
                continue
            for event_id, (kind, at_ms, quiet, times, matches) in events.items():
                before = held.get(event_id, (kind, at_ms, quiet, 0, 0))
                held[event_id] = (kind, at_ms, quiet, before[3] + times, before[4] + matches)
            if len(held) > PIECE_EVENTS and sizes[1:]:
                self.waiting.updateValue((sizes[0], piece), (json.dumps(CUT),))
                self._keep(held, sizes[1:])
            else:
                self._wait((sizes[0], piece), held)

    def _held(self, size: int, piece: int) -> dict | str:
        found = self.waiting.getValue((size, piece))
        return json.loads(found[0]) if found is not None else {}

    def _piece_at(self, at_ms: int) -> tuple[tuple[int, int], dict]:
        for size in PIECES_MS:
            held = self._held(size, at_ms // size)
            if held and held != CUT:
                return (size, at_ms // size), held
        return (size, at_ms // size), {}

    def _wait(self, piece: tuple[int, int], events: dict) -> None:
        self.waiting.updateValue(piece, (json.dumps(events),))
        # A timer goes off when the watermark has passed it; events at the watermark are complete.
        self.handle.registerTimer(min(e[1] for e in events.values()) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, mark = expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs()
        stored = self.visit.get()
        entered, notified, last = (None, None, None) if stored is None else map(_whole, stored)
        piece, held = self._piece_at(at)
        ready = sorted((e[1], int(i), *e) for i, e in held.items() if e[1] <= mark)
        if not ready:
            if last is not None and last + self.forget_ms <= at:
                self.visit.clear()
            return
        out = []
        for at_ms, event_id, kind, _, quiet, times, matches in ready:
            if last is not None and at_ms - last > self.forget_ms:
                entered = notified = None
            last, count = at_ms, matches // max(1, times)
            decision, entered, notified = visit(kind, at_ms, quiet, count, entered, notified)
            if decision is not None:
                out.append(Row(event_id=event_id, user_id=key[0], fence_id=key[1], at_ms=at_ms,
                               match_count=count, decision=decision))
        self.visit.update((entered, notified, last))
        self.handle.registerTimer(last + self.forget_ms - 1)
        rest = {i: e for i, e in held.items() if e[1] > mark}
        if rest:
            self._wait(piece, rest)
        else:
            self.waiting.removeKey(piece)
        for size in PIECES_MS:  # nothing more can come to a piece that is over, cut or not
            if size > piece[0] and (at // size + 1) * size <= mark:
                self.waiting.removeKey((size, at // size))
        yield from out

    def close(self) -> None:
        pass


FORGET_MS = 7 * 24 * 3_600_000  # more than any stay and cooldown


def visit_decisions(events: DataFrame, lateness: str = "0 seconds", forget_ms: int = FORGET_MS) -> DataFrame:
    """Streaming enter events with their ``match_count`` and ``decision``, in the order of their time.

    ``events``: event_id, user_id, fence_id, kind, ts, match_count, already limited to known
    places and to users with notifications on and a program declared; several rows of an event, as
    ``with_matches`` makes them, are added up. An event is decided once no event before it can
    come any more: ``lateness`` is how far events may arrive out of order, and what comes later
    still is left out. A visit is forgotten ``forget_ms`` after its last event.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_STORE_KEY, ROCKSDB)
    if "is_match" not in events.columns:
        events = events.withColumn("is_match", F.lit(0))
    clocked = with_clock(events.withWatermark("ts", lateness)).select(
        "event_id", "user_id", "fence_id", "kind", "ts", "at_ms", "quiet",
        F.col("match_count").cast("bigint").alias("match_count"), F.col("is_match").cast(IntegerType()).alias("is_match"),
    )
    return clocked.groupBy("user_id", "fence_id").transformWithState(
        statefulProcessor=VisitProcessor(forget_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def with_matches(
    events: DataFrame, places: DataFrame, owned: DataFrame, muted: DataFrame, benefits: DataFrame,
    policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """``openings.match_rows`` as part of a running query: rows of an event whose ``match_count``
    add up, the event itself among them (``is_match`` 0).

    What events are matched with is written once, in small steps: a micro-batch is planned anew, on the
    driver and without sizes measured on the way, so its plan holds only the joins with those tables, and
    none is sent whole. ``session.release`` removes them, so not before the query has ended.

    ``places``: (fence_id, merchant_id); ``events``: event_id, user_id, fence_id, kind, ts."""
    kept = lambda table, name: written(table, name).hint("merge")
    return matched(events, *match_tables(places, owned, muted, benefits, policy, kept), policy)


def eligible_events(
    events: DataFrame, places: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Events at places that exist, of users who want and could use a reminder.

    Static sides: ``places`` (fence_id), ``profiles`` (user_id,
    notifications_enabled, n_programs).
    """
    able = profiles.where("notifications_enabled AND n_programs > 0").select("user_id")
    return events.join(places.select("fence_id").distinct(), "fence_id", "left_semi").join(
        able, "user_id", "left_semi"
    )


def notification_events(decisions: DataFrame) -> DataFrame:
    """What a sent notification adds to the interaction log."""
    return decisions.where(F.col("decision") == NOTIFY).select(
        "event_id", "user_id", F.timestamp_millis("at_ms").alias("ts"),
        F.lit("notification_sent").alias("kind"),
    )
