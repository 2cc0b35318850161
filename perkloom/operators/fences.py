"""Fence decisions: when to re-pick fences and when to notify."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField

from perkloom.functions import fixed_values as V
from perkloom.functions import money, timefn
from perkloom.operators import rank
from perkloom.operators.fold import UNKNOWN, ordered_fold
from perkloom.session import written

NOTIFY = "notify"


def _meters(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2)
    b = math.sin(math.radians(lng2 - lng1) / 2)
    h = a * a + b * b * math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))
    return 2 * V.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def refresh_step(rows: pd.DataFrame, origin: list | None) -> tuple[list, list | None]:
    """True where the user moved far enough from where fences were last chosen."""
    out = []
    for lat, lng in zip(rows["lat"].tolist(), rows["lng"].tolist()):
        moved = origin is None or _meters(origin[0], origin[1], lat, lng) >= V.FENCE_REFRESH_M
        if moved:
            origin = [lat, lng]
        out.append(moved)
    return out, origin


class RefreshSummary:
    """Re-picks of a piece of a user's positions as a function of where fences were last chosen.

    From a place that is near the first position, the next re-pick falls within the first rows, up
    to one twice as far away as asked: that one is far enough from any such place. Each of these rows
    is followed as if fences were chosen there; those that come together go on as one. A piece that
    stays around its first position changes nothing. Where the first rows are too many (someone
    who wanders about), the summary cannot tell.
    """

    FOLLOWED = 32

    def __init__(self):
        self.rows: list[tuple[float, float]] = []  # where the next re-pick can fall
        self.ends: list[tuple[tuple[float, float], list[int]]] = []  # last re-pick, for which of the rows
        self.reach = 0.0  # of all positions, from the first one
        self.open, self.crowded = True, False

    def add(self, rows: pd.DataFrame) -> None:
        for here in zip(rows["lat"].tolist(), rows["lng"].tolist()):
            away = _meters(*self.rows[0], *here) if self.rows else 0.0
            self.reach = max(self.reach, away)
            moved = [e for e in self.ends if _meters(*e[0], *here) >= V.FENCE_REFRESH_M]
            come = [i for _, own in moved for i in own]
            if self.open:
                come.append(len(self.rows))
                self.rows.append(here)
                self.open = away < 2 * V.FENCE_REFRESH_M + 1
            if come:
                self.ends = [e for e in self.ends if e not in moved] + [(here, come)]
            if self.open and len(self.rows) > self.FOLLOWED:
                self.open, self.crowded = False, True
                self.rows = self.rows[:1]
                self.ends = [(at, [0]) for at, own in self.ends if 0 in own]

    def done(self) -> list:
        end = {i: at for at, own in self.ends for i in own}
        return [self.reach, self.crowded, [[*row, *end[i]] for i, row in enumerate(self.rows)]]

    @staticmethod
    def follow(summary: list, state: list | None) -> list | None:
        reach, crowded, rows = summary
        if state is None:
            return rows[0][2:]
        away = _meters(*state, *rows[0][:2])
        if away >= V.FENCE_REFRESH_M:
            return rows[0][2:]
        if away + reach < V.FENCE_REFRESH_M - 1:
            return state
        if crowded:
            return UNKNOWN
        return next((r[2:] for r in rows if _meters(*state, *r[:2]) >= V.FENCE_REFRESH_M), state)


def fence_refreshes(positions: DataFrame, pieces: int | None = None) -> DataFrame:
    """Positions with a ``refresh`` flag, per user in time order."""
    known = positions.where("lat IS NOT NULL AND lng IS NOT NULL")
    return ordered_fold(
        known, ["user_id"], ["ts", "pos_id"], refresh_step,
        StructField("refresh", BooleanType()), RefreshSummary, pieces,
    )


def in_quiet_hours(minutes: Column) -> Column:
    """[22:00, 08:00) local, wrapping over midnight."""
    lo, hi = F.lit(V.QUIET_FROM_MINUTES), F.lit(V.QUIET_TO_MINUTES)
    return F.when(lo < hi, (minutes >= lo) & (minutes < hi)).otherwise(
        (minutes >= lo) | (minutes < hi)
    )


def decide(at_ms: int, quiet: bool, matches: int, entered: int, notified: int | None) -> str:
    """The first reason not to notify, or ``notify``."""
    if matches <= 0:
        return "nothing_to_show"
    if at_ms - entered < V.MIN_DWELL_MS:
        return "dwell_too_short"
    if notified is not None and at_ms - notified < V.COOLDOWN_MS:
        return "cooldown"
    return "quiet_hours" if quiet else NOTIFY


def notify_decision(
    now_ms: Column, entered_ms: Column, notified_ms: Column, quiet: Column, matches: Column
) -> Column:
    """The same decision as one expression, where state is already on the row."""
    return (
        F.when(matches <= 0, "nothing_to_show")
        .when(now_ms - entered_ms < V.MIN_DWELL_MS, "dwell_too_short")
        .when(F.coalesce(now_ms - notified_ms < V.COOLDOWN_MS, F.lit(False)), "cooldown")
        .when(quiet, "quiet_hours")
        .otherwise(NOTIFY)
    )


def visit(
    kind: str, at_ms: int, quiet: bool, matches: int, entered: int | None, notified: int | None
) -> tuple[str | None, int | None, int | None]:
    """One enter or exit: its decision (none for an exit) and when the user entered and was notified.

    Entering again while inside keeps the clock; leaving clears it but keeps the
    time of the last notification, so the cooldown survives.
    """
    if kind == "exit":
        return None, None, notified
    entered = at_ms if entered is None else entered
    decision = decide(at_ms, quiet, matches, entered, notified)
    return decision, entered, at_ms if decision == NOTIFY else notified


def visit_step(rows: pd.DataFrame, state: list | None) -> tuple[list, list | None]:
    """Walk enter/exit events. State: [entered_ms or None, notified_ms or None]."""
    entered, notified = state or (None, None)
    out = []
    for kind, at_ms, quiet, matches in zip(
        rows["kind"].tolist(), rows["at_ms"].tolist(), rows["quiet"].tolist(),
        rows["match_count"].tolist(),
    ):
        decision, entered, notified = visit(kind, at_ms, quiet, matches, entered, notified)
        out.append(decision)
    return out, [entered, notified]


class VisitSummary:
    """Visits of a piece of one (user, fence) history as a function of when the user had entered
    and been notified before it.

    Up to its first exit a piece goes by the given entry, and what could be notified there by the
    time alone; after it everything is known but the cooldown. A notification at one place leads to
    the same last one whatever came before, so the function is a list of places where the first
    notification can fall, with the last one each leads to. Neighbours that lead to the same are
    one, and places beyond any entry and cooldown that can be given are left out.
    """

    def __init__(self):
        self.start = self.first = self.entered = None
        self.left = False  # there was an exit
        self.head: list[int] = []
        self.tail: list[int] = []

    def add(self, rows: pd.DataFrame) -> None:
        for kind, at_ms, quiet, matches in zip(
            rows["kind"].tolist(), rows["at_ms"].tolist(), rows["quiet"].tolist(), rows["match_count"].tolist()
        ):
            self.start = at_ms if self.start is None else self.start
            if kind == "exit":
                self.left, self.entered = True, None
                continue
            self.entered = at_ms if self.entered is None else self.entered
            if not self.left and self.first is None:
                self.first = at_ms
            if matches > 0 and not quiet:
                if not self.left:
                    self.head.append(at_ms)
                elif at_ms - self.entered >= V.MIN_DWELL_MS:
                    self.tail.append(at_ms)

    def done(self) -> list:
        times = self.head + self.tail
        last_from, j = list(times), len(times)
        for i in range(len(times) - 1, -1, -1):
            while j > i + 1 and times[j - 1] - times[i] >= V.COOLDOWN_MS:
                j -= 1
            if j < len(times) and times[j] - times[i] >= V.COOLDOWN_MS:
                last_from[i] = last_from[j]
        bound = max(self.start + V.COOLDOWN_MS, (self.first or self.start) + V.MIN_DWELL_MS)
        n = len(self.head)
        return [
            self.left, self.first, self.entered,
            _leads(self.head, last_from[:n], bound), _leads(self.tail, last_from[n:], bound),
        ]

    @staticmethod
    def follow(summary: list, state: list | None) -> list:
        left, first, inside, head, tail = summary
        entered, notified = state or (None, None)
        entered = first if entered is None else entered
        rested = -math.inf if notified is None else notified + V.COOLDOWN_MS
        stayed = math.inf if entered is None else max(rested, entered + V.MIN_DWELL_MS)
        ends = [end for at, end in head if at >= stayed][:1] or [end for at, end in tail if at >= rested][:1]
        return [inside if left else entered, ends[0] if ends else notified]


def _leads(times: list[int], ends: list[int], bound: int) -> list[list[int]]:
    """(last time, end) of neighbours with equal end, up to the first time at ``bound`` or later."""
    out: list[list[int]] = []
    for at, end in zip(times, ends):
        if out and out[-1][1] == end:
            out[-1][0] = at
        elif out and out[-1][0] >= bound:
            break
        else:
            out.append([at, end])
    return out


def with_clock(events: DataFrame) -> DataFrame:
    """``at_ms`` and ``quiet``, computed once outside the walk."""
    return events.withColumns(
        {
            "at_ms": F.unix_millis("ts"),
            "quiet": in_quiet_hours(timefn.local_minutes(F.col("ts"))),
        }
    )


def visit_decisions(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Enter events with ``decision``, per (user, fence) in time order."""
    walked = ordered_fold(
        with_clock(events), ["user_id", "fence_id"], ["ts", "event_id"], visit_step,
        StructField("decision", StringType()), VisitSummary, pieces,
    )
    return walked.where("kind = 'enter'")


def notification_text(
    place_name: Column, lines: Column, total: Column
) -> tuple[Column, Column]:
    """(title, body): the two best offers and how many more; null when none."""
    shown = F.slice(lines, 1, 2)
    joined = F.array_join(shown, " • ")
    rest = total - F.size(shown)
    title = F.when(total > 0, F.format_string(V.NOTIFY_TITLE, place_name))
    body = F.when(total > 0, F.when(rest > 0, F.format_string(V.NOTIFY_MORE, joined, rest)).otherwise(joined))
    return title, body


def notifications(ranked: DataFrame, programs: DataFrame, by: list[str]) -> DataFrame:
    """Message per place visit from ranked usable benefits.

    ``ranked`` holds ``by`` columns, ``place_name``, ``position``. A message is about the
    ``NOTIFY_TOP`` best offers of a visit: the two best are written out, the others counted.
    """
    names = programs.select(F.col("id").alias("program_id"), F.col("name").alias("_club"))
    line = F.format_string(
        V.NOTIFY_LINE,
        money.headline(F.col("type"), F.col("value")),
        F.col("merchant_name"),
        F.coalesce("_club", "program_id"),
    )
    with_line = ranked.join(names, "program_id", "left").withColumn("_line", line)

    def best(position: int) -> Column:
        return F.max(F.when(F.col("position") == position, F.col("_line")))

    grouped = with_line.groupBy(*by, "place_name").agg(
        best(1).alias("_one"), best(2).alias("_two"),
        F.count_if(F.col("position") <= V.NOTIFY_TOP).cast("int").alias("_n"),
    )
    lines = F.array_compact(F.array("_one", "_two"))
    title, body = notification_text(F.col("place_name"), lines, F.col("_n"))
    return grouped.select(*by, title.alias("title"), body.alias("body"))


def enter_matches(
    events: DataFrame, places: DataFrame, owned: DataFrame, muted: DataFrame, benefits: DataFrame
) -> DataFrame:
    """Usable benefits at the place a user enters, as they stand at that moment, whatever the
    channel: ``event_id``, ``fence_id`` and the columns ranking and messages need.

    ``places``: (fence_id, merchant_id). A written table, as it is counted and ranked."""
    contexts = events.where("kind = 'enter'").join(places.distinct(), "fence_id").select(
        F.col("event_id").alias("ctx_id"), "user_id", "fence_id", F.col("ts").alias("now"), "merchant_id",
        F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("cart_amount"),
    )
    usable = rank.candidates(contexts, owned, benefits, muted=muted)
    return written(
        usable.select(
            F.col("ctx_id").alias("event_id"), "fence_id", "readiness", "saving", "age_days",
            "benefit_seq", "benefit_id", "type", "value", "merchant_name", "program_id",
        ),
        "enter-matches",
    )


def with_match_counts(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events with ``match_count``: the benefits of the place that are usable now."""
    counts = matches.groupBy("event_id").agg(F.count(F.lit(1)).alias("match_count"))
    return events.join(counts, "event_id", "left").withColumn(
        "match_count", F.coalesce("match_count", F.lit(0).cast("bigint"))
    )


def enter_messages(decisions: DataFrame, matches: DataFrame, venues: DataFrame, programs: DataFrame) -> DataFrame:
    """Message of every notified enter event, from its ``NOTIFY_TOP`` best benefits.

    ``decisions``: event_id, decision; ``venues``: id, name."""
    notified = decisions.where(F.col("decision") == NOTIFY).select("event_id")
    top = rank.rank(matches.join(notified, "event_id", "left_semi"), V.NOTIFY_TOP, ["event_id"])
    named = top.join(
        venues.select(F.col("id").alias("fence_id"), F.col("name").alias("place_name")), "fence_id"
    )
    return notifications(named, programs, ["event_id"])
