"""What a place offers a user at a moment, without pairing every event with every offer.

Whoever enters a place has neither cart nor channel yet, so only time rules an offer out: its
interval, weekdays and hours. Offers of one place and program with the same weekdays and hours are
therefore added up to steps over time, filed under the local days they touch, and an event looks up
the steps of its day. For the best offers, each day keeps those of every program that
can still be among the best: an offer that enough others exceed at all its moments of that day cannot.
Both grow with the offers and with the events, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkloom.operators import conditions
from perkloom.operators.conditions import DEFAULT_POLICY, Policy
from perkloom.operators.rank import catalog_side, publishable, with_programs

DAY_MS = 86_400_000
# A local day is at most this far from whole where clocks change around midnight.
SLACK_US = 3 * 3_600_000_000


def _day(micros: Column, policy: Policy) -> Column:
    local = F.convert_timezone(None, F.lit(policy.zone), F.timestamp_micros(micros).cast("timestamp_ntz"))
    return local.cast("date")


def _on(days: Column, weekday: Column) -> Column:
    return days.isNull() | F.array_contains(days, weekday)


def _offers(places: DataFrame, benefits: DataFrame, policy: Policy) -> DataFrame:
    """Offers of every place with the interval in microseconds in which their dates rule them in:
    ``from_us`` (null: ever since) up to ``until_us``, not included."""
    stale = (F.unix_millis("last_verified_at") + policy.stale_days * DAY_MS + 1) * 1000
    dated = catalog_side(publishable(benefits, policy)).where("last_verified_at IS NOT NULL").withColumns(
        {"from_us": F.unix_micros("valid_from"), "until_us": F.least(stale, F.unix_micros("valid_until") + 1)}
    )
    # Opened benefits are misjudged before running: a catalog that does not fit would be sent whole.
    lasting = dated.where("from_us IS NULL OR from_us < until_us").hint("merge")
    return lasting.join(places.select("fence_id", "merchant_id").distinct(), "merchant_id")


def _by_weekday(weekday: Column) -> Column:
    return F.concat(F.lit("weekday "), weekday.cast("string"))


def usable_steps(places: DataFrame, benefits: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """(fence_id, program_id, filed, steps): how many offers dates and weekdays rule in.

    Each of ``steps`` is valid_hours, from_us (null: ever since), until_us (not included) and n. What
    has been so ever since is filed by weekday, all else by day."""
    return _steps(_timed_offers(places, benefits, policy), policy)


def _timed_offers(places: DataFrame, benefits: DataFrame, policy: Policy) -> DataFrame:
    return _offers(places, benefits, policy).select(
        "fence_id", "program_id", "benefit_id", "conditions.valid_days", "conditions.valid_hours", "from_us", "until_us")


def _steps(offers: DataFrame, policy: Policy) -> DataFrame:
    kind = ["fence_id", "program_id", "valid_days", "valid_hours"]
    changes = offers.select(*kind, F.explode(F.array(
        F.struct(F.col("from_us").alias("at"), F.lit(1).alias("change")),
        F.struct(F.col("until_us").alias("at"), F.lit(-1).alias("change")),
    )).alias("_c")).select(*kind, "_c.at", "_c.change").groupBy(*kind, "at").agg(F.sum("change").alias("change"))
    along = Window.partitionBy(*kind).orderBy(F.col("at").asc_nulls_first())
    steps = changes.select(
        *kind, F.col("at").alias("from_us"), F.lead("at").over(along).alias("until_us"), F.sum("change").over(along).alias("n")
    ).where("n > 0")
    weekdays = F.array(*[F.lit(w) for w in range(1, 8)])
    ever = steps.where("from_us IS NULL").withColumn("weekday", F.explode(weekdays)).withColumn(
        "filed", _by_weekday(F.col("weekday"))
    )
    touched = F.sequence(_day(F.col("from_us") - SLACK_US, policy), _day(F.col("until_us") + SLACK_US, policy))
    dated = steps.where("from_us IS NOT NULL").withColumn("_day", F.explode(touched)).select(
        *steps.columns, F.dayofweek("_day").alias("weekday"), F.col("_day").cast("string").alias("filed")
    )
    key, step = ["fence_id", "program_id", "filed"], ["valid_hours", "from_us", "until_us"]
    open_then = ever.unionByName(dated).where(_on(F.col("valid_days"), F.col("weekday")))
    added = open_then.groupBy(*key, *step).agg(F.sum("n").alias("n"))
    return added.groupBy(*key).agg(F.collect_list(F.struct(*step, "n")).alias("steps"))


def match_tables(
    places: DataFrame, owned: DataFrame, muted: DataFrame, benefits: DataFrame, policy: Policy = DEFAULT_POLICY,
    kept: Callable[[DataFrame, str], DataFrame] = lambda table, name: table,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What events are matched with: programs of a user, muted offers of a user at a place, ``usable_steps``.
    ``kept`` may write a table that several steps use, or that events meet."""
    offers, owned = kept(_timed_offers(places, benefits, policy), "enter-offers"), kept(owned, "enter-owned")
    held = owned.groupBy("user_id").agg(F.collect_set("program_id").alias("_held"))
    silent = (
        offers.join(muted.select("user_id", "benefit_id").distinct(), "benefit_id")
        .join(owned.select("user_id", "program_id").distinct(), ["user_id", "program_id"], "left_semi")
        .groupBy("user_id", "fence_id").agg(F.collect_list(F.struct(
            "valid_days", "valid_hours", "from_us", "until_us")).alias("_silent"))
    )
    return kept(held, "enter-held"), kept(silent, "enter-silent"), kept(_steps(offers, policy), "enter-steps")


def match_rows(
    events: DataFrame, places: DataFrame, owned: DataFrame, muted: DataFrame, benefits: DataFrame,
    policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """Rows of events whose ``match_count`` add up to the benefits that a user who enters can use at
    the place at that moment, whatever the channel: one per event (``is_match`` 0) that takes off the
    muted ones, and one more (``is_match`` 1) per program that has some.

    ``places``: (fence_id, merchant_id); ``events``: event_id, user_id, fence_id, kind, ts."""
    return matched(events, *match_tables(places, owned, muted, benefits, policy), policy)


def matched(
    events: DataFrame, held: DataFrame, silent: DataFrame, steps: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """``match_rows`` from the tables of ``match_tables``. Events may be a stream: they meet
    standing tables by joins and nothing else."""
    on_entering = events.withColumns({
        "_day": _day(F.unix_micros("ts"), policy), "_user": F.when(F.col("kind") == "enter", F.col("user_id")),
    })
    known = on_entering.join(held.withColumnRenamed("user_id", "_user"), "_user", "left").join(
        silent.withColumnRenamed("user_id", "_user"), ["_user", "fence_id"], "left"
    )
    filed = F.array(F.col("_day").cast("string"), _by_weekday(F.dayofweek("_day")))
    asks = F.flatten(F.transform("_held", lambda p: F.transform(
        filed, lambda f: F.struct(p.alias("program_id"), f.alias("filed")))))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("program_id"), F.lit(None).cast("string").alias("filed")))
    rows = known.withColumn("_ask", F.explode(F.concat(itself, F.coalesce(asks, F.slice(itself, 1, 0))))).withColumns(
        {"program_id": F.col("_ask.program_id"), "filed": F.col("_ask.filed"), "now": F.col("ts")}
    ).withColumn("is_match", F.col("filed").isNotNull().cast("int"))
    met = rows.join(steps, ["fence_id", "program_id", "filed"], "left")
    # The lambda's variable stands for the offer's conditions, which the checks read.
    found = conditions.findings(policy)
    then = "(conditions.from_us IS NULL OR conditions.from_us <= unix_micros(now)) AND unix_micros(now) < conditions.until_us"
    counted = F.expr(
        f"aggregate(filter(steps, conditions -> {then} AND NOT {found['wrong_hours']}), 0L, (sum, s) -> sum + s.n)")
    taken = F.expr(f"size(filter(_silent, conditions -> {then} AND NOT {found['wrong_day']} AND NOT {found['wrong_hours']}))")
    count = F.when(F.col("is_match") == 1, F.coalesce(counted, F.lit(0))).otherwise(-F.when(
        F.col("_silent").isNotNull(), taken).otherwise(0)).cast("bigint")
    return met.withColumn("match_count", count).where("is_match = 0 OR match_count > 0").select(
        "event_id", "user_id", "fence_id", "kind", "ts", "match_count", "is_match"
    )


def best_matches(
    events: DataFrame, places: DataFrame, owned: DataFrame, muted: DataFrame, benefits: DataFrame,
    limit: int, policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """Like ``fences.enter_matches``, for events where a user enters, with at least the ``limit`` best
    of each event but without most of the others."""
    local = {"channel": F.lit(None).cast("string"), "cart_amount": F.lit(None).cast("double")}
    days = events.select("fence_id", _day(F.unix_micros("ts"), policy).alias("_day")).distinct()
    offers = conditions.placed(_offers(places, benefits, policy).withColumns(local), policy).drop(*local)
    # An offer may start or end within a day, or is there from its beginning or to its end.
    day, start, end = F.col("_day"), F.col("from_us"), F.col("until_us")
    starts = F.coalesce(_day(start + SLACK_US, policy) >= day, F.lit(False))
    ends = _day(end - SLACK_US, policy) <= day
    there = (start.isNull() | (_day(start - SLACK_US, policy) <= day)) & (_day(end + SLACK_US, policy) >= day)
    daily = offers.join(days, "fence_id").where(there & _on(F.col("conditions.valid_days"), F.dayofweek(day))).withColumns({
        "_start": F.when(starts, start), "_end": F.when(ends, end), "_hours": F.col("conditions.valid_hours"),
        # Offers verified at the same time of day keep their order of age all day.
        "_clock": F.pmod(F.unix_millis("last_verified_at"), F.lit(DAY_MS)),
    })
    # A user's muted ones may be among the best: places are told, and a user with m of them reads m more.
    silent = muted.groupBy("user_id").agg(F.countDistinct("benefit_id").alias("_n"))
    most = limit + (silent.agg(F.max("_n")).first()[0] or 0)
    alike = ["fence_id", "program_id", "_day", "_hours", "_start", "_end"]
    better = Window.partitionBy(*alike).orderBy("readiness", F.col("saving").desc())
    fresher = Window.partitionBy(*alike, "readiness", "saving", "_clock").orderBy(
        F.col("last_verified_at").desc(), "benefit_seq")
    kept = daily.withColumn("_better", F.rank().over(better)).where(F.col("_better") <= most).withColumn(
        "_fresher", F.row_number().over(fresher)
    ).where(F.col("_fresher") <= most).withColumn("_place", F.greatest("_better", "_fresher")).drop(
        "_hours", "_start", "_end", "_clock", "_better", "_fresher", "from_us", "until_us", "readiness", "saving")
    asked = with_programs(events.select(
        F.col("event_id").alias("ctx_id"), "user_id", "fence_id", F.col("ts").alias("now"),
        _day(F.unix_micros("ts"), policy).alias("_day"),
    ), owned, muted).withColumns(local)
    own = F.when(F.col("_muted").isNotNull(), F.size("_muted")).otherwise(0)
    is_muted = F.coalesce(F.array_contains("_muted", F.col("benefit_id")), F.lit(False))
    pairs = asked.join(kept, ["fence_id", "program_id", "_day"]).where((F.col("_place") <= limit + own) & ~is_muted)
    usable = conditions.usable(pairs.withColumns({"owned": F.lit(True), "muted": F.lit(False)}), policy)
    return usable.select(
        F.col("ctx_id").alias("event_id"), "fence_id", "readiness", "saving", "age_days",
        "benefit_seq", "benefit_id", "type", "value", "merchant_name", "program_id",
    )
