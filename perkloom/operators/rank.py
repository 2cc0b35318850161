"""From contexts and a catalog to ranked benefits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import money
from perkloom.operators import conditions
from perkloom.operators.conditions import DEFAULT_POLICY, Policy
from perkloom.operators.skew import hot_splits, skew_join


def catalog_side(benefits: DataFrame) -> DataFrame:
    """Catalog columns under the names evaluation uses."""
    return benefits.withColumnsRenamed({"id": "benefit_id", "seq": "benefit_seq"})


def publishable(benefits: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Rows no context can rule in are dropped before any join."""
    return benefits.where(
        (F.col("confidence_score") >= policy.min_confidence) | F.col("reviewed_by_human")
    )


def with_programs(contexts: DataFrame, owned: DataFrame, muted: DataFrame | None = None) -> DataFrame:
    """One row per context and program its user holds; with ``muted``, also the user's muted
    benefits as ``_muted``.

    A user holds at most as many programs as exist, so they travel as one short
    array per user and the join is a lookup; adaptive execution splits the contexts
    of a user who has very many.
    """
    held = owned.groupBy("user_id").agg(F.collect_set("program_id").alias("_held"))
    if muted is not None:
        silent = muted.groupBy("user_id").agg(F.collect_set("benefit_id").alias("_muted"))
        held = held.join(silent, "user_id", "left")
    return contexts.join(held, "user_id").withColumn("program_id", F.explode("_held")).drop("_held")


def mark_muted(pairs: DataFrame, muted: DataFrame) -> DataFrame:
    """``muted`` flag from (user_id, benefit_id)."""
    marks = muted.select("user_id", "benefit_id").distinct().withColumn("muted", F.lit(True))
    return pairs.join(marks, ["user_id", "benefit_id"], "left").withColumn(
        "muted", F.coalesce("muted", F.lit(False))
    )


def drop_muted(pairs: DataFrame, muted: DataFrame) -> DataFrame:
    return pairs.join(muted.select("user_id", "benefit_id"), ["user_id", "benefit_id"], "left_anti")


def candidates(
    contexts: DataFrame,
    owned: DataFrame,
    benefits: DataFrame,
    policy: Policy = DEFAULT_POLICY,
    muted: DataFrame | None = None,
    **bounds,
) -> DataFrame:
    """Usable (context, benefit) pairs at the context's merchant, less the ``muted`` ones.

    Ownership is part of the join key, so a pair the user could never redeem is
    not produced at all; ``owned`` is therefore true on every row. What a user has muted
    comes along with the programs, so pairs are not shuffled for it. A merchant may
    be crowded with carts, with benefits or with both: its rows are split.
    """
    offers = publishable(benefits, policy)
    pairs = skew_join(
        with_programs(conditions.timed(contexts, policy), owned, muted),
        catalog_side(offers),
        ["merchant_id", "program_id"],
        ["ctx_id"],
        ["benefit_id"],
        hot_splits(contexts, benefits, ["merchant_id"], **bounds),
        int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    if muted is not None:
        silent = F.coalesce(F.array_contains("_muted", F.col("benefit_id")), F.lit(False))
        pairs = pairs.where(~silent).drop("_muted")
    marked = pairs.withColumns({"owned": F.lit(True), "muted": F.lit(False)})
    return conditions.usable(marked, policy)


def rank_order() -> list:
    return ["readiness", F.col("saving").desc(), "age_days", "benefit_seq"]


def rank(evaluated: DataFrame, limit: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Position per context: nothing left to do first, then the larger saving,
    then the fresher row, then catalog order.

    With a limit Spark keeps only the best ``limit`` rows per context before the
    shuffle (WindowGroupLimit), so a crowded context does not travel whole.
    """
    window = Window.partitionBy(*(by or ["ctx_id"])).orderBy(*rank_order())
    ranked = evaluated.withColumn("position", F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def top_benefits(
    contexts: DataFrame,
    owned: DataFrame,
    muted: DataFrame,
    benefits: DataFrame,
    limit: int,
    policy: Policy = DEFAULT_POLICY,
    **bounds,
) -> DataFrame:
    """The best ``limit`` usable benefits of every context."""
    return rank(candidates(contexts, owned, benefits, policy, muted, **bounds), limit)


def split_ready(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nothing left to do, something left to do)."""
    return evaluated.where("n_actions = 0"), evaluated.where("n_actions > 0")


def describe(
    ranked: DataFrame, merchants: DataFrame, programs: DataFrame, limit: int = V.CANDIDATE_LIMIT
) -> DataFrame:
    """The flat facts handed to a downstream answerer, for the top of each list."""
    top = conditions.explain(ranked.where(F.col("position") <= limit))
    m = merchants.select(F.col("id").alias("merchant_id"), "categories")
    p = programs.select(F.col("id").alias("program_id"), F.col("name").alias("_club"))
    return (
        top.join(m, "merchant_id", "left")
        .join(p, "program_id", "left")
        .select(
            "ctx_id",
            "position",
            "benefit_id",
            F.col("merchant_name").alias("merchant"),
            F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
            F.coalesce("_club", "program_id").alias("club"),
            money.offer_text(F.col("type"), F.col("value")).alias("offer"),
            F.floor(F.col("saving") + 0.5).cast("bigint").alias("estimated_saving_ils"),
            "is_estimate",
            (F.col("n_actions") == 0).alias("ready_now"),
            F.col("conditions.raw_text_summary").alias("terms"),
            F.transform(
                "gates",
                lambda g: F.concat(g.label, F.lit(": "), g.detail, F.lit(" ["), g.state, F.lit("]")),
            ).alias("conditions"),
        )
    )


def guard_answers(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """Keep an answer's ids only when they were among the candidates sent.

    ``answers``: (ctx_id, best_benefit_id, runner_up_id). An id that was not sent
    becomes null; so does a runner-up equal to the best.
    """
    ids = sent.select("ctx_id", "benefit_id").distinct()
    best = ids.select("ctx_id", F.col("benefit_id").alias("best_benefit_id"), F.lit(True).alias("_b"))
    second = ids.select("ctx_id", F.col("benefit_id").alias("runner_up_id"), F.lit(True).alias("_r"))
    joined = answers.join(best, ["ctx_id", "best_benefit_id"], "left").join(
        second, ["ctx_id", "runner_up_id"], "left"
    )
    best_id = F.when(F.col("_b"), F.col("best_benefit_id"))
    return joined.select(
        "ctx_id",
        best_id.alias("best_benefit_id"),
        F.when(
            F.col("_r") & ~F.col("runner_up_id").eqNullSafe(best_id), F.col("runner_up_id")
        ).alias("runner_up_id"),
    )
