"""Working the review queue and publishing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.timefn import utc_text
from perkloom.operators.ingest import merge_benefits


@dataclass(frozen=True)
class Rule:
    """A class of offers an operator is ready to approve."""

    type: str | None = None
    program: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_confidence: float | None = None

    def condition(self) -> Column:
        tests = [
            self.type is not None and F.col("type") == self.type,
            self.program is not None and F.col("program_id") == self.program,
            self.min_value is not None and F.col("value") >= self.min_value,
            self.max_value is not None and F.col("value") <= self.max_value,
            self.min_confidence is not None and F.col("confidence_score") >= self.min_confidence,
        ]
        given = [t for t in tests if t is not False]
        if not given:
            raise ValueError("a rule needs at least one criterion")
        out = given[0]
        for test in given[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))


def preview(queue: DataFrame, rule: Rule, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Dry run: (how many match of how many, the first few)."""
    hit = rule.condition()
    counts = queue.agg(F.count_if(hit).alias("matching"), F.count(F.lit(1)).alias("queued"))
    return counts, queue.where(hit).orderBy("seq").limit(limit)


def _approve(benefits: DataFrame, rows: DataFrame) -> DataFrame:
    return merge_benefits(benefits, rows.withColumn("reviewed_by_human", F.lit(True)))


def apply_rule(benefits: DataFrame, queue: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(catalog with the matching rows approved, what stays queued)."""
    hit = queue.where(rule.condition())
    left = queue.join(hit.select("id"), "id", "left_anti")
    return _approve(benefits, hit), left


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows with ``outcome``: approved, kept or dropped.

    ``decisions``: (id, answer). ``a`` approves, ``s`` skips, ``q`` stops there and
    keeps everything from that row on; any other answer, or none, drops the row.
    """
    answered = queue.join(decisions, "id", "left")
    quit_at = answered.where("answer = 'q'").select(F.min("seq")).scalar()
    return answered.withColumn(
        "outcome",
        F.when(F.coalesce(F.col("seq") >= quit_at, F.lit(False)), "kept")
        .when(F.col("answer") == "a", "approved")
        .when(F.col("answer") == "s", "kept")
        .otherwise("dropped"),
    )


def apply_decisions(
    benefits: DataFrame, queue: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    out = decided(queue, decisions)
    approved = out.where("outcome = 'approved'").drop("answer", "outcome")
    return _approve(benefits, approved), out.where("outcome = 'kept'").select(*queue.columns)


def publish(generated: DataFrame, queue: DataFrame, shipped: DataFrame) -> DataFrame:
    """Every row of the three tables with what publishing does to it (``action``).

    A queued id is blocked and, if shipped before, withdrawn; other generated rows
    replace the shipped ones; of rows that repeat an id the last one counts (by ``seq``, or by
    content where there is none). One aggregation over the tagged union, so no table is
    joined and a repeated id costs one row per task. Nothing generated is an error: it would
    pass a failed run for a catalog that did not change.
    """
    if generated.isEmpty():
        raise ValueError("nothing was generated; the shipped catalog is left alone")
    row = F.struct(*generated.columns)
    none = F.lit(None).cast(generated.schema)

    def tag(df: DataFrame, new: Column, old: Column, queued: bool) -> DataFrame:
        return df.select("id", new.alias("new"), old.alias("old"), F.lit(queued).alias("q"))

    tagged = (
        tag(generated, row, none, False)
        .unionByName(tag(shipped, none, row, False))
        .unionByName(tag(queue, none, none, True))
    )
    in_order = "seq" in generated.columns

    def place(side: str) -> Column:
        own = F.struct(F.col(side)["seq"] if in_order else F.lit(0), F.xxhash64(F.to_json(side)))
        return F.when(F.col(side).isNotNull(), own)

    one = tagged.groupBy("id").agg(
        F.max_by("new", place("new")).alias("new"),
        F.max_by("old", place("old")).alias("old"),
        F.max("q").alias("q"),
    )
    has_new, has_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    same = F.to_json("new") == F.to_json("old")
    return one.withColumn(
        "action",
        F.when(F.col("q") & has_old, "withdrawn")
        .when(F.col("q") & has_new, "blocked")
        .when(F.col("q"), "queued")
        .when(has_new & ~has_old, "added")
        .when(has_new & same, "unchanged")
        .when(has_new, "updated")
        .otherwise("kept"),
    )


def shipped_after(published: DataFrame) -> DataFrame:
    """The catalog once the publish went through."""
    live = published.where("NOT q").withColumn("row", F.coalesce("new", "old"))
    return live.where("row IS NOT NULL").select("row.*", "action")


def publish_report(published: DataFrame) -> DataFrame:
    """One row: generated, in review, blocked, added, updated, unchanged, withdrawn,
    catalog size before and after."""
    has_new, has_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    n = lambda test, name: F.count_if(test).alias(name)
    action = F.col("action")
    return published.agg(
        n(has_new, "generated"),
        n(F.col("q"), "in_review"),
        n(F.col("q") & has_new, "blocked"),
        n(action == "added", "added"),
        n(action == "updated", "updated"),
        n(action == "unchanged", "unchanged"),
        n(action == "withdrawn", "withdrawn"),
        n(has_old, "before"),
        n(~F.col("q") & (has_new | has_old), "after"),
    )


def review_sheet(queue: DataFrame) -> DataFrame:
    """The thirteen flat columns of the review export, the costliest rows first."""
    b = queue
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return b.select(
        F.col("program_id").alias("program"),
        F.col("merchant_name").alias("merchant"),
        F.when(F.col("merchant_id").startswith(V.UNMAPPED_PREFIX), "no").otherwise("yes").alias(
            "merchant_mapped"
        ),
        "type",
        "value",
        F.col("confidence_score").alias("confidence"),
        F.col("reason").alias("why"),
        blank(utc_text(F.col("valid_until"))).alias("valid_until"),
        blank(F.col("conditions.min_spend")).alias("min_spend"),
        blank(F.col("conditions.channel")).alias("channel"),
        blank(F.col("conditions.requires_voucher")).alias("requires_voucher"),
        F.col("conditions.raw_text_summary").alias("source_text"),
        "source_url",
    ).orderBy(F.col("value").desc(), "program")
