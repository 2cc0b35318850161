"""A whole ingest run: offers that were read to the next catalog and queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.operators import ingest
from perkloom.session import written


@dataclass(frozen=True)
class Run:
    benefits: DataFrame
    queue: DataFrame
    quarantine: DataFrame
    outcomes: DataFrame  # what ``ingest.run_report`` counts
    observed: dict[str, Observation]  # figures of the stages, taken while they were written


def ingest_offers(
    extracted: DataFrame,
    merchants: DataFrame,
    stored: DataFrame,
    queue: DataFrame,
    now: Column,
    threshold: float = V.MIN_CONFIDENCE,
    order: str = "line_no",
    calls: DataFrame | None = None,
) -> Run:
    """Validate, identify, gate and merge.

    Offers a human approved with these very terms skip the gate and only refresh
    their date; everything else is published or queued by confidence. ``calls``: what reading the
    pages took, a row per page (program_id, input_tokens, output_tokens); it goes into the report.
    """
    valid, quarantine = ingest.split_valid(extracted)
    observed = {name: Observation(name) for name in ("extracted", "to_gate", "published")}
    count = F.count(F.lit(1)).alias("rows")
    # Used by several outputs each: written where a stage ends, not planned again. What is
    # written is counted on its way. Rows are written once, with the mark that splits them.
    stored = written(stored, "stored")
    names = written(ingest.merchant_names(merchants), "merchant-names")
    known = written(ingest.approved_terms(stored), "approved")
    marked = ingest.mark_approved(ingest.to_benefits(valid, merchants, now, names), known)
    rows = written(
        marked.observe(observed["extracted"], count, F.sum("confidence_score").alias("confidence"))
        .observe(observed["to_gate"], F.count_if(~F.col("_approved")).alias("rows")), "rows",
    )
    approved, to_gate = ingest.split_marked(rows)
    sure, unsure = ingest.gate(to_gate, threshold)
    benefits = written(
        ingest.merge_benefits(stored, approved.unionByName(sure), order).observe(observed["published"], count), "benefits"
    )
    tokens = ("input_tokens", "output_tokens")
    named = lambda df, kind: df.select(
        "program_id", F.lit(kind).alias("kind"),
        *[(F.col(t) if kind == "scraped" else F.lit(0)).cast("bigint").alias(t) for t in tokens],
    )
    outcomes = (
        named(rows, "extracted").unionByName(named(approved, "published")).unionByName(named(sure, "published"))
        .unionByName(named(unsure, "queued")).unionByName(named(quarantine, "failed"))
    )
    if calls is not None:
        outcomes = outcomes.unionByName(named(calls, "scraped"))
    reviewed = unsure.withColumnRenamed("confidence_reason", "reason")
    return Run(
        benefits=benefits,
        queue=ingest.merge_queue(queue, reviewed, to_gate, benefits, order),
        quarantine=quarantine,
        outcomes=outcomes,
        observed=observed,
    )
