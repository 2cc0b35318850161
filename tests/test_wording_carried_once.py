"""An ingest run compares wording by a mark and writes the offers it read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.helpers import benefit, catalog
from tests.test_catalog_life import NOW, merchants, offer, offers
from perkloom.operators import ingest
from perkloom.plans import catalog_run
from perkloom.session import written


def test_terms_are_as_long_as_a_mark(spark):
    long = "only on weekdays " * 5_000
    rows = catalog(spark, benefit(1, {"raw_text_summary": long}), benefit(2, {"raw_text_summary": long + "."}), benefit(3))
    marks = [r[0] for r in rows.select(ingest.terms()).collect()]
    assert len(set(marks)) == 3 and max(map(len, marks)) <= 64


def test_repeated_approvals_do_not_repeat_an_offer(spark):
    stored = catalog(spark, *[benefit(1, reviewed_by_human=True)] * 3, benefit(2, reviewed_by_human=False))
    found = catalog(spark, benefit(1), benefit(1, value=99.0), benefit(2), benefit(3))
    approved, to_gate = ingest.split_approved(found, stored)
    assert [r.id for r in approved.collect()] == ["b1"]
    assert sorted((r.id, r.value == 99.0) for r in to_gate.collect()) == [("b1", True), ("b2", False), ("b3", False)]


def test_offers_are_written_once(spark, monkeypatch):
    made = []
    real = catalog_run.written
    monkeypatch.setattr(catalog_run, "written", lambda df, name: made.append(name) or real(df, name))
    rows = offers(spark, offer(1), offer(2, confidence_score=0.5), offer(3, confidence_score=0.5))
    base = ingest.to_benefits(offers(spark), merchants(spark), F.lit(NOW)).drop("line_no")
    queue = base.withColumnRenamed("confidence_reason", "reason")
    run = catalog_run.ingest_offers(rows, merchants(spark), base.drop("confidence_reason"), queue, F.lit(NOW))
    assert sorted(made) == ["approved", "benefits", "merchant-names", "rows", "stored"]
    assert (run.observed["extracted"].get["rows"], run.observed["to_gate"].get["rows"]) == (3, 3)


def test_offers_stay_where_they_are_to_find_few_merchants(spark, monkeypatch):
    rows = offers(
        spark, offer(1), offer(2, merchant_name=" C-UPS"), offer(3, merchant_name="none"), offer(4, merchant_name=None)
    )
    names = written(ingest.merchant_names(merchants(spark)), "merchant-names")
    sent = ingest.resolve_merchants(rows, merchants(spark), names)
    found = lambda df: {r.line_no: r.merchant_id for r in df.collect()}
    assert found(sent) == found(ingest.resolve_merchants(rows, merchants(spark)))
    assert "hashpartitioning" not in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ingest, "NAMES_SENT", 1)
    assert found(ingest.resolve_merchants(rows, merchants(spark), names)) == found(sent)
