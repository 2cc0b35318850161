from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from perkloom.operators import ingest, numbering, proof, quality, review
from perkloom.plans.catalog_run import ingest_offers
from perkloom.schemas import EXTRACTED
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tests.helpers import EMPTY, benefit, catalog, utc

NOW = utc("2026-08-02T10:00:00Z")
OFFER = StructType(
    [StructField("line_no", LongType()), StructField("program_id", StringType()), *EXTRACTED.fields]
)


def offer(line_no, conditions=None, **over):
    row = {
        "line_no": line_no, "program_id": "riders", "merchant_name": "Tea Leaf", "type": "percent",
        "value": 10.0, "source_url": None, "valid_from": None, "valid_until": None,
        "confidence_score": 0.93, "confidence_reason": "ברור",
        "conditions": {**EMPTY, "raw_text_summary": "תנאים", **(conditions or {})},
    }
    return {**row, **over}


def offers(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in OFFER.fields) for r in rows], OFFER)


def merchants(spark):
    return spark.createDataFrame(
        [("tea_leaf", "Tea-Leaf", 1), ("cups", "CUPS", 2), ("cups2", "cups", 3)],
        "id string, name string, seq int",
    )


def test_offers_become_benefits(spark):
    rows = ingest.to_benefits(
        offers(
            spark, offer(1, valid_until="2026-12-31"), offer(2, merchant_name=" C-UPS"),
            offer(3, merchant_name="חנות חדשה"), offer(4, value=15.0), offer(5),
        ).withColumn("run_url", F.lit("https://run")),
        merchants(spark), F.lit(NOW),
    ).withColumn("end_ms", F.unix_millis("valid_until")).orderBy("line_no").collect()
    assert [r.merchant_id for r in rows] == [
        "tea_leaf", "cups", "unmapped_חנות_חדשה", "tea_leaf", "tea_leaf",
    ]
    assert rows[0].id == rows[4].id != rows[3].id
    assert rows[0].id.startswith("riders_tea_leaf_") and len(rows[0].id) == len("riders_tea_leaf_") + 12
    assert rows[0].source_url == "https://run" and not rows[0].reviewed_by_human
    assert rows[0].end_ms == round(utc("2026-12-31T21:59:59.999Z").timestamp() * 1000)


def test_bad_offers_are_quarantined(spark):
    _, bad = ingest.split_valid(
        offers(
            spark, offer(1), offer(2, {"valid_days": [0]}), offer(3, {"valid_days": []}),
            offer(4, {"valid_hours": {"from": "8am", "to": "12pm"}}), offer(5, value=-1.0),
            offer(6, value=140.0), offer(7, type="gift"), offer(8, {"max_discount": 0.0}),
            offer(9, valid_until="soon"), offer(10, {"raw_text_summary": ""}),
            offer(11, {"valid_hours": {"from": "08:00", "to": "23:59"}}, type="fixed", value=140.0),
        )
    )
    assert {r.line_no: r.faults for r in bad.collect()} == {
        2: ["valid_days"], 3: ["valid_days"], 4: ["valid_hours"], 5: ["value"],
        6: ["percent_over_100"], 7: ["type"], 8: ["max_discount"], 9: ["valid_until"],
        10: ["raw_text_summary"],
    }


def _sequential_merge(stored, incoming):
    by = {b["id"]: b for b in stored}
    for b in sorted(incoming, key=lambda b: b["seq"]):
        old = by.get(b["id"])
        if old is not None:
            same = (old["conditions"], old["value"], old["type"]) == (b["conditions"], b["value"], b["type"])
            b = {**b, "reviewed_by_human": old["reviewed_by_human"] if same else False}
        by[b["id"]] = b
    return {i: (b["value"], b["reviewed_by_human"], b["source_url"]) for i, b in by.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)

    def row(seq, url):
        return benefit(
            seq, {"min_spend": rnd.choice([None, 50.0])}, id=f"b{rnd.randint(0, 40)}",
            value=rnd.choice([10.0, 10.0, 20.0]), reviewed_by_human=rnd.random() < 0.6, source_url=url,
        )

    stored = list({r["id"]: r for r in (row(s, "old") for s in range(30))}.values())
    incoming = [row(s, f"new {s}") for s in range(100, 160)]
    got = ingest.merge_benefits(catalog(spark, *stored), catalog(spark, *incoming)).collect()
    assert {r.id: (r.value, r.reviewed_by_human, r.source_url) for r in got} == _sequential_merge(
        stored, incoming
    )


def _run(spark, rows, stored=None, queue=None):
    columns = [c for c in ingest.to_benefits(offers(spark), merchants(spark), F.lit(NOW)).columns
               if c not in ("line_no", "confidence_reason")]
    base = ingest.to_benefits(offers(spark), merchants(spark), F.lit(NOW))
    stored = stored if stored is not None else base.select(*columns)
    queue = queue if queue is not None else base.select(*columns, F.lit("").alias("reason"))
    run = ingest_offers(offers(spark, *rows), merchants(spark), stored.select(*columns), queue, F.lit(NOW))
    return run.benefits.checkpoint(), run.queue.checkpoint()


def test_review_survives_a_rerun(spark):
    unsure = offer(1, confidence_score=0.8)
    benefits, queue = _run(spark, [unsure, offer(2, confidence_score=0.8)])
    assert benefits.count() == 0 and queue.count() == 1  # two branches, one benefit
    approved, left = review.apply_rule(
        benefits, queue.withColumn("seq", F.lit(1)), review.Rule(type="percent")
    )
    assert left.count() == 0
    # The same offer again: still approved, not queued, date refreshed.
    benefits, queue = _run(spark, [unsure], approved.checkpoint())
    assert [r.reviewed_by_human for r in benefits.collect()] == [True] and queue.count() == 0
    # Other terms under the same id: back to review, the old row stays until then.
    changed = offer(1, {"min_spend": 99.0}, confidence_score=0.8)
    benefits2, queue2 = _run(spark, [changed], benefits)
    assert benefits2.count() == 1 and queue2.count() == 0  # an id is never in both
    sure = offer(1, {"min_spend": 99.0}, confidence_score=0.9)
    benefits3, _ = _run(spark, [sure], benefits)
    assert [r.reviewed_by_human for r in benefits3.collect()] == [False]


def test_rule_needs_a_criterion_and_decisions(spark):
    with pytest.raises(ValueError):
        review.Rule().condition()
    queue = catalog(spark, *[benefit(i, confidence_score=0.5) for i in range(1, 8)]).withColumn(
        "reason", F.lit("r")
    )
    decisions = spark.createDataFrame(
        [("b1", "a"), ("b2", "s"), ("b3", "r"), ("b5", "q"), ("b6", "a")], "id string, answer string"
    )
    stored = catalog(spark, benefit(9))
    catalog_, left = review.apply_decisions(stored, queue, decisions)
    assert {(r.id, r.reviewed_by_human) for r in catalog_.collect()} == {("b9", False), ("b1", True)}
    assert {r.id for r in left.collect()} == {"b2", "b5", "b6", "b7"}
    counts, first = review.preview(queue, review.Rule(min_value=5, program="riders"))
    assert tuple(counts.first()) == (7, 7) and first.first().id == "b1"


def test_publish_withdraws_what_is_back_in_review(spark):
    shipped = catalog(spark, benefit(1), benefit(2), benefit(3))
    generated = catalog(spark, benefit(2, value=12.0), benefit(3), benefit(4), benefit(5))
    queue = catalog(spark, benefit(1), benefit(5), benefit(6))
    out = review.publish(generated, queue, shipped).checkpoint()
    assert {r.id: r.action for r in out.collect()} == {
        "b1": "withdrawn", "b2": "updated", "b3": "unchanged", "b4": "added", "b5": "blocked",
        "b6": "queued",
    }
    assert {(r.id, r.value) for r in review.shipped_after(out).collect()} == {
        ("b2", 12.0), ("b3", 10.0), ("b4", 10.0),
    }
    assert review.publish_report(out).first().asDict() == {
        "generated": 4, "in_review": 3, "blocked": 1, "added": 1, "updated": 1, "unchanged": 1,
        "withdrawn": 1, "before": 3, "after": 3,
    }


RECORD = "line_no int, category string, offer_url string, content_hash string, verified_at timestamp"


def test_a_proof_counts_for_every_copy_of_a_link(spark):
    fresh, old = utc("2026-08-01T00:00:00Z"), utc("2026-07-01T00:00:00Z")
    records = spark.createDataFrame(
        [(1, "x", "u1", "h", None), (2, "y", "u1", "h", fresh), (3, "x", "u2", "h", None),
         (4, "x", "u3", "h", None), (5, "x", "u4", "h", old), (6, "x", "u5", "h", None)], RECORD,
    )
    verdicts = spark.createDataFrame(
        [("u2", "live", NOW), ("u3", "gone", NOW), ("u4", "unreachable", NOW), ("u5", "gone", old)],
        "offer_url string, state string, checked_at timestamp",
    )
    at = F.lit(NOW)
    out = proof.apply_verdicts(records, verdicts, at).checkpoint()
    assert {r.line_no: r.outcome for r in out.collect()} == {
        1: "proven", 2: "proven", 3: "live", 4: "removed", 5: "unproven", 6: "unproven",
    }
    assert tuple(proof.pass_verdict(out).first()) == (3, 1, 2, 60, False)
    assert {r.offer_url for r in proof.links_to_check(records, verdicts, at).collect()} == {"u4", "u5"}
    total = proof.coverage(out.where("outcome <> 'removed'")).where("category IS NULL").first()
    assert (total.total, total.verified, total.percent, total.passes_left) == (5, 4, 80, 1)
    nothing = proof.apply_verdicts(records.where("line_no = 6"), verdicts, at)
    assert proof.pass_verdict(nothing).first().failed


def test_proof_is_carried_only_when_nothing_changed(spark):
    seen = utc("2026-08-01T00:00:00Z")
    before = spark.createDataFrame([(1, "x", "u1", "h1", seen), (2, "x", "u2", "h2", seen)], RECORD)
    again = spark.createDataFrame(
        [(1, "x", "u1", "h1", None), (2, "x", "u2", "changed", None), (3, "x", "u3", "h3", None)], RECORD
    )
    got = {r.offer_url: r.verified_at is not None for r in proof.keep_verification(again, before).collect()}
    assert got == {"u1": True, "u2": False, "u3": False}


def test_row_numbers_over_a_crowded_key(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 9}", i) for i in range(60)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int")
    got = numbering.row_numbers(df, ["k"], ["i"], pieces=7).collect()
    by: dict = {}
    for k, i in sorted(rows):
        by.setdefault(k, []).append(i)
    assert {(r.k, r.i): r.n for r in got} == {
        (k, i): n for k, items in by.items() for n, i in enumerate(items, 1)
    }


def test_merchant_merge_keeps_every_list(spark):
    rows = [(1, "e", "old", ["b"]), (2, "e", "new", ["a"]), (3, "f", "x", ["c", "c"])]
    df = spark.createDataFrame(rows, "seq int, easy_id string, name string, lists array<string>")
    got = {r.easy_id: (r.name, r.lists) for r in proof.merge_merchants(df).collect()}
    assert got == {"e": ("new", ["a", "b"]), "f": ("x", ["c"])}


def test_violations_find_each_planted_fault(spark):
    benefits = catalog(
        spark, benefit(1), benefit(1), benefit(2, value=120.0), benefit(3, source_url="ftp://x"),
        benefit(4, program_id="nobody"), benefit(5, merchant_id="gone"),
        benefit(6, merchant_id="unmapped_x"), benefit(7, last_verified_at=None),
        benefit(8, {"valid_days": [9]}), benefit(9, type="odd"),
    )
    programs = spark.createDataFrame([("riders", "credit_card"), ("p", "club")], "id string, category string")
    merchants_ = spark.createDataFrame(
        [("tea_leaf",), ("lost",), ("any_merchant",)], "id string"
    )
    venues = spark.createDataFrame([("v", 35.0, 34.9, 20)], "id string, lat double, lng double, radius_m int")
    members = spark.createDataFrame([("tea_leaf", "nowhere")], "merchant_id string, venue_id string")
    branches = spark.createDataFrame([("tea_leaf", 52.0, 13.0)], "merchant_id string, lat double, lng double")
    domains = spark.createDataFrame([("tea_leaf", "https://a.il/x")], "merchant_id string, domain string")
    got = quality.violations(benefits, programs, merchants_, venues, members, branches, domains)
    assert {(r.table, r.id, r.rule) for r in got.collect()} == {
        ("benefits", "b1", "duplicate_id"), ("benefits", "b2", "percent_over_100"),
        ("benefits", "b3", "source_url"), ("benefits", "b4", "unknown_program"),
        ("benefits", "b5", "unknown_merchant"), ("benefits", "b7", "last_verified_at"),
        ("benefits", "b8", "valid_days"), ("benefits", "b9", "type"), ("programs", "p", "category"),
        ("venues", "v", "lat"), ("venues", "v", "radius"), ("merchants", "tea_leaf", "unknown_venue"),
        ("merchants", "tea_leaf", "domain"), ("merchants", "tea_leaf", "branch_outside"),
        ("merchants", "lost", "unreachable"),
    }
