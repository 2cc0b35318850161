"""Offers valid everywhere are asked once per situation, and thinning shuffles a cart's offers a fixed number of times."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.helpers import benefit, catalog, utc
from perkloom.operators import combos, conditions, rank


def _tables(spark):
    rnd = random.Random(3)
    rows = [
        benefit(
            seq, {"stacks_with_club": rnd.choice([True, True, None, False]), "min_spend": rnd.choice([None, 0.0, 90.0, 400.0]),
                  "max_discount": rnd.choice([None, 20.0]), "channel": rnd.choice([None, "online", "in_store"]),
                  "valid_hours": rnd.choice([None, {"from": "09:00", "to": "14:00"}])},
            program_id=rnd.choice("pqr"), merchant_id=rnd.choice(["s1", "s2", "any_merchant", "any_merchant"]),
            type=rnd.choice(["percent", "fixed", "cashback", "bogo"]), value=float(rnd.choice([5, 10, 20, 60])),
        )
        for seq in range(1, 120)
    ]
    n = F.col("id")
    contexts = spark.range(90).select(
        n.alias("ctx_id"), (n % 5).alias("user_id"), F.when(n % 2 == 0, "s1").otherwise("s2").alias("merchant_id"),
        F.when(n % 3 == 0, F.lit(utc("2026-08-02T10:00:00Z"))).otherwise(F.lit(utc("2026-08-03T17:30:00Z"))).alias("now"),
        F.when(n % 4 == 0, "online").alias("channel"),
        F.when(n % 7 == 0, F.lit(None)).otherwise((n % 3) * 100.0).cast("double").alias("cart_amount"),
    )
    owned = spark.createDataFrame([(u, p) for u in range(5) for p in "pqr"[u % 2:]], "user_id bigint, program_id string")
    muted = spark.createDataFrame([(u, f"b{s}") for u in (1, 2) for s in range(1, 120, 4)], "user_id bigint, benefit_id string")
    return contexts, owned, muted, catalog(spark, *rows)


def test_situations_answer_as_pairing_every_cart(spark):
    contexts, owned, muted, benefits = _tables(spark)
    met = contexts.withColumnRenamed("merchant_id", "_shop").join(owned, "user_id").join(rank.catalog_side(benefits), "program_id")
    met = met.where("merchant_id IN (_shop, 'any_merchant')").withColumns({"owned": F.lit(True), "muted": F.lit(False)})
    evaluated = rank.drop_muted(conditions.usable(met), muted)
    for limit in (1, 4):
        columns = ["ctx_id", "position", "first_id", "second_id", "combo_saving", "confirmed", "merchant_name"]
        want = combos.best_combos(evaluated, limit).select(*columns).collect()
        got = combos.top_combos(contexts, owned, muted, benefits, limit, piece_rows=7).select(*columns).collect()
        assert sorted(got) == sorted(want) and len(want) > 40


def test_layers_of_thinning_share_their_shuffles(spark):
    contexts, owned, _, benefits = _tables(spark)
    evaluated = rank.candidates(contexts, owned, benefits)
    def shuffles(limit):
        thinned = combos._thin(combos._combinable(evaluated), limit, "merchant_id")
        return thinned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(2) == shuffles(6)
