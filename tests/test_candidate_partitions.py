"""Few short rows of carts and offers make many pairs, so their join keeps its partitions."""

from __future__ import annotations

from perkloom.operators import rank
from perkloom.plans.domain import Domain


def test_pairs_keep_their_partitions(spark, sf_dir):
    d = Domain(spark, sf_dir)
    plan = rank.candidates(d.contexts, d.owned, d.benefits, muted=d.muted)._jdf.queryExecution().sparkPlan().toString()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    kept = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert sum(f", {parts}), REPARTITION_BY_NUM" in line and "merchant_id" in line for line in kept) == 2
