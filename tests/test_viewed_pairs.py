"""Opened benefits are not shuffled again for what their user holds and has muted."""

from __future__ import annotations

import re

from perkloom.operators import rank
from perkloom.plans import benefit_queries
from perkloom.plans.domain import Domain


def test_flags_come_with_the_cart(spark, sf_dir):
    d = Domain(spark, sf_dir)
    pairs = benefit_queries._viewed_pairs(d)
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any(re.search(r"user_id#\d+", j) and re.search(r"(program|benefit)_id#\d+", j) for j in joins)
    held = {tuple(r) for r in d.owned.collect()}
    silent = {tuple(r) for r in d.muted.select("user_id", "benefit_id").collect()}
    rows = pairs.select("user_id", "program_id", "benefit_id", "owned", "muted").collect()
    assert {r.owned for r in rows} == {True, False}
    for r in rows:
        assert r.owned == ((r.user_id, r.program_id) in held) and r.muted == ((r.user_id, r.benefit_id) in silent)
    assert len(rows) == d.viewed.join(rank.catalog_side(d.benefits), "benefit_id").join(d.contexts, "ctx_id").count()
