"""Short rows that become a wide catalog are dealt out in every session, in pieces of a fixed size."""

from __future__ import annotations

from perkloom.plans import benefit_queries, domain
from perkloom.session import SPREAD_KEY


def test_pieces_grow_with_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setitem(domain.PIECE_ROWS, "part", 16)
    asked = spark.conf.get(SPREAD_KEY)
    spark.conf.set(SPREAD_KEY, "false")
    try:
        d = domain.Domain(spark, sf_dir)
        parts = d.table("part")
        n = parts.count()
        assert parts.rdd.getNumPartitions() == -(-n // 16) > 4
        assert d.table("supplier").rdd.getNumPartitions() == 1
        assert d.benefits.count() == 5 * n
    finally:
        spark.conf.set(SPREAD_KEY, asked)


def test_the_catalog_is_not_sent_whole_to_tasks_that_look_it_up(spark, sf_dir):
    lines = [
        line for query in (benefit_queries.saving_estimate, benefit_queries.eval_status)
        for line in query(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString().splitlines()
        if "Join" in line and "benefit_id#" in line.split("], [")[0]
    ]
    assert lines and all("SortMergeJoin" in line for line in lines)
