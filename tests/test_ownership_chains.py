"""Ancestors of programs: rounds make hardly more pairs than there are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from perkloom.operators import ownership

SCHEMA = "id string, parent_id string"


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_of_programs_with_several_parents_and_cycles(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"p{i}", rnd.choice([None, f"p{rnd.randrange(40)}", f"p{i + 1}", f"p{i + 1}"])) for i in range(40) for _ in range(rnd.choice([1, 1, 2]))]
    above = {}
    for child, parent in rows:
        if parent:
            above.setdefault(child, set()).add(parent)
    want = set()
    for start in {r[0] for r in rows}:
        seen, ask = {start}, [start]
        while ask:
            more = above.get(ask.pop(), set()) - seen
            seen |= more
            ask += more
        want |= {(start, a) for a in seen}
    got = ownership.program_ancestors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_round_meets_hardly_more_pairs_than_it_finds(spark, monkeypatch):
    met, onwards = [], ownership._onwards
    monkeypatch.setattr(ownership, "_onwards", lambda jump, up: met.append(onwards(jump, up)) or met[-1])
    chain = spark.range(200).select(
        F.concat(F.lit("p"), "id").alias("id"), F.when(F.col("id") < 199, F.concat(F.lit("p"), F.col("id") + 1)).alias("parent_id"))
    assert ownership.program_ancestors(chain).count() == 200 * 201 // 2
    assert sum(df.count() for df in met) < 200 * 201
