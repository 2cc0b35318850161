"""The language model learns from every training document, not only from those it begins with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from perkloom.llm import attention, lm_scoring


def sequences(n, size, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 40, (n, size))
    rows[:, 2::3] = (rows[:, 1::3][:, : rows[:, 2::3].shape[1]] + rows[:, ::3][:, : rows[:, 2::3].shape[1]]) % 40
    rows[:, -1] = lm_scoring.END
    return rows


def test_every_subword_of_all_documents_is_told_once(spark):
    rows = sequences(500, 300)
    counts = np.bincount(rows.ravel(), minlength=lm_scoring.SUBWORDS).astype(float)
    ids = spark.createDataFrame(
        [(bytes(r.astype(np.uint16).tobytes()), i % lm_scoring.ROUNDS) for i, r in enumerate(rows)],
        "ids binary, part int",
    )
    number = lm_scoring.numbers(counts)
    pairs = lm_scoring.follower_counts(ids, number)
    size = attention.KNOWN + 1
    want = np.zeros((size, size))
    for r in rows:
        t = number[np.concatenate([[lm_scoring.END], r])]
        np.add.at(want, (t[:-1], t[1:]), 1)
    assert np.array_equal(pairs.reshape(size, size), want)
    scorer = lm_scoring.Scorer(counts, np.array([lm_scoring.END]), 0, pairs)
    held = sequences(20, 300, seed=4).tolist()
    before = sum(scorer.scores(held)) / 6_000
    assert lm_scoring.learn(scorer, ids.repartition(2 * lm_scoring.FAN_IN + 1)) == rows.size
    # Averages of 33 tasks, made by three, are those of the same shapes.
    assert all(np.isfinite(w).all() for w in scorer.network.p.values())
    lm_scoring.learn(scorer, ids.coalesce(1))
    assert sum(scorer.scores(held)) / 6_000 > before + 0.005


def test_order_is_learnt_from_documents_that_no_sample_holds(make):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(30)])
    ordered = lambda at: " ".join(words[(at + np.arange(400)) % 30])
    mixed = lambda: " ".join(words[rng.permutation(np.arange(400) % 30)])
    docs = make([ordered(i) for i in range(600)] + [mixed() for _ in range(100)]).coalesce(1)
    docs = docs.where("doc_id < 600 OR crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 1")
    scored = lm_scoring.lm_scores(docs, sample=0).where("held_out").groupBy((F.col("doc_id") < 600).alias("ordered"))
    mean = {r["ordered"]: r["mean"] for r in scored.agg(F.avg(F.col("score") / F.col("n_tokens")).alias("mean")).collect()}
    assert mean[True] > mean[False] + 0.02
