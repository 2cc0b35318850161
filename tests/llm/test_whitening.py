"""Whitening against numpy's eigenvalues and exact sums."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from perkloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows):
    """(n, rows by id as (deviation, whitened), explained) of usable (id, vector)."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = (x - sums // n).astype(float) - (sums % n).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    k = min(32, int((values > 1e-9 * values[0]).sum()))
    w = centred @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(1)]
    return n, deviation, w, values[:k] / values.sum()


def compare(df, rows):
    n, deviation, w, explained = brute(rows)
    got = defaultdict(list)
    for r in df.collect():
        got[r["component"]].append(r)
    assert sorted(got) == list(range(1, w.shape[1] + 1))
    for c, found in got.items():
        assert Counter((r["vec_id"], r["n"], r["deviation"]) for r in found) == Counter(
            (i, n, d) for (i, _), d in zip(rows, deviation, strict=True))
        assert all(r["explained"] == pytest.approx(explained[c - 1], rel=1e-9) for r in found)
        assert all(0 <= r["identity_error"] < 1e-8 for r in found)
        by_value = sorted((r["deviation"], r["vec_id"], r["whitened"]) for r in found if r["vec_id"] is not None)
        want = sorted((d, i, x) for (i, _), d, x in zip(rows, deviation, w[:, c - 1], strict=True) if i is not None)
        a, b = np.array([x for *_, x in by_value]), np.array([x for *_, x in want])
        a = a * np.sign((a * b).sum())
        assert np.abs(a - b).max() < 1e-6
    errors = {r["identity_error"] for found in got.values() for r in found}
    assert len(errors) == 1


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    compare(whitening.whiten(df), rows)


def test_nulls_repeats_and_clashing_columns(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in random.normal(0, 1, 5)]) for i in range(40)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (3, rows[2][1])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    for name in ("n", "component", "whitened", "at", "vector", "deviation"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    compare(whitening.whiten(df), rows)


def test_constant_and_dependent_dimensions(spark):
    random = np.random.default_rng(4)
    rows = []
    for i in range(30):
        a, b = (float(x) / 64 for x in random.integers(-200, 200, 2))
        rows.append((i, [a, 7.0, b, a + b, a]))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["component"] for r in whitening.whiten(df).collect()} == {1, 2}
    compare(whitening.whiten(df), rows)


def test_no_variance_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_shorter_vectors_count_as_filled_up(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [4.0, 1.0]), (3, []), (4, [0.5, 0.25, 5.0])]
    filled = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4))
    compare(got, filled)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2.0**e), float(i)]) for i, e in enumerate((30, 3, 31, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()}


def test_factor_and_rotations():
    random = np.random.default_rng(8)
    m = random.normal(size=(40, 24)) * np.logspace(0, -6, 24)
    v = m.T @ m / 40
    factor = whitening.pivoted_cholesky(v)
    assert np.abs(factor @ factor.T - v).max() < 1e-14 * v.max()
    turned = whitening.one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    unit = (turned / norms).astype(float)
    assert np.abs(unit.T @ unit - np.eye(unit.shape[1])).max() < 1e-14
    assert np.sort(norms**2)[::-1].astype(float) == pytest.approx(np.sort(np.linalg.eigvalsh(v))[::-1], rel=1e-6, abs=1e-16)
