"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi on the triangular factor.

Entries are taken as whole 64ths, so sums and the centred scatter are exact whole numbers: tasks add
products of differences from a whole-number centre near the mean, Spark adds the tasks, and what
the centre is off by is taken out in exact arithmetic. What reaches the driver is one number per
pair of dimensions, however many vectors there are. There the covariance V is factored as L L'
with pivoting, and the columns of L are rotated against each other until they are orthogonal:
their squared norms are the eigenvalues of V, the columns over their norms its components.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import stored

STEPS = 64  # whole steps of one
OFFSET = 1_000_000
HELD = 2.0**48  # entries are held within so many steps, far beyond what a long deviation can hold
COMPONENTS = 32
SWEEPS = 60
SUM = "decimal(38,0)"


class Model(NamedTuple):
    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # a column per component
    trace: float


def steps(values: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers; a shorter vector counts as filled up
    with zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.full((len(values), dims), OFFSET, np.int64)
    whole = np.clip(np.floor(STEPS * flat), -HELD, HELD).astype(np.int64) + OFFSET
    row = np.repeat(np.arange(len(values)), lengths)
    first = np.cumsum(lengths) - lengths
    found[row, np.arange(len(whole)) - np.repeat(first, lengths)] = whole
    return found


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows whose vector has only finite entries."""
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & finite).select("vec_id", F.col(column).alias("vector"))


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of every dimension."""

    def add(batches):
        held, total = 0, np.zeros(0, object)
        for batch in batches:
            values = batch.column(0)
            dims = int(np.diff(values.offsets.to_numpy()).max(initial=0))
            if dims > len(total):
                total = np.concatenate([total, np.full(dims - len(total), held * OFFSET, object)])
            found = steps(values, len(total)) - OFFSET
            rows = max(1, int(2**62 / max(1, np.abs(found).max(initial=0))))
            for at in range(0, len(found), rows):
                part = found[at : at + rows]
                total = total + part.sum(0).astype(object) + len(part) * OFFSET
            held += len(values)
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([-1, *range(len(total))], pa.int32()),
            "rows": pa.array([held] * (len(total) + 1), pa.int64()),
            "total": pa.array([str(held), *map(str, total)], pa.string()),
        })

    added = vectors.select("vector").mapInArrow(add, "dim int, rows bigint, total string")
    found = added.groupBy("dim").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("total").cast(SUM)).alias("total")
    ).collect()  # a row per dimension
    by_dim = {r["dim"]: (r["rows"], int(r["total"])) for r in found}
    n = by_dim.pop(-1, (0, 0))[0]
    # Tasks that only saw shorter vectors have not filled them up to the last dimension.
    return n, [by_dim[j][1] + (n - by_dim[j][0]) * OFFSET for j in range(len(by_dim))]


def _products(part: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, as exact whole numbers."""
    most = float(np.abs(part).max(initial=0)) ** 2
    if most * len(part) < 2.0**53:  # every partial sum is a whole number that a double holds
        as_double = part.astype(np.float64)
        return (as_double.T @ as_double).astype(np.int64).astype(object)
    if most * len(part) < 2.0**62:
        return (part.T @ part).astype(object)
    exact = part.astype(object)
    return exact.T @ exact


def _scatter(vectors: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of the products (x_j - centre_j) * (x_k - centre_k) for j <= k."""
    dims = len(centre)
    upper = np.triu_indices(dims)

    def multiply(batches):
        total = None
        for batch in batches:
            found = steps(batch.column(0), dims) - centre
            most = max(1.0, float(np.abs(found).max(initial=0)) ** 2)
            rows = max(1, min(65_536, int(2**53 / most) - 1))
            for at in range(0, len(found), rows):
                part = _products(found[at : at + rows])[upper]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "j": pa.array(upper[0], pa.int32()), "k": pa.array(upper[1], pa.int32()),
                "total": pa.array(list(map(str, total)), pa.string()),
            })

    made = vectors.select("vector").mapInArrow(multiply, "j int, k int, total string")
    summed = made.groupBy("j", "k").agg(F.sum(F.col("total").cast(SUM)).alias("total"))
    return {(r["j"], r["k"]): int(r["total"]) for r in summed.toLocalIterator()}  # dims * dims / 2 rows


def _long_double(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L': the largest remaining diagonal entry is taken next, and what is left
    below rounding of the largest one counts as zero, so L has as many columns as v has rank."""
    left = v.astype(np.longdouble).copy()
    dims = len(v)
    factor = np.zeros((dims, dims), np.longdouble)
    least = dims * np.finfo(np.float64).eps * max(left.diagonal().max(initial=0), 0) / 64
    for c in range(dims):
        p = int(left.diagonal().argmax())
        if left[p, p] <= least:
            return factor[:, :c]
        column = left[:, p] / np.sqrt(left[p, p])
        factor[:, c] = column
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The columns of ``factor`` after rotations that make them orthogonal. A sweep meets all pairs
    of columns in rounds of disjoint pairs, as in a tournament, each round at once."""
    a = factor.copy()
    n = a.shape[1]
    seats = np.arange(n + n % 2)  # with an empty seat if the number is odd
    half = len(seats) // 2
    close = np.longdouble(np.finfo(np.float64).eps) / 8
    for _ in range(sweeps):
        rotated = False
        for _ in range(max(0, len(seats) - 1)):
            i, j = seats[:half], seats[half:][::-1]
            real = (i < n) & (j < n)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > close * np.sqrt(xx * yy)
            if turn.any():
                rotated = True
                i, j, x, y = i[turn], j[turn], x[:, turn], y[:, turn]
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                cos = 1 / np.sqrt(1 + t * t)
                a[:, i], a[:, j] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not rotated:
            break
    return a


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model:
    """Eigenvalues and components of the covariance of all ``vector``; as many components as
    there are directions with variance, ``components`` at most."""
    n, sums = _sums(vectors)
    dims = len(sums)
    if not n or not dims:
        return Model(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    centre = [s // n for s in sums]
    off = [s - n * m for s, m in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims), np.longdouble)
    trace = Fraction(0)
    for (j, k), total in _scatter(vectors, np.array(centre, np.int64)).items():
        entry = Fraction(n * total - off[j] * off[k], n * n)
        v[j, k] = v[k, j] = _long_double(entry)
        trace += entry if j == k else 0
    turned = one_sided_jacobi(pivoted_cholesky(v))
    eigenvalues = (turned * turned).sum(0)
    order = np.argsort(-eigenvalues, kind="stable")[:components]
    unit = turned[:, order] / np.sqrt(eigenvalues[order])
    return Model(n, sums, eigenvalues[order].astype(np.float64), unit.astype(np.float64), float(trace))


def _deviations(off_mean: np.ndarray, n: int, off: np.ndarray) -> list[int | None]:
    """Sums of squares of n * (x - centre) - off, exact; null beyond a long."""
    most = n * float(np.abs(off_mean).max(initial=0)) + float(max(map(abs, off), default=0))
    if most * most * max(1, len(off)) < 2.0**62:
        d = n * off_mean - off.astype(np.int64)
        return (d * d).sum(1).tolist()
    exact = [sum(int(e) ** 2 for e in row) for row in n * off_mean.astype(object) - off]
    return [e if e < 2**63 else None for e in exact]


def projected(vectors: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, whitened): the coordinates of every vector, largest eigenvalue first."""
    dims, n = len(model.sums), max(1, model.n)
    centre = np.array([s // n for s in model.sums], np.int64)
    off = np.array([s % n for s in model.sums], object)
    rest = np.array([float(Fraction(int(o), n)) for o in off])
    scale = model.vectors / np.sqrt(model.eigenvalues)

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = steps(part.column(1), dims) - centre
                whitened = (found - rest) @ scale
                rows, width = whitened.shape
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0),
                    "deviation": pa.array(_deviations(found, model.n, off), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(whitened.ravel(), pa.float64())
                    ),
                })

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vector").mapInArrow(
        project, f"vec_id {kind}, deviation bigint, whitened array<double>"
    )


def identity_error(rows: DataFrame, width: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""

    def multiply(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += w.sum(0)
            products += w.T @ w
        at = np.indices((width, width)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate([np.full(width, -1), at[0]]), pa.int32()),
            "b": pa.array(np.concatenate([np.arange(width), at[1]]), pa.int32()),
            "total": pa.array(np.concatenate([total, products.ravel()]), pa.float64()),
        })

    found = rows.select("whitened").mapInArrow(multiply, "a int, b int, total double").groupBy("a", "b").agg(
        F.sum("total").alias("total")
    ).collect()  # at most 33 * 32 rows
    summed = {(r["a"], r["b"]): r["total"] for r in found}
    n = rows.count()
    # The coordinates are of centred vectors already: their means are rounding, taken out here.
    mean = np.array([summed[-1, b] for b in range(width)]) / n
    products = np.array([[summed[a, b] for b in range(width)] for a in range(width)]) / n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Coordinates of every usable vector along the leading components, scaled to variance one.

    Returns for each row and component ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``
    (vectors fitted), ``deviation`` (exact sum of (n * x - S)^2; null beyond a long), ``whitened``,
    ``explained`` (share of the variance) and ``identity_error``. Rows whose vector is null or has a
    null or non-finite entry are left out; all others count, repeated ones each time, those without
    vec_id and empty vectors too. A vector shorter than the longest counts as filled up with zeros.
    Only directions with variance are components: a single vector, or equal ones, give no rows, and
    neither does an empty table. Equal eigenvalues stand in an order that reruns repeat. Other
    columns are ignored."""
    rows = usable(vectors, column)
    model = fit(rows, components)
    width = len(model.eigenvalues)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not width:
        return vectors.sparkSession.createDataFrame([], (
            f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
            "explained double, identity_error double"
        ))
    found = stored(projected(rows, model), "whitened")
    error = identity_error(found, width)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
