"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution already splits an oversized join partition at run time. The
explicit form here is for the joins where *both* sides can be crowded on the same
key, and works with adaptive execution off as well.

A key is *hot* on a side when it holds more than ``PIECE_ROWS`` rows there, and is
cut into pieces of about that size. A table of n rows has fewer than n /
``PIECE_ROWS`` such keys, so the table that names them is bounded by construction (a
trillion rows: a million short entries); adaptive execution broadcasts it where it is small.
Rows of a hot key are
spread over the cells of an a x b grid: a left row goes to one grid row and every
grid column, a right row to one grid column and every grid row. Each pair meets in
exactly one cell, so the result is the plain inner join, while no cell holds much
more than one piece of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 1_000_000


def hot_keys(
    df: DataFrame, keys: list[str], ways: str, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Hot keys of one side and the number of pieces of each.

    A column-pruned scan and a map-side-combined count; only counts are shuffled.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > piece_rows)
        .select(*keys, F.ceil(F.col("_n") / piece_rows).cast("int").alias(ways))
    )


def hot_counts(counts: DataFrame, keys: list[str], ways: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Like ``hot_keys``, from rows that already carry a count ``_n`` of the key's rows."""
    return (
        counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        .where(F.col("_n") > piece_rows)
        .select(*keys, F.ceil(F.col("_n") / piece_rows).cast("int").alias(ways))
    )


def either_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Grid size per key from the hot keys of both sides (``_a`` and ``_b`` ways)."""
    one = F.lit(1)
    both = left.withColumn("_b", one).unionByName(right.withColumn("_a", one))
    return both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def hot_splits(
    left: DataFrame | None, right: DataFrame | None, keys: list[str], **bounds
) -> DataFrame:
    """Grid size (``_a`` x ``_b``) per key that is hot on either side.

    Give base tables, not derived join sides, so that the counts cost one narrow
    scan each; a side given as None is left to adaptive execution.
    """
    one = F.lit(1)
    sides = []
    if left is not None:
        sides.append(hot_keys(left, keys, "_a", **bounds).withColumn("_b", one))
    if right is not None:
        sides.append(hot_keys(right, keys, "_b", **bounds).withColumn("_a", one))
    if len(sides) == 1:
        return sides[0]
    return either_hot(sides[0].drop("_b"), sides[1].drop("_a"), keys)


def _salt(spread_by: list[str], ways: str) -> Column:
    n = F.coalesce(F.col(ways), F.lit(1))
    hashed = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), n.cast("bigint")).cast("int")
    return F.when(n > 1, hashed).otherwise(F.lit(0))


def _every(ways: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(ways), F.lit(1)) - 1))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: list[str],
    right_id: list[str],
    splits: DataFrame,
    parts: int | None = None,
) -> DataFrame:
    """Exact inner equi-join on ``on``, hot keys split on both sides.

    ``splits`` comes from ``hot_splits`` on some of the ``on`` columns. The salt
    is a hash of the id columns, so a task that is run again places its rows the
    same way. ``parts`` keeps that many partitions where few rows stand for a large result,
    which adaptive execution would gather in a task or two.
    """
    keys = [c for c in splits.columns if c not in ("_a", "_b")]
    grid = splits
    salted_left = (
        left.join(grid, keys, "left")
        .withColumn("_row", _salt(left_id, "_a"))
        .withColumn("_col", _every("_b"))
        .drop("_a", "_b")
    )
    salted_right = (
        right.join(grid, keys, "left")
        .withColumn("_col", _salt(right_id, "_b"))
        .withColumn("_row", _every("_a"))
        .drop("_a", "_b")
    )
    cell = [*on, "_row", "_col"]
    if parts is not None:
        salted_left, salted_right = salted_left.repartition(parts, *cell), salted_right.repartition(parts, *cell)
    return salted_left.join(salted_right, cell).drop("_row", "_col")


# Rows without a key match nothing; they only need to be apart from each other, each on its own.
NULL_WAYS = 2**31 - 1


def skew_lookup(
    left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], how: str = "left", **bounds
) -> DataFrame:
    """Join to a table with at most one row per key (``how``: left or inner).

    Hot keys of the left side are cut into pieces and the one matching row of each
    is repeated per piece; rows without a key are spread as well.
    """
    grid = hot_keys(left.dropna(subset=on), on, "_a", **bounds)
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    apart = F.pmod(F.xxhash64(*[F.col(c) for c in left_id]), F.lit(NULL_WAYS)).cast("int")
    salted_left = (
        left.join(grid, on, "left")
        .withColumn("_row", F.when(no_key, apart).otherwise(_salt(left_id, "_a")))
        .drop("_a")
    )
    salted_right = right.join(grid, on, "left").withColumn("_row", _every("_a")).drop("_a")
    return salted_left.join(salted_right, [*on, "_row"], how).drop("_row")
