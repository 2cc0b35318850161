"""Row numbers per group without sending a group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkloom.session import ensure_checkpoint_dir

PIECE_ROWS = 1_000_000


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str = "n", pieces: int | None = None
) -> DataFrame:
    """Adds 1-based ``name`` within ``keys`` along ``order``.

    Rows are range-partitioned on (keys, order): a long group spans consecutive
    pieces, is numbered inside each, and shifted by the sizes of the pieces before. There is a
    piece for every ``PIECE_ROWS`` rows at least.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIECE_ROWS))
    # Written out once: piece numbers must be the same in both uses below.
    cut = (
        df.repartitionByRange(n, *keys, *order)
        .withColumn("_piece", F.spark_partition_id())
        .checkpoint()
    )
    sizes = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        cut.withColumn("_local", F.row_number().over(inside))
        .join(shift, [*keys, "_piece"])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_local", "_shift", "_piece")
    )
