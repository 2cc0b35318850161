"""Pieces shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkloom.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
    """Cut the lineage: write a table to the shared checkpoint folder and read it back.

    Later steps survive the loss of every executor that computed it, and columnar
    files keep what is read twice small."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables that ``stored`` wrote; call it once results are consumed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(column: str, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def prefix_sum(
    df: DataFrame, key: str, order: list[str], value: str, name: str, bucket_rows: int = 4096
) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one in its ``key``.

    The order inside a key is (bucket, ``order``), a bucket being a hash of the first
    order column. Buckets are summed on their own and then shifted by the totals of the
    buckets before, so a key that holds most rows spreads over many tasks. ``df`` should
    be a written table, as it is read twice and once more for its row count."""
    from pyspark.sql import Window

    buckets = max(1, -(-df.count() // bucket_rows))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)))
    totals = cut.groupBy(key, "_bucket").agg(F.sum(value).alias("_total"))
    # A few thousand buckets are shifted together; sections of buckets once more.
    totals = totals.withColumn("_section", F.expr(f"_bucket div {bucket_rows}"))
    rows_before = (Window.unboundedPreceding, -1)
    sections = totals.groupBy(key, "_section").agg(F.sum("_total").alias("_total"))
    over_sections = Window.partitionBy(key).orderBy("_section").rowsBetween(*rows_before)
    sections = sections.select(
        key, "_section", F.coalesce(F.sum("_total").over(over_sections), F.lit(0)).alias("_far")
    )
    over_buckets = Window.partitionBy(key, "_section").orderBy("_bucket").rowsBetween(*rows_before)
    shifts = (
        totals.withColumn("_near", F.coalesce(F.sum("_total").over(over_buckets), F.lit(0)))
        .join(sections, [key, "_section"])
        .select(key, "_bucket", (F.col("_near") + F.col("_far")).alias("_shift"))
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(*rows_before)
    return (
        cut.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(shifts, [key, "_bucket"])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_bucket", "_local", "_shift")
    )
