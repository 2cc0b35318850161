"""Writing and reading the engine's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _read_pointer(spark: SparkSession, root: str) -> str | None:
    fs, at, _ = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return stream.readLine()
    finally:
        stream.close()


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version beside the old one, then move the pointer.

    Readers see the old table until the pointer file is renamed into place, and a
    job may read the version it replaces.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    fs, draft, jvm = _fs(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(draft, True)
    out.writeBytes(version + "\n")
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(draft), context.makeQualified(target), options)
    return version


def read_table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The current version; a table never written reads as empty."""
    version = _read_pointer(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{version}")


FILE_ROWS = 1_000_000


def write_lists(records: DataFrame, crawls: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """Replace the lists that were crawled completely and found something, in files of about
    ``file_rows``.

    ``crawls``: (list, complete). A crawl cut short is not a smaller list, so its
    partition, like that of an empty list, is left alone.
    """
    whole = crawls.where("complete").select("list")
    ways = records.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_ways"))
    (
        records.join(whole, "list", "left_semi").join(ways, "list")
        .withColumn("_way", F.pmod(F.xxhash64("offer_url"), F.col("_ways")))
        .repartition("list", "_way").drop("_ways", "_way")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("list")
        .parquet(root)
    )


def write_review_sheet(sheet: DataFrame, path: str) -> None:
    """Quoted CSV in sorted parts; each part has the header."""
    sheet.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_events(events: DataFrame, root: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)
