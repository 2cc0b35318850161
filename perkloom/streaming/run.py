"""Streams into tables: queries that run on, and draining what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from perkloom.operators.ingest import last_per
from perkloom.session import ensure_checkpoint_dir, keep_track


def run_to_table(stream: DataFrame, folder: str, output_mode: str = "append", **trigger) -> StreamingQuery:
    """Start a query that writes to ``folder``/out and keeps its progress in ``folder``/state.

    A micro-batch is written to a folder of its own number, so one that is run again replaces its
    own rows; read the result with ``results``. Started again on the same folder it goes on where
    it ended. ``trigger``: as of a stream writer, such as processingTime or availableNow."""

    # So that the folder can be read before the first micro-batch, and if none comes.
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/out/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return (
        stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{folder}/state")
        .trigger(**trigger).foreachBatch(write).start()
    )


def results(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What a query of ``run_to_table`` has written so far, with the number of its ``batch``."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    return spark.read.schema(numbered).parquet(f"{folder}/out")


def drain(stream: DataFrame, output_mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process all that is available and return it as a table.

    State and output live in the shared checkpoint folder. A micro-batch is written
    to a folder of its own number, so one that is run again replaces its own rows.
    With ``keys`` the row of the latest micro-batch wins.
    """
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    keep_track(root)
    run_to_table(stream, root, output_mode, availableNow=True).awaitTermination()
    rows = results(spark, root, stream.schema)
    if keys is None:
        return rows.drop("batch")
    return last_per(rows, keys, "batch").drop("batch")
