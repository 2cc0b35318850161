"""Session settings the jobs are written for, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning carries most of the physical tuning: partition counts are
# coalesced from a generous start, skewed join partitions are split, and a join
# side is only broadcast when its measured size is under the threshold.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Tables of a single small file are dealt over the cores only where a session asks for it.
SPREAD_KEY = "spark.perkloom.spreadInputs"
STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("perkloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Tables of a few megabytes still deserve every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # On small tables planning is most of a run; inferred filters do not repay theirs.
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config(STATE_STORE_KEY, ROCKSDB)
        .config(SPREAD_KEY, "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable folder for cut lineage.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a session
    without one (a local test) gets a temporary folder, and never one whose
    master is remote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="perkloom-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: what several steps use
    is computed once, and survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_track(path: str) -> None:
    """Have ``release`` remove this folder as well."""
    _written.append(path)


def release(spark: SparkSession) -> None:
    """Remove the folders written so far; call it when their results are consumed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
