"""Session settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured sizes (broadcast only under the threshold) and
# splits skewed shuffle partitions; no operator forces a broadcast by hint.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rank filters up to the largest screen limit prune inside each map task.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def local_session(cores: int = 8, memory: str = "12g", app: str = "knownby") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        # Plans with many stages compile many classes; the default keeps only 100.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Windows widen rows after their shuffle, so that a task's sorts hold many times the bytes it fetched. Shuffles are cut
# finely and merged by measured bytes: a task's rows stay the same, however large the input.
# The JVM never compiles a method of more than 8000 bytes. A stage whose code, written as one, has such a method runs
# operator by operator instead, in methods that are compiled.
FINE = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that results depend on, and ``FINE`` where the cluster names none."""
    for key in ("spark.sql.session.timeZone", "spark.sql.optimizer.windowGroupLimitThreshold"):
        spark.conf.set(key, SETTINGS[key])
    for key, value in FINE.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a new local one only where unset on a single machine."""
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of about ``each`` rows, two a core at least: for few rows that a shuffle deals into many partitions."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def materialize(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back; in at most ``tasks`` files, if given.

    Used where a plan reads the same expensive intermediate several times: the
    lineage is cut, a lost executor re-reads files instead of recomputing the
    upstream, and later scans prune columns and know their size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/intermediate-{uuid.uuid4().hex}"
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
