"""Session defaults. Everything else (memory, cores, partitions) belongs to the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

ADVISORY, DEFAULT_ADVISORY, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b", "8m"


def build_session(app_name: str = "quillrec", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the library defaults; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a local master without that setting falls back to a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def small_tasks(spark: SparkSession) -> None:
    """Let adaptive coalescing stop at TASK_BYTES, unless the cluster names a size of its own.

    Rows of ids, lists and scores take some ten to twenty times as much memory as on the wire: tasks of 64 MB may spill.
    """
    if spark.conf.get(ADVISORY) == DEFAULT_ADVISORY:
        spark.conf.set(ADVISORY, TASK_BYTES)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives executor loss.

    Used for tables that are read several times. Parquet keeps column pruning and filters working.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether the files behind a staged table still exist."""
    files = df.inputFiles()
    if not files:
        return False
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)
