"""Sinks: Parquet and CSV export, upsert by key, replacement by run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header; arrays become pipe-joined text, other nested values JSON."""

    def flat(field: T.StructField):
        if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, T.StructType):
            return F.array_join(F.col(field.name).cast("array<string>"), "|").alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    df.select(*[flat(field) for field in df.schema]).write.mode("overwrite").option("header", True).csv(path)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Upsert result: rows of both tables by key; new values win.

    Columns in `keep_old` fall back to the old value when the new one is null. `new` must hold one
    row per key (see last_per_key).
    """
    keys = list(keys)
    values = [c for c in new.columns if c not in keys]
    left = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_in_old"))
    right = new.withColumn("_in_new", F.lit(True))
    joined = left.join(right, keys, "full")
    columns = []
    for c in [c for c in old.columns if c not in keys]:
        if c not in values:
            columns.append(F.col(f"_old_{c}").alias(c))
        elif c in keep_old:
            columns.append(F.coalesce(c, f"_old_{c}").alias(c))
        else:
            columns.append(F.when(F.col("_in_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return joined.select(*keys, *columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order_column: str) -> DataFrame:
    """One row per key, the one with the largest order value (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys and c != order_column]
    best = df.groupBy(*keys).agg(F.max(F.struct(order_column, *rest)).alias("r"))
    return best.select(*keys, "r.*")


class VersionedTable:
    """A folder of table versions: a write goes to a new version, readers use the newest complete one.

    A version counts once its _SUCCESS marker exists, so a failed or repeated write is never read
    and the version being read is never overwritten.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[tuple[int, str]]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1:].split("-")[0]), name))
        return sorted(found)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/{versions[-1][1]}") if versions else None

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        versions = self._versions()
        number = versions[-1][0] + 1 if versions else 1
        write_table(df, f"{self.root}/v{number:08d}-{uuid.uuid4().hex[:8]}", partition_by)
        return self.read()

    def upsert(self, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
        old = self.read()
        return self.write(new if old is None else merged(old, new, keys, keep_old))


def replace_run(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Replace only the runs present in `df` (column run_id); other runs stay untouched."""
    writer = df.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return spark.read.parquet(path)


def import_log(recs: DataFrame, model_name: str) -> DataFrame:
    """Log rows of an offline import; the score is the MMR score, or the rank score when that is 0 or missing."""
    score = F.coalesce(F.nullif("mmr_score", F.lit(0.0)), "rank_score")
    return recs.select(
        "run_id",
        "user_id",
        "item_id",
        "rank_position",
        score.alias("score"),
        F.lit(model_name).alias("model_name"),
        F.lit("offline_import").alias("event_type"),
    )
