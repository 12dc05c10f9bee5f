"""Joins whose probe side may be dominated by a few keys, and tasks of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
# A key is hot above this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1.0 / 200.0
TASK_ROWS = 1 << 19


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding more than HOT_SHARE of the rows: fewer than 200 of them by construction."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.where(F.col("_n") > F.greatest(total * HOT_SHARE, F.lit(1000))).select(key)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a large table to a lookup (bounded rows per key) with hot keys spread over SALTS tasks.

    Only hot keys are replicated on the lookup side, so the lookup grows by at most
    200 * SALTS keys. Cold keys keep salt 0 and shuffle as usual.
    """
    hot = F.broadcast(hot_keys(facts, key).withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS))).otherwise(F.lit(0))
    left = facts.join(hot, key, "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int | None = None) -> DataFrame:
    """Rows dealt out by `keys` into tasks of about `task_rows` (default TASK_ROWS); `rows` is their number.

    Lists of ids and scores compress to a few bytes a row, so tasks cut by bytes on the wire hold many times as many
    rows as planned, and may spill. A given number of partitions is not coalesced.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // (task_rows or TASK_ROWS)))
    return df.repartition(tasks, *keys)
