"""Top-k, pagination, ordered lists and supplementing of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrec.operators.ranks import with_global_rank

# orderBy().limit() merges every partition's head in one task; above this, rank with a range sort.
SINGLE_TASK_LIMIT = 10_000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per key under a total order.

    row_number + filter lets Spark cut each key to k rows before the shuffle, so a hot key
    reaches its final task already reduced to k rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Ordered de-duplication: the first row per key."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global first n rows; large n is ranked in parallel instead of merged in one task."""
    if n <= SINGLE_TASK_LIMIT:
        return df.orderBy(*order).limit(n)
    return with_global_rank(df, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def ranked_list(df: DataFrame, keys: Sequence[str], value: Column, rank: str, output: str) -> DataFrame:
    """One row per key with its values as an array in rank order. Use after top_k, so it is bounded."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda pair: pair["v"]).alias(output))


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 .. offset+limit of each key's ordered list, with position column `rn`."""
    return top_k(df, keys, order, offset + limit).where(F.col("rn") > offset)


def wrap_slice(df: DataFrame, keys: Sequence[str], rank: str, start: Column, size: int) -> DataFrame:
    """`size` entries of each ranked list from `start`, wrapping past the end; adds `slot` from 1.

    Lists must already be bounded (a top-k result).
    """
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        df.withColumn("_len", length)
        .withColumn("slot", (F.pmod(F.col(rank) - 1 - F.pmod(start, F.col("_len")), F.col("_len")) + 1).cast("int"))
        .where(F.col("slot") <= size)
        .drop("_len")
    )


def supplement(
    lists: Sequence[DataFrame], keys: Sequence[str], item: str, rank: str, k: int
) -> DataFrame:
    """Fill each key's list to k: lists in priority order, no repeats. Output has `priority` and `position`.

    Every input must hold the keys, the item and its rank within that list. Rows past k + (rows
    kept from earlier lists) can never be used, so each list is cut at its own first k ranks per
    earlier list.
    """
    tagged = [
        df.select(*keys, item, F.col(rank).cast("int").alias("_r"), F.lit(i).alias("priority"))
        .where(F.col("_r") <= k * (i + 1))
        for i, df in enumerate(lists)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    best = union.groupBy(*keys, item).agg(F.min(F.struct("priority", "_r")).alias("best"))
    flat = best.select(*keys, item, F.col("best.priority").alias("priority"), F.col("best._r").alias("_r"))
    order = [F.col("priority"), F.col("_r"), F.col(item)]
    return top_k(flat, keys, order, k, "position").drop("_r")
