"""Fusion of candidate lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrec.functions.scores import min_max
from quillrec.operators.skew import dealt
from quillrec.operators.topk import top_k

# Channel weights of the offline fusions and of the request-time fusion.
SIX_CHANNELS = {"als": 0.30, "itemcf": 0.22, "embedding": 0.16, "graph": 0.12, "content": 0.12, "hot": 0.08}
SEVEN_CHANNELS = {
    "als": 0.28,
    "itemcf": 0.20,
    "embedding": 0.15,
    "graph": 0.11,
    "content": 0.10,
    "hot": 0.08,
    "kg": 0.08,
}
REQUEST_WEIGHTS = {"als": 0.30, "itemcf": 0.25, "content": 0.20, "ranker": 0.15, "hot": 0.10, "kg": 0.10}
UNKNOWN_WEIGHT = 0.05
SOURCE_BONUS = 0.1
REQUEST_BONUS = 0.05
DIGITS = 6


def wide_candidates(candidates: DataFrame, channels) -> DataFrame:
    """One row per (user, item) with a score and a 0/1 flag per channel and their count.

    Conditional maxima over the stacked lists: one aggregate instead of a chain of outer joins. Rows are dealt out by user,
    so what follows for each user needs no other shuffle. `candidates` is counted first: hand in a stored table.
    """
    channels = list(channels)
    score = lambda c: F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score")
    known = candidates.where(F.col("channel").isin(channels) & F.col("score").isNotNull())
    grouped = dealt(known, known.count(), "user_id").groupBy("user_id", "item_id").agg(*[score(c) for c in channels])
    flagged = grouped.select(
        "*", *[F.col(f"{c}_score").isNotNull().cast("int").alias(f"is_{c}_recall") for c in channels]
    )
    count = sum((F.col(f"is_{c}_recall") for c in channels[1:]), F.col(f"is_{channels[0]}_recall"))
    return flagged.withColumn("recall_source_count", count)


def normalised(wide: DataFrame, channels, mode: str = "coalesced") -> DataFrame:
    """Add norm_<channel>: per-user min-max of each channel.

    'coalesced' counts a missing score as 0 before scaling, so a channel without any row for a
    user gives 1 to all of them; 'present' scales rows that have a score and gives 0 to the rest.
    A user holds at most (channels x list length) rows, so the window stays small.
    """
    per_user = Window.partitionBy("user_id")
    columns = {}
    for c in channels:
        raw = F.col(f"{c}_score")
        value = F.coalesce(raw, F.lit(0.0)) if mode == "coalesced" else raw
        scaled = min_max(value, F.min(value).over(per_user), F.max(value).over(per_user))
        columns[f"norm_{c}"] = scaled if mode == "coalesced" else F.when(raw.isNull(), 0.0).otherwise(scaled)
    filled = {f"{c}_score": F.coalesce(f"{c}_score", F.lit(0.0)) for c in channels}
    return wide.withColumns(columns).withColumns(filled)


def weighted_sum(weights: Mapping[str, float], bonus: float) -> Column:
    terms = [F.lit(float(w)) * F.col(f"norm_{c}") for c, w in weights.items()]
    return sum(terms, F.lit(float(bonus)) * F.col("recall_source_count"))


def fuse(
    candidates: DataFrame,
    weights: Mapping[str, float] = SEVEN_CHANNELS,
    mode: str = "coalesced",
    bonus: float = SOURCE_BONUS,
    top_n: int = 100,
) -> DataFrame:
    """Top candidates per user by the weighted sum of normalised channel scores plus a source bonus."""
    scored = normalised(wide_candidates(candidates, weights), weights, mode).withColumn(
        "merged_score", F.round(weighted_sum(weights, bonus), DIGITS)
    )
    best = top_k(scored, ["user_id"], [F.desc("merged_score"), F.asc("item_id")], top_n)
    return best.drop("rn", *[f"norm_{c}" for c in weights])


def reduce_request(candidates: DataFrame, top_n: int = 20, weights: Mapping[str, float] = REQUEST_WEIGHTS) -> DataFrame:
    """Request-time fusion of (user_id, item_id, channel, score, reason) rows.

    Scores are scaled per user and channel, weighted and summed; every further source adds a
    bonus; at most three distinct reasons are joined in weight order.
    """
    lists = Window.partitionBy("user_id", "channel")
    scaled = min_max(F.col("score"), F.min("score").over(lists), F.max("score").over(lists))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.coalesce(F.try_element_at(table, F.col("channel")), F.lit(UNKNOWN_WEIGHT))
    rows = candidates.withColumn("score", F.coalesce("score", F.lit(0.0))).select(
        "user_id", "item_id", "channel", (scaled * weight).alias("w"), (-weight).alias("priority"), "reason"
    )
    grouped = rows.groupBy("user_id", "item_id").agg(
        F.sum("w").alias("w"),
        F.array_sort(F.collect_set("channel")).alias("sources"),
        F.array_sort(F.collect_set(F.struct("priority", "channel", "reason"))).alias("why"),
    )
    count = F.size("sources")
    reasons = F.filter(F.transform("why", lambda x: x["reason"]), lambda x: x != "")
    final = grouped.select(
        "user_id",
        "item_id",
        F.round(F.col("w") + F.greatest(count - 1, F.lit(0)) * F.lit(REQUEST_BONUS), DIGITS).alias("score"),
        F.array_join("sources", "|").alias("sources"),
        count.alias("source_count"),
        F.array_join(F.slice(F.array_distinct(reasons), 1, 3), " + ").alias("reason"),
    )
    order = [F.desc("score"), F.desc("source_count"), F.asc("item_id")]
    return top_k(final, ["user_id"], order, top_n, "position")
