"""Feedback logs: A/B metrics, counters, live profiles rebuilt from the log, live recommendations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.functions.scores import safe_ratio
from quillrec.operators.itemcf import _order, _runs, _within
from quillrec.operators.topk import ranked_list, top_k
from quillrec.session import stage

# Fixed values.
VALID_TYPES = ("click", "like", "dislike", "not_interested", "seen", "rating")
POSITIVE = ("click", "like", "seen")
NEGATIVE = ("dislike", "not_interested")
RECENT_LENGTH, LIST_LENGTH = 50, 100
RESULT_BUCKETS = (0, 1, 5, 10, 20, 50, 100)
SEED_WEIGHTS = {"like": 1.25, "click": 0.85, "seen": 0.45}
RECENCY_STEP, RECENCY_FLOOR = 0.04, 0.35
POSITIVE_FLOOR, POSITIVE_SEEDS = 0.75, 20
DIGITS = 6
# Six-digit similarities times four-digit weights have ten digits: rounding there removes only float noise.
SCORE_DIGITS = 10
GROUP_SEEDS = 50_000  # seeds and blocked items of the users of a group
AT_ONCE = 1_000_000  # neighbours of seeds that are summed at once


def ab_metrics(recommendation_log: DataFrame, feedback_log: DataFrame, dedup: bool = False) -> DataFrame:
    """Per group: events, exposures, clicks, likes, negatives and their rates per exposure.

    Feedback is written to both logs, so the plain union counts it twice; with `dedup` only
    exposures are taken from the recommendation log.
    """
    shown = recommendation_log.where(F.col("feedback_type") == "exposure") if dedup else recommendation_log
    part = lambda df, own: df.select(
        F.coalesce("run_id", F.lit("unknown")).alias("group_name"), "feedback_type", F.lit(own).alias("own")
    )
    union = part(shown, 0).unionByName(part(feedback_log, 1))
    kind = F.col("feedback_type")
    counted = union.groupBy("group_name").agg(
        F.sum("own").cast("long").alias("events"),
        F.count_if((kind == "exposure") & (F.col("own") == 0)).alias("exposures"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "like").alias("likes"),
        F.count_if(kind.isin(*NEGATIVE)).alias("negatives"),
    )
    rate = lambda c: F.round(safe_ratio(F.col(c), F.col("exposures")), DIGITS)
    return counted.withColumns({"ctr": rate("clicks"), "like_rate": rate("likes"), "negative_rate": rate("negatives")})


def business_counters(recommendation_log: DataFrame, feedback_log: DataFrame) -> DataFrame:
    """One row of totals over both logs."""
    kind = F.col("feedback_type")
    shown = recommendation_log.agg(
        F.count(F.lit(1)).alias("recommendation_events"),
        F.count_if(kind == "exposure").alias("exposures"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "like").alias("likes"),
        F.count_if(kind.isin(*NEGATIVE)).alias("negatives"),
    )
    total = feedback_log.agg(F.count(F.lit(1))).scalar()
    return shown.select(
        total.alias("feedback_total"), "*", F.round(safe_ratio(F.col("clicks"), F.col("exposures")), DIGITS).alias("ctr")
    )


def outcome_counters(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, empty results, summed duration and results, and cumulative result-count buckets.

    `requests`: keys, duration_ms, result_count; negative or missing numbers count as 0.
    """
    duration = F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0)) / 1000
    results = F.greatest(F.coalesce("result_count", F.lit(0)), F.lit(0))
    named = requests.withColumns({k: F.coalesce(F.nullif(F.trim(k), F.lit("")), F.lit("unknown")) for k in keys})
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(results == 0).alias("empty"),
        F.round(F.sum(duration), DIGITS).alias("duration_seconds"),
        F.sum(results).cast("long").alias("results"),
        *[F.count_if(results <= b).alias(f"le_{b}") for b in RESULT_BUCKETS],
    )


def event_counters(feedback: DataFrame) -> DataFrame:
    """Events per type; works on static and streaming frames."""
    kind = F.lower(F.coalesce(F.nullif(F.trim("feedback_type"), F.lit("")), F.lit("unknown")))
    return feedback.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("event_id")]


def live_profiles(feedback: DataFrame, window: int | None = None) -> DataFrame:
    """Per user: newest events (50) and distinct newest-first positive and negative items (100 each).

    With `window` only each user's newest `window` events count, as when a profile is rebuilt from
    the log. Lists run newest first.
    """
    source = top_k(feedback, ["user_id"], newest_first(), window).drop("rn") if window else feedback
    recent = top_k(source, ["user_id"], newest_first(), RECENT_LENGTH)
    out = ranked_list(recent, ["user_id"], F.col("event_id"), "rn", "recent_events")
    for name, kinds in (("positive_items", POSITIVE), ("negative_items", NEGATIVE)):
        last = (
            source.where(F.col("feedback_type").isin(*kinds))
            .groupBy("user_id", "item_id")
            .agg(F.max(F.struct("ts", "event_id")).alias("last"))
        )
        ordered = top_k(last, ["user_id"], [F.desc("last")], LIST_LENGTH)
        listed = ranked_list(ordered, ["user_id"], F.col("item_id"), "rn", name)
        out = out.join(listed, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return out


def seed_weights(recent: DataFrame, positives: DataFrame) -> DataFrame:
    """(user_id, item_id, weight, blocked): seeds of live recommendations and blocked items.

    `recent`: (user_id, item_id, feedback_type, feedback_value, rn) newest first; `positives`:
    (user_id, item_id, rn). Seeds are blocked as well as disliked items; weight is null for the latter.
    """
    kind = F.col("feedback_type")
    base = F.coalesce(
        *[F.when(kind == name, F.lit(w)) for name, w in SEED_WEIGHTS.items()],
        F.when(kind == "rating", F.greatest((F.col("feedback_value") - 3) / 2, F.lit(0.0))),
        F.lit(0.0),
    )
    recency = F.greatest(1 - RECENCY_STEP * (F.col("rn") - 1), F.lit(RECENCY_FLOOR))
    events = recent.where(F.col("rn") <= RECENT_LENGTH).select(
        "user_id", "item_id", F.when(base > 0, base * recency).alias("weight"), kind.isin(*NEGATIVE).alias("negative")
    )
    floor = positives.where(F.col("rn") <= POSITIVE_SEEDS).select(
        "user_id", "item_id", F.lit(POSITIVE_FLOOR).alias("weight"), F.lit(False).alias("negative")
    )
    merged = events.unionByName(floor).groupBy("user_id", "item_id").agg(
        F.max("weight").alias("weight"), F.max("negative").alias("negative")
    )
    return merged.where(F.col("weight").isNotNull() | F.col("negative")).select("user_id", "item_id", "weight")


def _best_live(k: int):
    """The k best items of every user of a group. Rows without a weight block an item, which counts as the value -inf."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        users = left["user_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        order = np.argsort(users.indices.to_numpy(), kind="stable")
        who, items = users.indices.to_numpy()[order].astype(np.int64), left["item_id"].to_numpy()[order]
        weights = left["weight"].to_numpy()[order]
        blocks = left["weight"].is_null().to_numpy()[order]
        known = np.argsort(right["seed"].to_numpy())
        names, ids, similarity = right["seed"].to_numpy()[known], right["ids"].combine_chunks(), right["similarity"].combine_chunks()
        first, sizes = ids.offsets.to_numpy()[:-1][known], np.diff(ids.offsets.to_numpy())[known]
        ids, similarity = (x.values.to_numpy(zero_copy_only=False) for x in (ids, similarity))
        at = np.minimum(np.searchsorted(names, items), max(0, len(names) - 1))
        listed = ~blocks & (names[at] == items) if len(names) else np.zeros(len(items), bool)
        sent = np.where(listed, sizes[at], 0) if len(names) else np.zeros(len(items), np.int64)
        ends = np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1 if len(who) else np.zeros(0, int)
        upto, found, low = np.append(0, np.cumsum(sent + blocks)), [], 0
        while low < len(who):
            high = ends[max(np.searchsorted(upto[ends], upto[low] + AT_ONCE, side="right") - 1, np.searchsorted(ends, low, side="right"))]
            own = low + np.flatnonzero(listed[low:high])
            shut = low + np.flatnonzero(blocks[low:high])
            n = sent[own]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[own]] if len(own) else n, n)
            group = np.concatenate([np.repeat(who[own], n), who[shut]])
            other = np.concatenate([ids[place], items[shut]])
            value = np.concatenate([similarity[place] * np.repeat(weights[own], n), np.full(len(shut), -np.inf)])
            by = _order(group, other)
            group, other, value = group[by], other[by], value[by]
            starts = _runs(group, other) if len(group) else np.zeros(0, int)
            group, other = group[starts], other[starts]
            score = np.round(np.add.reduceat(value, starts), SCORE_DIGITS) if len(starts) else value
            by = np.lexsort((other, -score, group))
            by = by[score[by] > -np.inf]
            position = _within(group[by]) + 1 if len(by) else by + 1
            by, position = by[position <= k], position[position <= k]
            found.append((group[by], other[by], score[by], position))
            low = high
        group, other, score, position = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, int)] * 4
        user = users.dictionary.take(pa.array(group, pa.int64()))
        columns = [user, pa.array(other, pa.int64()), pa.array(score, pa.float64()), pa.array(position, pa.int32())]
        return pa.table(columns, ["user_id", "item_id", "score", "position"])

    return best


def live_recommendations(seeds: DataFrame, blocked: DataFrame, similar: DataFrame, k: int = 20) -> DataFrame:
    """Sum over seeds of similarity * weight on their neighbours, without blocked items.

    `seeds`: (user_id, item_id, weight); `similar`: (item_id, similar_id, score), at most max(8k, 40)
    neighbours per item. Users are dealt into groups of about GROUP_SEEDS rows. An item's neighbours move once to each group that has
    it as a seed, as one row of arrays, and are summed there; no row for a seed and a neighbour moves.
    """
    item = F.col("item_id").cast("long").alias("item_id")
    rows = seeds.where(F.col("weight").isNotNull()).select("user_id", item, F.col("weight").cast("double").alias("weight"))
    shut = blocked.where("user_id is not null").select("user_id", item).distinct().withColumn("weight", F.lit(None).cast("double"))
    rows = stage(rows.unionByName(shut).where("item_id is not null"))
    groups = max(1, -(-rows.count() // GROUP_SEEDS))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int"))
    entry = F.struct(F.col("similar_id").cast("long").alias("id"), F.col("score").cast("double").alias("s"))
    lists = similar.groupBy(item).agg(F.collect_list(entry).alias("x"))
    lists = lists.select(F.col("item_id").alias("seed"), F.col("x.id").alias("ids"), F.col("x.s").alias("similarity"))
    asked = rows.where("weight is not null").select(F.col("group").alias("part"), F.col("item_id").alias("seed")).distinct()
    wanted = asked.join(lists.hint("merge"), "seed")
    kind = rows.schema["user_id"].dataType.simpleString()
    return rows.groupBy("group").cogroup(wanted.groupBy("part")).applyInArrow(
        _best_live(k), f"user_id {kind}, item_id long, score double, position int"
    )
