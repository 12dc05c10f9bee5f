"""Popularity recall: each user's best-ranked unseen items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrec.functions.scores import min_max
from quillrec.operators.ranks import with_global_rank
from quillrec.operators.skew import dealt
from quillrec.session import stage

HEAD = 10_000  # rows of the ranking that may be broadcast: a fixed bound, whatever the data
SCORE_DIGITS = 6


def hot_scores(item_stats: DataFrame) -> DataFrame:
    """(item_id, score): average * ln(1 + count), scaled to [0, 1] over all items; unrated items count 0."""
    raw = item_stats.select(
        "item_id",
        (
            F.coalesce("item_avg_rating", F.lit(0.0)) * F.log1p(F.coalesce("item_rating_count", F.lit(0)))
        ).alias("raw"),
    )
    span = raw.agg(F.struct(F.min("raw").alias("lo"), F.max("raw").alias("hi"))).scalar()
    return raw.select("item_id", F.round(min_max(F.col("raw"), span["lo"], span["hi"]), SCORE_DIGITS).alias("score"))


def unseen_positions(users: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """First n positions of a ranking (1, 2, ...) each user has not seen. `seen`: distinct (user_id, pos).

    The j-th seen position s_j has s_j - j unseen ones before it, so only seen positions with
    s_j - j < n matter and the answer is the gaps between them, up to position n + (their count).
    Only those gaps are produced: no user x item pairs, no anti-join.
    """
    # Coarse cut first: counts per power-of-two band bound the last position a user can need.
    band = F.floor(F.log2("pos")).cast("int")
    per_band = seen.groupBy("user_id", band.alias("band")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("user_id").orderBy("band"))  # at most 63 rows per user
    band_end = F.pow(F.lit(2.0), F.col("band") + 1) - 1
    enough = per_band.withColumn("unseen", band_end - upto).where(F.col("unseen") >= n)
    limits = enough.groupBy("user_id").agg(F.min(band_end).cast("long").alias("limit"))
    within = seen.join(limits, "user_id", "left").where(F.col("limit").isNull() | (F.col("pos") <= F.col("limit")))

    ordered = Window.partitionBy("user_id").orderBy("pos")
    numbered = within.select(
        "user_id",
        "pos",
        F.row_number().over(ordered).alias("j"),
        F.coalesce(F.lag("pos").over(ordered), F.lit(0)).alias("before"),
    ).where(F.col("pos") - F.col("j") < n)
    gaps = numbered.where(F.col("pos") - F.col("before") > 1).select(
        "user_id", F.explode(F.sequence(F.col("before") + 1, F.col("pos") - 1)).alias("pos")
    )
    last = numbered.groupBy("user_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("k"))
    tail = users.join(last, "user_id", "left").select(
        "user_id",
        (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("start"),
        (F.lit(n) + F.coalesce("k", F.lit(0))).cast("long").alias("stop"),
    )
    rest = tail.where(F.col("start") <= F.col("stop")).select(
        "user_id", F.explode(F.sequence("start", "stop")).alias("pos")
    )
    return gaps.unionByName(rest)


def hot_recall(users: DataFrame, item_stats: DataFrame, seen: DataFrame, top_n: int = 50) -> DataFrame:
    """Each user's top_n unseen items by hot score (ties by id). `seen`: (user_id, item_id), repeats allowed.

    A list ends no deeper than top_n places past the number of the user's seen rows, so only the ranking down to the most
    of these is joined to seen items: few of their rows move, unless somebody has seen very many.
    """
    ranking = with_global_rank(hot_scores(item_stats), [F.desc("score"), F.asc("item_id")], "pos")
    most = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    reach = top_n + (most or 0)
    needed = ranking.where(F.col("pos") <= reach)
    within = needed.select("item_id", "pos")
    seen_pos = seen.join(F.broadcast(within) if reach <= HEAD else within, "item_id")
    seen_pos = stage(seen_pos.select("user_id", "pos").distinct())
    seen_pos = dealt(seen_pos, seen_pos.count(), "user_id")
    wanted = unseen_positions(users.select("user_id").distinct(), seen_pos, top_n)
    # The head of the ranking is in everybody's list: a hot join key, but a table of bounded size.
    found = wanted.where(F.col("pos") <= HEAD).join(F.broadcast(needed.where(F.col("pos") <= HEAD)), "pos")
    if reach > HEAD:
        found = found.unionByName(wanted.where(F.col("pos") > HEAD).join(needed.where(F.col("pos") > HEAD), "pos"))
    return found.select("user_id", "item_id", F.lit("hot").alias("channel"), "score")
