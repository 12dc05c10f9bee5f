"""Cleaning of raw ratings, items and tags, and the leave-one-out split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators.topk import first_per_key

RATING_SCALE = 5.0


def clean_ratings(raw: DataFrame) -> DataFrame:
    """Distinct rating rows with valid ids and rating; a bad timestamp is kept as null.

    Exact repeats are dropped before casting, so '4' and '4.0' stay separate rows.
    """
    unique = raw.dropDuplicates(["user_id", "item_id", "rating", "ts"])
    typed = unique.select(
        F.col("user_id").try_cast("long").alias("user_id"),
        F.col("item_id").try_cast("long").alias("item_id"),
        F.col("rating").try_cast("double").alias("rating"),
        F.col("ts").try_cast("long").alias("ts"),
    ).dropna(subset=["user_id", "item_id", "rating"])
    return typed.select("user_id", "item_id", "rating", (F.col("rating") / RATING_SCALE).alias("rating_norm"), "ts")


def clean_items(raw: DataFrame) -> DataFrame:
    """One row per item with parsed year, stripped title and genre array (lowest title wins)."""
    typed = raw.where(F.col("item_id").isNotNull() & F.col("title").isNotNull()).withColumn(
        "item_id", F.col("item_id").try_cast("long")
    )
    first = first_per_key(
        typed.where(F.col("item_id").isNotNull()), ["item_id"], [F.asc("title"), F.asc_nulls_last("genres")]
    )
    genres = tx.split_genres(F.col("genres"))
    return first.select(
        "item_id",
        "title",
        tx.clean_title(F.col("title")).alias("clean_title"),
        tx.title_year(F.col("title")).alias("year"),
        genres.alias("genres"),
        F.size(genres).alias("genre_count"),
    )


def tag_bridge(items: DataFrame, user_tags: DataFrame) -> DataFrame:
    """Distinct (item, tag, type): the items' own genres and the users' tags, lower-cased."""
    own = items.select("item_id", F.explode("genres").alias("tag"), F.lit("genre").alias("tag_type"))
    given = user_tags.select(
        F.col("item_id").try_cast("long").alias("item_id"), "tag", F.lit("user_tag").alias("tag_type")
    )
    merged = own.unionByName(given).withColumn("tag", F.lower(F.trim("tag")))
    return merged.where(F.col("item_id").isNotNull() & (F.col("tag") != "")).distinct()


def leave_one_out(ratings: DataFrame) -> DataFrame:
    """Mark each user's newest row (ts, then item, then rating) as test; users with one row are dropped.

    The newest row is a per-user maximum (combined before the shuffle), joined back, so a user
    with a large share of all rows is never sorted in a single task.
    """
    complete = ratings.dropna(subset=["user_id", "item_id", "rating", "ts"])
    key = F.struct("ts", "item_id", "rating")
    newest = complete.groupBy("user_id").agg(F.max(key).alias("_newest"), F.count(F.lit(1)).alias("_n"))
    joined = complete.join(newest.where(F.col("_n") >= 2), "user_id")
    return joined.withColumn("is_test", key == F.col("_newest")).drop("_newest", "_n")


def train_rows(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_test")).drop("is_test")


def test_rows(split: DataFrame) -> DataFrame:
    return split.where(F.col("is_test")).drop("is_test")
