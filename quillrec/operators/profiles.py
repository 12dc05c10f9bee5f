"""User and item profiles: rating statistics, favourite genres and decades, ordered item lists."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.functions.scores import safe_ratio, unit
from quillrec.operators.ranks import quantile_of
from quillrec.operators.topk import ranked_list, top_k

LIKED = 4.0
FAVOURITES = 5
LIST_LENGTH = 20
MAX_TAGS = 50


def user_stats(train: DataFrame) -> DataFrame:
    return (
        train.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("user_rating_count"),
            F.avg("rating").alias("user_avg_rating"),
            F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_rating_std"),
            F.min("rating").alias("user_min_rating"),
            F.max("rating").alias("user_max_rating"),
        )
        .withColumn("active_level", tx.activity_level(F.col("user_rating_count")))
    )


def item_stats(train: DataFrame) -> DataFrame:
    """Average, count, deviation and popularity = average * ln(count + 1)."""
    return (
        train.groupBy("item_id")
        .agg(
            F.avg("rating").alias("item_avg_rating"),
            F.count(F.lit(1)).alias("item_rating_count"),
            F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("item_rating_std"),
        )
        .withColumn("item_popularity", F.col("item_avg_rating") * F.log1p("item_rating_count"))
    )


def bayesian_popularity(train: DataFrame, items: DataFrame, quantile: float = 0.9) -> DataFrame:
    """n/(n+m) * avg + m/(n+m) * C with m the quantile of item counts and C the global mean."""
    stats = items.select("item_id").join(item_stats(train), "item_id", "left")
    counted = stats.withColumn("item_rating_count", F.coalesce("item_rating_count", F.lit(0)))
    mean_of_items = counted.agg(F.avg("item_avg_rating")).scalar()
    overall = train.agg(F.avg("rating")).scalar()
    prior = quantile_of(counted, "item_rating_count", quantile)
    n = F.col("item_rating_count")
    average = F.coalesce("item_avg_rating", mean_of_items)
    return counted.withColumn("item_avg_rating", average).withColumn(
        "bayesian_popularity", safe_ratio(n, n + prior) * F.col("item_avg_rating") + safe_ratio(prior, n + prior) * overall
    ).select("item_id", "item_avg_rating", "item_rating_count", "bayesian_popularity")


def liked_with_items(train: DataFrame, items: DataFrame) -> DataFrame:
    liked = train.where(F.col("rating") >= LIKED).select("user_id", "item_id")
    attributes = items.select("item_id", "genres", tx.decade_label(F.col("year")).alias("decade"))
    return liked.join(attributes, "item_id")


def genre_counts(train: DataFrame, items: DataFrame) -> DataFrame:
    exploded = liked_with_items(train, items).select("user_id", F.explode("genres").alias("genre"))
    return exploded.where(F.col("genre") != "").groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("hits"))


def decade_counts(train: DataFrame, items: DataFrame) -> DataFrame:
    labelled = liked_with_items(train, items).where(F.col("decade") != "")
    return labelled.groupBy("user_id", "decade").agg(F.count(F.lit(1)).alias("hits"))


def favourites(counts: DataFrame, value: str, output: str, k: int = FAVOURITES) -> DataFrame:
    top = top_k(counts, ["user_id"], [F.desc("hits"), F.asc(value)], k)
    return ranked_list(top, ["user_id"], F.col(value), "rn", output)


def liked_list(train: DataFrame, k: int = LIST_LENGTH) -> DataFrame:
    order = [F.desc("rating"), F.desc("ts"), F.desc("item_id")]
    return top_k(train.where(F.col("rating") >= LIKED), ["user_id"], order, k)


def recent_list(train: DataFrame, k: int = LIST_LENGTH) -> DataFrame:
    return top_k(train, ["user_id"], [F.desc("ts"), F.desc("item_id"), F.desc("rating")], k)


def build_user_profile(train: DataFrame, items: DataFrame, list_length: int = LIST_LENGTH) -> DataFrame:
    """One row per user; lists are arrays, empty when there is nothing to list."""
    item = F.col("item_id")
    parts = {
        "favorite_genres": favourites(genre_counts(train, items), "genre", "favorite_genres"),
        "favorite_decades": favourites(decade_counts(train, items), "decade", "favorite_decades"),
        "liked_items": ranked_list(liked_list(train, list_length), ["user_id"], item, "rn", "liked_items"),
        "recent_items": ranked_list(recent_list(train, list_length), ["user_id"], item, "rn", "recent_items"),
    }
    profile = user_stats(train)
    for name, part in parts.items():
        empty = F.array().cast(part.schema[name].dataType)
        profile = profile.join(part, "user_id", "left").withColumn(name, F.coalesce(name, empty))
    return profile


def tag_profile(tags: DataFrame, max_tags: int = MAX_TAGS) -> DataFrame:
    """At most `max_tags` tags per item (recipe tags, then genres, then others), as a sorted set."""
    priority = F.when(F.col("tag_type") == "recipe_tag", 0).when(F.col("tag_type") == "genre", 1).otherwise(2)
    cleaned = tags.withColumn("tag", F.lower(F.trim("tag"))).where(F.col("tag") != "").distinct()
    kept = top_k(cleaned, ["item_id"], [priority, F.asc("tag"), F.asc("tag_type")], max_tags)
    return (
        kept.groupBy("item_id")
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        .withColumn("tag_count", F.size("tags").cast("long"))
    )


def build_item_profile(train: DataFrame, items: DataFrame, tags: DataFrame, max_tags: int = MAX_TAGS) -> DataFrame:
    """One row per item, rated or not; missing statistics are 0."""
    joined = items.join(item_stats(train), "item_id", "left").join(tag_profile(tags, max_tags), "item_id", "left")
    zeros = ("item_avg_rating", "item_rating_std", "item_popularity")
    filled = joined.withColumn("decade", tx.decade_label(F.col("year")))
    for name in zeros:
        filled = filled.withColumn(name, F.coalesce(name, F.lit(0.0)))
    for name in ("item_rating_count", "tag_count"):
        filled = filled.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return filled.withColumn("tags", F.coalesce("tags", tx.empty_strings()))


def genre_preference(train: DataFrame, items: DataFrame) -> DataFrame:
    """Rating-weighted share of each genre: sum(rating of items with it) / sum(all ratings)."""
    rated = train.select("user_id", "item_id", "rating").join(items.select("item_id", "genres"), "item_id")
    totals = rated.groupBy("user_id").agg(F.sum("rating").alias("total"))
    weights = (
        rated.select("user_id", F.explode(F.array_distinct("genres")).alias("genre"), "rating")
        .groupBy("user_id", "genre")
        .agg(F.sum("rating").alias("weight"))
    )
    return weights.join(totals, "user_id").select(
        "user_id", "genre", safe_ratio(F.col("weight"), F.col("total")).alias("preference")
    )


def top_tags(tags: DataFrame, tag_type: str = "genre", k: int = 10) -> DataFrame:
    counts = tags.where(F.col("tag_type") == tag_type).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("tag")).limit(k)


def mean_vectors(members: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Unit-length mean of the members' unit vectors per key. `members`: (key, item_id).

    The vector mean is one JVM aggregate per key, combined before the shuffle.
    """
    joined = members.select(key, "item_id").join(vectors.select("item_id", "vector"), "item_id")
    means = joined.groupBy(key).agg(Summarizer.mean(array_to_vector("vector")).alias("mean"))
    return means.select(key, unit(vector_to_array("mean")).alias("vector"))
