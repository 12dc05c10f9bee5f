"""Import of raw recipes and interactions, and of ready-made train/valid/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators.topk import first_per_key, top_n

RATING_SCALE = 5.0
TAG_TEXT_LIMIT, INGREDIENT_TEXT_LIMIT = 24, 40
TAG_BRIDGE_LIMIT, INGREDIENT_BRIDGE_LIMIT = 30, 20


def date_epoch(date):
    """Date text to epoch seconds; a bad date gives 0."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(date)), F.lit(0))


def typed_interactions(raw: DataFrame) -> DataFrame:
    """Raw (user_id, recipe_id, date, rating) text to typed rows; rows with a bad key or rating go."""
    return raw.select(
        F.col("user_id").try_cast("long").alias("user_id"),
        F.col("recipe_id").try_cast("long").alias("item_id"),
        F.col("rating").try_cast("double").alias("rating"),
        "date",
    ).dropna(subset=["user_id", "item_id", "rating"])


def most_frequent(df: DataFrame, key: str, at_least: int, at_most: int) -> DataFrame:
    """Keys with at least `at_least` rows; the `at_most` most frequent of them (ties by key)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return top_n(counts, [F.desc("n"), F.asc(key)], at_most).select(key) if at_most else counts.select(key)


def import_popular(
    raw: DataFrame,
    recipes: DataFrame,
    min_recipe: int = 5,
    min_user: int = 5,
    max_recipes: int = 0,
    max_users: int = 0,
    max_interactions: int = 0,
) -> DataFrame:
    """Rated interactions of popular recipes by active users as canonical ratings; 0 means no cap.

    Caps keep the most used recipes, then the most active users, then the newest rows.

    The date column must be present for the user count and the final rows, not for the recipe count.
    """
    rated = typed_interactions(raw).where(F.col("rating") > 0)
    popular = most_frequent(rated, "item_id", min_recipe, max_recipes)
    dated = rated.where(F.col("date").isNotNull()).join(popular, "item_id", "left_semi")
    active = most_frequent(dated, "user_id", min_user, max_users)
    kept = dated.join(active, "user_id", "left_semi").withColumn("ts", date_epoch(F.col("date")))
    if max_interactions:
        kept = top_n(kept, [F.desc("ts"), F.asc("user_id"), F.asc("item_id"), F.desc("rating")], max_interactions)
    unique = first_per_key(kept, ["user_id", "item_id", "ts"], [F.desc("rating")])
    known = recipes.where(F.col("name").isNotNull()).select(F.col("id").try_cast("long").alias("item_id"))
    return unique.join(known, "item_id", "left_semi").select("user_id", "item_id", "rating", "ts")


def import_splits(
    splits: dict[str, DataFrame],
    recipes: DataFrame,
    max_users: int = 0,
    max_recipes: int = 0,
    max_train: int = 0,
) -> DataFrame:
    """Train/valid/test tables as one canonical table with a `split` column; 0 means no cap.

    Caps follow the most active train users, then their most used recipes, then newest train rows.
    Of rows equal in (user, item, ts) within a split the highest rating is kept.
    """
    tables = {
        name: typed_interactions(raw).where(F.col("date").isNotNull()).withColumn("ts", date_epoch(F.col("date")))
        for name, raw in splits.items()
    }
    if max_users:
        users = most_frequent(tables["train"], "user_id", 1, max_users)
        tables = {name: df.join(users, "user_id", "left_semi") for name, df in tables.items()}
    if max_recipes:
        items = most_frequent(tables["train"], "item_id", 1, max_recipes)
        tables = {name: df.join(items, "item_id", "left_semi") for name, df in tables.items()}
    if max_train:
        order = [F.desc("ts"), F.asc("user_id"), F.asc("item_id"), F.desc("rating")]
        tables["train"] = top_n(tables["train"], order, max_train)
    union = None
    for name, df in tables.items():
        tagged = df.withColumn("split", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged)
    known = recipes.where(F.col("name").isNotNull()).select(F.col("id").try_cast("long").alias("item_id"))
    unique = (
        union.join(known, "item_id", "left_semi")
        .groupBy("split", "user_id", "item_id", "ts")
        .agg(F.max("rating").alias("rating"))
    )
    return unique.select(
        "user_id", "item_id", "rating", (F.col("rating") / RATING_SCALE).alias("rating_norm"), "ts", "split"
    )


def recipe_items(recipes: DataFrame) -> DataFrame:
    """Raw recipes (list text columns) to items: title, genres, nutrition, ingredient text."""
    year = F.year(F.try_to_timestamp("submitted"))
    title = F.coalesce(tx.blank_to_null(F.col("name")), F.lit(tx.UNTITLED))
    tokens = tx.clean_tokens(tx.literal_list(F.col("tags")), TAG_TEXT_LIMIT)
    genres = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(tx.EMPTY_GENRES_LABEL)))
    typed = recipes.withColumn("item_id", F.col("id").try_cast("long"))
    typed = typed.where(F.col("item_id").isNotNull() & F.col("name").isNotNull())
    first = first_per_key(typed, ["item_id"], [F.asc("name"), F.asc("tags"), F.asc("ingredients")])
    return first.select(
        "item_id",
        F.concat(title, F.lit(" ("), F.coalesce(year, F.lit(0)).cast("string"), F.lit(")")).alias("title"),
        title.alias("clean_title"),
        F.coalesce(year, F.lit(0)).alias("year"),
        genres.alias("genres"),
        F.size(genres).alias("genre_count"),
        tx.clean_tokens(tx.literal_list(F.col("ingredients")), INGREDIENT_TEXT_LIMIT).alias("ingredients"),
        F.coalesce(F.col("minutes").try_cast("int"), F.lit(0)).alias("minutes"),
        F.coalesce(F.col("n_steps").try_cast("int"), F.lit(0)).alias("n_steps"),
        F.coalesce(F.col("n_ingredients").try_cast("int"), F.lit(0)).alias("n_ingredients"),
        tx.nutrition_struct(F.col("nutrition")).alias("nutrition"),
    ).select("*", "nutrition.*").drop("nutrition")


def recipe_tags(recipes: DataFrame) -> DataFrame:
    """Tag bridge of raw recipes: first 30 tags and first 20 ingredients (prefixed), typed."""

    def cleaned(column: str, limit: int, prefix: str):
        values = F.slice(tx.literal_list(F.col(column)), 1, limit)
        kept = F.filter(F.transform(values, tx.clean_token), lambda token: token != "")
        return F.transform(kept, lambda token: F.concat(F.lit(prefix), token))

    values = F.concat(
        cleaned("tags", TAG_BRIDGE_LIMIT, ""), cleaned("ingredients", INGREDIENT_BRIDGE_LIMIT, "ingredient:")
    )
    kind = F.when(F.startswith(F.col("tag"), F.lit("ingredient:")), "ingredient").otherwise("recipe_tag")
    return (
        recipes.select(F.col("id").try_cast("long").alias("item_id"), F.explode(values).alias("tag"))
        .where(F.col("item_id").isNotNull())
        .withColumn("tag_type", kind)
        .distinct()
    )


# The display columns of an item.
DISPLAY_COLUMNS = (
    "has_image",
    "image_url",
    "recipe_yield_raw",
    "recipe_yield_min",
    "recipe_yield_max",
    "serves_best_guess",
    "yield_unit_raw",
    "yield_type",
    "ready_in_display",
    "author_name",
    "photo_count",
    "rating_value",
    "review_count",
)


def recipe_details(recipes: DataFrame, url_prefix: str) -> DataFrame:
    """Detail rows: list columns as JSON text, nutrition as a JSON object, slug URL."""
    typed = recipes.withColumn("item_id", F.col("id").try_cast("long")).where(F.col("item_id").isNotNull())
    first = first_per_key(typed, ["item_id"], [F.asc_nulls_last("name"), F.asc_nulls_last("tags")])
    blank = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    lists = ["tags", "ingredients", "quantities", "steps"]
    return first.select(
        "item_id",
        *[blank(name) for name in ("name", "description") if name in recipes.columns],
        F.col("minutes").try_cast("double").alias("minutes"),
        *[tx.list_json(F.col(name)).alias(f"{name}_json") for name in lists if name in recipes.columns],
        tx.nutrition_json(F.col("nutrition")).alias("nutrition_json"),
        F.concat(F.lit(url_prefix), tx.slug(F.col("name")), F.lit("-"), F.col("item_id").cast("string")).alias(
            "source_url"
        ),
    )


def with_display_columns(base: DataFrame, display: DataFrame, columns=DISPLAY_COLUMNS) -> DataFrame:
    """Left-join display columns by item, replacing columns of the same name."""
    unique = first_per_key(display, ["item_id"], [F.desc("has_image"), F.asc_nulls_last("image_url")])
    cleaned = unique.withColumn("image_url", F.trim(F.coalesce("image_url", F.lit("")))).withColumn(
        "has_image", F.coalesce(F.col("has_image").try_cast("int"), F.lit(0))
    )
    return base.drop(*[c for c in columns if c in base.columns]).join(
        cleaned.select("item_id", *columns), "item_id", "left"
    )


def image_coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a non-blank image address."""
    present = tx.blank_to_null(F.col("image_url")).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(present).alias("with_image"),
        F.coalesce(F.avg(present.cast("double")), F.lit(0.0)).alias("coverage"),
    )
