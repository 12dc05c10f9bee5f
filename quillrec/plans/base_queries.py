"""Queries over sources, projections, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrec.functions import scores as sc
from quillrec.functions import text as tx
from quillrec.operators import ingest, prepare, profiles, topk
from quillrec.operators.ranks import quantiles, with_global_rank
from quillrec.plans.registry import query

DIGITS = 6


def r(col, name):
    return F.round(col, DIGITS).alias(name)


def cnt(col, name):
    return col.cast("long").alias(name)


# --- sources -----------------------------------------------------------------------------------



def raw_interactions(d):
    """Ratings as raw text rows, the way interaction files arrive."""
    return d.raw_ratings.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("recipe_id"),
        F.date_add(F.lit("1970-01-01").cast("date"), (F.col("ts") / 86400).cast("int")).cast("string").alias("date"),
        F.col("rating").cast("string").alias("rating"),
    )


def raw_recipes(d):
    """Parts as raw recipe text rows with list-text columns."""
    quoted = F.transform("genres", lambda g: F.concat(F.lit("'"), g, F.lit("'")))
    words = F.transform("ingredients", lambda g: F.concat(F.lit("'"), g, F.lit("'")))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return d.items.select(
        F.col("item_id").cast("string").alias("id"),
        F.col("clean_title").alias("name"),
        F.col("minutes").cast("string").alias("minutes"),
        F.concat(F.col("year").cast("string"), F.lit("-06-15")).alias("submitted"),
        listed(quoted).alias("tags"),
        F.concat(
            F.lit("["), F.col("calories").cast("string"), F.lit(", "), F.col("protein_pct").cast("string"), F.lit("]")
        ).alias("nutrition"),
        F.lit("3").alias("n_steps"),
        listed(words).alias("ingredients"),
        F.size("ingredients").cast("string").alias("n_ingredients"),
    )


@query(
    "src_2_import_popular",
    """SELECT user_id, item_id, max(rating) AS rating, ts FROM (
         SELECT * FROM raw_ratings
           WHERE item_id IN (SELECT item_id FROM raw_ratings GROUP BY 1 HAVING count(*) >= 25
) AND user_id IN (
               SELECT user_id FROM raw_ratings
               WHERE item_id IN (SELECT item_id FROM raw_ratings GROUP BY 1 HAVING count(*) >= 25)
               GROUP BY 1 HAVING count(*) >= 10))
       GROUP BY user_id, item_id, ts""",
)
def import_popular(d):
    return ingest.import_popular(raw_interactions(d), raw_recipes(d), 25, 10)


@query(
    "src_3_import_splits",
    """SELECT user_id, item_id, max(rating) AS rating, round(max(rating) / 5.0, 6) AS rating_norm, ts,
              CASE WHEN ts < 915148800 THEN 'train' WHEN ts < 946684800 THEN 'valid' ELSE 'test' END AS split
       FROM raw_ratings GROUP BY user_id, item_id, ts""",
)
def import_splits(d):
    raw = raw_interactions(d)
    splits = {
        "train": raw.where(F.col("date") < "1999-01-01"),
        "valid": raw.where((F.col("date") >= "1999-01-01") & (F.col("date") < "2000-01-01")),
        "test": raw.where(F.col("date") >= "2000-01-01"),
    }
    df = ingest.import_splits(splits, raw_recipes(d))
    return df.withColumn("rating_norm", F.round("rating_norm", DIGITS))


@query(
    "src_4_parquet_scan",
    """SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
       UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events
       UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings""",
)
def parquet_scan(d):
    out = None
    for name in ("lineitem", "orders", "part", "events", "documents", "embeddings"):
        part = d.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- projections -------------------------------------------------------------------------------


@query("prj_1_clean_ratings", "SELECT user_id, item_id, rating, round(rating_norm, 6) AS rating_norm, ts FROM ratings")
def clean_ratings(d):
    text = d.raw_ratings.select(*[F.col(c).cast("string").alias(c) for c in ("user_id", "item_id", "rating", "ts")])
    return prepare.clean_ratings(text).withColumn("rating_norm", F.round("rating_norm", DIGITS))


def raw_items(d):
    return d.items.select("item_id", "title", tx.pipe_join(F.col("genres")).alias("genres"))


@query(
    "prj_2_title_year",
    """SELECT item_id, CAST(nullif(regexp_extract(title, '\\((\\d{4})\\)\\s*$', 1), '') AS INT) AS year,
              trim(regexp_replace(title, '\\s*\\(\\d{4}\\)\\s*$', '')) AS clean_title FROM items""",
)
def title_year(d):
    return prepare.clean_items(raw_items(d)).select("item_id", "year", "clean_title")


@query(
    "prj_3_genre_split",
    "SELECT item_id, array_to_string(genres, ',') AS genres, CAST(len(genres) AS INT) AS genre_count FROM items",
)
def genre_split(d):
    cleaned = prepare.clean_items(raw_items(d))
    return cleaned.select("item_id", F.array_join("genres", ",").alias("genres"), "genre_count")


@query(
    "prj_4_tag_bridge",
    """SELECT DISTINCT item_id, genre AS tag, 'genre' AS tag_type FROM item_genres
       UNION ALL SELECT DISTINCT l_partkey, lower(trim(l_returnflag || l_linestatus)), 'user_tag' FROM lineitem""",
)
def tag_bridge(d):
    given = d.table("lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"), F.concat("l_returnflag", "l_linestatus").alias("tag")
    )
    return prepare.tag_bridge(prepare.clean_items(raw_items(d)), given)


@query(
    "prj_5_clean_tokens",
    """SELECT doc_id, array_to_string(list(token ORDER BY pos)[1:24], '|') AS tokens FROM (
         SELECT doc_id, token, min(pos) AS pos FROM (
           SELECT doc_id, trim(regexp_replace(regexp_replace(lower(part), '[|,]', ' ', 'g'), '\\s+', ' ', 'g')) AS token,
                  pos FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part,
                                   generate_subscripts(string_split(text, '.'), 1) AS pos FROM documents))
         WHERE token <> '' GROUP BY doc_id, token) GROUP BY doc_id""",
)
def clean_tokens(d):
    parts = F.split(F.col("text"), r"\.")
    tokens = tx.clean_tokens(parts, ingest.TAG_TEXT_LIMIT)
    return d.documents.select("doc_id", tx.pipe_join(tokens).alias("tokens")).where(F.col("tokens") != "")


@query(
    "prj_6_nutrition",
    """SELECT p_partkey AS item_id, p_retailprice AS calories, CAST(p_size AS DOUBLE) AS total_fat_pct,
              0.0::DOUBLE AS sugar_pct, 0.0::DOUBLE AS sodium_pct, 0.0::DOUBLE AS protein_pct,
              0.0::DOUBLE AS saturated_fat_pct, 0.0::DOUBLE AS carbohydrates_pct FROM part""",
)
def nutrition(d):
    return ingest.recipe_items(raw_recipes(d)).select("item_id", *tx.NUTRITION_FIELDS)


@query(
    "prj_7_recipe_tags",
    """SELECT DISTINCT item_id, genre AS tag, 'recipe_tag' AS tag_type FROM item_genres
       UNION ALL SELECT DISTINCT item_id, 'ingredient:' || unnest(ingredients), 'ingredient' FROM items""",
)
def recipe_tags(d):
    return ingest.recipe_tags(raw_recipes(d))


@query(
    "prj_8_recipe_defaults",
    """SELECT item_id, title, clean_title, year, array_to_string(genres, '|') AS genres FROM items""",
)
def recipe_defaults(d):
    df = ingest.recipe_items(raw_recipes(d))
    return df.select("item_id", "title", "clean_title", "year", tx.pipe_join(F.col("genres")).alias("genres"))


@query(
    "prj_9_decade_label",
    """SELECT decade, count(*) AS n FROM (
         SELECT CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's' AS decade FROM items) GROUP BY 1""",
)
def decade_label(d):
    return d.items.groupBy(tx.decade_label(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_10_activity_level", "SELECT active_level, count(*) AS n FROM user_stats GROUP BY 1")
def activity_level(d):
    return profiles.user_stats(d.train).groupBy("active_level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj_11_activity_band",
    """SELECT user_id, CASE WHEN n <= 20 THEN 'cold' WHEN n <= 50 THEN 'low' WHEN n <= 100 THEN 'medium'
              WHEN n <= 500 THEN 'high' WHEN n <= 10000 THEN 'power' END AS band
       FROM (SELECT user_id, count(*) AS n FROM train GROUP BY 1)""",
)
def activity_band(d):
    counts = d.train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", tx.activity_band(F.col("n")).alias("band"))


@query(
    "prj_12_activity_code",
    """SELECT user_id, CASE active_level WHEN 'low' THEN 0.0 WHEN 'medium' THEN 1.0 ELSE 2.0 END::DOUBLE AS code
       FROM user_stats""",
)
def activity_code(d):
    return profiles.user_stats(d.train).select("user_id", tx.activity_code(F.col("active_level")).alias("code"))


@query(
    "prj_13_decade_code",
    "SELECT item_id, CAST(floor(year / 10) * 10 AS DOUBLE) AS code FROM items",
)
def decade_code(d):
    return d.items.select("item_id", tx.decade_code(tx.decade_label(F.col("year")), F.col("year")).alias("code"))


@query(
    "prj_14_pipe_terms",
    "SELECT item_id, array_to_string(genres, ',') AS terms, CAST(len(genres) AS INT) AS n FROM items",
)
def pipe_terms(d):
    padded = F.concat(F.lit(" |"), F.upper(tx.pipe_join(F.col("genres"))), F.lit("| (No Genres Listed)"))
    terms = tx.pipe_terms(padded)
    return d.items.select("item_id", F.array_join(terms, ",").alias("terms"), F.size(terms).alias("n"))


@query(
    "prj_15_detail_json",
    """SELECT item_id, '["' || array_to_string(ingredients, '","') || '"]' AS ingredients_json,
              'https://example.org/recipe/' || replace(clean_title, ' ', '-') || '-' || CAST(item_id AS VARCHAR)
                AS source_url FROM items""",
)
def detail_json(d):
    details = ingest.recipe_details(raw_recipes(d), "https://example.org/recipe/")
    return details.select("item_id", "ingredients_json", "source_url")


@query(
    "prj_16_display_columns",
    """SELECT count(*) AS rows, count(*) FILTER (p_partkey % 3 = 0) AS with_image,
              round(avg(CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM part""",
)
def display_columns(d):
    shown = d.table("part").where("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("item_id"),
        F.lit("1").alias("has_image"),
        F.concat(F.lit(" https://example.org/img/"), F.col("p_partkey").cast("string")).alias("image_url"),
    )
    joined = ingest.with_display_columns(d.items, shown, ("has_image", "image_url"))
    return ingest.image_coverage(joined).withColumn("coverage", F.round("coverage", DIGITS))


@query(
    "prj_17_unit_vectors",
    """SELECT item_id, round(vector[1], 6) AS first, round(vector[64], 6) AS last,
              round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm FROM vectors""",
)
def unit_vectors(d):
    v = F.col("vector")
    return d.vectors.select(
        "item_id", r(F.element_at(v, 1), "first"), r(F.element_at(v, 64), "last"), r(sc.norm(v), "norm")
    )


@query(
    "prj_18_vector_text",
    "SELECT vec_id AS item_id, CAST(len(embedding) AS INT) AS dim, true AS same FROM embeddings",
)
def vector_text(d):
    back = sc.text_to_vector(sc.vector_to_text(F.col("embedding")))
    return d.table("embeddings").select(
        F.col("vec_id").alias("item_id"), F.size(back).alias("dim"), (back == F.col("embedding")).alias("same")
    )


@query(
    "prj_19_jaccard",
    """SELECT user_id, item_id, round(CASE WHEN len(favorite_genres) = 0 THEN 0.0 ELSE
              len(list_intersect(favorite_genres, genres)) /
              (len(favorite_genres) + len(genres) - len(list_intersect(favorite_genres, genres))) END, 6) AS overlap
       FROM test JOIN user_profile USING (user_id) JOIN items USING (item_id)""",
)
def jaccard(d):
    fav = profiles.favourites(profiles.genre_counts(d.train, d.items), "genre", "favorite_genres")
    joined = d.test.join(fav, "user_id", "left").join(d.items.select("item_id", "genres"), "item_id")
    liked = F.coalesce("favorite_genres", tx.empty_strings())
    return joined.select("user_id", "item_id", r(sc.jaccard(liked, F.col("genres")), "overlap"))


QUERY_WORDS = ("the", "ing", "und", "que")


@query(
    "prj_20_term_match",
    """SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'ing') AS INT)
              + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'que') AS INT)) / 4, 6) AS score
       FROM documents""",
)
def term_match(d):
    terms = F.array(*[F.lit(w) for w in QUERY_WORDS])
    return d.documents.select("doc_id", r(sc.term_match(F.lower("text"), terms), "score"))


@query(
    "prj_21_token_overlap",
    """SELECT doc_id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[|,;/\\s]+')),
              ['the', 'ing', 'und', 'que'])) / 4, 6) AS score FROM documents""",
)
def token_overlap(d):
    terms = F.array(*[F.lit(w) for w in QUERY_WORDS])
    return d.documents.select("doc_id", r(sc.token_overlap(tx.token_set(F.col("text")), terms), "score"))


@query(
    "prj_22_global_min_max",
    """SELECT item_id, round((item_popularity - lo) / (hi - lo), 6) AS score FROM item_profile,
              (SELECT min(item_popularity) AS lo, max(item_popularity) AS hi FROM item_profile)""",
)
def global_min_max(d):
    stats = d.items.select("item_id").join(profiles.item_stats(d.train), "item_id", "left")
    stats = stats.select("item_id", F.coalesce("item_popularity", F.lit(0.0)).alias("p"))
    span = stats.agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi"))).scalar()
    return stats.select("item_id", r(sc.min_max(F.col("p"), span["lo"], span["hi"]), "score"))


@query(
    "prj_24_content_text",
    """SELECT item_id, lower(clean_title || ' ' || title || ' ' || array_to_string(genres, ' ')) AS content FROM items""",
)
def content_text(d):
    text = tx.content_text(F.col("clean_title"), F.col("title"), tx.pipe_join(F.col("genres")), F.lit(" _| "))
    return d.items.select("item_id", text.alias("content"))


@query(
    "prj_28_ab_group",
    """SELECT c_custkey AS user_id, CASE WHEN CAST('0x' || substr(sha256('default:' || CAST(c_custkey AS VARCHAR)), 1, 8)
              AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS grp FROM customer""",
)
def ab_group(d):
    return d.table("customer").select(
        F.col("c_custkey").alias("user_id"), sc.ab_group(F.lit("default"), F.col("c_custkey")).alias("grp")
    )


# --- joins used on their own ---------------------------------------------------------------------


@query(
    "jn_1_semi_valid_users",
    "SELECT user_id, item_id, rating FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 30)",
)
def semi_valid_users(d):
    valid = d.ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    return d.ratings.join(valid, "user_id", "left_semi").select("user_id", "item_id", "rating")


@query(
    "jn_2_left_item_attributes",
    """SELECT user_id, item_id, rating, decade, array_to_string(genres, '|') AS genres
       FROM train LEFT JOIN item_profile USING (item_id)""",
)
def left_item_attributes(d):
    attributes = d.items.select(
        "item_id", tx.decade_label(F.col("year")).alias("decade"), tx.pipe_join(F.col("genres")).alias("genres")
    )
    return d.train.select("user_id", "item_id", "rating").join(attributes, "item_id", "left")


@query(
    "jn_5_anti_test_users",
    "SELECT DISTINCT user_id FROM ratings WHERE user_id NOT IN (SELECT user_id FROM train WHERE rating >= 5)",
)
def anti_test_users(d):
    fans = d.train.where("rating >= 5").select("user_id").distinct()
    return d.ratings.select("user_id").distinct().join(fans, "user_id", "left_anti")


# --- aggregates ------------------------------------------------------------------------------------


@query(
    "agg_1_user_stats",
    """SELECT user_id, user_rating_count, round(user_avg_rating, 6) AS user_avg_rating,
              round(user_rating_std, 6) AS user_rating_std, user_min_rating, user_max_rating, active_level
       FROM user_stats""",
)
def user_stats(d):
    df = profiles.user_stats(d.train)
    return df.withColumn("user_avg_rating", F.round("user_avg_rating", DIGITS)).withColumn(
        "user_rating_std", F.round("user_rating_std", DIGITS)
    )


@query(
    "agg_2_item_stats",
    """SELECT item_id, round(item_avg_rating, 6) AS item_avg_rating, item_rating_count,
              round(item_rating_std, 6) AS item_rating_std, round(item_popularity, 6) AS item_popularity
       FROM item_stats""",
)
def item_stats(d):
    df = profiles.item_stats(d.train)
    for name in ("item_avg_rating", "item_rating_std", "item_popularity"):
        df = df.withColumn(name, F.round(name, DIGITS))
    return df


@query(
    "agg_3_bayesian_popularity",
    """SELECT item_id, item_rating_count, round(item_avg_rating, 6) AS item_avg_rating,
              round(item_rating_count / (item_rating_count + m) * item_avg_rating
                    + m / (item_rating_count + m) * c, 6) AS bayesian_popularity
       FROM (SELECT item_id, coalesce(s.item_rating_count, 0) AS item_rating_count,
                    coalesce(s.item_avg_rating, (SELECT avg(item_avg_rating) FROM item_stats)) AS item_avg_rating
             FROM items LEFT JOIN item_stats s USING (item_id)),
            (SELECT quantile_cont(coalesce(s.item_rating_count, 0), 0.9) AS m
             FROM items LEFT JOIN item_stats s USING (item_id)),
            (SELECT avg(rating) AS c FROM train)""",
)
def bayesian_popularity(d):
    df = profiles.bayesian_popularity(d.train, d.items)
    return df.withColumn("item_avg_rating", F.round("item_avg_rating", DIGITS)).withColumn(
        "bayesian_popularity", F.round("bayesian_popularity", DIGITS)
    )


@query(
    "agg_4_genre_decade_counts",
    """SELECT user_id, genre AS value, 'genre' AS kind, hits FROM genre_counts
       UNION ALL SELECT user_id, decade, 'decade', hits FROM decade_counts""",
)
def genre_decade_counts(d):
    genres = profiles.genre_counts(d.train, d.items).select("user_id", F.col("genre").alias("value"), F.lit("genre").alias("kind"), "hits")
    decades = profiles.decade_counts(d.train, d.items).select("user_id", F.col("decade").alias("value"), F.lit("decade").alias("kind"), "hits")
    return genres.unionByName(decades)


@query(
    "agg_5_ordered_lists",
    "SELECT user_id, array_to_string(favorite_genres, '|') AS favorite_genres FROM favorite_genres",
)
def ordered_lists(d):
    fav = profiles.favourites(profiles.genre_counts(d.train, d.items), "genre", "favorite_genres")
    return fav.withColumn("favorite_genres", tx.pipe_join(F.col("favorite_genres")))


@query(
    "agg_6_tag_profile",
    "SELECT item_id, array_to_string(tags, '|') AS tag_text, tag_count FROM tag_profile",
)
def tag_profile(d):
    df = profiles.tag_profile(d.tags)
    return df.select("item_id", tx.pipe_join(F.col("tags")).alias("tag_text"), "tag_count")


@query(
    "agg_8_genre_preference",
    """SELECT user_id, genre, round(sum(rating) / max(total), 6) AS preference FROM train
       JOIN item_genres USING (item_id) JOIN (SELECT user_id, sum(rating) AS total FROM train GROUP BY 1) USING (user_id)
       GROUP BY user_id, genre""",
)
def genre_preference(d):
    return profiles.genre_preference(d.train, d.items).withColumn("preference", F.round("preference", DIGITS))


@query(
    "agg_9_mean_vectors",
    """SELECT label, round(list_sum(list_transform(m, lambda x: x * x)), 6) AS squared,
              round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first,
              round(m[64] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS last
       FROM (SELECT label, list(x ORDER BY pos) AS m FROM (
               SELECT label, pos, avg(x) AS x FROM (
                 SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM vectors)
               GROUP BY label, pos) GROUP BY label)""",
)
def mean_vectors(d):
    members = d.vectors.select("label", "item_id")
    means = profiles.mean_vectors(members, d.vectors, "label")
    raw = d.vectors.select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    squared = raw.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("squared"))
    return means.join(squared, "label").select(
        "label",
        r(F.col("squared"), "squared"),
        r(F.element_at("vector", 1), "first"),
        r(F.element_at("vector", 64), "last"),
    )


@query(
    "agg_10_summary",
    """SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
              min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS avg_rating FROM ratings""",
)
def summary(d):
    return d.ratings.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        r(F.avg("rating"), "avg_rating"),
    )


@query(
    "agg_17_quantiles",
    """SELECT q, round(CASE q WHEN 0.35 THEN quantile_cont(item_popularity, 0.35) WHEN 0.65 THEN
              quantile_cont(item_popularity, 0.65) ELSE quantile_cont(item_popularity, 0.7) END, 6) AS quantile
       FROM item_profile, (SELECT unnest([0.35::DOUBLE, 0.65::DOUBLE, 0.7::DOUBLE]) AS q) GROUP BY q""",
)
def popularity_quantiles(d):
    stats = d.items.select("item_id").join(profiles.item_stats(d.train), "item_id", "left")
    filled = stats.select(F.coalesce("item_popularity", F.lit(0.0)).alias("p"))
    return quantiles(filled, [], "p", [0.35, 0.65, 0.7]).withColumn("quantile", F.round("quantile", DIGITS))


# --- windows, sorts, set operations ------------------------------------------------------------------


@query("win_1_leave_one_out", "SELECT user_id, item_id, rating, ts FROM test")
def leave_one_out(d):
    return d.test.select("user_id", "item_id", "rating", "ts")


@query(
    "win_2_favourites",
    """SELECT user_id, array_to_string(favorite_decades, '|') AS favorite_decades FROM favorite_decades""",
)
def favourite_decades(d):
    fav = profiles.favourites(profiles.decade_counts(d.train, d.items), "decade", "favorite_decades")
    return fav.withColumn("favorite_decades", tx.pipe_join(F.col("favorite_decades")))


@query(
    "win_3_item_lists",
    """SELECT user_id, item_id, CAST(rn AS INT) AS rn, 'liked' AS kind FROM liked_rows WHERE rn <= 20
       UNION ALL SELECT user_id, item_id, CAST(rn AS INT), 'recent' FROM recent_rows WHERE rn <= 20""",
)
def item_lists(d):
    liked = profiles.liked_list(d.train).select("user_id", "item_id", "rn", F.lit("liked").alias("kind"))
    recent = profiles.recent_list(d.train).select("user_id", "item_id", "rn", F.lit("recent").alias("kind"))
    return liked.unionByName(recent)


@query(
    "win_4_tag_cap",
    """SELECT item_id, tag, tag_type FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY
              CASE tag_type WHEN 'recipe_tag' THEN 0 WHEN 'genre' THEN 1 ELSE 2 END, tag, tag_type) AS rn FROM tags)
       WHERE rn <= 3""",
)
def tag_cap(d):
    priority = F.when(F.col("tag_type") == "recipe_tag", 0).when(F.col("tag_type") == "genre", 1).otherwise(2)
    order = [priority, F.asc("tag"), F.asc("tag_type")]
    return topk.top_k(d.tags, ["item_id"], order, 3).select("item_id", "tag", "tag_type")


@query("win_5_liked_guard", "SELECT DISTINCT user_id, item_id FROM liked_rows WHERE rn <= 100")
def liked_guard(d):
    from quillrec.operators.itemcf import liked_pairs

    return liked_pairs(d.train, max_liked=100)


@query(
    "win_9_pages",
    """SELECT user_id, item_id, CAST(rn AS INT) AS rn, CAST((rn - 1 - 12 % n + n) % n + 1 AS INT) AS slot FROM (
         SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM liked_rows WHERE rn <= 30)
       WHERE (rn - 1 - 12 % n + n) % n + 1 <= 5""",
)
def pages(d):
    liked = profiles.liked_list(d.train, 30).select("user_id", "item_id", "rn")
    return topk.wrap_slice(liked, ["user_id"], "rn", F.lit(12), 5)


@query(
    "win_9_offset_page",
    "SELECT user_id, item_id, CAST(rn AS INT) AS rn FROM recent_rows WHERE rn > 5 AND rn <= 10",
)
def offset_page(d):
    order = [F.desc("ts"), F.desc("item_id"), F.desc("rating")]
    return topk.page(d.train, ["user_id"], order, 5, 5).select("user_id", "item_id", "rn")


@query(
    "srt_1_popular_items",
    """SELECT item_id, has_image, round(item_popularity, 6) AS item_popularity FROM item_profile
       ORDER BY has_image DESC, round(item_popularity, 6) DESC, round(item_avg_rating, 6) DESC, item_rating_count DESC, item_id
       LIMIT 50""",
)
def popular_items(d):
    from quillrec.operators.scenarios import popular

    return popular(d.item_profile, 50).select("item_id", "has_image", r(F.col("item_popularity"), "item_popularity"))


@query(
    "srt_2_top_genres",
    "SELECT tag, count(*) AS n FROM tags WHERE tag_type = 'genre' GROUP BY 1 ORDER BY n DESC, tag LIMIT 10",
)
def top_genres(d):
    return profiles.top_tags(d.tags)


@query(
    "srt_3_candidate_pool",
    """SELECT item_id, CAST(rn AS BIGINT) AS pool_rank FROM (SELECT item_id, row_number() OVER (ORDER BY
         round(item_popularity, 6) DESC, item_rating_count DESC, round(item_avg_rating, 6) DESC, item_id) AS rn
         FROM item_profile) WHERE rn <= 1500""",
)
def candidate_pool(d):
    order = [
        F.desc(F.round("item_popularity", DIGITS)),
        F.desc("item_rating_count"),
        F.desc(F.round("item_avg_rating", DIGITS)),
        F.asc("item_id"),
    ]
    return with_global_rank(d.item_profile.select("item_id", "item_popularity", "item_rating_count", "item_avg_rating"), order, "pool_rank").where(
        "pool_rank <= 1500"
    ).select("item_id", "pool_rank")


@query(
    "set_1_union",
    """SELECT user_id, item_id, 1 AS label FROM train WHERE rating >= 4
       UNION ALL SELECT user_id, item_id, 0 FROM train WHERE rating <= 3""",
)
def union(d):
    likes = d.train.where("rating >= 4").select("user_id", "item_id", F.lit(1).alias("label"))
    rest = d.train.where("rating <= 3").select("user_id", "item_id", F.lit(0).alias("label"))
    return likes.unionByName(rest)


@query(
    "set_2_intersect",
    "SELECT user_id, item_id FROM train INTERSECT SELECT user_id, item_id FROM test",
)
def intersect(d):
    return d.train.select("user_id", "item_id").intersect(d.test.select("user_id", "item_id"))


@query("set_3_distinct", "SELECT user_id, item_id, max(rating) AS rating FROM train GROUP BY 1, 2")
def distinct(d):
    first = topk.first_per_key(d.train, ["user_id", "item_id"], [F.desc("rating"), F.desc("ts")])
    return first.select("user_id", "item_id", "rating")
