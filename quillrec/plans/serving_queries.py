"""Queries over served lists, search, user matching, feedback, sinks and streams."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators import feedback, knowledge, nearest, prepare, profiles, scenarios, search, usermatch
from quillrec.operators.topk import supplement, top_k
from quillrec.plans.rank_queries import ranked50
from quillrec.plans.recall_queries import ingredient_bridge
from quillrec.plans.registry import VIEWS, query, view
from quillrec.session import DEFAULTS, shared_dir, stage
from quillrec.sinks import tables as sinks
from quillrec.sources import tables as sources
from quillrec.streaming import feedback_stream as fs
from quillrec.streaming.keyed_sink import KeyedSink, write_keyed

DIGITS = 6
STREAM_LIMIT_SECONDS = 3600


def scratch(d, name: str) -> str:
    return f"{shared_dir(d.spark)}/{name}-{uuid.uuid4().hex}"


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in columns})


# --- raw files -------------------------------------------------------------------------------------


@query("src_1_raw_csv_scan", "SELECT user_id, item_id, rating, ts FROM ratings")
def raw_csv_scan(d):
    root = scratch(d, "raw")
    names = {"user_id": "userId", "item_id": "movieId", "ts": "timestamp"}
    sinks.write_csv(d.raw_ratings.withColumnsRenamed(names), f"{root}/inner/ratings.csv")
    sinks.write_csv(d.items.select("item_id", "title", "genres").withColumnsRenamed(names), f"{root}/inner/movies.csv")
    tags = d.tags.select(F.lit(0).alias("user_id"), "item_id", "tag", F.lit(0).alias("ts"))
    sinks.write_csv(tags.withColumnsRenamed(names), f"{root}/inner/tags.csv")
    return prepare.clean_ratings(sources.read_raw(d.spark, root)["ratings"]).drop("rating_norm")


def dictionary(d) -> DataFrame:
    """Distinct item names with their frequency and, for half of them, a given label without Latin letters."""
    counts = d.items.groupBy(F.col("clean_title").alias("ingredient")).agg(F.count(F.lit(1)).alias("count"))
    given = F.when(F.length("ingredient") % 2 == 0, F.translate("ingredient", "abcdefghijklmnopqrstuvwxyz", "0123456789!#$%&*+:;<=>?@^~"))
    return counts.withColumn("translated_ingredient", F.coalesce(given, F.lit("x")))


def word_labels(d) -> DataFrame:
    return d.items.select(F.explode("ingredients").alias("name")).distinct().withColumn("label", F.upper("name"))


def phrase_labels(d) -> DataFrame:
    return d.items.where(F.startswith("clean_title", F.lit("red"))).select(
        F.col("clean_title").alias("name"), F.concat(F.lit("#"), F.col("clean_title")).alias("label")
    ).distinct()


view(
    "dictionary",
    """SELECT clean_title AS name, count(*) AS n, CASE WHEN length(clean_title) % 2 = 0 THEN
              translate(clean_title, 'abcdefghijklmnopqrstuvwxyz', '0123456789!#$%&*+:;<=>?@^~') ELSE 'x' END AS raw_label
       FROM items GROUP BY clean_title""",
)
view(
    "catalog",
    """SELECT name, n, CASE WHEN starts_with(name, 'red') THEN '#' || name WHEN raw_label <> 'x' THEN raw_label
              ELSE replace(upper(name), ' ', '') END AS label FROM dictionary""",
)


@query("src_6_ingredient_dictionary", "SELECT name, raw_label, n FROM dictionary")
def ingredient_dictionary(d):
    path = scratch(d, "dictionary")
    dictionary(d).write.options(header=True, sep="\t").csv(path)
    return sources.read_ingredient_dictionary(d.spark, path)


def catalog(d) -> DataFrame:
    table = dictionary(d).select(
        F.col("ingredient").alias("name"), F.col("translated_ingredient").alias("raw_label"), F.col("count").alias("n")
    )
    return search.ingredient_catalog(table, phrase_labels(d), word_labels(d))


@query("prj_30_ingredient_labels", "SELECT name, label, n FROM catalog")
def ingredient_labels(d):
    return catalog(d)


# --- sinks -------------------------------------------------------------------------------------------


@query("snk_1_csv_export", "SELECT item_id, title, array_to_string(genres, '|') AS genres FROM items")
def csv_export(d):
    path = scratch(d, "export")
    sinks.write_csv(d.items.select("item_id", "title", "genres"), path)
    back = sources.read_text_table(d.spark, path, ("item_id", "title", "genres"))
    return back.withColumn("item_id", F.col("item_id").cast("long"))


@query(
    "snk_2_upsert",
    """SELECT item_id, CASE WHEN item_id % 2 = 0 AND item_id % 4 <> 0 THEN upper(title) ELSE title END AS title, CASE WHEN item_id % 2 = 0 THEN 9 ELSE minutes END AS minutes
       FROM items WHERE item_id % 5 <> 0 OR item_id % 2 = 0""",
)
def upsert(d):
    table = sinks.VersionedTable(d.spark, scratch(d, "items"))
    base = d.items.select("item_id", "title", "minutes")
    table.upsert(base.where("item_id % 5 <> 0 OR item_id % 4 = 0"), ["item_id"])
    changed = base.where("item_id % 2 = 0").select(
        "item_id", F.when(F.col("item_id") % 4 != 0, F.upper("title")).alias("title"), F.lit(9).alias("minutes")
    )
    return table.upsert(changed, ["item_id"], keep_old=["title"])


@query(
    "snk_3_replace_run",
    """SELECT run_id, user_id, item_id, CAST(rank_position AS INT) AS rank_position, score, event_type FROM (
         SELECT 'second' AS run_id, user_id, item_id, rank_position, CASE WHEN rank_position = 1 THEN rank_score ELSE 0.5 END AS score,
                'offline_import' AS event_type FROM ranked50 WHERE rank_position <= 3
         UNION ALL SELECT 'first', user_id, item_id, rank_position, rank_score, 'offline_import' FROM ranked50 WHERE rank_position <= 2)""",
)
def replace_run(d):
    path = scratch(d, "runs")
    top = ranked50(d)
    mmr = F.when(F.col("rank_position") == 1, 0.0).otherwise(0.5)
    plain = F.lit(None).cast("double")
    first = top.where("rank_position <= 2").withColumns({"run_id": F.lit("first"), "mmr_score": plain})
    old = top.where("rank_position <= 9").withColumns({"run_id": F.lit("second"), "mmr_score": mmr})
    new = top.where("rank_position <= 3").withColumns({"run_id": F.lit("second"), "mmr_score": mmr})
    sinks.replace_run(d.spark, sinks.import_log(first.unionByName(old), "ranker"), path)
    final = sinks.replace_run(d.spark, sinks.import_log(new, "ranker"), path)
    return final.select("run_id", "user_id", "item_id", "rank_position", "score", "event_type")


@query(
    "snk_4_metric_upsert",
    """SELECT 'r1' AS run_id, channel AS model_name, 10 AS k, CASE channel WHEN 'hot' THEN round(avg(score), 6) ELSE 0.0 END AS precision
       FROM candidates GROUP BY channel""",
)
def metric_upsert(d):
    means = d.candidates.groupBy(F.col("channel").alias("model_name")).agg(F.round(F.avg("score"), DIGITS).alias("precision"))
    rows = means.select(F.lit("r1").alias("run_id"), "model_name", F.lit(10).alias("k"), "precision")
    table = sinks.VersionedTable(d.spark, scratch(d, "metrics"))
    table.upsert(rows.withColumn("precision", F.lit(0.0)), ["run_id", "model_name", "k"])
    return table.upsert(rows.where("model_name = 'hot'"), ["run_id", "model_name", "k"])


@query(
    "snk_6_search_documents",
    """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN clean_title ELSE title END AS title, array_to_string(tags, ' ') AS tags_text,
              array_to_string(ingredients, ' ') AS ingredients_text FROM item_profile""",
)
def search_documents(d):
    words = F.concat(F.lit('["'), F.array_join("ingredients", '", "'), F.lit('"]'))
    profile = d.item_profile.select(
        "item_id", F.when(F.col("item_id") % 3 != 0, F.col("title")).alias("title"), "clean_title", F.array_join("tags", " ").alias("tag_text")
    )
    detail = d.items.select("item_id", F.col("clean_title").alias("name"), words.alias("ingredients_json"))
    return search.search_documents(profile, detail).select("item_id", "title", "tags_text", "ingredients_text")


# --- lists for users -----------------------------------------------------------------------------------


@query(
    "qry_popular",
    """SELECT item_id, title, round(item_popularity, 6) AS score FROM item_profile ORDER BY has_image DESC, round(item_popularity, 6) DESC,
              round(item_avg_rating, 6) DESC, item_rating_count DESC, item_id LIMIT 20""",
)
def qry_popular(d):
    return scenarios.popular(d.item_profile, 20).select("item_id", "title", F.round("item_popularity", DIGITS).alias("score"))


view(
    "popular_ranked",
    """SELECT item_id, row_number() OVER (ORDER BY has_image DESC, round(item_popularity, 6) DESC, round(item_avg_rating, 6) DESC,
              item_rating_count DESC, item_id) AS rank_position FROM item_profile""",
)


@query(
    "qry_personal",
    """SELECT user_id, item_id, CAST(priority AS INT) AS priority, CAST(position AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, rank_position, item_id) AS position FROM (
           SELECT user_id, item_id, min(priority) AS priority, arg_min(rank_position, priority) AS rank_position FROM (
             SELECT user_id, item_id, rank_position, 0 AS priority FROM ranked50 WHERE rank_position <= 10 AND user_id % 3 = 0
             UNION ALL SELECT user_id, item_id, rank_position, 1 FROM ranked50 WHERE rank_position <= 15 AND user_id % 3 < 2
             UNION ALL SELECT c_custkey, item_id, rank_position, 2 FROM customer, popular_ranked WHERE rank_position <= 40)
           GROUP BY 1, 2)) WHERE position <= 20""",
)
def qry_personal(d):
    users = d.table("customer").select(F.col("c_custkey").alias("user_id"))
    top = ranked50(d).select("user_id", "item_id", "rank_position")
    final = top.where("rank_position <= 10 AND user_id % 3 = 0")
    longer = top.where("rank_position <= 15 AND user_id % 3 < 2")
    return scenarios.personal(users, final, longer, d.item_profile, 20)


@query(
    "set_5_supplement",
    """SELECT user_id, item_id, CAST(priority AS INT) AS priority, CAST(position AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, rank_position, item_id) AS position FROM (
           SELECT user_id, item_id, min(priority) AS priority, arg_min(rank_position, priority) AS rank_position FROM (
             SELECT user_id, item_id, rank_position, 0 AS priority FROM ranked50 WHERE rank_position <= 4
             UNION ALL SELECT user_id, item_id, rn, 1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM hot) WHERE rn <= 24)
           GROUP BY 1, 2)) WHERE position <= 12""",
)
def set_supplement(d):
    first = ranked50(d).where("rank_position <= 4").select("user_id", "item_id", "rank_position")
    popular = top_k(d.candidates.where("channel = 'hot'"), ["user_id"], [F.desc("score"), F.asc("item_id")], 24, "rank_position")
    return supplement([first, popular.select("user_id", "item_id", "rank_position")], ["user_id"], "item_id", "rank_position", 12)


@query(
    "qry_userprofile",
    """SELECT user_id, array_to_string(list(item_id ORDER BY rn) FILTER (kind = 'best'), '|') AS top_rated,
              array_to_string(list(item_id ORDER BY rn) FILTER (kind = 'new'), '|') AS recent FROM (
         SELECT user_id, item_id, 'best' AS kind, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, ts DESC, item_id DESC) AS rn FROM train
         UNION ALL SELECT user_id, item_id, 'new', rn FROM recent_rows) WHERE rn <= 10 GROUP BY user_id""",
)
def qry_userprofile(d):
    table = scenarios.user_overview(d.train, profiles.genre_preference(d.train, d.items))
    return joined(table.select("user_id", "top_rated", "recent"), "top_rated", "recent")


# --- cold start ------------------------------------------------------------------------------------------


def requests(d) -> DataFrame:
    """One preference per nation."""
    key = F.col("n_nationkey")
    pick = lambda step, *values: F.element_at(F.array(*map(F.lit, values)), key % step + 1)
    none = tx.empty_strings()
    return d.table("nation").select(
        key.cast("long").alias("pref_id"),
        F.array(pick(4, "red", "Small|blue", "type-promo", "hot, cold")).alias("preferred_tags"),
        F.when(key % 3 == 0, F.array(pick(2, "gizmo", "widget"), F.lit("rod"))).otherwise(none).alias("ingredients"),
        F.when(key % 2 == 0, F.array(F.lit("Low-Calorie"), F.lit("high protein"))).otherwise(none).alias("dietary_goals"),
        F.when(key % 4 == 1, F.lit(30)).alias("max_minutes"),
        F.when(key % 5 == 0, F.lit(2.9)).cast("double").alias("min_rating"),
        (key % 7 == 0).alias("require_image"),
        pick(3, "pantry", "health", "quick_meal").alias("scenario"),
    )


PREF_SQL = """SELECT *, list_sort(list_distinct(list_concat(list_concat(tag_terms, ingredient_terms), {goal_terms}))) AS terms FROM (
     SELECT CAST(n_nationkey AS BIGINT) AS pref_id, {tags} AS tag_terms,
            CASE WHEN n_nationkey % 3 = 0 THEN [CASE n_nationkey % 2 WHEN 0 THEN 'gizmo' ELSE 'widget' END, 'rod'] ELSE [] END AS ingredient_terms,
            n_nationkey, {minutes} AS max_minutes, {rating} AS min_rating, n_nationkey % 7 = 0 AS require_image FROM nation {where})"""
TAGS_SQL = """(CASE n_nationkey % 4 WHEN 0 THEN ['red'] WHEN 1 THEN ['blue', 'small'] WHEN 2 THEN ['type-promo'] ELSE ['cold', 'hot'] END)"""
view(
    "prefs",
    PREF_SQL.format(
        tags=TAGS_SQL,
        goal_terms="CASE WHEN n_nationkey % 2 = 0 THEN ['high protein', 'low-calorie'] ELSE [] END",
        minutes="CASE WHEN n_nationkey % 4 = 1 THEN 30 END",
        rating="CASE WHEN n_nationkey % 5 = 0 THEN 2.9 END",
        where="",
    ),
)
view(
    "pref_items",
    """SELECT p.*, item_id, minutes, calories, protein_pct, has_image, item_avg_rating, item_rating_count,
              lower(concat_ws(' ', title, clean_title, array_to_string(genres, '|'), array_to_string(tags, '|'), array_to_string(ingredients, '|'))) AS text
       FROM prefs p JOIN item_profile i ON (min_rating IS NULL OR item_avg_rating >= min_rating) AND (max_minutes IS NULL OR minutes <= max_minutes)
         AND (len(ingredient_terms) = 0 OR len(list_intersect(ingredients, ingredient_terms)) > 0) AND (NOT require_image OR has_image > 0)""",
)
view(
    "cold",
    """SELECT pref_id, item_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY pref_id ORDER BY score DESC, item_id) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY pref_id ORDER BY score DESC, item_avg_rating DESC, item_rating_count DESC, item_id) AS short FROM (
           SELECT pref_id, item_id, item_avg_rating, item_rating_count, round(
             0.34 * coalesce(list_sum(list_transform(terms, lambda t: CAST(contains(text, t) AS INT))), 0) / len(terms)
             + 0.18 * CASE WHEN len(ingredient_terms) = 0 THEN 0 ELSE list_sum(list_transform(ingredient_terms, lambda t: CAST(contains(text, t) AS INT))) / len(ingredient_terms) END
             + 0.16 * list_sum(list_transform(tag_terms, lambda t: CAST(contains(text, t) AS INT))) / len(tag_terms)
             + 0.12 * CASE WHEN n_nationkey % 2 = 0 THEN (CAST(calories <= 500 AS INT) + CAST(protein_pct >= q AS INT)) / 2 ELSE 0 END
             + 0.08 * CASE WHEN max_minutes IS NULL THEN 0.5 ELSE least(greatest(max_minutes / greatest(CAST(minutes AS DOUBLE), 1), 0), 1) END
             + 0.08 * least(greatest(item_avg_rating, 0), 5) / 5 + 0.03 * ln(1 + item_rating_count) / peak + 0.01 * has_image, 6) AS score
           FROM pref_items JOIN (SELECT pref_id, quantile_cont(protein_pct, 0.65) AS q, ln(1 + max(item_rating_count)) AS peak FROM pref_items GROUP BY 1) USING (pref_id)))
       WHERE short <= 160) WHERE position <= 20""",
)


@query("qry_cold", "SELECT pref_id, item_id, score, CAST(position AS INT) AS position FROM cold")
def qry_cold(d):
    return scenarios.cold_start(requests(d), d.item_profile, 20)


@query(
    "qry_cold_kg",
    """SELECT pref_id, item_id, score, CAST(row_number() OVER (PARTITION BY pref_id ORDER BY position) AS INT) AS position FROM (
         SELECT c.*, m.pref_id IS NOT NULL AS member, bool_or(m.pref_id IS NOT NULL) OVER (PARTITION BY c.pref_id) AS hit FROM cold c
         LEFT JOIN (SELECT pref_id, item_id FROM (
             SELECT *, row_number() OVER (PARTITION BY pref_id ORDER BY score DESC, item_id) AS rn FROM (
               SELECT pref_id, item_id, CAST(count(DISTINCT ingredient) AS DOUBLE) AS score
               FROM (SELECT pref_id, unnest(ingredient_terms) AS t FROM prefs) JOIN item_ingredients ON contains(ingredient, t) GROUP BY 1, 2))
           WHERE rn <= 20) m ON m.pref_id = c.pref_id AND m.item_id = c.item_id) WHERE member OR NOT hit""",
)
def qry_cold_kg(d):
    asked = stage(requests(d))
    lists = scenarios.cold_start(asked, d.item_profile, 20)
    wanted = asked.where(F.size("ingredients") > 0).select(F.col("pref_id").alias("qid"), "ingredients")
    members = knowledge.by_ingredients(wanted, ingredient_bridge(d), 20).select(
        F.col("qid").alias("pref_id"), "item_id", F.col("rn").alias("member_rank")
    )
    return scenarios.prefer_members(lists, members, 20)


SCENARIO_TAGS_SQL = f"""list_sort(list_distinct({TAGS_SQL} || CASE n_nationkey % 3 WHEN 0 THEN ['main-ingredient', 'easy']
            WHEN 1 THEN ['healthy', 'dietary'] ELSE ['easy', 'quick', '30-minutes-or-less', 'time-to-make'] END))"""
view(
    "scenario_prefs",
    PREF_SQL.format(
        tags=SCENARIO_TAGS_SQL,
        goal_terms="""CASE WHEN n_nationkey % 2 = 0 THEN ['high protein', 'low-calorie']
                      WHEN n_nationkey % 3 = 1 THEN ['healthy', 'low-calorie', 'low-fat'] ELSE [] END""",
        minutes="CASE WHEN n_nationkey % 4 = 1 OR n_nationkey % 3 = 2 THEN 30 END",
        rating="CASE WHEN n_nationkey % 5 = 0 THEN 2.9 WHEN n_nationkey % 3 = 1 THEN 4.0 END",
        where="",
    ),
)
view("scenario_items", VIEWS["pref_items"].replace("FROM prefs p", "FROM scenario_prefs p"))
view(
    "scenario_lists",
    VIEWS["cold"].replace("pref_items", "scenario_items").replace(
        "/ 2 ELSE 0 END", "/ 2 WHEN n_nationkey % 3 = 1 THEN CAST(calories <= 500 AS INT) / 2 ELSE 0 END"
    ),
)


@query("qry_scenario", "SELECT pref_id, item_id, score, CAST(position AS INT) AS position FROM scenario_lists")
def qry_scenario(d):
    return scenarios.cold_start(scenarios.expand_scenarios(requests(d)), d.item_profile, 20)


# --- search ------------------------------------------------------------------------------------------------


def text_queries(d) -> DataFrame:
    return d.items.select(F.substring("clean_title", 2, 6).alias("query")).distinct()


@query(
    "qry_search_substring",
    """SELECT query, item_id FROM (SELECT query, item_id, row_number() OVER (PARTITION BY query ORDER BY item_id) AS rn
         FROM (SELECT DISTINCT substr(clean_title, 2, 6) AS query FROM items) q JOIN items i ON contains(lower(i.title || ' ' || i.clean_title), query))
       WHERE rn <= 20""",
)
def search_substring(d):
    return search.substring_search(text_queries(d), d.items, "item_id", F.concat_ws(" ", "title", "clean_title"))


BOOSTS = {"title": 4.0, "tags_text": 1.0}
view(
    "postings",
    """SELECT item_id, field, word, count(*) AS tf, max(len) AS len FROM (
         SELECT item_id, field, len(w) AS len, unnest(w) AS word FROM (
           SELECT item_id, 'title' AS field, regexp_extract_all(lower(title), '\\w\\w+') AS w FROM item_profile
           UNION ALL SELECT item_id, 'tags_text', regexp_extract_all(array_to_string(tags, ' '), '\\w\\w+') FROM item_profile)) GROUP BY 1, 2, 3""",
)
view(
    "terms",
    """SELECT query, w AS term, w AS word, 1.0 AS weight FROM (
         SELECT DISTINCT query, unnest(regexp_extract_all(query, '\\w\\w+')) AS w FROM (SELECT DISTINCT clean_title AS query FROM items))""",
)
view(
    "search_exact",
    """SELECT query, item_id, max(s) AS score FROM (
         SELECT query, item_id, field, round(sum(w), 6) AS s FROM (
           SELECT query, term, item_id, field, max(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))
                  * CASE field WHEN 'title' THEN 4.0 ELSE 1.0 END) AS w
           FROM terms JOIN postings USING (word) JOIN (SELECT field, word, count(*) AS df FROM postings GROUP BY 1, 2) USING (field, word)
           JOIN (SELECT field, count(*) AS n, avg(len) AS avg_len FROM (SELECT DISTINCT item_id, field, len FROM postings) GROUP BY 1) USING (field)
           GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


def search_docs(d) -> DataFrame:
    return d.item_profile.select("item_id", "title", F.array_join("tags", " ").alias("tags_text"))


@query(
    "qry_search_weighted",
    """SELECT query, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rn FROM search_exact)
       WHERE rn <= 20""",
)
def search_weighted(d):
    queries = d.items.select(F.col("clean_title").alias("query")).distinct()
    return search.weighted_search(queries, search_docs(d), "item_id", BOOSTS, 20, fuzzy=False)


view(
    "fuzzy_terms",
    """SELECT query, term, word, 1 - levenshtein(term, word)::DOUBLE / least(length(term), length(word)) AS weight FROM (
         SELECT DISTINCT query, unnest(regexp_extract_all(query, '\\w\\w+')) AS term FROM (
           SELECT DISTINCT substr(clean_title, 1, 4) || substr(clean_title, 6, 20) AS query FROM items))
       JOIN (SELECT DISTINCT word FROM postings)
         ON levenshtein(term, word) <= CASE WHEN length(term) < 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END""",
)


@query(
    "qry_search_fuzzy",
    """SELECT query, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rn FROM (
         SELECT query, item_id, max(s) AS score FROM (
           SELECT query, item_id, field, round(sum(w), 6) AS s FROM (
             SELECT query, term, item_id, field, max(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))
                    * CASE field WHEN 'title' THEN 4.0 ELSE 1.0 END) AS w
             FROM fuzzy_terms JOIN postings USING (word) JOIN (SELECT field, word, count(*) AS df FROM postings GROUP BY 1, 2) USING (field, word)
             JOIN (SELECT field, count(*) AS n, avg(len) AS avg_len FROM (SELECT DISTINCT item_id, field, len FROM postings) GROUP BY 1) USING (field)
             GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE rn <= 20""",
)
def search_fuzzy(d):
    queries = d.items.select(F.concat(F.substring("clean_title", 1, 4), F.substring("clean_title", 6, 20)).alias("query"))
    return search.weighted_search(queries.distinct(), search_docs(d), "item_id", BOOSTS, 20)


@query(
    "qry_ingr",
    """SELECT query, name, label, n, CAST(position AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY query ORDER BY r, length(label), n DESC, length(name), lower(label), name) AS position FROM (
           SELECT *, row_number() OVER (PARTITION BY query, lower(label) ORDER BY r, length(label), n DESC, length(name), name) AS d FROM (
             SELECT query, name, label, n, CASE WHEN lower(label) = query THEN 1 WHEN starts_with(lower(label), query) THEN 2 WHEN contains(lower(label), query) THEN 3
                    WHEN name = query THEN 4 WHEN starts_with(name, query) THEN 5 ELSE 6 END AS r
             FROM (SELECT DISTINCT unnest(ingredients) AS query FROM items) q JOIN catalog ON contains(lower(label), query) OR contains(name, query)))
         WHERE d = 1) WHERE position <= 30""",
)
def qry_ingr(d):
    queries = d.items.select(F.explode("ingredients").alias("query")).distinct()
    return search.ingredient_matches(queries, catalog(d), 30)


# --- user matching -------------------------------------------------------------------------------------------


def accounts(d) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 1000).alias("is_discoverable"))


view("eligible", "SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 1000")


@query("set_4_eligible_users", "SELECT user_id FROM eligible")
def eligible_users(d):
    return usermatch.eligible_users(d.ratings, accounts(d))


view(
    "twins",
    """SELECT user_id, twin_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, twin_id) AS rn FROM (
         SELECT a.item_id AS user_id, b.item_id AS twin_id, round(list_inner_product(a.vector, b.vector), 6) AS score
         FROM vectors a JOIN vectors b ON a.item_id <> b.item_id WHERE b.item_id IN (SELECT user_id FROM eligible))) WHERE rn <= 10""",
)


def twins(d) -> DataFrame:
    vectors = d.vectors.select(F.col("item_id").alias("user_id"), "vector")
    return usermatch.user_matches(vectors, usermatch.eligible_users(d.ratings, accounts(d)), 10)


@query("twin_1_matches", "SELECT * FROM twins")
def twin_matches(d):
    return twins(d)


view(
    "signs",
    """SELECT user_id, item_id, bool_or(feedback_type = 'like' OR (feedback_type = 'rating' AND feedback_value >= 4)) AS positive,
              bool_or(feedback_type = 'dislike' OR (feedback_type = 'rating' AND feedback_value <= 2)) AS negative FROM feedback GROUP BY 1, 2""",
)


@query(
    "twin_2_rerank",
    """SELECT user_id, twin_id, round(score + coalesce(change, 0), 6) AS score FROM twins LEFT JOIN (
         SELECT t.user_id, t.twin_id, 0.015 * count(*) FILTER (positive AND high) + 0.01 * count(*) FILTER (negative AND low)
                - 0.02 * count(*) FILTER (negative AND high) AS change
         FROM twins t JOIN signs s ON s.user_id = t.user_id JOIN (SELECT user_id AS twin_id, item_id, bool_or(rating >= 4) AS high,
              bool_or(rating <= 2) AS low FROM ratings GROUP BY 1, 2) o ON o.twin_id = t.twin_id AND o.item_id = s.item_id GROUP BY 1, 2)
       USING (user_id, twin_id)""",
)
def twin_rerank(d):
    return usermatch.rerank_matches(stage(twins(d)), usermatch.feedback_signs(d.feedback), d.ratings)


view(
    "twin_high",
    "SELECT user_id AS twin_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, ts DESC, item_id DESC) AS rn FROM ratings WHERE rating >= 4",
)
view(
    "twin_low",
    "SELECT user_id AS twin_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating, ts DESC, item_id DESC) AS rn FROM ratings WHERE rating <= 2",
)


@query(
    "twin_3_cards",
    """SELECT t.user_id, t.twin_id, round(least(greatest(score, 0), 1) * 100, 1) AS match_score,
              coalesce(array_to_string(h.items[1:CASE WHEN l.items IS NULL THEN 6 ELSE 3 END], '|'), '') AS high, coalesce(array_to_string(l.items, '|'), '') AS low
       FROM twins t LEFT JOIN (SELECT twin_id, list(item_id ORDER BY rn) AS items FROM twin_high WHERE rn <= 6 GROUP BY 1) h USING (twin_id)
       LEFT JOIN (SELECT twin_id, list(item_id ORDER BY rn) AS items FROM twin_low WHERE rn <= 3 GROUP BY 1) l USING (twin_id)""",
)
def twin_cards(d):
    cards = usermatch.match_cards(twins(d), d.user_profile, d.ratings)
    return joined(cards.select("user_id", "twin_id", "match_score", "high", "low"), "high", "low")


@query(
    "twin_4_favourites",
    """SELECT user_id, twin_id, item_id, CAST(rn AS INT) AS position FROM (
         SELECT t.user_id, t.twin_id, r.item_id, row_number() OVER (PARTITION BY t.user_id, t.twin_id ORDER BY rating DESC, ts DESC, r.item_id DESC) AS rn
         FROM twins t JOIN ratings r ON r.user_id = t.twin_id AND rating >= 4
         WHERE NOT EXISTS (SELECT 1 FROM ratings x WHERE x.user_id = t.user_id AND x.item_id = r.item_id)) WHERE rn <= 5""",
)
def twin_favourites(d):
    return usermatch.twin_favourites(twins(d), d.ratings, 5).select("user_id", "twin_id", "item_id", "position")


view(
    "shared",
    """SELECT t.user_id, t.twin_id, item_id, round(avg(rating), 6) AS score, max(ts) AS latest FROM twins t
       JOIN ratings r ON r.user_id IN (t.user_id, t.twin_id) AND rating >= 4 GROUP BY 1, 2, 3 HAVING count(DISTINCT r.user_id) = 2""",
)


@query("agg_15_shared_favourites", "SELECT * FROM shared")
def shared_favourites(d):
    return usermatch.shared_favourites(twins(d), d.ratings)


@query(
    "twin_5_joint_menu",
    """SELECT user_id, twin_id, item_id, score, CAST(rn AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, twin_id ORDER BY score DESC, latest DESC, item_id DESC) AS rn FROM (
           SELECT * FROM shared
           UNION ALL
           SELECT user_id, twin_id, item_id, round(2.0 * len(list_intersect(list_distinct(list_concat(genres, tags)), mine)) + item_avg_rating
                  + least(item_rating_count, 50) / 50, 6), 0
           FROM (SELECT t.user_id, t.twin_id, list_distinct(list_concat(coalesce(a.favorite_genres[1:5], []), coalesce(b.favorite_genres[1:5], []))) AS mine FROM twins t
                 LEFT JOIN user_profile a ON a.user_id = t.user_id LEFT JOIN user_profile b ON b.user_id = t.twin_id
                 WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.user_id = t.user_id AND s.twin_id = t.twin_id)) p, item_profile i
           WHERE NOT EXISTS (SELECT 1 FROM ratings x WHERE x.user_id = p.user_id AND x.item_id = i.item_id)))
       WHERE rn <= 30""",
)
def joint_menu(d):
    return usermatch.joint_menu(stage(twins(d)), d.ratings, d.user_profile, d.item_profile)


view(
    "collections",
    """SELECT user_id, item_id, max(ts) AS ts FROM feedback WHERE feedback_type IN ('click', 'like') GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
)


def collections(d) -> DataFrame:
    return usermatch.current_collections(d.feedback.where("feedback_type IN ('click', 'like')"))


@query("twin_6_collections", "SELECT * FROM collections")
def twin_collections(d):
    return collections(d)


@query(
    "twin_6_timeline",
    """SELECT user_id, item_id, record_type, value, ts, CAST(rn AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, item_id DESC) AS rn FROM (
           SELECT user_id, item_id, 'collection' AS record_type, NULL::DOUBLE AS value, ts, -1 AS event_id FROM collections
           UNION ALL SELECT user_id, item_id, feedback_type, feedback_value, ts, event_id FROM feedback
           WHERE feedback_type IN ('like', 'dislike', 'not_interested', 'rating'))) WHERE rn <= 20""",
)
def twin_timeline(d):
    return usermatch.activity_timeline(collections(d), d.feedback, 20)


# --- feedback ------------------------------------------------------------------------------------------------


def explicit(d) -> DataFrame:
    return d.feedback.where("feedback_type <> 'exposure'")


AB_SQL = """SELECT run_id AS group_name, count(*) FILTER (feedback_type <> 'exposure') AS events, count(*) FILTER (feedback_type = 'exposure') AS exposures,
    {f} * count(*) FILTER (feedback_type = 'click') AS clicks, {f} * count(*) FILTER (feedback_type = 'like') AS likes,
    {f} * count(*) FILTER (feedback_type = 'dislike') AS negatives,
    round({f} * count(*) FILTER (feedback_type = 'click') / count(*) FILTER (feedback_type = 'exposure'), 6) AS ctr,
    round({f} * count(*) FILTER (feedback_type = 'like') / count(*) FILTER (feedback_type = 'exposure'), 6) AS like_rate,
    round({f} * count(*) FILTER (feedback_type = 'dislike') / count(*) FILTER (feedback_type = 'exposure'), 6) AS negative_rate
    FROM feedback GROUP BY run_id"""


@query("agg_12_ab_metrics", AB_SQL.format(f=2))
def ab_metrics(d):
    return feedback.ab_metrics(d.feedback, explicit(d))


@query("agg_12_ab_metrics_dedup", AB_SQL.format(f=1))
def ab_metrics_dedup(d):
    return feedback.ab_metrics(d.feedback, explicit(d), dedup=True)


@query(
    "agg_13_business_counters",
    """SELECT count(*) FILTER (feedback_type <> 'exposure') AS feedback_total, count(*) AS recommendation_events,
              count(*) FILTER (feedback_type = 'exposure') AS exposures, count(*) FILTER (feedback_type = 'click') AS clicks,
              count(*) FILTER (feedback_type = 'like') AS likes, count(*) FILTER (feedback_type = 'dislike') AS negatives,
              round(count(*) FILTER (feedback_type = 'click') / count(*) FILTER (feedback_type = 'exposure'), 6) AS ctr FROM feedback""",
)
def business_counters(d):
    return feedback.business_counters(d.feedback, explicit(d))


@query(
    "agg_14_outcome_counters",
    f"""SELECT event_type AS source, count(*) AS requests, count(*) FILTER (c = 0) AS empty, round(sum(value) / 1000, 6) AS duration_seconds,
               CAST(sum(c) AS BIGINT) AS results, {', '.join(f'count(*) FILTER (c <= {b}) AS le_{b}' for b in feedback.RESULT_BUCKETS)}
        FROM (SELECT event_type, value, CAST(floor(value) AS BIGINT) AS c FROM events) GROUP BY 1""",
)
def outcome_counters(d):
    table = d.table("events").select(
        F.col("event_type").alias("source"), F.col("value").alias("duration_ms"), F.floor("value").alias("result_count")
    )
    return feedback.outcome_counters(table, ["source"])


# --- streams ---------------------------------------------------------------------------------------------------


def message_file(d) -> str:
    """Events as JSON text lines, with a broken line and an event without a usable id per hundred."""
    path = scratch(d, "messages")
    good = d.feedback.where("feedback_type <> 'exposure'")
    body = F.to_json(
        F.struct(
            "event_id",
            "user_id",
            F.col("item_id").alias("recipe_id"),
            F.concat(F.lit(" "), F.initcap("feedback_type")).alias("feedback_type"),
            "feedback_value",
            F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        )
    )
    broken = F.when(F.col("event_id") % 100 == 7, F.substring(body, 1, 20)).when(
        F.col("event_id") % 100 == 8, F.replace(body, F.lit('"recipe_id":'), F.lit('"other":'))
    )
    good.select(F.coalesce(broken, body).alias("value")).write.text(path)
    return path


def messages(d) -> DataFrame:
    """A batch takes as many files as there are cores: most users have events in every batch, so each batch reads all state."""
    files = str(max(2, d.spark.sparkContext.defaultParallelism))
    return fs.parse_messages(fs.read_messages(d.spark, "text", path=message_file(d), maxFilesPerTrigger=files))


def run_stream(d, stream: DataFrame, name: str, mode: str = "update", transform=None) -> str:
    path = scratch(d, name)
    handle = fs.write_batches(stream, path, scratch(d, f"{name}-checkpoint"), mode, transform)
    if not handle.awaitTermination(STREAM_LIMIT_SECONDS):
        handle.stop()
        raise TimeoutError(f"stream {name} did not finish in {STREAM_LIMIT_SECONDS} s")
    return path


def run_keyed(d, stream: DataFrame, name: str, transform=None, alive: str | None = None) -> DataFrame:
    """Newest rows of each user once the stream is drained."""
    sink = KeyedSink(scratch(d, name), "user_id", alive)
    handle = write_keyed(stream, sink, scratch(d, f"{name}-checkpoint"), transform)
    if not handle.awaitTermination(STREAM_LIMIT_SECONDS):
        handle.stop()
        raise TimeoutError(f"stream {name} did not finish in {STREAM_LIMIT_SECONDS} s")
    return sink.rows(d.spark)


view("stream_events", "SELECT * FROM feedback WHERE feedback_type <> 'exposure' AND event_id % 100 NOT IN (7, 8)")


@query(
    "src_7_message_stream",
    """SELECT problem, count(*) AS n FROM (SELECT CASE event_id % 100 WHEN 7 THEN 'not an event' WHEN 8 THEN 'bad id' ELSE 'good' END AS problem
       FROM feedback WHERE feedback_type <> 'exposure') GROUP BY 1""",
)
def message_stream(d):
    path = run_stream(d, messages(d).select(F.coalesce("problem", F.lit("good")).alias("problem")), "raw-events", "append")
    return d.spark.read.parquet(path).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("str_1_parse", "SELECT event_id, user_id, item_id, feedback_type, feedback_value, ts FROM stream_events")
def str_parse(d):
    path = run_stream(d, fs.good_events(messages(d)), "parsed", "append")
    read = d.spark.read.parquet(path)
    return read.select("event_id", "user_id", "item_id", "feedback_type", "feedback_value", (F.col("ts") / 1_000_000).cast("long").alias("ts"))


@query(
    "str_2_known_types",
    """SELECT feedback_type, count(*) AS n, CAST(feedback_type <> 'exposure' AS INT) AS known FROM feedback GROUP BY 1""",
)
def str_known(d):
    allowed, rejected = fs.with_known_type(d.feedback)
    both = allowed.withColumn("known", F.lit(1)).unionByName(rejected.withColumn("known", F.lit(0)))
    return both.groupBy("feedback_type", "known").agg(F.count(F.lit(1)).alias("n"))


PROFILE_SQL = """SELECT user_id, recent_events, coalesce(positive_items, '') AS positive_items, coalesce(negative_items, '') AS negative_items FROM
  (SELECT user_id, string_agg(event_id, '|' ORDER BY ts DESC, event_id DESC) AS recent_events FROM (
     SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {source}) WHERE rn <= 50 GROUP BY 1)
  LEFT JOIN (SELECT user_id, string_agg(item_id, '|' ORDER BY rn) AS positive_items FROM (
     SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (
       SELECT user_id, item_id, max((ts, event_id)) AS last FROM {source} WHERE feedback_type IN ('click', 'like', 'seen') GROUP BY 1, 2))
     WHERE rn <= 100 GROUP BY 1) USING (user_id)
  LEFT JOIN (SELECT user_id, string_agg(item_id, '|' ORDER BY rn) AS negative_items FROM (
     SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (
       SELECT user_id, item_id, max((ts, event_id)) AS last FROM {source} WHERE feedback_type IN ('dislike', 'not_interested') GROUP BY 1, 2))
     WHERE rn <= 100 GROUP BY 1) USING (user_id)"""
LISTS = ("recent_events", "positive_items", "negative_items")


@contextmanager
def keyed_state(spark):
    """Keyed state needs the RocksDB store; a session that was not built by `build_session` gets it for one stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, DEFAULTS[name])
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("str_3_live_profiles", PROFILE_SQL.format(source="stream_events"))
def str_profiles(d):
    with keyed_state(d.spark):
        latest = run_keyed(d, fs.live_profile_stream(fs.good_events(messages(d)), ttl_ms=None), "profiles")
    return joined(latest.select("user_id", *LISTS), *LISTS)


view(
    "newest_events",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM feedback) WHERE place <= 50",
)


@query("str_4_profiles_from_log", PROFILE_SQL.format(source="newest_events"))
def str_log_profiles(d):
    return joined(feedback.live_profiles(d.feedback, 50), *LISTS)


view(
    "seeds",
    """SELECT user_id, item_id, max(w) AS weight FROM (
         SELECT user_id, item_id, place, CASE WHEN b > 0 THEN b * greatest(1 - 0.04 * (place - 1), 0.35) END AS w, neg FROM (
           SELECT *, feedback_type = 'dislike' AS neg, CASE feedback_type WHEN 'like' THEN 1.25 WHEN 'click' THEN 0.85
                  WHEN 'rating' THEN greatest((feedback_value - 3) / 2, 0) ELSE 0 END AS b FROM newest_events)
         UNION ALL
         SELECT user_id, item_id, 0, 0.75, false FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (
             SELECT user_id, item_id, max((ts, event_id)) AS last FROM newest_events WHERE feedback_type IN ('click', 'like') GROUP BY 1, 2)) WHERE rn <= 20)
       WHERE w IS NOT NULL OR neg GROUP BY 1, 2""",
)


def log_profiles(d) -> DataFrame:
    """Profiles rebuilt from the log, with the arrays the stream emits."""
    recent = top_k(d.feedback, ["user_id"], feedback.newest_first(), 50)
    entry = F.array_sort(F.collect_list(F.struct("rn", "item_id", "feedback_type", "feedback_value")))
    arrays = recent.groupBy("user_id").agg(entry.alias("m")).select(
        "user_id",
        F.transform("m", lambda x: x["item_id"]).alias("recent_items"),
        F.transform("m", lambda x: x["feedback_type"]).alias("recent_types"),
        F.transform("m", lambda x: x["feedback_value"]).alias("recent_values"),
    )
    return feedback.live_profiles(d.feedback, 50).join(arrays, "user_id")


@query("str_5_seed_weights", "SELECT user_id, item_id, round(weight, 6) AS weight FROM seeds")
def str_seeds(d):
    seeds, _ = fs.profile_seeds(log_profiles(d))
    return seeds.withColumn("weight", F.round("weight", DIGITS))


LIVE_SQL = """SELECT user_id, item_id, score, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
         SELECT s.user_id, n.similar_id AS item_id, round(sum(n.score * s.weight), 10) AS score FROM {seeds} s JOIN (
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id) AS rn FROM (
             SELECT a.item_id, b.item_id AS similar_id, round(list_inner_product(a.vector, b.vector), 6) AS score
             FROM vectors a JOIN vectors b ON a.item_id <> b.item_id)) WHERE rn <= 160) n ON n.item_id = s.item_id WHERE s.weight IS NOT NULL GROUP BY 1, 2) c
         WHERE NOT EXISTS (SELECT 1 FROM {seeds} b WHERE b.user_id = c.user_id AND b.item_id = c.item_id))
       WHERE rn <= 20"""


@query("str_6_live_recommendations", LIVE_SQL.format(seeds="seeds"))
def str_recommendations(d):
    similar = nearest.similar_vectors(d.vectors, 160)
    return fs.live_lists(stage(log_profiles(d)), similar, 20).select("user_id", "item_id", "score", "position")


view(
    "stream_seeds",
    """SELECT user_id, item_id, max(w) AS weight FROM (
         SELECT user_id, item_id, CASE WHEN b > 0 THEN b * greatest(1 - 0.04 * (place - 1), 0.35) END AS w, feedback_type = 'dislike' AS neg FROM (
           SELECT *, CASE feedback_type WHEN 'like' THEN 1.25 WHEN 'click' THEN 0.85
                  WHEN 'rating' THEN greatest((feedback_value - 3) / 2, 0) ELSE 0 END AS b FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM stream_events) WHERE place <= 50)
         UNION ALL
         SELECT user_id, item_id, 0.75, false FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (
             SELECT user_id, item_id, max((ts, event_id)) AS last FROM stream_events WHERE feedback_type IN ('click', 'like', 'seen') GROUP BY 1, 2)) WHERE rn <= 20
         UNION ALL
         SELECT user_id, item_id, NULL, true FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (
             SELECT user_id, item_id, max((ts, event_id)) AS last FROM stream_events
             WHERE feedback_type IN ('dislike', 'not_interested') GROUP BY 1, 2)) WHERE rn <= 100)
       WHERE w IS NOT NULL OR neg GROUP BY 1, 2""",
)


@query("snk_5_live_sink", LIVE_SQL.format(seeds="stream_seeds"))
def live_sink(d):
    """Stream to profiles to recommendations in a compacted sink; each user's newest list counts."""
    similar = stage(nearest.similar_vectors(d.vectors, 160))
    stream = fs.live_profile_stream(fs.good_events(messages(d)), ttl_ms=None)
    with keyed_state(d.spark):
        rows = run_keyed(d, stream, "live", lambda batch: fs.replacing_lists(batch, similar, 20), "item_id IS NOT NULL")
    return rows.select("user_id", "item_id", "score", "position")


@query("str_7_event_counters", "SELECT feedback_type AS event_type, count(*) AS n FROM stream_events GROUP BY 1")
def str_counters(d):
    path = run_stream(d, feedback.event_counters(fs.good_events(messages(d))), "counters")
    return fs.latest_per_key(d.spark, path, "event_type")


@query(
    "str_8_windowed_rates",
    """SELECT w AS window_start, w + 600 AS window_end, count(*) AS events, count(*) FILTER (feedback_type = 'click') AS clicks,
              count(*) FILTER (feedback_type = 'like') AS likes, count(*) FILTER (feedback_type = 'dislike') AS dislikes,
              round(count(*) FILTER (feedback_type = 'click') / count(*), 6) AS clicks_rate
       FROM (SELECT feedback_type, (ts // 60 - unnest(range(0, 10))) * 60 AS w FROM stream_events) GROUP BY w
       HAVING w + 600 <= (SELECT max(ts) FROM stream_events) - 600""",
)
def str_windows(d):
    path = scratch(d, "windows-in")
    d.feedback.where("feedback_type <> 'exposure' AND event_id % 100 NOT IN (7, 8)").select(
        "feedback_type", F.timestamp_seconds("ts").alias("created_at")
    ).write.parquet(path)
    stream = d.spark.readStream.schema("feedback_type string, created_at timestamp").parquet(path)
    out = run_stream(d, fs.windowed_rates(stream), "windows", "append")
    return d.spark.read.parquet(out).drop("likes_rate", "dislikes_rate", "batch_id")

