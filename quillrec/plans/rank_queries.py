"""Queries over features, ranking, explanation, evaluation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators import diversify, evaluate, features, models, profiles, quality, reasons
from quillrec.operators.nearest import liked_for_query, vector_checks
from quillrec.operators.skew import dealt
from quillrec.plans.recall_queries import tag_bridge
from quillrec.plans.registry import query, view
from quillrec.session import stage

DIGITS = 6


def rounded(df, columns, digits=DIGITS):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- features --------------------------------------------------------------------------------------

FEATURE_SQL = {
    **{c: f"coalesce(CAST(u.{c} AS DOUBLE), 0.0)" for c in features.USER_FEATURES if c != "active_level_code"},
    "active_level_code": "CASE u.active_level WHEN 'low' THEN 0.0 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 2.0 ELSE 0.0 END::DOUBLE",
    **{
        c: f"coalesce(CAST(i.{c} AS DOUBLE), 0.0)"
        for c in ("item_avg_rating", "item_rating_count", "item_rating_std", "item_popularity", "genre_count", "tag_count")
    },
    "item_year": "CAST(i.year AS DOUBLE)",
    "item_decade_code": "CAST(floor(i.year / 10) * 10 AS DOUBLE)",
    "genre_match_score": "coalesce(len(list_intersect(u.favorite_genres, i.genres)), 0) / CAST(i.genre_count AS DOUBLE)",
    "decade_match_score": "CAST(coalesce(list_contains(u.favorite_decades, i.decade), false) AS INT)::DOUBLE",
    "user_item_score_gap": "abs(coalesce(u.user_avg_rating, 0) - coalesce(i.item_avg_rating, 0))",
    **{c: "0.0::DOUBLE" for c in features.RECALL_FEATURES},
    **{
        c: f"coalesce(CAST(f.{c} AS DOUBLE), 0.0)"
        for c in ("itemcf_score", "hot_score", "is_itemcf_recall", "is_hot_recall", "recall_source_count", "merged_score")
    },
}
FEATURE_LIST = ", ".join(f"round({FEATURE_SQL[c]}, 6) AS {c}" for c in features.FEATURES)
FEATURE_JOINS = """LEFT JOIN user_profile u USING (user_id) LEFT JOIN item_profile i USING (item_id)
                   LEFT JOIN fused f USING (user_id, item_id)"""
view("labelled", "SELECT user_id, item_id, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS label FROM train WHERE rating >= 4 OR rating <= 3")
view("relevant", "SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4")


def train_table(d):
    return features.train_features(d.train, d.user_profile, d.item_profile, d.fused)


def candidate_table(d):
    return features.candidate_features(d.fused, d.test, d.user_profile, d.item_profile)


@query("rnk_1_train_features", f"SELECT user_id, item_id, label, {FEATURE_LIST} FROM labelled {FEATURE_JOINS}")
def rnk_train(d):
    return rounded(train_table(d), features.FEATURES)


@query(
    "rnk_1_candidate_features",
    f"""SELECT user_id, item_id, label, {FEATURE_LIST} FROM (
          SELECT user_id, item_id, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM relevant) AS INT) AS label FROM fused)
        {FEATURE_JOINS}""",
)
def rnk_candidates(d):
    return rounded(candidate_table(d), features.FEATURES)


@query(
    "rnk_2_pair_features",
    f"""SELECT user_id, item_id, label, {', '.join(f'round({FEATURE_SQL[c]}, 6) AS {c}' for c in features.PAIR_FEATURES)}
        FROM labelled {FEATURE_JOINS}""",
)
def rnk_pairs(d):
    return rounded(train_table(d).select("user_id", "item_id", "label", *features.PAIR_FEATURES), features.PAIR_FEATURES)


@query(
    "jn_9_feature_join",
    """SELECT user_id, item_id, user_rating_count, item_rating_count, tag_count FROM fused
       LEFT JOIN user_profile USING (user_id) LEFT JOIN item_profile USING (item_id)""",
)
def feature_join(d):
    users = d.user_profile.select("user_id", "user_rating_count")
    items = d.item_profile.select("item_id", "item_rating_count", "tag_count")
    # Both grow with the data, but look small enough to broadcast.
    pairs = d.fused.select("user_id", "item_id").join(users.hint("merge"), "user_id", "left")
    return pairs.join(items.hint("merge"), "item_id", "left")


@query(
    "rnk_3_basic_features",
    """SELECT user_id, item_id, rating, round(u.user_avg_rating, 6) AS user_avg_rating, u.user_rating_count,
              round(u.user_rating_std, 6) AS user_rating_std, round(coalesce(s.item_avg_rating, mean), 6) AS item_avg_rating,
              coalesce(s.item_rating_count, 0) AS item_rating_count, CAST(i.year AS DOUBLE) AS item_year,
              round(coalesce(g.m, 0), 6) AS genre_match,
              round(coalesce(list_inner_product(t.vector, v.vector), 0.0), 6) AS embedding_similarity
       FROM test JOIN user_stats u USING (user_id) JOIN items i USING (item_id) LEFT JOIN item_stats s USING (item_id)
       LEFT JOIN taste t USING (user_id) LEFT JOIN vectors v USING (item_id)
       LEFT JOIN (SELECT user_id, item_id, sum(preference) AS m FROM test JOIN item_genres USING (item_id) JOIN (
           SELECT user_id, genre, sum(rating) / max(total) AS preference FROM train JOIN item_genres USING (item_id)
           JOIN (SELECT user_id, sum(rating) AS total FROM train GROUP BY 1) USING (user_id) GROUP BY 1, 2) USING (user_id, genre)
         GROUP BY 1, 2) g USING (user_id, item_id), (SELECT avg(item_avg_rating) AS mean FROM item_stats)""",
)
def rnk_basic(d):
    taste = profiles.mean_vectors(liked_for_query(d.train), d.vectors, "user_id")
    df = features.basic_pair_features(
        d.test.select("user_id", "item_id", "rating"),
        profiles.user_stats(d.train),
        d.items,
        profiles.bayesian_popularity(d.train, d.items),
        profiles.genre_preference(d.train, d.items),
        taste,
        d.vectors,
    ).drop("bayesian_popularity")
    return rounded(df, ("user_avg_rating", "user_rating_std", "item_avg_rating", "genre_match", "embedding_similarity"))


@query(
    "prj_29_enhanced_features",
    """SELECT user_id, item_id, round(1 - least(abs(user_avg_rating - item_avg_rating), 5) / 5, 6) AS rating_alignment_score,
              round(merged_score * (1 + recall_source_count), 6) AS recall_strength_score,
              round(ln(1 + minutes), 6) AS log_minutes, round(protein_pct / calories, 6) AS protein_per_calorie,
              round(1.0 / (1 + 2026 - year), 6) AS recipe_recency_score,
              CAST(list_contains(recent_items, item_id) AS INT)::DOUBLE AS is_recent_user_item,
              CAST(list_contains(liked_items, item_id) AS INT)::DOUBLE AS is_liked_user_item
       FROM fused JOIN user_profile USING (user_id) JOIN item_profile USING (item_id)""",
)
def enhanced(d):
    names = (
        "rating_alignment_score", "recall_strength_score", "log_minutes", "protein_per_calorie", "recipe_recency_score",
        "is_recent_user_item", "is_liked_user_item",
    )
    df = features.with_enhanced_features(candidate_table(d), d.user_profile, d.items)
    return rounded(df.select("user_id", "item_id", *names), names)


@query(
    "srt_4_negative_sample",
    """SELECT user_id, item_id, 1 AS label FROM train WHERE rating >= 4
       UNION ALL SELECT user_id, item_id, 0 FROM (
         SELECT *, row_number() OVER (ORDER BY sha256('42:' || user_id || ':' || item_id || ':' || ts), user_id, item_id, ts) AS rn
         FROM train WHERE rating <= 3)
       WHERE rn <= (SELECT floor(count(*) * 0.5) FROM train WHERE rating >= 4)""",
)
def negative_sample(d):
    return features.labelled_pairs(d.train, negative_ratio=0.5)


@query(
    "srt_5_stratified_sample",
    """SELECT user_id, item_id, label FROM (
         SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || user_id || ':' || item_id), user_id, item_id) AS rn,
                greatest(floor(5000 * count(*) OVER (PARTITION BY label) / count(*) OVER ()), 1) AS quota FROM labelled)
       WHERE rn <= quota""",
)
def stratified_sample(d):
    pairs = features.labelled_pairs(d.train)
    return features.stratified_sample(pairs, "label", ["user_id", "item_id"], 5000).select("user_id", "item_id", "label")


@query(
    "srt_6_user_split",
    """SELECT user_id, item_id, ts, CAST('0x' || substr(sha256('42:' || user_id), 1, 8) AS BIGINT) % 100 < 20 AS is_valid FROM train""",
)
def user_split(d):
    return d.train.select("user_id", "item_id", "ts", features.is_validation_user(F.col("user_id")).alias("is_valid"))


# --- models ------------------------------------------------------------------------------------------


def fitted(d, rounds=5):
    train, valid = models.split_by_user(stage(train_table(d)))
    return models.fit("gbt", models.boosted_classifier(4, 0.1, rounds), train, features.FEATURES), valid


@query("rnk_4_classifier")
def classifier(d):
    ranker, valid = fitted(d)
    return models.classification_metrics(ranker.scored(valid), ranker.name)


@query("rnk_5_model_selection")
def model_selection(d):
    train, valid = models.split_by_user(stage(train_table(d)))
    _, table = models.select_model(train, valid, features.FEATURES)
    return table


@query("rnk_7_scored_top")
def scored_top(d):
    ranker, _ = fitted(d)
    scored = ranker.scored(candidate_table(d))
    return models.rank_top(scored, 50, scale=True).select("user_id", "item_id", "rank_score", "rank_position")


@query("rnk_9_rating_regressor")
def rating_regressor(d):
    names = ("user_avg_rating", "user_rating_count", "item_avg_rating", "item_rating_count")
    pairs = d.train.select("user_id", "item_id", "rating")
    table = pairs.join(profiles.user_stats(d.train), "user_id").join(profiles.item_stats(d.train), "item_id")
    train, valid = models.split_by_user(stage(table))
    return models.regression_metrics(models.rating_regressor(train, names, 5).scored(valid))


view(
    "ranked50",
    """SELECT * FROM (SELECT user_id, item_id, merged_score, round(merged_score - 0.25, 6) AS rank_score,
              row_number() OVER (PARTITION BY user_id ORDER BY round(merged_score - 0.25, 6) DESC, merged_score DESC, item_id) AS rank_position
       FROM fused) WHERE rank_position <= 50""",
)


def ranked50(d):
    """Top 50 per user by the shifted fused score, a stand-in for a model score that SQL can check."""
    scored = d.fused.select("user_id", "item_id", "merged_score", F.round(F.col("merged_score") - 0.25, DIGITS).alias("score"))
    return models.rank_top(scored, 50)


@query(
    "win_8_rank_position",
    "SELECT user_id, item_id, rank_score, CAST(rank_position AS INT) AS rank_position FROM ranked50",
)
def rank_position(d):
    return ranked50(d).select("user_id", "item_id", "rank_score", "rank_position")


@query(
    "rnk_6_group_metrics",
    """SELECT round(avg(hits / 10.0), 6) AS precision, round(avg(hits / n_rel), 6) AS recall, round(avg(dcg / ideal), 6) AS ndcg,
              round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, count(*) AS evaluated_users
       FROM (SELECT user_id, sum(label) AS hits, sum(label / log2(rn + 1)) AS dcg, max(n_rel) AS n_rel,
                    max(CASE WHEN n_rel >= 10 THEN (SELECT sum(1 / log2(j + 1)) FROM range(1, 11) t(j))
                        ELSE list_sum([1 / log2(j + 1) FOR j IN range(1, CAST(n_rel AS INT) + 1)]) END) AS ideal
             FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn,
                          sum(label) OVER (PARTITION BY user_id) AS n_rel
                   FROM (SELECT user_id, item_id, rating AS score, CAST(item_id % 3 = 0 AS INT) AS label FROM
                         (SELECT user_id, item_id, max(rating) AS rating FROM train GROUP BY 1, 2)))
             WHERE rn <= 10 AND n_rel > 0 GROUP BY user_id)""",
)
def group_metrics(d):
    best = d.train.groupBy("user_id", "item_id").agg(F.max("rating").alias("score"))
    return evaluate.group_ranking_metrics(best.withColumn("label", (F.col("item_id") % 3 == 0).cast("int")), 10)


def greedy_sql(lists: str, n: int) -> str:
    """Greedy picks from `lists` (user_id, gain, penalty, e = list of (item_id, rel, g) in tie-break order), one a step."""
    overlap = "bit_count(a.g & b.g)::DOUBLE / greatest(bit_count(a.g | b.g), 1)"
    return f"""SELECT user_id, gain, e[picks[place]].item_id AS item_id, e[picks[place]].rel AS rel, worths[place] AS worth, place
       FROM (SELECT *, unnest(range(1, len(picks) + 1)) AS place FROM (
         WITH RECURSIVE base AS MATERIALIZED (
           SELECT *, list_transform(e, lambda a: list_transform(e, lambda b: {overlap})) AS m FROM ({lists})),
         steps AS (
           SELECT user_id, CAST([] AS BIGINT[]) AS picks, CAST([] AS DOUBLE[]) AS worths, list_transform(e, lambda a: 0::DOUBLE) AS worst FROM base
           UNION ALL
           SELECT user_id, list_append(picks, best), list_append(worths, v[best]),
                  list_transform(range(1, len(e) + 1), lambda i: greatest(worst[i], m[best][i]))
           FROM (SELECT *, list_position(v, list_max(v)) AS best FROM (
             SELECT steps.*, e, m, list_transform(range(1, len(e) + 1), lambda i: CASE WHEN list_contains(picks, i) THEN '-infinity'::DOUBLE
                      ELSE gain * e[i].rel - penalty * worst[i] END) AS v
             FROM steps JOIN base USING (user_id) WHERE len(picks) < least({n}, len(e)))))
         SELECT user_id, gain, e, picks, worths FROM steps JOIN base USING (user_id) WHERE len(picks) = least({n}, len(e))))"""


view(
    "genre_bits",
    """SELECT item_id, bit_or(1::HUGEINT << CAST(place AS INT)) AS g FROM (SELECT DISTINCT item_id, lower(trim(unnest(genres))) AS genre FROM items)
       JOIN (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS place FROM (
         SELECT DISTINCT lower(trim(unnest(genres))) AS genre FROM items) WHERE genre <> '') USING (genre) GROUP BY item_id""",
)
GENRE_SET = "coalesce(g, 0)"
view(
    "mmr_lists",
    f"""SELECT user_id, list({{'item_id': item_id, 'rel': rank_score, 'g': {GENRE_SET}}} ORDER BY rank_score DESC, merged_score DESC, item_id) AS e
       FROM ranked50 LEFT JOIN genre_bits USING (item_id) GROUP BY user_id""",
)


@query(
    "rnk_8_mmr",
    f"""SELECT user_id, gain AS lambda_rel, item_id, rel AS rank_score, round(worth, 8) AS mmr_score, CAST(place AS INT) AS rank_position
       FROM ({greedy_sql("SELECT user_id, 0.7::DOUBLE AS gain, 1 - 0.7::DOUBLE AS penalty, e FROM mmr_lists", 10)})""",
)
def mmr(d):
    return diversify.mmr(ranked50(d), d.items, 10, (0.7,))


view(
    "explore_lists",
    f"""SELECT user_id, list({{'item_id': item_id, 'rel': score, 'g': {GENRE_SET}}} ORDER BY rank_position, rank_score DESC, item_id) AS e FROM (
         SELECT *, round(0.6::DOUBLE * (0.75::DOUBLE * rank_norm + 0.25::DOUBLE * rating) + 0.4::DOUBLE * (
                  0.45::DOUBLE * novelty + 0.25::DOUBLE * coalesce(has_image, 0) + 0.2::DOUBLE * pop_norm + 0.1::DOUBLE * rating), 8) AS score FROM (
           SELECT *, coalesce((rank_score - min(rank_score) OVER u) / nullif(max(rank_score) OVER u - min(rank_score) OVER u, 0), 0) AS rank_norm,
                  coalesce((item_popularity - min(item_popularity) OVER u) / nullif(max(item_popularity) OVER u - min(item_popularity) OVER u, 0), 0) AS pop_norm,
                  least(greatest(coalesce(item_avg_rating, 0) / 5, 0), 1) AS rating,
                  CASE WHEN len(favorite_genres) > 0 THEN 1 - len(list_intersect(genres, favorite_genres))::DOUBLE
                       / greatest(len(list_distinct(genres || favorite_genres)), 1) ELSE 0.35 END AS novelty
           FROM ranked50 LEFT JOIN (SELECT item_id, genres, item_avg_rating, item_popularity, has_image FROM item_profile) USING (item_id)
           LEFT JOIN genre_bits USING (item_id) LEFT JOIN (SELECT user_id, favorite_genres FROM user_profile) USING (user_id)
           WINDOW u AS (PARTITION BY user_id))) GROUP BY user_id""",
)


@query(
    "qry_explore",
    f"""SELECT user_id, item_id, rel AS score, CAST(place AS INT) AS position
       FROM ({greedy_sql("SELECT user_id, 1.0::DOUBLE AS gain, 0.12::DOUBLE * 0.4::DOUBLE AS penalty, e FROM explore_lists", 20)})""",
)
def explore(d):
    return diversify.explore(ranked50(d), d.user_profile, d.item_profile, 0.4, 20)


# --- explanations ------------------------------------------------------------------------------------

REASON_SQL = f"""CASE WHEN len(m) > 0 THEN '{reasons.MATCH_START}' || m[1] || '{reasons.MATCH_END}'
    ELSE '{reasons.GENRE_START}' || genres[1] || '{reasons.GENRE_END}' END"""


@query(
    "prj_25_template_reason",
    f"""SELECT user_id, item_id, CASE WHEN item_avg_rating >= 4.2 THEN rtrim(base, '。') || '{reasons.HIGH_RATING}'
              WHEN item_avg_rating >= 3.8 THEN rtrim(base, '。') || '{reasons.STEADY_RATING}'
              WHEN len(m) = 0 THEN rtrim(base, '。') || '{reasons.TAG_MATCH}' ELSE base END AS reason
       FROM (SELECT *, {REASON_SQL} AS base FROM (
         SELECT user_id, item_id, item_avg_rating, genres, list_filter(genres, lambda g: list_contains(favorite_genres, g)) AS m
         FROM ranked50 JOIN user_profile USING (user_id) JOIN item_profile USING (item_id)))""",
)
def template_reason(d):
    users = d.user_profile.select("user_id", "favorite_genres")
    items = d.item_profile.select("item_id", "genres", "item_avg_rating")
    joined = ranked50(d).join(users, "user_id").join(items, "item_id")
    reason = reasons.template_reason(F.col("favorite_genres"), F.col("genres"), F.col("item_avg_rating"), F.lit(0.5))
    return joined.select("user_id", "item_id", reason.alias("reason"))


@query(
    "prj_26_reason_table",
    f"""SELECT user_id, item_id, title, 'template' AS reason_source, rank_position AS evidence_position FROM (
          SELECT user_id, item_id, title, CAST(rank_position AS INT) AS rank_position FROM ranked50 JOIN items USING (item_id))""",
)
def reason_table(d):
    table = reasons.reason_table(ranked50(d), d.item_profile, d.user_profile)
    position = F.get_json_object("reason_evidence", "$.rank_position").cast("int")
    return table.select("user_id", "item_id", "title", "reason_source", position.alias("evidence_position"))


@query(
    "prj_27_kg_reason",
    f"""SELECT item_id, '{reasons.KG_START}' || array_to_string(list_sort(list_distinct(genres))[1:5], ', ') || '{reasons.KG_END}' AS reason
        FROM items""",
)
def kg_reason(d):
    return reasons.kg_reason(d.items, tag_bridge(d))


@query(
    "prj_31_rule_intent",
    """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(text, '鸡') OR contains(lower(text), 'chicken') THEN 'chicken' END,
                CASE WHEN contains(text, '蛋') OR contains(lower(text), 'egg') THEN 'egg' END], lambda x: x IS NOT NULL), '|') AS ingredients,
              array_to_string(list_filter([CASE WHEN contains(text, '素') OR contains(lower(text), 'vegetarian') THEN 'vegetarian' END,
                CASE WHEN contains(text, '低卡') OR contains(lower(text), 'low calorie') THEN 'healthy' END,
                CASE WHEN contains(text, '快') OR contains(lower(text), 'quick') OR contains(text, '30') THEN 'quick' END,
                CASE WHEN contains(text, '晚餐') OR contains(lower(text), 'dinner') THEN 'dinner' END,
                CASE WHEN contains(text, '不要辣') OR contains(lower(text), 'no spicy') THEN 'non-spicy' END], lambda x: x IS NOT NULL), '|') AS tags,
              CASE WHEN contains(text, '30') OR contains(text, '快') THEN 30 END AS max_minutes
       FROM conversations WHERE role = 'user'""",
)
def rule_intent(d):
    users = d.table("conversations").where("role = 'user'")
    found = reasons.rule_intent(users)
    return found.select(
        "conv_id", "turn", tx.pipe_join(F.col("ingredients")).alias("ingredients"), tx.pipe_join(F.col("tags")).alias("tags"), "max_minutes"
    )


# --- evaluation --------------------------------------------------------------------------------------

view("ks", "SELECT unnest([5, 10, 20, 50]) AS k")
view(
    "ev_lists",
    """SELECT * FROM (SELECT channel AS model_name, user_id, item_id, row_number() OVER (PARTITION BY channel, user_id
         ORDER BY score DESC, item_id) AS pos FROM candidates) WHERE pos <= 50 AND user_id IN (SELECT user_id FROM relevant)""",
)
view(
    "ev_user",
    """SELECT model_name, l.user_id, k, count(r.item_id) FILTER (pos <= k) AS hits,
              coalesce(sum(1 / log2(pos + 1)) FILTER (pos <= k AND r.item_id IS NOT NULL), 0) AS dcg, max(n_rel) AS n_rel
       FROM ev_lists l JOIN (SELECT user_id, count(*) AS n_rel FROM relevant GROUP BY 1) c ON c.user_id = l.user_id
       LEFT JOIN relevant r ON r.user_id = l.user_id AND r.item_id = l.item_id CROSS JOIN ks GROUP BY 1, 2, 3""",
)
view(
    "ev_pairs",
    """SELECT a.model_name, a.user_id, b.pos, len(list_intersect(x.genres, y.genres)) /
              (len(x.genres) + len(y.genres) - len(list_intersect(x.genres, y.genres))) AS j
       FROM ev_lists a JOIN ev_lists b ON a.model_name = b.model_name AND a.user_id = b.user_id AND a.pos < b.pos
       JOIN items x ON x.item_id = a.item_id JOIN items y ON y.item_id = b.item_id""",
)
view(
    "ev_diversity",
    """SELECT model_name, user_id, k, 1 - avg(j) AS diversity FROM ev_pairs JOIN ks ON pos <= k GROUP BY 1, 2, 3""",
)
view(
    "ev_metrics",
    """SELECT model_name, k, round(avg(hits / k), 6) AS precision, round(avg(hits / n_rel), 6) AS recall,
              round(avg(dcg / list_sum([1 / log2(j + 1) FOR j IN range(1, CAST(least(n_rel, k) AS INT) + 1)])), 6) AS ndcg,
              round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, round(avg(coalesce(diversity, 0)), 6) AS diversity,
              count(*) AS evaluated_users, max(c.n) AS recommended_items, round(max(c.n) / (SELECT count(*) FROM items), 6) AS coverage
       FROM ev_user LEFT JOIN ev_diversity USING (model_name, user_id, k)
       JOIN (SELECT model_name, k, count(DISTINCT item_id) AS n FROM ev_lists JOIN ks ON pos <= k GROUP BY 1, 2) c USING (model_name, k)
       GROUP BY model_name, k""",
)


def model_lists(d):
    return dealt(d.candidates, d.candidates.count(), "user_id").withColumnRenamed("channel", "model_name")


def metrics(d, *names):
    return evaluate.evaluate_lists(model_lists(d), d.test, d.items, metrics=names or evaluate.METRICS)


@query("evl_1_metrics", "SELECT model_name, k, precision, recall, ndcg, hit_rate, evaluated_users FROM ev_metrics")
def evl_metrics(d):
    return metrics(d, *evaluate.PER_LIST)


@query("evl_2_coverage", "SELECT model_name, k, recommended_items, coverage FROM ev_metrics")
def evl_coverage(d):
    return metrics(d, "coverage").select("model_name", "k", "recommended_items", "coverage")


@query("evl_3_diversity", "SELECT model_name, k, diversity FROM ev_metrics")
def evl_diversity(d):
    return metrics(d, "diversity").select("model_name", "k", "diversity")


@query(
    "evl_4_best_models",
    """SELECT metric, arg_min(model_name, (-value, model_name)) AS model_name, max(value) AS value
       FROM (UNPIVOT (SELECT model_name, precision, recall, ndcg, hit_rate, coverage, diversity FROM ev_metrics WHERE k = 10)
             ON precision, recall, ndcg, hit_rate, coverage, diversity INTO NAME metric VALUE value) GROUP BY metric""",
)
def evl_best(d):
    return evaluate.best_models(metrics(d), 10)


VARIANTS = (
    {"name": "hot", "removed": "all but popularity"},
    {"name": "itemcf", "removed": "all but co-occurrence", "baseline": "hot", "focus": "recall"},
)


@query(
    "evl_5_ablation",
    """SELECT CAST(1 AS INT) AS position, m.model_name AS variant, recall, NULL::DOUBLE AS delta_recall, 'hot single-channel baseline.' AS main_observation
       FROM ev_metrics m WHERE k = 10 AND model_name = 'hot'
       UNION ALL SELECT 2, m.model_name, m.recall, round(m.recall - b.recall, 6), 'Compared with hot, itemcf ' ||
              CASE WHEN m.recall - b.recall > 0 THEN 'improves' ELSE 'does not improve' END || ' recall@10 (' ||
              CASE WHEN m.recall - b.recall >= 0 THEN '+' ELSE '' END || printf('%.6f', round(m.recall - b.recall, 6)) || ').'
       FROM ev_metrics m, ev_metrics b WHERE m.k = 10 AND b.k = 10 AND m.model_name = 'itemcf' AND b.model_name = 'hot'""",
)
def evl_ablation(d):
    table = evaluate.ablation(metrics(d), VARIANTS, 10)
    return table.select("position", "variant", "recall", "delta_recall", "main_observation")


view(
    "tune_lists",
    """SELECT * FROM (SELECT first_weight, second_weight, source_bonus, user_id, item_id, row_number() OVER (
           PARTITION BY first_weight, source_bonus, user_id ORDER BY s DESC, item_id) AS pos FROM (
         SELECT g.first_weight, g.second_weight, b.source_bonus, user_id, item_id,
                round(g.first_weight * ph + g.second_weight * pi + b.source_bonus * (fi + fh), 6) AS s
         FROM (SELECT user_id, item_id, fi, fh,
                      CASE WHEN i IS NULL THEN 0.0 WHEN max(i) OVER w <= min(i) OVER w THEN 1.0 ELSE (i - min(i) OVER w) / (max(i) OVER w - min(i) OVER w) END AS pi,
                      CASE WHEN h IS NULL THEN 0.0 WHEN max(h) OVER w <= min(h) OVER w THEN 1.0 ELSE (h - min(h) OVER w) / (max(h) OVER w - min(h) OVER w) END AS ph
               FROM wide_norm WINDOW w AS (PARTITION BY user_id)),
              (SELECT CAST(j AS DOUBLE) / 10 AS first_weight, round(1 - CAST(j AS DOUBLE) / 10, 1) AS second_weight FROM range(0, 11) t(j)) g,
              (SELECT unnest([0.0::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS source_bonus) b
         WHERE user_id IN (SELECT user_id FROM relevant))) WHERE pos <= 10""",
)


@query(
    "evl_6_weight_grid",
    """SELECT first_weight, second_weight, source_bonus, round(avg(hits / 10.0), 6) AS precision, round(avg(hits / n_rel), 6) AS recall,
              round(avg(dcg), 6) AS ndcg FROM (
         SELECT first_weight, second_weight, source_bonus, l.user_id, count(r.item_id) AS hits, 1 AS n_rel,
                coalesce(sum(1 / log2(pos + 1)) FILTER (r.item_id IS NOT NULL), 0) AS dcg
         FROM tune_lists l LEFT JOIN relevant r ON r.user_id = l.user_id AND r.item_id = l.item_id GROUP BY 1, 2, 3, 4)
       GROUP BY 1, 2, 3""",
)
def evl_grid(d):
    names = ("precision", "recall", "ndcg")
    table = evaluate.tune_weights(d.candidates, d.test, d.items, "hot", "itemcf", metrics=names)
    return table.select("first_weight", "second_weight", "source_bonus", "precision", "recall", "ndcg")


LAMBDAS = (0.5, 0.6, 0.7, 0.8, 0.9)


def lambda_lists_sql(value: float) -> str:
    lists = f"SELECT user_id, {value}::DOUBLE AS gain, 1 - {value}::DOUBLE AS penalty, e FROM mmr_lists"
    return f"SELECT gain AS lambda_rel, user_id, item_id, place AS pos FROM ({greedy_sql(lists, 10)})"


view("lambda_all", " UNION ALL ".join(map(lambda_lists_sql, LAMBDAS)))
view("lambda_lists", "SELECT * FROM lambda_all WHERE user_id IN (SELECT user_id FROM relevant)")
view(
    "lambda_user",
    """SELECT lambda_rel, l.user_id, count(r.item_id) AS hits, coalesce(sum(1 / log2(pos + 1)) FILTER (r.item_id IS NOT NULL), 0) AS dcg,
              max(n_rel) AS n_rel
       FROM lambda_lists l JOIN (SELECT user_id, count(*) AS n_rel FROM relevant GROUP BY 1) c ON c.user_id = l.user_id
       LEFT JOIN relevant r ON r.user_id = l.user_id AND r.item_id = l.item_id GROUP BY 1, 2""",
)
view(
    "lambda_diversity",
    """SELECT a.lambda_rel, a.user_id, 1 - avg(len(list_intersect(x.genres, y.genres)) /
              (len(x.genres) + len(y.genres) - len(list_intersect(x.genres, y.genres)))) AS diversity
       FROM lambda_lists a JOIN lambda_lists b ON a.lambda_rel = b.lambda_rel AND a.user_id = b.user_id AND a.pos < b.pos
       JOIN items x ON x.item_id = a.item_id JOIN items y ON y.item_id = b.item_id GROUP BY 1, 2""",
)
view(
    "lambda_metrics",
    """SELECT lambda_rel, 10 AS k, round(avg(hits / 10), 6) AS precision, round(avg(hits / n_rel), 6) AS recall,
              round(avg(dcg / list_sum([1 / log2(j + 1) FOR j IN range(1, CAST(least(n_rel, 10) AS INT) + 1)])), 6) AS ndcg,
              round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, round(max(c.n) / (SELECT count(*) FROM items), 6) AS coverage,
              round(avg(coalesce(diversity, 0)), 6) AS diversity, count(*) AS evaluated_users, max(c.n) AS recommended_items
       FROM lambda_user LEFT JOIN lambda_diversity USING (lambda_rel, user_id)
       JOIN (SELECT lambda_rel, count(DISTINCT item_id) AS n FROM lambda_lists GROUP BY 1) c USING (lambda_rel) GROUP BY lambda_rel""",
)


@query(
    "evl_7_lambda_grid",
    """SELECT m.*, lambda_rel = (SELECT list_reduce(list({'l': lambda_rel, 'n': ndcg, 'd': diversity, 'r': recall} ORDER BY lambda_rel),
                lambda best, x: CASE WHEN x.n >= best.n - 0.001 AND (x.d > best.d OR x.n > best.n
                    OR (x.n = best.n AND (x.d > best.d OR (x.d = best.d AND x.r > best.r)))) THEN x ELSE best END).l
              FROM lambda_metrics) AS is_best
       FROM lambda_metrics m""",
)
def evl_lambda(d):
    lists = diversify.mmr(ranked50(d), d.items, 10, LAMBDAS)
    table = evaluate.evaluate_lists(lists, d.test, d.items, ["lambda_rel"], (10,))
    return evaluate.choose_lambda(stage(table))


view(
    "pools",
    """SELECT pool, user_id, item_id, item_popularity <= (SELECT quantile_cont(item_popularity, 0.7) FROM item_profile) AS t
       FROM (SELECT 'fused' AS pool, user_id, item_id FROM fused UNION ALL SELECT 'ranked', user_id, item_id FROM ranked50)
       JOIN item_profile USING (item_id)""",
)


def long_tail(d, per_user=False):
    pools = {"fused": d.fused, "ranked": ranked50(d)}
    return evaluate.long_tail_summary(pools, d.item_profile, per_user=per_user)


@query(
    "agg_16_long_tail_pools",
    """SELECT p.pool, count(*) AS rows, count(*) FILTER (t) AS tail_rows, count(DISTINCT item_id) AS items,
              count(DISTINCT item_id) FILTER (t) AS tail_items, max(c) AS user_tail_coverage
       FROM pools p JOIN (SELECT pool, round(avg(s), 6) AS c FROM (
         SELECT pool, user_id, count(DISTINCT item_id) FILTER (t) / count(DISTINCT item_id) AS s FROM pools GROUP BY 1, 2) GROUP BY 1) x
       USING (pool) GROUP BY p.pool""",
)
def agg_long_tail(d):
    return long_tail(d, per_user=True).select("pool", "rows", "tail_rows", "items", "tail_items", "user_tail_coverage")


@query(
    "evl_8_long_tail_effect",
    """SELECT pool, round(count(*) FILTER (t) / count(*), 6) AS tail_ratio,
              round(count(DISTINCT item_id) FILTER (t) / count(DISTINCT item_id), 6) AS tail_item_ratio FROM pools GROUP BY pool""",
)
def evl_long_tail(d):
    return long_tail(d).select("pool", "tail_ratio", "tail_item_ratio")


@query("evl_9_unique_coverage", "SELECT pool, round(count(DISTINCT item_id) / count(*), 6) AS unique_item_coverage FROM pools GROUP BY pool")
def evl_unique(d):
    return long_tail(d).select("pool", "unique_item_coverage")


@query(
    "win_10_rank_normaliser",
    "SELECT user_id, item_id, CAST(rn AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY merged_score DESC, item_id) AS rn FROM (SELECT user_id, item_id, merged_score FROM fused)) WHERE rn <= 20",
)
def rank_normaliser(d):
    recs = d.fused.select("user_id", "item_id", "merged_score")
    return evaluate.ranked_recommendations(recs, ("user_id",), 20).select("user_id", "item_id", "pos")


# --- data quality ------------------------------------------------------------------------------------


@query(
    "dq_1_split",
    """SELECT 'several_test_rows' AS "check", (SELECT count(*) FROM (SELECT user_id FROM test GROUP BY 1 HAVING count(*) > 1)) AS violations
       UNION ALL SELECT 'test_user_not_in_train', (SELECT count(DISTINCT user_id) FROM test WHERE user_id NOT IN (SELECT user_id FROM train))
       UNION ALL SELECT 'row_difference', abs((SELECT count(*) FROM ranked_ratings WHERE n >= 2) - (SELECT count(*) FROM train) - (SELECT count(*) FROM test))
       UNION ALL SELECT 'overlap', (SELECT count(*) FROM (SELECT user_id, item_id, ts FROM train INTERSECT SELECT user_id, item_id, ts FROM test))""",
)
def dq_split(d):
    return quality.split_checks(d.ratings, d.train, d.test)


@query(
    "dq_2_candidates",
    """SELECT 'other_channel' AS "check", count(*) AS violations FROM candidates WHERE channel <> 'itemcf'
       UNION ALL SELECT 'null_score', count(*) FROM candidates WHERE score IS NULL
       UNION ALL SELECT 'too_many', count(*) FROM (SELECT user_id FROM candidates GROUP BY 1 HAVING count(*) > 99)
       UNION ALL SELECT 'seen_item', count(*) FROM candidates JOIN seen USING (user_id, item_id)""",
)
def dq_candidates(d):
    return quality.candidate_checks(d.candidates, d.seen, "itemcf", 99)


@query(
    "dq_3_fusion",
    """SELECT 'no_source' AS "check", count(*) AS violations FROM fused WHERE recall_source_count < 1
       UNION ALL SELECT 'flag_mismatch', count(*) FROM fused WHERE is_itemcf_recall + is_hot_recall <> recall_source_count
       UNION ALL SELECT 'null_score', count(*) FROM fused WHERE merged_score IS NULL
       UNION ALL SELECT 'too_many', count(*) FROM (SELECT user_id FROM fused GROUP BY 1 HAVING count(*) > 100)""",
)
def dq_fusion(d):
    return quality.fusion_checks(d.fused)


@query(
    "dq_4_profiles",
    """SELECT c AS "check", CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['null_user', 'repeated_user', 'user_difference', 'null_item', 'missing_item']) AS c)""",
)
def dq_profiles(d):
    return quality.profile_checks(d.user_profile, d.item_profile, d.train, d.items)


@query(
    "dq_5_features",
    """SELECT 'train_label' AS "check", count(*) FILTER (label NOT IN (0, 1)) AS violations FROM labelled
       UNION ALL SELECT 'no_positive', CAST(count(*) FILTER (label = 1) = 0 AS BIGINT) FROM labelled
       UNION ALL SELECT 'candidate_label', CAST(0 AS BIGINT) UNION ALL SELECT 'row_gap', CAST(0 AS BIGINT)""",
)
def dq_features(d):
    candidates = quality.assert_numeric(candidate_table(d), features.FEATURES)
    return quality.feature_checks(train_table(d), candidates, d.fused)


@query(
    "dq_6_metrics_ranks",
    """SELECT 'precision' AS "check", count(*) FILTER (NOT precision BETWEEN 0 AND 1) AS violations FROM ev_metrics
       UNION ALL SELECT 'recall', count(*) FILTER (NOT recall BETWEEN 0 AND 1) FROM ev_metrics
       UNION ALL SELECT 'start', CAST(0 AS BIGINT) UNION ALL SELECT 'repeated_position', CAST(0 AS BIGINT)
       UNION ALL SELECT 'forbidden_column', CAST(0 AS BIGINT)""",
)
def dq_metrics(d):
    ranks = quality.rank_checks(ranked50(d), ("xgb_score",))
    return quality.metric_checks(metrics(d), ("precision", "recall")).unionByName(ranks)


@query(
    "dq_7_constraints",
    """SELECT 'unknown_item' AS "check", count(*) AS violations FROM ratings WHERE item_id NOT IN (SELECT p_partkey FROM part)
       UNION ALL SELECT 'unknown_user', count(*) FROM ratings WHERE user_id NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT user_id, item_id FROM ratings GROUP BY 1, 2 HAVING count(*) > 1)
       UNION ALL SELECT 'repeated_position', CAST(0 AS BIGINT)""",
)
def dq_constraints(d):
    users = d.table("customer").select(F.col("c_custkey").alias("user_id"))
    return (
        quality.reference_checks(d.ratings, "item_id", d.items, "unknown_item")
        .unionByName(quality.reference_checks(d.ratings, "user_id", users, "unknown_user"))
        .unionByName(quality.unique_checks(d.ratings, ["user_id", "item_id"], "repeated_pair"))
        .unionByName(quality.unique_checks(ranked50(d), ["user_id", "rank_position"], "repeated_position"))
    )


@query(
    "dq_8_vectors",
    """SELECT 'dimension' AS "check", count(*) FILTER (len(vector) <> 64) AS violations FROM vectors
       UNION ALL SELECT 'not_finite', CAST(0 AS BIGINT)
       UNION ALL SELECT 'not_unit', count(*) FILTER (abs(sqrt(list_inner_product(vector, vector)) - 1) > 1e-4) FROM vectors""",
)
def dq_vectors(d):
    return vector_checks(d.vectors)

