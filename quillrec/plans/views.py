"""Check SQL shared by many queries: the domain tables, split, profiles and candidate lists."""

from quillrec.plans.registry import view

view(
    "raw_ratings",
    """SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating,
              CAST(epoch(l_shipdate) AS BIGINT) AS ts
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
view("ratings", "SELECT DISTINCT user_id, item_id, rating, rating / 5.0 AS rating_norm, ts FROM raw_ratings")
view(
    "items",
    """SELECT p_partkey AS item_id, p_name || ' (' || CAST(1990 + p_partkey % 30 AS VARCHAR) || ')' AS title,
              p_name AS clean_title, CAST(1990 + p_partkey % 30 AS INT) AS year,
              list_concat(['type-' || lower(p_type), lower(p_brand)], string_split(p_name, ' ')) AS genres,
              string_split(p_name, ' ') AS ingredients, p_size AS minutes, p_retailprice AS calories,
              CAST(p_size AS DOUBLE) AS protein_pct, CAST(p_partkey % 3 = 0 AS INT) AS has_image
       FROM part""",
)
view("item_genres", "SELECT DISTINCT item_id, unnest(genres) AS genre FROM items")
view(
    "tags",
    """SELECT DISTINCT item_id, unnest(genres[1:2]) AS tag, 'genre' AS tag_type FROM items
       UNION ALL SELECT DISTINCT item_id, unnest(ingredients) AS tag, 'recipe_tag' AS tag_type FROM items""",
)
view(
    "ranked_ratings",
    """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, rating DESC) AS rn,
              count(*) OVER (PARTITION BY user_id) AS n FROM ratings""",
)
view("train", "SELECT user_id, item_id, rating, rating_norm, ts FROM ranked_ratings WHERE n >= 2 AND rn > 1")
view("test", "SELECT user_id, item_id, rating, rating_norm, ts FROM ranked_ratings WHERE n >= 2 AND rn = 1")
view("seen", "SELECT DISTINCT user_id, item_id FROM train")
view(
    "user_stats",
    """SELECT user_id, count(*) AS user_rating_count, avg(rating) AS user_avg_rating,
              coalesce(stddev_samp(rating), 0) AS user_rating_std, min(rating) AS user_min_rating,
              max(rating) AS user_max_rating,
              CASE WHEN count(*) < 20 THEN 'low' WHEN count(*) < 80 THEN 'medium' ELSE 'high' END AS active_level
       FROM train GROUP BY user_id""",
)
view(
    "item_stats",
    """SELECT item_id, avg(rating) AS item_avg_rating, count(*) AS item_rating_count,
              coalesce(stddev_samp(rating), 0) AS item_rating_std, avg(rating) * ln(count(*) + 1) AS item_popularity
       FROM train GROUP BY item_id""",
)
view(
    "genre_counts",
    """SELECT user_id, genre, count(*) AS hits FROM train JOIN item_genres USING (item_id)
       WHERE rating >= 4 GROUP BY user_id, genre""",
)
view(
    "decade_counts",
    """SELECT user_id, CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's' AS decade, count(*) AS hits
       FROM train JOIN items USING (item_id) WHERE rating >= 4 GROUP BY 1, 2""",
)
view(
    "favorite_genres",
    """SELECT user_id, list(genre ORDER BY rn) AS favorite_genres FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, genre) AS rn FROM genre_counts)
       WHERE rn <= 5 GROUP BY user_id""",
)
view(
    "favorite_decades",
    """SELECT user_id, list(decade ORDER BY rn) AS favorite_decades FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, decade) AS rn FROM decade_counts)
       WHERE rn <= 5 GROUP BY user_id""",
)
view(
    "liked_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY rating DESC, ts DESC, item_id DESC) AS rn FROM train WHERE rating >= 4)""",
)
view(
    "recent_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY ts DESC, item_id DESC, rating DESC) AS rn FROM train)""",
)
view(
    "user_profile",
    """SELECT s.*, coalesce(favorite_genres, []) AS favorite_genres, coalesce(favorite_decades, []) AS favorite_decades,
              coalesce(liked_items, []) AS liked_items, coalesce(recent_items, []) AS recent_items
       FROM user_stats s LEFT JOIN favorite_genres USING (user_id) LEFT JOIN favorite_decades USING (user_id)
       LEFT JOIN (SELECT user_id, list(item_id ORDER BY rn) AS liked_items FROM liked_rows WHERE rn <= 20 GROUP BY 1)
         USING (user_id)
       LEFT JOIN (SELECT user_id, list(item_id ORDER BY rn) AS recent_items FROM recent_rows WHERE rn <= 20 GROUP BY 1)
         USING (user_id)""",
)
view(
    "tag_profile",
    """SELECT item_id, list(DISTINCT tag ORDER BY tag) AS tags, count(DISTINCT tag) AS tag_count FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY
             CASE tag_type WHEN 'recipe_tag' THEN 0 WHEN 'genre' THEN 1 ELSE 2 END, tag, tag_type) AS rn FROM tags)
       WHERE rn <= 50 GROUP BY item_id""",
)
view(
    "item_profile",
    """SELECT i.*, CAST(len(genres) AS INT) AS genre_count,
              CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's' AS decade,
              coalesce(item_avg_rating, 0) AS item_avg_rating, coalesce(item_rating_count, 0) AS item_rating_count,
              coalesce(item_rating_std, 0) AS item_rating_std, coalesce(item_popularity, 0) AS item_popularity,
              coalesce(tags, []) AS tags, coalesce(tag_count, 0) AS tag_count
       FROM items i LEFT JOIN item_stats USING (item_id) LEFT JOIN tag_profile USING (item_id)""",
)
view(
    "feedback",
    """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
              CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'like' WHEN 'view' THEN 'exposure'
                   WHEN 'error' THEN 'dislike' WHEN 'signup' THEN 'rating' END AS feedback_type,
              CASE WHEN event_type = 'signup' THEN floor(value % 5) + 1 END AS feedback_value,
              CAST(floor(epoch(ts)) AS BIGINT) AS ts,
              CASE WHEN CAST('0x' || substr(sha256('default:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0
                   THEN 'A' ELSE 'B' END AS run_id
       FROM events""",
)
view(
    "vectors",
    """SELECT vec_id AS item_id, label,
              list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n) AS vector
       FROM (SELECT *, CASE WHEN s > 0 THEN sqrt(s) ELSE 1 END AS n FROM (
         SELECT *, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS s FROM embeddings))""",
)
view("liked", "SELECT DISTINCT user_id, item_id FROM liked_rows")
view(
    "cooc",
    """SELECT a.item_id AS item_i, b.item_id AS item_j, count(*) AS common FROM liked a JOIN liked b
       ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2""",
)
view("like_counts", "SELECT item_id, count(*) AS n FROM liked GROUP BY 1")
view(
    "near_items",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, similar_id) AS rn FROM (
         SELECT item_i AS item_id, item_j AS similar_id,
                common / sqrt(CAST(a.n AS DOUBLE) * b.n) AS similarity
         FROM cooc JOIN like_counts a ON a.item_id = item_i JOIN like_counts b ON b.item_id = item_j)) WHERE rn <= 50""",
)
view(
    "itemcf",
    """SELECT user_id, item_id, 'itemcf' AS channel, score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
           SELECT user_id, similar_id AS item_id, round(sum(similarity), 6) AS score
           FROM liked JOIN near_items USING (item_id) GROUP BY 1, 2) s
         WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = s.user_id AND seen.item_id = s.item_id))
       WHERE rn <= 50""",
)
view(
    "hot_items",
    """SELECT item_id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS score FROM (
         SELECT item_id, item_avg_rating * ln(1 + item_rating_count) AS raw FROM item_profile)""",
)
view(
    "hot",
    """SELECT user_id, item_id, 'hot' AS channel, score FROM (
         SELECT user_id, h.item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, h.item_id) AS rn
         FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN hot_items h
         WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = u.user_id AND seen.item_id = h.item_id))
       WHERE rn <= 50""",
)
view("candidates", "SELECT * FROM itemcf UNION ALL SELECT * FROM hot")
view(
    "wide",
    """SELECT user_id, item_id, max(score) FILTER (channel = 'itemcf') AS i, max(score) FILTER (channel = 'hot') AS h
       FROM candidates GROUP BY 1, 2""",
)
view(
    "wide_norm",
    """SELECT *, CAST(i IS NOT NULL AS INT) AS fi, CAST(h IS NOT NULL AS INT) AS fh,
              CASE WHEN hi_i <= lo_i THEN 1.0 ELSE (coalesce(i, 0) - lo_i) / (hi_i - lo_i) END AS ni,
              CASE WHEN hi_h <= lo_h THEN 1.0 ELSE (coalesce(h, 0) - lo_h) / (hi_h - lo_h) END AS nh
       FROM (SELECT *, min(coalesce(i, 0)) OVER (PARTITION BY user_id) AS lo_i, max(coalesce(i, 0)) OVER (PARTITION BY user_id) AS hi_i,
                    min(coalesce(h, 0)) OVER (PARTITION BY user_id) AS lo_h, max(coalesce(h, 0)) OVER (PARTITION BY user_id) AS hi_h
             FROM wide)""",
)
view(
    "fused",
    """SELECT * FROM (SELECT user_id, item_id, coalesce(i, 0) AS itemcf_score, coalesce(h, 0) AS hot_score, fi AS is_itemcf_recall,
              fh AS is_hot_recall, fi + fh AS recall_source_count, merged_score,
              row_number() OVER (PARTITION BY user_id ORDER BY merged_score DESC, item_id) AS rn FROM (
         SELECT *, round(0.28 + 0.20 * ni + 0.15 + 0.11 + 0.10 + 0.08 * nh + 0.08 + 0.1 * (fi + fh), 6) AS merged_score
         FROM wide_norm)) WHERE rn <= 100""",
)
view(
    "item_texts",
    """SELECT item_id, lower(concat_ws(' ', clean_title, title, array_to_string(genres, ' '), array_to_string(tags, ' '))) AS text
       FROM item_profile""",
)
view("item_ingredients", "SELECT DISTINCT item_id, unnest(ingredients) AS ingredient FROM items")
