"""Queries over candidate generation and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators import als, content, fuse, graph, itemcf, knowledge, nearest
from quillrec.plans.registry import query, view

DIGITS = 6


# --- pieces of recall ------------------------------------------------------------------------------


@query(
    "agg_7_cooccurrence",
    "SELECT item_i, item_j, common, a.n AS n_i, b.n AS n_j FROM cooc JOIN like_counts a ON a.item_id = item_i "
    "JOIN like_counts b ON b.item_id = item_j WHERE item_i < item_j",
)
def cooccurrence(d):
    return itemcf.cooccurrence(itemcf.liked_pairs(d.train))


@query(
    "jn_7_pair_totals",
    """SELECT user_id, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs FROM (SELECT user_id, count(*) AS n FROM liked GROUP BY 1)""",
)
def pair_totals(d):
    n = F.count(F.lit(1))
    return itemcf.liked_pairs(d.train).groupBy("user_id").agg((n * (n - 1) / 2).cast("long").alias("pairs"))


@query("win_6_similar_items", "SELECT item_id, similar_id, round(similarity, 6) AS similarity FROM near_items")
def similar_items(d):
    return itemcf.similar_items(itemcf.liked_pairs(d.train)).withColumn("similarity", F.round("similarity", DIGITS))


@query(
    "jn_4_anti_seen",
    """SELECT user_id, item_id FROM (SELECT DISTINCT user_id, item_id FROM ratings) r
       WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = r.user_id AND seen.item_id = r.item_id)""",
)
def anti_seen(d):
    pairs = d.ratings.select("user_id", "item_id").distinct()
    return pairs.join(d.seen, ["user_id", "item_id"], "left_anti")


@query(
    "jn_6_leak_check",
    "SELECT count(*) AS leaked FROM itemcf JOIN seen USING (user_id, item_id)",
)
def leak_check(d):
    leaked = itemcf.itemcf_recall(d.train).join(d.seen, ["user_id", "item_id"], "left_semi")
    return leaked.agg(F.count(F.lit(1)).alias("leaked"))


# --- channels --------------------------------------------------------------------------------------


@query("rec_itemcf", "SELECT * FROM itemcf")
def rec_itemcf(d):
    return itemcf.itemcf_recall(d.train)


@query(
    "rec_hot",
    "SELECT user_id, item_id, channel, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY score DESC, item_id) AS rn FROM hot) WHERE rn <= 10",
)
def rec_hot(d):
    return d.hot_lists(10)


@query("jn_12_unseen_hot", "SELECT * FROM hot")
def unseen_hot(d):
    return d.hot_lists()


@query(
    "rec_graphedges",
    """SELECT 'user' AS src_type, CAST(user_id AS VARCHAR) AS src_id, 'item' AS dst_type, CAST(item_id AS VARCHAR) AS dst_id,
              'liked' AS edge_type, rating AS weight FROM train WHERE rating >= 4
       UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), 'genre', genre, 'has_genre', 1.0 FROM item_genres""",
)
def rec_graphedges(d):
    return graph.graph_edges(d.train, d.items)


view(
    "edges",
    """SELECT user_id, item_id, 1 / sqrt(CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) * count(*) OVER (PARTITION BY item_id)) AS w
       FROM (SELECT DISTINCT user_id, item_id FROM train WHERE rating >= 4)""",
)


@query(
    "rec_graph_step",
    """SELECT user_id, round(sum(w * minutes), 6) AS a, round(sum(w * calories), 6) AS b
       FROM edges JOIN items USING (item_id) GROUP BY user_id""",
)
def rec_graph_step(d):
    seeds = d.items.select("item_id", F.array(F.col("minutes").cast("double"), "calories").alias("vector"))
    stepped = graph.propagate_step(graph.normalised_edges(d.train), seeds, "item_id", "user_id")
    at = lambda i: F.round(F.element_at("vector", i), DIGITS)
    return stepped.select("user_id", at(1).alias("a"), at(2).alias("b"))


@query("rec_als")
def rec_als(d):
    model = als.fit_als(d.train, rank=16, iterations=5)
    return als.als_recall(model, d.seen, 50)


@query("rec_graph")
def rec_graph(d):
    model = als.fit_als(d.train, rank=16, iterations=5)
    return graph.graph_recall(d.train, als.user_factors(model), als.item_factors(model), 2, 50)


view(
    "taste",
    """SELECT user_id, list(x / n ORDER BY pos) AS vector FROM (
         SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS n FROM (
           SELECT user_id, pos, avg(x) AS x FROM (
             SELECT user_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
             FROM (SELECT user_id, item_id FROM liked_rows) l JOIN vectors USING (item_id))
           GROUP BY 1, 2)) GROUP BY user_id""",
)


@query(
    "rec_emb",
    """SELECT user_id, item_id, 'embedding' AS channel, score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS place FROM (
           SELECT user_id, v.item_id, round(list_inner_product(t.vector, v.vector), 6) AS score FROM taste t CROSS JOIN vectors v) s
         WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = s.user_id AND seen.item_id = s.item_id))
       WHERE place <= 50""",
)
def rec_emb(d):
    return nearest.embedding_recall(d.train, d.vectors)


@query(
    "rec_simitem",
    """SELECT item_id, similar_id, score FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id) AS rn FROM (
           SELECT a.item_id, b.item_id AS similar_id, round(list_inner_product(a.vector, b.vector), 6) AS score
           FROM vectors a JOIN vectors b ON a.item_id <> b.item_id)) WHERE rn <= 20""",
)
def rec_simitem(d):
    return nearest.similar_vectors(d.vectors, 20).select("item_id", "similar_id", "score")


view(
    "content_tokens",
    """SELECT item_id AS id, 'i' AS kind, regexp_extract_all(text, '\\w\\w+') AS t FROM item_texts
       UNION ALL
       SELECT user_id, 'u', regexp_extract_all(concat_ws(' ', array_to_string(favorite_genres, ' '),
              (SELECT string_agg(text, ' ' ORDER BY pos) FROM (
                 SELECT unnest(liked_items) AS item_id, generate_subscripts(liked_items, 1) AS pos) x JOIN item_texts USING (item_id))), '\\w\\w+')
       FROM user_profile""",
)
view(
    "content_tf",
    """SELECT kind, id, term, count(*) AS tf FROM (
         SELECT kind, id, unnest(t) AS term FROM content_tokens
         UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM content_tokens)
       GROUP BY ALL""",
)
view(
    "content_vocab",
    """SELECT term, ln((1.0 + (SELECT count(*) FROM items)) / (1.0 + count(*))) + 1 AS idf FROM content_tf WHERE kind = 'i'
       GROUP BY term""",
)
view(
    "content_w",
    """SELECT kind, id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY kind, id)) AS w
       FROM content_tf JOIN content_vocab USING (term)""",
)


@query(
    "rec_content",
    """SELECT user_id, item_id, 'content' AS channel, score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS place FROM (
           SELECT u.id AS user_id, i.id AS item_id, round(sum(u.w * i.w), 6) AS score
           FROM content_w u JOIN content_w i ON u.term = i.term AND u.kind = 'u' AND i.kind = 'i'
           GROUP BY 1, 2) s
         WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = s.user_id AND seen.item_id = s.item_id))
       WHERE place <= 50""",
)
def rec_content(d):
    return content.content_recall(d.user_profile, d.item_profile, d.item_texts, d.seen, 50)


# --- knowledge bridges -------------------------------------------------------------------------------


def ingredient_bridge(d):
    quoted = F.transform("ingredients", lambda w: F.concat(F.lit("'"), w, F.lit("'")))
    text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return knowledge.ingredient_bridge(d.items.select("item_id", text.alias("ingredients")))


def tag_bridge(d):
    return knowledge.tag_bridge(d.items.select("item_id", tx.pipe_join(F.col("genres")).alias("genres")))


@query(
    "rec_kg_build",
    "SELECT item_id, ingredient AS value, 'ingredient' AS kind FROM item_ingredients UNION ALL SELECT item_id, genre, 'tag' FROM item_genres",
)
def rec_kg_build(d):
    left = ingredient_bridge(d).select("item_id", F.col("ingredient").alias("value"), F.lit("ingredient").alias("kind"))
    return left.unionByName(tag_bridge(d).select("item_id", F.col("tag").alias("value"), F.lit("tag").alias("kind")))


view(
    "query_ingredients",
    """SELECT user_id, ingredient, n, rn FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, met) AS rn FROM (
           SELECT user_id, ingredient, count(*) AS n, min(pos * 1000 + ix) AS met FROM (
             SELECT user_id, pos, unnest(ingredients) AS ingredient, generate_subscripts(ingredients, 1) AS ix FROM (
               SELECT user_id, unnest(list_concat(recent_items, liked_items)[1:20]) AS item_id,
                      generate_subscripts(list_concat(recent_items, liked_items)[1:20], 1) AS pos FROM user_profile)
             JOIN items USING (item_id)) GROUP BY 1, 2)) WHERE rn <= 3""",
)
view(
    "kg_queries",
    """SELECT p.user_id, i.ingredients, list_sort(list_concat(favorite_genres, favorite_decades)) AS tags,
              CAST(CASE WHEN user_avg_rating >= 4.5 THEN 800 WHEN user_avg_rating <= 3.5 THEN 1200 ELSE 1000 END AS DOUBLE) AS max_calories,
              CAST(CASE active_level WHEN 'medium' THEN 15 WHEN 'high' THEN 20 ELSE 0 END AS DOUBLE) AS min_protein
       FROM user_profile p JOIN (SELECT user_id, list(ingredient ORDER BY ingredient) AS ingredients FROM query_ingredients GROUP BY 1) i
         USING (user_id)""",
)
view(
    "kg_ingr",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
         SELECT user_id, item_id, CAST(count(DISTINCT b.ingredient) AS DOUBLE) AS score
         FROM query_ingredients q JOIN item_ingredients b ON contains(b.ingredient, q.ingredient) GROUP BY 1, 2)) WHERE rn <= 50""",
)
view(
    "kg_tag",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
         SELECT user_id, item_id, CAST(count(DISTINCT genre) AS DOUBLE) AS score
         FROM (SELECT user_id, unnest(tags) AS genre FROM kg_queries) JOIN item_genres USING (genre) GROUP BY 1, 2)) WHERE rn <= 50""",
)
view(
    "kg_nutr",
    """SELECT user_id, item_id, score, rn FROM kg_queries JOIN (
         SELECT max_calories, min_protein, item_id, protein_pct AS score,
                row_number() OVER (PARTITION BY max_calories, min_protein ORDER BY protein_pct DESC, calories, item_id) AS rn
         FROM (SELECT DISTINCT max_calories, min_protein FROM kg_queries) l JOIN items
           ON calories <= max_calories AND protein_pct >= min_protein) USING (max_calories, min_protein) WHERE rn <= 50""",
)


def kg_queries(d):
    return knowledge.user_queries(d.user_profile, d.items.select("item_id", "ingredients"))


@query(
    "agg_18_frequent_ingredients",
    "SELECT user_id, ingredient, n, CAST(rn AS INT) AS rn FROM query_ingredients",
)
def frequent_ingredients(d):
    return knowledge.frequent_ingredients(d.user_profile, d.items.select("item_id", "ingredients"))


@query(
    "rec_kg_query",
    """SELECT user_id, array_to_string(ingredients, '|') AS ingredients, array_to_string(tags, '|') AS tags, max_calories, min_protein
       FROM kg_queries""",
)
def rec_kg_query(d):
    df = kg_queries(d)
    return df.withColumns({c: tx.pipe_join(F.col(c)) for c in ("ingredients", "tags")})


def per_user(d, method, *args):
    queries = kg_queries(d)
    users, distinct = knowledge._per_distinct(queries, ["ingredients", "tags", "max_calories", "min_protein"])
    return users.join(method(distinct, *args, 50), "qid").select("user_id", "item_id", "score")


@query("rec_kg_ingr", "SELECT user_id, item_id, score FROM kg_ingr")
def rec_kg_ingr(d):
    return per_user(d, knowledge.by_ingredients, ingredient_bridge(d))


@query("rec_kg_tag", "SELECT user_id, item_id, score FROM kg_tag")
def rec_kg_tag(d):
    return per_user(d, knowledge.by_tags, tag_bridge(d))


@query("rec_kg_nutr", "SELECT user_id, item_id, score FROM kg_nutr")
def rec_kg_nutr(d):
    return per_user(d, knowledge.by_nutrition, d.items)


@query(
    "rec_kg_hybrid",
    """SELECT user_id, item_id, 'kg' AS channel, score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
           SELECT user_id, item_id, round(w / max(w) OVER (PARTITION BY user_id) + 0.12 * (1 - item_rating_count / most), 6) AS score
           FROM (SELECT user_id, item_id, sum(w) AS w FROM (
                   SELECT user_id, item_id, score * 0.42 AS w FROM kg_ingr UNION ALL SELECT user_id, item_id, score * 0.28 FROM kg_tag
                   UNION ALL SELECT user_id, item_id, score * 0.18 FROM kg_nutr) GROUP BY 1, 2)
             JOIN item_profile USING (item_id), (SELECT max(item_rating_count) AS most FROM item_profile)))
       WHERE rn <= 50""",
)
def rec_kg_hybrid(d):
    return knowledge.hybrid(kg_queries(d), ingredient_bridge(d), tag_bridge(d), d.items, d.item_profile, 50)


@query(
    "jn_11_shared_ingredients",
    """SELECT item_id, similar_id, shared FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, similar_id) AS rn FROM (
           SELECT a.item_id, b.item_id AS similar_id, count(DISTINCT a.ingredient) AS shared
           FROM item_ingredients a JOIN item_ingredients b ON a.ingredient = b.ingredient AND a.item_id <> b.item_id GROUP BY 1, 2))
       WHERE rn <= 20""",
)
def rec_kg_sim(d):
    return knowledge.most_shared(ingredient_bridge(d), 20)


@query(
    "rec_kg_tagmatch",
    """SELECT user_id, item_id, CAST(len(list_intersect(favorite_genres, genres)) AS INT) AS kg_tag_match
       FROM (SELECT DISTINCT user_id, item_id FROM test) JOIN user_profile USING (user_id) JOIN items USING (item_id)""",
)
def rec_kg_tagmatch(d):
    return knowledge.tag_matches(d.test.select("user_id", "item_id"), d.user_profile, tag_bridge(d))


@query(
    "rec_kg_ingrsim",
    """SELECT item_a, item_b, round(len(list_intersect(a.ingredients, b.ingredients)) /
              (len(a.ingredients) + len(b.ingredients) - len(list_intersect(a.ingredients, b.ingredients))), 6) AS similarity
       FROM (SELECT p_partkey AS item_a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS item_b FROM part) p
       JOIN items a ON a.item_id = item_a JOIN items b ON b.item_id = item_b""",
)
def rec_kg_ingrsim(d):
    n = d.items.agg(F.count(F.lit(1))).scalar()
    pairs = d.items.select(F.col("item_id").alias("item_a"), ((F.col("item_id") * 7 + 3) % n).alias("item_b"))
    return knowledge.ingredient_similarity(pairs, ingredient_bridge(d)).withColumn("similarity", F.round("similarity", DIGITS))


# --- fusion ----------------------------------------------------------------------------------------


@query(
    "jn_3_wide_candidates",
    """SELECT user_id, item_id, i AS itemcf_score, h AS hot_score, CAST(i IS NOT NULL AS INT) AS is_itemcf_recall,
              CAST(h IS NOT NULL AS INT) AS is_hot_recall, CAST(i IS NOT NULL AS INT) + CAST(h IS NOT NULL AS INT) AS recall_source_count
       FROM wide""",
)
def wide_candidates(d):
    return fuse.wide_candidates(d.candidates, ("itemcf", "hot"))


@query(
    "agg_11_max_dedupe",
    "SELECT user_id, item_id, max(score) AS score FROM candidates GROUP BY 1, 2",
)
def max_dedupe(d):
    return d.candidates.groupBy("user_id", "item_id").agg(F.max("score").alias("score"))


@query(
    "prj_23_user_min_max",
    """SELECT user_id, item_id, round(ni, 6) AS coalesced, round(CASE WHEN i IS NULL THEN 0.0 WHEN p_hi <= p_lo THEN 1.0
              ELSE (i - p_lo) / (p_hi - p_lo) END, 6) AS present
       FROM (SELECT *, min(i) OVER (PARTITION BY user_id) AS p_lo, max(i) OVER (PARTITION BY user_id) AS p_hi FROM wide_norm)""",
)
def user_min_max(d):
    wide = fuse.wide_candidates(d.candidates, ("itemcf", "hot"))
    left = fuse.normalised(wide, ("itemcf",), "coalesced").select("user_id", "item_id", F.round("norm_itemcf", DIGITS).alias("coalesced"))
    right = fuse.normalised(wide, ("itemcf",), "present").select("user_id", "item_id", F.round("norm_itemcf", DIGITS).alias("present"))
    return left.join(right, ["user_id", "item_id"])


@query(
    "win_7_partition_range",
    "SELECT DISTINCT user_id, lo_h AS low, hi_h AS high FROM wide_norm",
)
def partition_range(d):
    wide = fuse.wide_candidates(d.candidates, ("itemcf", "hot"))
    value = F.coalesce("hot_score", F.lit(0.0))
    return wide.groupBy("user_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))


FUSED_COLUMNS = (
    "user_id", "item_id", "itemcf_score", "hot_score", "is_itemcf_recall", "is_hot_recall", "recall_source_count", "merged_score",
)


@query("rec_merge7", f"SELECT {', '.join(FUSED_COLUMNS)} FROM fused")
def rec_merge7(d):
    return d.fused.select(*FUSED_COLUMNS)


@query(
    "rec_merge",
    """SELECT user_id, item_id, merged_score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY merged_score DESC, item_id) AS rn FROM (
           SELECT *, round(0.30 + 0.22 * ni + 0.16 + 0.12 + 0.12 + 0.08 * nh + 0.1 * (fi + fh), 6) AS merged_score FROM wide_norm))
       WHERE rn <= 100""",
)
def rec_merge(d):
    return fuse.fuse(d.candidates, fuse.SIX_CHANNELS).select("user_id", "item_id", "merged_score")


@query(
    "rec_reduce",
    """SELECT user_id, item_id, score, sources, source_count, reason, CAST(position AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source_count DESC, item_id) AS position FROM (
           SELECT user_id, item_id, round(sum(s * w) + 0.05 * (count(*) - 1), 6) AS score,
                  string_agg(channel, '|' ORDER BY channel) AS sources, CAST(count(*) AS INT) AS source_count,
                  string_agg(channel || ' list', ' + ' ORDER BY w DESC) AS reason
           FROM (SELECT *, CASE channel WHEN 'itemcf' THEN 0.25 ELSE 0.10 END AS w,
                        CASE WHEN hi <= lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s
                 FROM (SELECT *, min(score) OVER (PARTITION BY user_id, channel) AS lo,
                              max(score) OVER (PARTITION BY user_id, channel) AS hi FROM candidates)) GROUP BY 1, 2))
       WHERE position <= 20""",
)
def rec_reduce(d):
    reasons = d.candidates.withColumn("reason", F.concat("channel", F.lit(" list")))
    return fuse.reduce_request(reasons, 20)


@query(
    "src_5_channel_scan",
    "SELECT user_id, item_id, score FROM hot",
)
def channel_scan(d):
    import uuid

    from quillrec.session import shared_dir
    from quillrec.sources.tables import read_candidates

    path = f"{shared_dir(d.spark)}/candidates-{uuid.uuid4().hex}"
    d.candidates.write.parquet(path)
    return read_candidates(d.spark, path, "hot").select("user_id", "item_id", "score")


@query(
    "jn_10_contains_join",
    """SELECT DISTINCT q.ingredient AS term, b.ingredient FROM query_ingredients q JOIN item_ingredients b ON contains(b.ingredient, q.ingredient)""",
)
def contains_join(d):
    terms = knowledge.frequent_ingredients(d.user_profile, d.items.select("item_id", "ingredients"))
    return knowledge.containing_names(terms.select(F.col("ingredient").alias("term")).distinct(), ingredient_bridge(d))



@query(
    "rec_contentrule",
    """SELECT user_id, item_id, 'content' AS channel, score FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM (
           SELECT user_id, item_id, round(CASE WHEN len(favorite_genres) > 0 THEN
                    0.55 * len(list_intersect(tok, favorite_genres)) / len(favorite_genres) + 0.25 * r + 0.15 * p + 0.05 * has_image
                    ELSE 0.45 * r + 0.40 * p + 0.15 * has_image END, 6) AS score
           FROM user_profile CROSS JOIN (
             SELECT item_id, has_image, regexp_split_to_array(lower(concat_ws(' ', title, clean_title, array_to_string(genres, '|'),
                      array_to_string(tags, '|'))), '[|,;/\\s]+') AS tok,
                    (item_avg_rating - min(item_avg_rating) OVER ()) / (max(item_avg_rating) OVER () - min(item_avg_rating) OVER ()) AS r,
                    (item_popularity - min(item_popularity) OVER ()) / (max(item_popularity) OVER () - min(item_popularity) OVER ()) AS p
             FROM item_profile))) WHERE rn <= 50""",
)
def rec_contentrule(d):
    return content.profile_match(d.user_profile, d.item_profile, 50)


@query(
    "jn_8_semi_id_set",
    "SELECT user_id, item_id, rating FROM ratings WHERE item_id IN (SELECT item_id FROM hot)",
)
def semi_id_set(d):
    wanted = d.hot_lists().select("item_id").distinct()
    return d.ratings.join(wanted, "item_id", "left_semi").select("user_id", "item_id", "rating")
