"""Small-table tests with exact expectations, brute-force comparisons and plan checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.operators import diversify, fuse, hot, ingest, itemcf, nearest, prepare, quality
from quillrec.operators.ranks import lowest_hashes, quantiles, with_global_rank
from quillrec.operators.topk import supplement, top_k


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_clean_ratings_drops_bad_ids_and_keeps_bad_time(spark):
    raw = spark.createDataFrame(
        [("1", "2", "4", "10"), ("1", "2", "4", "10"), ("x", "2", "4", "10"), ("1", "3", "bad", "1"), ("1", "4", "5", "?")],
        "user_id string, item_id string, rating string, ts string",
    )
    assert rows(prepare.clean_ratings(raw), "user_id", "item_id", "rating_norm", F.coalesce("ts", F.lit(-1))) == [
        (1, 2, 0.8, 10),
        (1, 4, 1.0, -1),
    ]


def test_clean_items_parses_titles_and_empty_genres(spark):
    raw = spark.createDataFrame(
        [("1", "Soup (1999) ", "a|b"), ("2", "Plain", "(no genres listed)"), ("3", "Null", None)],
        "item_id string, title string, genres string",
    )
    out = {r.item_id: r for r in prepare.clean_items(raw).collect()}
    assert (out[1].clean_title, out[1].year, out[1].genre_count) == ("Soup", 1999, 2)
    assert (out[2].year, out[2].genres, out[3].genres) == (None, [], [])


def test_leave_one_out_takes_newest_and_skips_single_rows(spark):
    ratings = spark.createDataFrame(
        [(1, 1, 5.0, 10), (1, 2, 4.0, 20), (1, 3, 3.0, 20), (2, 1, 5.0, 1)], "user_id long, item_id long, rating double, ts long"
    )
    split = prepare.leave_one_out(ratings)
    assert rows(prepare.test_rows(split), "user_id", "item_id") == [(1, 3)]
    assert rows(prepare.train_rows(split), "user_id", "item_id") == [(1, 1), (1, 2)]


def test_list_text_and_nutrition(spark):
    df = spark.createDataFrame([("['A|b', 'a b', 'C']", "[1.5, 'x', 3]"), ("oops", None)], "tags string, nutrition string")
    out = df.select(tx.clean_tokens(tx.literal_list(F.col("tags")), 5).alias("t"), tx.nutrition_struct(F.col("nutrition")).alias("n"))
    first, second = out.collect()
    assert first.t == ["a b", "c"] and second.t == []
    assert (first.n.calories, first.n.total_fat_pct, first.n.sugar_pct, first.n.sodium_pct) == (1.5, 0.0, 3.0, 0.0)
    assert second.n.calories == 0.0


def test_import_popular_drops_review_only_rows(spark):
    raw = spark.createDataFrame(
        [("1", "10", "2001-01-01", "5"), ("1", "11", "2001-01-02", "4"), ("2", "10", "2001-01-03", "3"), ("2", "11", "2001-01-04", "2"),
         ("2", "12", "2001-01-04", "0")],
        "user_id string, recipe_id string, date string, rating string",
    )
    recipes = spark.createDataFrame([("10", "a"), ("11", "b"), ("12", "c")], "id string, name string")
    out = ingest.import_popular(raw, recipes, min_recipe=2, min_user=2)
    assert out.count() == 4 and out.select("item_id").distinct().count() == 2


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    ranked = with_global_rank(df.repartition(7), [F.desc("v")], "r").collect()
    assert sorted((r.r, r.v) for r in ranked) == [(i + 1, 999 - i) for i in range(1000)]


@pytest.mark.parametrize("q", [0.0, 0.35, 0.7, 1.0])
def test_quantiles_match_numpy(spark, q):
    values = [1.0] * 50 + [float(i) ** 1.5 for i in range(37)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = quantiles(df, ["k"], "v", [q]).first().quantile
    assert got == pytest.approx(np.quantile(values, q))


def test_quantiles_of_values_that_crowd_in_a_small_interval(spark):
    """99 % of the values lie in one of any number of buckets of equal width; a second key has other values."""
    rng = np.random.default_rng(8)
    crowded = np.concatenate([1 + rng.random(3960) * 1e-9, 10.0 ** rng.uniform(1, 12, 40)])
    spread = rng.integers(0, 9, 500).astype(float)
    rows = [("a", float(v)) for v in crowded] + [("b", float(v)) for v in spread] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = [0.0, 0.1, 0.5, 0.985, 0.9901, 0.999, 1.0]
    found = {(r.k, r.q): r.quantile for r in quantiles(df, ["k"], "v", points).collect()}
    for key, values in (("a", crowded), ("b", spread)):
        for q in points:
            assert found[key, q] == pytest.approx(np.quantile(values, q), rel=1e-15)


@pytest.mark.parametrize("n", [0, 1, 7, 250, 399, 400, 1000])
def test_lowest_hashes(spark, n):
    from quillrec.operators.features import seeded_hash

    df = spark.range(400).select((F.col("id") % 390).alias("id"), F.col("id").alias("at")).repartition(3)
    order = [seeded_hash(1, "id"), F.col("at")]
    wanted = [r.at for r in df.orderBy(*order).limit(n).collect()]
    assert sorted(r.at for r in lowest_hashes(df, order[0], order[1:], n).collect()) == sorted(wanted)


def test_hot_skips_seen_items_even_for_a_heavy_user(spark):
    stats = spark.createDataFrame([(i, 3.0, 100 - i) for i in range(60)], "item_id long, item_avg_rating double, item_rating_count long")
    seen = spark.createDataFrame([(1, i) for i in range(0, 50, 2)] + [(2, 0)] + [(4, i) for i in range(58)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    out = {}
    for r in hot.hot_recall(users, stats, seen, 5).collect():
        out.setdefault(r.user_id, []).append(r.item_id)
    assert {k: sorted(v) for k, v in out.items()} == {1: [1, 3, 5, 7, 9], 2: [1, 2, 3, 4, 5], 3: [0, 1, 2, 3, 4], 4: [58, 59]}


def test_itemcf_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    likes = {(int(u), int(i)) for u, i in zip(rng.integers(0, 25, 150), rng.integers(0, 18, 150))}
    train = spark.createDataFrame([(u, i, 5.0, 1) for u, i in likes], "user_id long, item_id long, rating double, ts long")
    users = {}
    for u, i in likes:
        users.setdefault(i, set()).add(u)
    sim = {(i, j): len(users[i] & users[j]) / np.sqrt(len(users[i]) * len(users[j])) for i in users for j in users if i != j and users[i] & users[j]}
    want = {}
    for u, i in likes:
        for (a, b), s in sim.items():
            if a == i and (u, b) not in likes:
                want[u, b] = want.get((u, b), 0) + s
    got = {(r.user_id, r.item_id): r.score for r in itemcf.itemcf_recall(train, top_n=50).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("n_cells", [1, 8])
def test_nearest_matches_brute_force(spark, n_cells):
    rng = np.random.default_rng(5)
    items, queries = rng.normal(size=(200, 6)), rng.normal(size=(30, 6))
    as_df = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vector array<double>")
    got = nearest.nearest(as_df(queries, "query_id"), as_df(items, "item_id"), 7, n_cells=n_cells)
    scores = np.round(queries @ items.T, 6)
    want = sorted((q, int(i)) for q in range(30) for i in np.lexsort((np.arange(200), -scores[q]))[:7])
    assert rows(got, "query_id", "item_id") == want


def test_fusion_normalisers_differ_for_missing_channels(spark):
    df = spark.createDataFrame(
        [(1, 10, "als", 2.0), (1, 11, "als", 4.0), (1, 12, "hot", 0.5)], "user_id long, item_id long, channel string, score double"
    )
    wide = fuse.wide_candidates(df, ("als", "hot", "kg"))
    coalesced = {r.item_id: r for r in fuse.normalised(wide, ("als", "kg"), "coalesced").collect()}
    present = {r.item_id: r for r in fuse.normalised(wide, ("als", "kg"), "present").collect()}
    assert [coalesced[i].norm_als for i in (10, 11, 12)] == [0.5, 1.0, 0.0]
    assert [coalesced[i].norm_kg for i in (10, 11, 12)] == [1.0, 1.0, 1.0]
    assert [present[i].norm_als for i in (10, 11, 12)] == [0.0, 1.0, 0.0]
    assert [present[i].norm_kg for i in (10, 11, 12)] == [0.0, 0.0, 0.0]


def test_mmr_prefers_other_genres(spark):
    ranked = spark.createDataFrame(
        [(1, 1, 0.9, 0.0), (1, 2, 0.8, 0.0), (1, 3, 0.7, 0.0)], "user_id long, item_id long, rank_score double, merged_score double"
    )
    items = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"])], "item_id long, genres array<string>")
    out = {r.rank_position: (r.item_id, r.mmr_score) for r in diversify.mmr(ranked, items, 3, (0.5,)).collect()}
    assert out == {1: (1, 0.45), 2: (3, 0.35), 3: (2, -0.1)}


def test_supplement_fills_without_repeats(spark):
    first = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "user_id long, item_id long, r int")
    second = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3)], "user_id long, item_id long, r int")
    out = supplement([first, second], ["user_id"], "item_id", "r", 3)
    assert rows(out, "position", "item_id") == [(1, 10), (2, 11), (3, 12)]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_quality_checks_raise(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a long, b long")
    with pytest.raises(ValueError, match="repeated=1"):
        quality.raise_on_violations(quality.unique_checks(df, ["a", "b"], "repeated"))


def test_cooccurrence_of_a_user_with_many_likes(spark):
    """Likes beyond one chunk are paired with all others of the user."""
    from quillrec.operators import itemcf

    likes = [(1, i) for i in range(230)] + [(2, i) for i in range(0, 230, 7)]
    rows = itemcf.cooccurrence(spark.createDataFrame(likes, "user_id long, item_id long")).collect()
    assert len(rows) == 230 * 229 // 2
    assert all(r.item_i < r.item_j for r in rows)
    common = {(r.item_i, r.item_j): r.common for r in rows}
    assert all(n == 1 + (i % 7 == 0 and j % 7 == 0) for (i, j), n in common.items())
