"""Steps that work in groups or ranges: the results stay whole, and what moves is bounded."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from quillrec.operators import evaluate, features, feedback, models, ranks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_seeds_do_not_move_one_by_one(spark, monkeypatch):
    """Live lists equal plain sums over several groups of users and several steps; a null user is a user like others."""
    monkeypatch.setattr(feedback, "GROUP_SEEDS", 20, raising=False)
    monkeypatch.setattr(feedback, "AT_ONCE", 15, raising=False)
    rng = random.Random(2)
    users = [None, *range(30)]
    seeds = sorted({(u, rng.randrange(12)): rng.randrange(1, 9) / 8 for u in users for _ in range(5)}.items(), key=str)
    seeds = [(u, i, w if rng.random() < 0.8 else None) for (u, i), w in seeds]
    shut = [(u, rng.randrange(20)) for u in users for _ in range(3)] + [(77, 1)]
    near = [(i, j, (j % 5) / 4) for i in range(10) for j in range(20) if i != j and rng.random() < 0.5]
    frames = (
        spark.createDataFrame(seeds, "user_id long, item_id long, weight double"),
        spark.createDataFrame(shut, "user_id long, item_id long"),
        spark.createDataFrame(near, "item_id long, similar_id long, score double"),
    )
    found = feedback.live_recommendations(*frames, 4)
    assert "CoGroup" in plan(found)
    sums: dict = {}
    for u, i, w in seeds:
        for a, b, s in near:
            if a == i and w is not None and (u is None or (u, b) not in shut):
                sums.setdefault(u, {}).setdefault(b, []).append(w * s)
    wanted = {
        (u, b, p, round(-s, 9))
        for u, own in sums.items()
        for p, (s, b) in enumerate(sorted((-sum(x), b) for b, x in own.items())[:4], 1)
    }
    assert {(r.user_id, r.item_id, r.position, round(r.score, 9)) for r in found.collect()} == wanted
    empty = feedback.live_recommendations(frames[0].limit(0), frames[1], frames[2], 4)
    assert empty.count() == 0
    assert feedback.live_recommendations(frames[0], frames[1], frames[2].limit(0), 4).count() == 0


def lists_and_test(spark):
    rng = random.Random(4)
    rows = [(u, i, c, rng.randrange(1, 9) / 8) for u in range(25) for c in ("hot", "itemcf") for i in rng.sample(range(40), 15)]
    liked = {(u, rng.randrange(40)) for u in range(20) for _ in range(2)}
    lists = spark.createDataFrame(rows, "user_id long, item_id long, channel string, score double")
    test = spark.createDataFrame([(u, i, 5.0) for u, i in liked], "user_id long, item_id long, rating double")
    items = spark.range(50).selectExpr("id AS item_id", "array(concat('g', id % 7), concat('h', id % 3)) AS genres")
    return rows, liked, lists, test, items


def test_settings_are_tried_where_candidates_lie(spark):
    """Each setting's metrics equal a plain ranking; candidates are not copied for the settings."""
    rows, liked, lists, test, items = lists_and_test(spark)
    names = ("precision", "recall", "ndcg")
    found = evaluate.tune_weights(lists, test, items, "hot", "itemcf", metrics=names)
    assert "MapInArrow" in plan(found) and "genres" not in plan(found)
    got = {(r.first_weight, r.source_bonus): tuple(r[x] for x in names) for r in found.collect()}
    assert len(got) == 33
    raw: dict = {}
    for u, i, c, s in rows:
        raw.setdefault(u, {}).setdefault(c, {})[i] = s
    for (a, bonus), values in got.items():
        sums = []
        for u in sorted({u for u, _ in liked}):
            scaled = {}
            for c, own in raw[u].items():
                low, high = min(own.values()), max(own.values())
                scaled[c] = {i: (s - low) / (high - low) if high > low else 1.0 for i, s in own.items()}
            hot, cf = scaled["hot"], scaled["itemcf"]
            score = lambda i: round(a * hot.get(i, 0) + round(1 - a, 1) * cf.get(i, 0) + bonus * ((i in hot) + (i in cf)), 6)  # noqa: B023, E731
            best = sorted(hot.keys() | cf.keys(), key=lambda i: (-score(i), i))[:10]
            n = sum(1 for x, _ in liked if x == u)
            at = [p for p, i in enumerate(best, 1) if (u, i) in liked]
            ideal = sum(1 / math.log2(p + 1) for p in range(1, min(n, 10) + 1))
            sums.append((len(at) / 10, len(at) / n, sum(1 / math.log2(p + 1) for p in at) / ideal))
        assert values == pytest.approx([sum(x) / len(sums) for x in zip(*sums, strict=True)], abs=1e-6)
    every = evaluate.tune_weights(lists, test, items, "hot", "itemcf")
    assert {(r.first_weight, r.source_bonus): tuple(r[x] for x in names) for r in every.collect()} == got
    assert every.where("is_best").count() == 1


def test_only_wanted_metrics_are_worked_out(spark):
    """Precision needs no genres and coverage no relevant ranks; either equals its column of the whole table."""
    _, _, lists, test, items = lists_and_test(spark)
    recs = lists.withColumnRenamed("channel", "model_name")
    whole = evaluate.evaluate_lists(recs, test, items)
    for names in (evaluate.PER_LIST, ("coverage",), ("diversity",)):
        part = evaluate.evaluate_lists(recs, test, items, metrics=names)
        assert names == ("diversity",) or "genres" not in plan(part)
        pick = ["model_name", "k", *names]
        assert sorted(part.select(*pick).collect()) == sorted(whole.select(*pick).collect())


def test_pools_are_counted_before_they_meet_items(spark):
    pool = spark.range(60).selectExpr("id % 6 AS user_id", "id % 11 AS item_id")
    items = spark.range(11).selectExpr("id AS item_id", "double(id) AS item_popularity")
    whole = evaluate.long_tail_summary({"a": pool}, items).drop("user_tail_coverage").collect()
    part = evaluate.long_tail_summary({"a": pool}, items, per_user=False)
    assert part.collect() == whole and (whole[0].rows, whole[0]["items"], whole[0].tail_items) == (60, 11, 8)


def test_only_the_last_range_of_a_sample_is_ordered(spark, monkeypatch):
    """A label's rows of lowest hashes, repeated rows and a null label too, without sorting n rows of every task."""
    rows = [(i % 700, i % 3, None if i % 50 == 0 else i % 7 // 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int")
    found = features.stratified_sample(df, "label", ["user_id", "item_id"], 400)
    assert "WindowGroupLimit" not in plan(found).split("Union")[0] and found.columns == df.columns
    wanted = []
    for label in (None, 0, 1):
        own = [(hashlib.sha256(f"42:{u}:{i}".encode()).hexdigest(), u, i, x) for u, i, x in rows if x == label]
        wanted += [x[1:] for x in sorted(own, key=lambda x: x[:3])[: max(1, 400 * len(own) // len(rows))]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert ranks.lowest_per_label(df.limit(0), "label", features.seeded_hash(1, "user_id"), [], 5).count() == 0


def test_models_hold_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(models, "MODEL_ROWS", 50, raising=False)
    train = spark.range(0, 400, 1, 1).selectExpr("double(id % 9) AS x", "double(id % 4) AS y", "double(id % 5) AS rating", "id AS user_id")
    assert models.training_rows(train, ["x", "rating"]).rdd.glom().map(len).max() <= 60
    found = models.regression_metrics(models.rating_regressor(train, ("x", "y"), 2).scored(train)).first()
    assert found.n == 400 and 0 < found.rmse < 2


def test_labels_of_candidates_need_no_shuffle_of_their_own(spark):
    """Labels come by user, as the user profile does; a like without a candidate and a user without likes change nothing."""
    users = spark.range(6).selectExpr(
        "id AS user_id", "1L AS user_rating_count", "4D AS user_avg_rating", "0D AS user_rating_std", "4D AS user_min_rating",
        "4D AS user_max_rating", "'low' AS active_level", "array('a') AS favorite_genres", "array('1990s') AS favorite_decades",
    )
    items = spark.range(6).selectExpr(
        "id AS item_id", "3D AS item_avg_rating", "1L AS item_rating_count", "0D AS item_rating_std", "1D AS item_popularity",
        "1995 AS year", "'1990s' AS decade", "array('a', 'b') AS genres", "2 AS genre_count", "2L AS tag_count",
    )
    recall = spark.range(24).selectExpr("id % 6 AS user_id", "id % 4 AS item_id", "0.5D AS hot_score", "1 AS is_hot_recall", "0.7D AS merged_score").distinct()
    test = spark.createDataFrame([(0, 0, 5.0), (0, 0, 4.0), (1, 1, 4.0), (1, 3, 5.0), (2, 2, 3.0), (5, 5, 5.0)], "user_id long, item_id long, rating double")
    found = features.candidate_features(recall, test, users, items)
    rows = found.collect()
    assert "SortMergeJoin [user_id" in plan(found) and ", item_id" not in "".join(x for x in plan(found).splitlines() if "SortMergeJoin" in x)
    assert len(rows) == recall.count() and {(r.user_id, r.item_id) for r in rows if r.label == 1} == {(0, 0), (1, 1), (1, 3)}
