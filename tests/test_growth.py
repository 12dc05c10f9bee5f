"""Steps that must not grow faster than the input: what they move, and that their results stay whole."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillrec.operators import als, bitmaps, features, fuse, hot, itemcf, nearest, search
from quillrec.plans import catalog
from quillrec.sources.domain import Domain


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_neighbours(liked: set, k: int) -> dict:
    by_user: dict = {}
    for user, item in sorted(liked):
        by_user.setdefault(user, []).append(item)
    n = Counter(item for _, item in liked)
    common = Counter((a, b) for items in by_user.values() for a in items for b in items if a != b)
    found: dict = {}
    for (a, b), c in common.items():
        found.setdefault(a, []).append((-c / (float(n[a]) * n[b]) ** 0.5, b))
    return {a: [b for _, b in sorted(rows)[:k]] for a, rows in found.items()}


@pytest.mark.parametrize(("chunk", "part"), [(100, 10_000), (3, 4)])
def test_pairs_of_liked_items_do_not_move(spark, monkeypatch, chunk, part):
    """One row of arrays for each like moves, in one task or dealt out in chunks and parts; all neighbours are found."""
    rng = random.Random(5)
    liked = {(rng.randrange(40), int(rng.random() ** 2 * 30)) for _ in range(400)}
    liked |= {(99, 1000)}  # liked with nothing else
    rows = spark.createDataFrame(sorted(liked), "user_id long, item_id long")
    monkeypatch.setattr(itemcf, "CHUNK", chunk)
    monkeypatch.setattr(itemcf, "PART", part, raising=False)
    near = itemcf.similar_items(rows, 5)
    got: dict = {}
    for row in near.orderBy("item_id", "similarity", ascending=[True, False]).collect():
        got.setdefault(row.item_id, set()).add(row.similar_id)
    assert got == {a: set(b) for a, b in plain_neighbours(liked, 5).items()}
    train = rows.selectExpr("user_id", "item_id", "5D AS rating", "0L AS ts")
    assert "item_j" not in plan(itemcf.itemcf_recall(train)) and "item_j" not in plan(near)


def test_pair_features_broadcast_nothing(spark):
    """Two columns of long compressed lists look small to the planner; no table that grows is broadcast."""
    users = spark.range(20).selectExpr(
        "id AS user_id", "1L AS user_rating_count", "4D AS user_avg_rating", "0D AS user_rating_std", "4D AS user_min_rating",
        "4D AS user_max_rating", "'low' AS active_level", "array('a') AS favorite_genres", "array('1990s') AS favorite_decades",
    )
    items = spark.range(20).selectExpr(
        "id AS item_id", "3D AS item_avg_rating", "1L AS item_rating_count", "0D AS item_rating_std", "1D AS item_popularity",
        "1995 AS year", "'1990s' AS decade", "array('a', 'b') AS genres", "2 AS genre_count", "2L AS tag_count",
    )
    recall = spark.range(20).selectExpr("id AS user_id", "id AS item_id", "0.5D AS hot_score", "1 AS is_hot_recall", "0.7D AS merged_score")
    pairs = spark.range(20).selectExpr("id AS user_id", "id AS item_id", "1 AS label")
    found = features.with_pair_features(pairs, users, items, recall)
    assert "Broadcast" not in plan(found)
    assert {(r.genre_match_score, r.merged_score) for r in found.collect()} == {(0.5, 0.7)}


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Similar vectors and unseen items equal brute force over several groups, blocks and steps; no row per query and cell moves."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6))
    vectors[:20] = vectors[0]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, vector array<double>")
    similar = nearest.similar_vectors(rows, 7)
    assert "CoGroup" in plan(similar)
    monkeypatch.setattr("quillrec.operators.blocks.QUERIES", (8, 16))
    monkeypatch.setattr("quillrec.operators.blocks.ITEMS", 40)
    monkeypatch.setattr("quillrec.operators.blocks.STEP", (5, 9))
    scores = np.round(vectors @ vectors.T, 6)
    wanted = {i: sorted((-scores[i, j], j) for j in range(90) if j != i)[:7] for i in range(90)}
    for found in (similar, nearest.similar_vectors(rows, 7)):
        got: dict = {}
        for r in found.collect():
            got.setdefault(r.item_id, []).append((-r.score, r.similar_id))
        assert all([j for _, j in sorted(got[i])] == [j for _, j in wanted[i]] for i in wanted)
    seen = spark.createDataFrame([(i, j) for i in range(90) for j in range(i)], "user_id long, item_id long")
    users = rows.withColumnRenamed("item_id", "user_id")
    got = {}
    for r in nearest.nearest_unseen(users, rows, seen, 4).collect():
        got.setdefault(r.user_id, []).append((-r.score, r.item_id))
    fresh = {i: sorted((-scores[i, j], j) for j in range(i, 90))[:4] for i in range(90)}
    assert all([j for _, j in sorted(got[i])] == [j for _, j in fresh[i]] for i in fresh)


def test_a_block_of_items_moves_once_for_its_requests(spark, monkeypatch):
    """Requests pass by their block in the task that holds it; the block is not copied for every few of them."""

    def sent(n, work):
        def count(batches):
            for batch in batches:
                held = len(batch) - batch.column(batch.schema.get_field_index("ids")).null_count
                yield pa.RecordBatch.from_arrays([pa.array([0] * held), pa.array([0] * held), pa.array([0.0] * held)], ["qid", "item_id", "score"])

        return count

    monkeypatch.setattr(bitmaps, "_matcher", sent)
    monkeypatch.setattr(bitmaps, "PACK", 4, raising=False)
    block = spark.sql("SELECT 0L AS block, array(5L, 6L) AS ids, array(1L) AS terms, array(2L) AS sizes, array(0, 1) AS places")
    requests = spark.range(200).selectExpr("id AS qid", "array(1L) AS terms")
    open_at = spark.range(200).selectExpr("id AS qid", "0L AS block", "0L AS floor")
    assert bitmaps._visited(open_at, requests, block, 5, None).count() == 1


def test_tasks_of_candidates_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Candidates compress to a few bytes a row, so their tasks are cut by rows and are not coalesced by bytes."""
    monkeypatch.setattr("quillrec.operators.skew.TASK_ROWS", 25, raising=False)
    monkeypatch.setattr(itemcf, "TASK_LIKES", 25, raising=False)
    lists = spark.range(400).selectExpr("id % 40 AS user_id", "id AS item_id", "'hot' AS channel", "1D / (1 + id) AS score")
    wide = fuse.wide_candidates(lists, ("hot", "itemcf"))
    train = spark.range(400).selectExpr("id % 40 AS user_id", "id % 30 AS item_id", "5D AS rating", "id AS ts")
    for df in (wide, itemcf.itemcf_recall(train)):
        rows = df.collect()
        assert df.rdd.getNumPartitions() >= 5 and len(rows) == len({(r.user_id, r.item_id) for r in rows})
    assert wide.count() == 400


def test_queries_ask_for_small_tasks(spark):
    Domain(spark, "/nowhere")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_words_of_documents_are_not_broadcast(spark, tmp_path):
    """Words exploded from short files look small to the planner; the table of all documents' words must be joined."""
    spark.range(300).selectExpr("id AS item_id", "'red bolt' AS title", "'large ring' AS tags_text").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    queries = spark.createDataFrame([("red bolt",), ("rings",)], "query string")
    found = search.weighted_search(queries, docs, "item_id", {"title": 4.0, "tags_text": 1.0}, 5)
    assert re.search(r"SortMergeJoin \[word#\d+, field#\d+\]", plan(found))
    assert {(r.query, r.item_id) for r in found.collect()} == {(q, i) for q in ("red bolt", "rings") for i in range(5)}


@pytest.mark.parametrize("head", [10_000, 4])
def test_popularity_moves_only_reachable_places(spark, monkeypatch, head):
    """Seen items below the deepest place a list can reach are not moved; lists equal a plain count, with repeats, too."""
    rng = random.Random(8)
    seen = [(u, i) for u in range(12) for i in rng.sample(range(400), 6)] + [(0, i) for i in range(3)] + [(1, 5)] * 2
    stats = spark.range(400).selectExpr("id AS item_id", "5D AS item_avg_rating", "1000 - id AS item_rating_count")
    rows = spark.createDataFrame(seen, "user_id long, item_id long")
    held, stage = [], hot.stage
    monkeypatch.setattr(hot, "stage", lambda df: held.append(stage(df)) or held[-1])
    monkeypatch.setattr(hot, "HEAD", head)
    users = spark.range(13).selectExpr("id AS user_id")  # one has seen nothing
    found: dict = {}
    for row in hot.hot_recall(users, stats, rows, 5).collect():
        found.setdefault(row.user_id, set()).add(row.item_id)
    ranks = sorted(range(400))
    assert found == {u: set([i for i in ranks if (u, i) not in set(seen)][:5]) for u in range(13)}
    assert held[-1].count() == len({x for x in seen if x[1] < 5 + 9})


def test_popular_items_need_no_cooccurrence(spark, monkeypatch):
    """The set of listed popular items is read without making the other channel's lists."""
    monkeypatch.setattr(itemcf, "itemcf_recall", None)
    assert catalog.QUERIES["jn_8_semi_id_set"](spark, "/root/testdata/sf0.001").count() > 0


def test_feature_join_broadcasts_nothing(spark):
    found = catalog.QUERIES["jn_9_feature_join"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in plan(found)


def test_factor_recall_meets_in_blocks(spark, monkeypatch):
    """Recall from few factors makes its products in blocks, sized for their dimensions, and equals brute force."""
    rng = np.random.default_rng(4)
    users, items = rng.integers(-3, 4, (30, 4)).astype(float), rng.integers(-3, 4, (200, 4)).astype(float)  # many ties
    rows = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, features array<float>")
    seen = {(u, int(i)) for u in range(29) for i in rng.integers(0, 200, 1 + u % 5)}
    monkeypatch.setattr("quillrec.operators.blocks.QUERIES", (4, 8))
    monkeypatch.setattr("quillrec.operators.blocks.ITEMS", 5)  # of 64 dimensions: 80 of four
    monkeypatch.setattr("quillrec.operators.blocks.STEP", (7, 9))
    model = type("Model", (), {"userFactors": rows(users), "itemFactors": rows(items)})()
    recall = als.als_recall(model, spark.createDataFrame(sorted(seen), "user_id long, item_id long"), 6)
    assert "CoGroup" in plan(recall)
    found: dict = {}
    for r in recall.collect():
        found.setdefault(r.user_id, set()).add(r.item_id)
    scores = users @ items.T
    assert found == {
        u: {i for _, i in sorted((-scores[u, i], i) for i in range(200) if (u, i) not in seen)[:6]} for u in range(30)
    }
