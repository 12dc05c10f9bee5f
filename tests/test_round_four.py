"""Faults found by running queries against their SQL and on larger tables."""

from __future__ import annotations

import inspect
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillrec.operators import alike, blocks, content, models, usermatch
from quillrec.plans import rank_queries


def test_match_scores_round_as_in_sql(spark):
    """All scores of six digits that lie halfway between two percentages of one digit, 0.0045 for example, and odd ones."""
    scores = [n / 1e6 for n in range(500, 1_000_000, 1000)] + [-0.2, 0.0, 0.123456, 1.0, 1.3]
    matches = spark.createDataFrame(list(enumerate(scores)), "user_id long, score double").selectExpr("user_id", "user_id + 1 AS twin_id", "score")
    profile = spark.createDataFrame([], "user_id long, favorite_genres array<string>")
    ratings = spark.createDataFrame([], "user_id long, item_id long, rating double, ts long")
    cards = usermatch.match_cards(matches, profile, ratings).select("user_id", "match_score").collect()
    values = ", ".join(f"({i}, CAST({s!r} AS DOUBLE))" for i, s in enumerate(scores))
    want = duckdb.sql(f"SELECT i, round(least(greatest(score, 0), 1) * 100, 1) FROM (VALUES {values}) t(i, score)").fetchall()
    assert {(r.user_id, r.match_score) for r in cards} == set(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"QUERIES": (2, 4), "TERMS": 8, "ITEMS": 8, "FREQUENT": 2, "STEP": 16}.items():
        monkeypatch.setattr(alike, name, value)


def plain_best(rows, k: int, sign: int = 1):
    return sorted(rows, key=lambda row: (-row[1], sign * row[0]))[:k]


def test_joint_menus_compare_pairs_with_sets_of_tags(spark, small_blocks):
    """Items nobody shares are ranked in blocks of equal tag sets, not as rows of pair, item and tag; items without any score count."""
    rng = random.Random(4)
    tags = {i: sorted(rng.sample("abcd", rng.randrange(4))) for i in range(40)}
    rating = {i: (rng.choice([0.0, 3.0, 4.5]), rng.choice([0, 10, 90])) for i in tags}
    favourites = {u: rng.sample("abcdx", rng.randrange(4)) for u in range(8)}
    rated = {(u, i) for u in range(8) for i in rng.sample(range(40), 6)}
    pairs = [(u, t) for u in range(9) for t in range(8) if u != t and rng.random() < 0.5]
    found = usermatch.joint_menu(
        spark.createDataFrame(pairs, "user_id long, twin_id long"),
        spark.createDataFrame([(u, i, 3.0, 1) for u, i in rated], "user_id long, item_id long, rating double, ts long"),
        spark.createDataFrame(list(favourites.items()), "user_id long, favorite_genres array<string>"),
        spark.createDataFrame(
            [(i, t[:2], t[1:], *rating[i]) for i, t in tags.items()],
            "item_id long, genres array<string>, tags array<string>, item_avg_rating double, item_rating_count int",
        ),
        k=30,
    )
    assert "CoGroup" in plan(found)
    got: dict = {}
    for row in found.orderBy("position").collect():
        got.setdefault((row.user_id, row.twin_id), []).append((row.item_id, row.score))
    for u, t in pairs:
        wanted = set(favourites.get(u, [])) | set(favourites[t])
        scored = [(i, round(2.0 * len(wanted & set(x)) + rating[i][0] + min(rating[i][1], 50) / 50, 6)) for i, x in tags.items() if (u, i) not in rated]
        assert got[u, t] == plain_best(scored, 30, -1)


def test_profile_matches_compare_users_with_sets_of_terms(spark, small_blocks):
    """Each user's best items by the rule, those of score 0 too, from blocks of equal favourite terms."""
    rng = random.Random(7)
    items = [(i, f"t{i}", rng.sample(["a", "b", "c"], rng.randrange(4)), float(rng.randrange(3)), float(rng.randrange(3)), i % 2) for i in range(30)]
    favourites = {u: rng.sample(["a", "b", "c", "z"], rng.randrange(4)) for u in range(9)}
    found = content.profile_match(
        spark.createDataFrame(list(favourites.items()), "user_id long, favorite_genres array<string>"),
        spark.createDataFrame(
            items, "item_id long, title string, genres array<string>, item_avg_rating double, item_popularity double, has_image int"
        ).selectExpr("*", "title AS clean_title", "array('x') AS tags", "array('x') AS ingredients"),
        29,
    )
    assert "CoGroup" in plan(found)
    got: dict = {}
    for row in found.collect():
        got.setdefault(row.user_id, []).append((row.item_id, row.score))
    for u, terms in favourites.items():
        shares = (0.25, 0.15, 0.05) if terms else (0.45, 0.40, 0.15)
        own = lambda i: sum(w * x for w, x in zip(shares, (i[3] / 2, i[4] / 2, i[5]), strict=True))
        match = lambda i: 0.55 * len(set(i[2]) & set(terms)) / max(1, len(terms))
        assert plain_best(got[u], 29) == plain_best([(i[0], round(match(i) + own(i), 6)) for i in items], 29)


def test_items_of_equal_terms_are_one_group(spark, monkeypatch):
    """Of 400 items with three sets of terms three rows are compared; a set of very many items is cut."""
    items = spark.range(400).selectExpr("id AS item_id", "array(string(id % 3)) AS terms", "array(1D) AS weights", "0D AS value")
    assert sorted(len(r.ids) for r in alike.alike(items).collect()) == [133, 133, 134]
    more = spark.range(6000).selectExpr("id AS item_id", "array(string(int(id < 20))) AS terms", "array(1D) AS weights", "0D AS value")
    cut = alike.alike(more).collect()
    assert len(cut) == 33 and sum(len(r.ids) for r in cut) == 6000


@pytest.mark.parametrize("short", [100_000, 0])
def test_content_recall_compares_users_with_different_texts(spark, small_blocks, monkeypatch, short):
    """Lists equal brute force over all items, those of one text too, and are filled past what is seen; no tree of cells is visited."""
    monkeypatch.setattr(content, "SHORT", short)
    rng = random.Random(11)
    texts = {i: " ".join(rng.choice(["red", "blue", "big", "old"]) for _ in range(rng.randrange(1, 4))) for i in range(40)}
    favourites = {u: (rng.sample(["red", "old", "new"], rng.randrange(3)), rng.sample(range(40), rng.randrange(1, 4))) for u in range(9)}
    seen = {(u, i) for u, (_, liked) in favourites.items() for i in [*liked, *rng.sample(range(40), 5)]}
    found = content.content_recall(
        spark.createDataFrame([(u, *x) for u, x in favourites.items()], "user_id long, favorite_genres array<string>, liked_items array<long>"),
        None,
        spark.createDataFrame(list(texts.items()), "item_id long, text string"),
        spark.createDataFrame(sorted(seen), "user_id long, item_id long"),
        12,
    )
    assert "CoGroup" in plan(found)

    def terms(text):
        words = text.split()
        return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])

    df = Counter(t for text in texts.values() for t in terms(text))
    df = {t: sum(t in terms(text) for text in texts.values()) for t in df}

    def unit(text):
        w = {t: n * (math.log(41 / (1 + df[t])) + 1) for t, n in terms(text).items() if t in df}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    got: dict = {}
    for row in found.collect():
        got.setdefault(row.user_id, []).append((row.item_id, row.score))
    for u, (genres, liked) in favourites.items():
        mine = unit(" ".join([*genres, *(texts[i] for i in liked)]))
        scores = [(i, round(sum(mine.get(t, 0) * x for t, x in unit(text).items()), 6)) for i, text in texts.items() if (u, i) not in seen]
        assert plain_best(got.get(u, []), 12) == plain_best([x for x in scores if x[1] > 0], 12)


def test_model_selection_grows_all_trees(monkeypatch):
    """The query leaves the number of trees to the operator, whose number is the whole one."""
    asked: dict = {}
    monkeypatch.setattr(rank_queries, "train_table", lambda d: None)
    monkeypatch.setattr(rank_queries, "stage", lambda df: df)
    monkeypatch.setattr(models, "split_by_user", lambda df: (None, None))
    signature = inspect.signature(models.select_model)
    monkeypatch.setattr(models, "select_model", lambda *a, **b: (None, asked.update(signature.bind(*a, **b).arguments)))
    rank_queries.model_selection(None)
    assert asked.get("rounds", signature.parameters["rounds"].default) == 120


def test_model_selection_deals_rows_out_once(spark, monkeypatch):
    """Five models are trained on one dealt table and compared by metrics that are worked out once."""
    rows = spark.range(400).selectExpr("id % 40 AS user_id", "double(id % 7) AS a", "double(id % 5) AS b", "int(id % 7 > 2) AS label")
    train, valid = rows.where("user_id < 30"), rows.where("user_id >= 30")
    calls = []
    dealt = models.training_rows
    monkeypatch.setattr(models, "training_rows", lambda *a, **b: calls.append(a) or dealt(*a, **b))
    winner, table = models.select_model(train, valid, ["a", "b"], rounds=2)
    assert len(calls) == 1 and "Aggregate" not in plan(table) and "UDF" not in plan(table)
    got = {r.model: r for r in table.collect()}
    assert len(got) == 5 and winner.name in got and all(r.auc == 1.0 and r.accuracy > 0.8 for r in got.values())
    one = models.classification_metrics(winner.scored(valid.where("label = 1")), "x").first()
    assert (one.auc, one.logloss) == (0.0, 0.0)


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_products_that_cannot_count_are_not_made(monkeypatch, scale):
    """Best items equal brute force, ties and near ties too; most queries pass by the items that point away from them."""
    rng = np.random.default_rng(8)
    queries = rng.normal(size=(40, 5)) * 0.2 + 1
    items = rng.normal(size=(300, 5)) * 0.2 + rng.choice([-1.0, 1.0], size=(300, 1))
    items[40:60] = items[:20]
    items[60:80] = items[:20] + 1e-9
    items *= scale
    k = rng.integers(1, 30, 40).astype(np.int32)
    k[0] = 400
    monkeypatch.setattr(blocks, "STEP", (7, 20))
    met = []
    reaching = blocks._Items.reaching
    monkeypatch.setattr(blocks._Items, "reaching", lambda self, asked, *a: met.append(len(asked)) or reaching(self, asked, *a))
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    found = blocks._searched(
        pa.table({"query_id": np.arange(40), "k": k, "vector": lists(queries)}), pa.table({"item_id": np.arange(300), "vector": lists(items)})
    ).to_pylist()
    scores = np.round(queries @ items.T, 6)
    for q in range(40):
        want = sorted(range(300), key=lambda i: (-scores[q, i], i))[: k[q]]
        assert [r["item_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: (-r["score"], r["item_id"]))] == want
    assert sum(met) < 0.6 * 40 * 14
