"""The corpus pipeline against plain versions of its stages, and the registered names."""

from __future__ import annotations

import random

import __spark_entry__
import corpus_pipeline
from tests.llm.cases import prose
from tests.llm.test_dedup import cut_words, least_reachable, word_sets


def test_stages_follow_plain_versions(spark, tmp_path):
    rng = random.Random(11)
    items = [prose(rng, 40) for _ in range(5)]
    own = [prose(rng, rng.randint(30, 120)) for _ in range(80)]
    passage = prose(rng, 60)
    for i in range(0, 20):
        own[i] += " " + passage
    for i in range(20, 30):
        own[i] = own[30]
    own[40], own[41] = f"{own[40]} {items[0]}", f"{own[41]} {items[1]}"
    texts = [*own, None, "", "12 34 !!"]
    rows = [(i, t, "xx" if i % 2 else "yy", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
    sets = word_sets(kept)
    ids = sorted(kept)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = least_reachable(ids, links)
    kept = {i: t for i, t in kept.items() if label[i] == i}
    cut = cut_words(kept)
    kept = {i: (t if not cut[i][1] else cut[i][2]) for i, t in kept.items() if cut[i][2]}
    kept = {i: t for i, t in kept.items() if i not in (40, 41)}

    table = docs
    for name, build in corpus_pipeline.STAGES[:-1]:
        table = build(spark, table, str(tmp_path))
        assert table.columns == docs.columns, name
    found = {r.doc_id: r for r in table.collect()}
    assert {i: r.text for i, r in found.items()} == kept
    assert all(r.n_chars == len(r.text) for r in found.values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rng = random.Random(5)
    one, other, third = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, one), (2, other), (None, third), (None, third), (3, other + " end"), (4, None), (4, ""), (5, prose(rng, 3))]
    schema = "doc_id long, text string, kept string, spans string, n_words int, id long, score double, found string, _row string"
    docs = spark.createDataFrame([(*x, "k", "s", 7, 9, 0.5, "f", "r") for x in rows], schema).repartition(3)
    alone = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert alone.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in alone.collect()), key=repr)
    assert found == sorted({*rows} - {(3, other + " end")}, key=repr)
    cut = corpus_pipeline.without_repeats(spark, docs, "")
    assert cut.columns == docs.columns
    assert all(tuple(r)[2:] == ("k", "s", 7, 9, 0.5, "f", "r") for r in cut.collect())
    for build in (corpus_pipeline.one_of_each_group, corpus_pipeline.without_repeats):
        assert build(spark, docs.limit(0), "").collect() == []


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert set(__spark_entry__.oracle_sql()) <= set(names)
