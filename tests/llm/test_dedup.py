"""Near copies, repeated passages and repeated bytes against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillrec.llm import ngram_join, shards, substring, suffixes
from quillrec.llm.components import components
from tests.llm.cases import collected, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(rows):
    out = {}
    for key, text in rows.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        width = min(5, len(words))
        out[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    return out


def least_reachable(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def rows_of(docs):
    return {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}


def check_groups(docs):
    rows = rows_of(docs)
    sets = word_sets(rows)
    ids = sorted(rows)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = least_reachable(ids, links)
    found = {row.id: (row.n_shingles, row.component) for row in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates(spark):
    check_groups(documents(spark))


def test_near_duplicates_in_cut_blocks(spark, monkeypatch):
    """A group of near copies that is larger than a block, with borderline pairs, and strangers that share a passage."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(3)
    base, passage = prose(rng, 70).split(), prose(rng, 30)
    own = []
    for i in range(60):
        copy = list(base)
        for place in rng.sample(range(len(copy)), i % 5):
            copy[place] = prose(rng, 1)
        own.append(" ".join(copy))
    own += [f"{passage} {prose(rng, 8)}" for _ in range(30)]
    check_groups(documents(spark, own))


def test_near_duplicates_of_nothing(spark):
    assert collected(ngram_join.near_duplicates(empty(spark))) == []


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)], "doc_id long, text string")
    found = sorted(collected(ngram_join.near_duplicates(docs)))
    first = shards.FIRST_ID
    assert found == [(first, 2, first), (3, 2, first), (3, 2, first), (5, 0, 5)]


def test_count_tree_keeps_every_pair_in_reach():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, ngram_join.GROUPS))
    points[100:200] = np.maximum(0, points[:100] + rng.integers(-1, 2, (100, ngram_join.GROUPS)))
    sizes = points.sum(axis=1)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    i, j, bound = ngram_join.CountTree(points, sizes).pairs(75)
    found = dict(zip(zip(i.tolist(), j.tolist(), strict=True), bound.tolist(), strict=True))
    wanted = {}
    for a in range(300):
        for b in range(a + 1, 300):
            common = min(int(np.minimum(points[a], points[b]).sum()), int(sizes[a]))
            if 175 * common >= 75 * (sizes[a] + sizes[b]):
                wanted[a, b] = common
    assert found == wanted and wanted


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long").repartition(5)
    found = dict(collected(components(links)))
    assert found == {i: 1 for i in range(2, 61)} | {101: 100}


def cut_words(rows, window=13):
    first, words = {}, {k: WORD.findall(t or "") for k, t in rows.items()}
    for key, own in words.items():
        for i in range(len(own) - window + 1):
            run = tuple(own[i : i + window])
            first[run] = min(key, first.get(run, key))
    out = {}
    for key, own in words.items():
        gone = {
            i + j for i in range(len(own) - window + 1) if first[tuple(own[i : i + window])] < key for j in range(window)
        }
        out[key] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out


@pytest.mark.parametrize("window", [13, 8])
def test_substring_dedup(spark, window):
    docs = documents(spark)
    found = substring.dedup_substrings(docs, "doc_id", "found", window=window)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in found.collect()}
    assert got == cut_words(rows_of(docs), window)
    assert found.columns == ["doc_id", "found", "n_words", "kept", "spans"]


def test_substring_dedup_edges(spark):
    assert collected(substring.dedup_substrings(empty(spark), "doc_id")) == []
    run = " ".join("abcdefghijklm")
    docs = spark.createDataFrame([(None, run), (2, f"z {run}"), (2, f"z {run}"), (3, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.kept) for r in substring.dedup_substrings(docs, "doc_id").collect())
    assert found == [(0, run), (2, "z"), (2, "z"), (3, "")]


def cut_bytes(rows, length):
    seen, data = {}, {k: (t or "").encode() for k, t in rows.items()}
    for own in data.values():
        for i in range(len(own) - length + 1):
            seen[own[i : i + length]] = seen.get(own[i : i + length], 0) + 1
    out = {}
    for key, own in data.items():
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - length + 1):
            if seen[own[i : i + length]] > 1:
                gone[i : i + length] = True
        out[key] = (len(own), int(gone.sum()), np.frombuffer(own, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("length", [200, 100])
def test_suffix_dedup(spark, length):
    docs = documents(spark)
    found = suffixes.dedup_suffixes(docs, "doc_id", "held", length=length)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in found.collect()}
    assert got == cut_bytes(rows_of(docs), length)
    spans = [[(s.start, s.end) for s in r.spans] for r in found.collect()]
    assert all(a[1] < b[0] for own in spans for a, b in zip(own, own[1:], strict=False))


def test_suffix_dedup_edges(spark):
    assert collected(suffixes.dedup_suffixes(empty(spark), "doc_id")) == []
    docs = spark.createDataFrame([(None, "q" * 200), (1, "r" * 199), (2, "r" * 199), (3, "s" * 201)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in suffixes.dedup_suffixes(docs, "doc_id").collect()}
    assert got == {None: (200, 200), 1: (199, 199), 2: (199, 199), 3: (201, 0)}


def test_repeated_rows_take_from_each_other(spark):
    text = prose(random.Random(5), 80)
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [len(r.kept) for r in suffixes.dedup_suffixes(docs, "doc_id").collect()] == [0, 0]


def test_filters_hold_back_only_strangers(spark):
    docs = documents(spark)
    ids = docs.where("doc_id % 2 = 0").select(shards.id_key().alias("id"))
    left = shards.without(docs, ids)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id % 2)
