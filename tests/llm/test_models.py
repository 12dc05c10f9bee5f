"""Fingerprints, languages, quality, URLs and leaks."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrec.llm import decontaminate, fingerprint, language, quality, urls
from tests.llm.cases import collected, documents, empty, prose


def test_fingerprints_of_next_and_edited(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    docs = documents(spark)
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    found = {r.doc_id: r for r in fingerprint.compare_with_next(docs).collect()}
    assert len(found) == len(rows)
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        got = found[key]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint == fingerprint.fingerprint(text)
        assert got.edited_fingerprint == fingerprint.fingerprint(edited)
        assert 0 <= got.near_next <= 1 and (edited != text or got.near_edited == 1)


def test_fingerprints_of_little(spark):
    assert collected(fingerprint.compare_with_next(empty(spark))) == []
    one = spark.createDataFrame([(None, "abc def")], "doc_id long, text string")
    row = fingerprint.compare_with_next(one).first()
    assert row.near_next == 1 and row.doc_id is None
    tied = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    assert fingerprint.compare_with_next(tied).count() == 3


def test_likeness_falls_with_edits():
    rng = random.Random(1)
    words = prose(rng, 300).split()
    near = [*words[:270], *prose(rng, 30).split()]
    far = "".join(rng.choices("qwxyzkvj ", k=1500))
    own, close, other = (fingerprint.codes(t.encode(), fingerprint._tables()) for t in (" ".join(words), " ".join(near), far))
    assert 1 > fingerprint.likeness(own, close) > fingerprint.likeness(own, other) >= 0


ALPHABETS = {"xx": "abcdefg", "yy": "hijklmn", "zz": "òéàüßñç"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = list(ALPHABETS)[i % 3]
        text = " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(5, 150)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_held_out(spark, labelled):
    network = language.fit(labelled.where("doc_id % 5 <> 0"), per_language=60, steps=120)
    found = language.predict(labelled.where("doc_id % 5 = 0"), network, "doc_id", "lang").collect()
    right = [r.lang == r.lang_pred for r in found]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (3, "12 34 !"), (4, "abc " * 9000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in language.predict(odd, network, "doc_id").collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "xx")]
    assert [r.doc_id for r in language.accepted(odd, network, 0.3).collect()] == [4]
    assert collected(language.predict(empty(spark), network, "doc_id")) == []


def test_nothing_to_learn_from(spark):
    network = language.fit(empty(spark))
    assert {r.lang_pred for r in language.predict(documents(spark), network, "doc_id").collect()} == {"und"}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = language.ByteNetwork.fresh(["a", "b"], rng)
    for i, x in enumerate(network.filters):
        network.filters[i] = x.astype(np.float64)
    network.embedding, network.weights = network.embedding.astype(np.float64), network.weights.astype(np.float64)
    windows, labels = rng.integers(0, 256, (3, 40)).astype(np.uint8), np.array([0, 1, 0])

    def loss() -> float:
        return -np.log(network.probabilities(windows)[np.arange(3), labels]).mean()

    grads = network.gradients(windows, labels)
    for parameter, grad in zip(network.parameters(), grads, strict=True):
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        step, kept = 1e-4, parameter[place]
        parameter[place] = kept + step
        up = loss()
        parameter[place] = kept - step
        down = loss()
        parameter[place] = kept
        assert abs((up - down) / (2 * step) - grad[place]) < 2e-2 * max(1, abs(grad[place]))


def test_quality_finds_marked_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic, junk = i % 7 == 0, i % 5 == 0
        text = prose(rng, 60) + (" vilest vermin" if toxic else "") + (" ###$$$" * 30 if junk else "")
        rows.append((i, text, f"h{i % 3}", None if i % 2 else "p"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(400, None, None, None), (401, "", "h1", "p"), (None, prose(rng, 20), "h0", "p"), (3, rows[3][1], "h0", None)]
    labels += [(0, 1, 1), (None, 1, 1), (999, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, good string")
    marks = spark.createDataFrame(labels, "doc_id long, good int, toxic int")
    found = quality.classify(docs, marks.where("doc_id % 4 <> 1"), F.col("host"), F.col("good"))
    got = [r for r in found.collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 1]
    assert found.count() == len(rows)
    assert all((r.p_toxic > 0.5) == (r.doc_id % 7 == 0) for r in got)
    assert all((r.p_good < 0.5) == (r.doc_id % 5 == 0) for r in got)
    none = quality.classify(docs, marks.limit(0), F.col("host"), F.col("good")).collect()
    assert {round(r.p_good, 6) for r in none} == {0.5}
    assert collected(quality.classify(empty(spark), marks, F.col("source"), F.col("lang"))) == []


def test_site_rates_shrink_sparse_sites(spark):
    sites = spark.createDataFrame(
        [("a", "a/x", 1000, 900), ("a", "a/y", 1, 0), ("b", "b/x", 1000, 100), ("c", "c/x", 0, 0)],
        "host string, site string, n long, good long",
    )
    rate = {r.site: r.rate for r in quality.site_rates(sites, "good").collect()}
    assert rate["a/x"] > 0.85 and rate["b/x"] < 0.15
    assert 0.3 < rate["a/y"] < 0.9 and 0.3 < rate["c/x"] < 0.7


RULES = [
    urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"),
]


def test_url_rules_and_reputation(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y"), (2, "https://example.net/de"), (3, "http://www.example.com/de/1#t"),
        (4, "http://xexample.com/de/"), (5, "http://q.org/fr/"), (6, None), (7, "no scheme"), (8, "http://net"),
        (9, "http://a.co.uk:80/x"), (10, "ftp://bad.org/1"), (10, "ftp://bad.org/1"), (None, "http://É.org?x/fr/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    extra = [(100 + i, "http://bad.org/x") for i in range(200)] + [(400 + i, "http://good.org/x") for i in range(200)]
    pages = pages.union(spark.createDataFrame([(*r, "h", "v") for r in extra], pages.schema))
    marks = spark.createDataFrame([(i, int(i < 300)) for i, _ in extra] + [(None, 1), (10, 0), (10, 1)], "page_id long, bad int")
    found = urls.filter_urls(pages, marks, RULES).collect()
    assert len(found) == len(rows) + len(extra)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de", "net/", "block")
    assert got[3] == ("www.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("xexample.com", "/de/", None, "allow")
    assert got[5] == ("q.org", "/fr/", "org/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("net", "", None, "allow")
    assert got[9][0] == "a.co.uk:80" and got[None][:2] == ("É.org", "")
    assert got[10] == ("bad.org", "/1", None, "block")
    assert got[400][3] == "allow"
    assert collected(urls.filter_urls(pages.limit(0), marks, RULES)) == []


def test_suffixes_and_domains(spark):
    hosts = [("a.b.co.uk", "co.uk", "b.co.uk"), ("x.example.org", "org", "example.org"), ("org", "org", "org"), ("", "", "")]
    rows = spark.createDataFrame([(h,) for h, _, _ in hosts], "host string")
    found = rows.select("host", urls.suffix_of(F.col("host")), urls.domain_of(F.col("host"))).collect()
    assert sorted(map(tuple, found)) == sorted(hosts)


def test_leaks_whole_and_paraphrased(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randint(15, 60)) for _ in range(30)]
    own = [prose(rng, rng.randint(100, 400)) for _ in range(200)]
    wanted = set()
    for i in range(0, 40):
        words = items[i % 30].split()
        if i >= 20:
            for place in rng.sample(range(len(words)), len(words) // 8):
                words[place] = prose(rng, 1)
        own[i] = f"{prose(rng, 50)} {' '.join(words).upper() if i % 3 else ' '.join(words) + '.'} {prose(rng, 70)}"
        wanted.add((7 * i % 1009, i % 30))
    for i in range(40, 60):
        own[i] += " " + " ".join(items[i % 30].split()[:5])
    docs = documents(spark, [*own, None, "", "one"])
    bench = spark.createDataFrame(
        [(i, t, "c") for i, t in enumerate(items)] + [(98, None, "c"), (99, "", "c"), (97, "too short", "c")],
        "item_id long, text string, doc_id string",
    )
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    assert collected(decontaminate.find_leaks(empty(spark), bench)) == []
    assert collected(decontaminate.find_leaks(docs, bench.limit(0))) == []


def test_lcs_with_bits():
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.randint(1, 6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.lcs(decontaminate.lcs_masks(np.array(a)), len(a), b) == row[-1]


def leaks_of_all_windows(items: list[str], texts: list[str]) -> set[tuple[int, int]]:
    """Pairs of a text and an item that the subsequence alone accepts, whatever the cosine."""
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in decontaminate.tokens(x.encode()) if w] for x in items]
    sizes = decontaminate.spans_of([len(x) for x in coded])
    found = set()
    for d, text in enumerate(texts):
        codes = [vocabulary.get(w, 0) for w in decontaminate.tokens(text.encode())]
        for i, item in enumerate(coded):
            size = next(x for x in sizes if x >= len(item))
            tail = item[-max(4, len(item) // 4) :]
            masks, tail_masks = (decontaminate.lcs_masks(np.array(x)) for x in (item, tail))
            for start in range(0, max(0, len(codes) - size) + size // 4, size // 4):
                region = codes[max(0, start - size // 2) : min(start + size, len(codes)) + size // 2]
                common = decontaminate.lcs(masks, len(item), region) / len(item)
                answer = decontaminate.lcs(tail_masks, len(tail), region) / len(tail)
                if common >= decontaminate.STRONG or (common >= decontaminate.WEAK and answer >= decontaminate.ANSWER):
                    found.add((d, i))
    return found


def test_paraphrases_in_mixed_windows(spark):
    rng = random.Random(2)
    items = [prose(rng, rng.randint(8, 30)) for _ in range(30)]
    pool = " ".join(items).split()
    texts = [prose(rng, rng.randint(100, 300)) for _ in range(400)]
    for i in range(90):
        words = items[i % 30].split()
        for place in rng.sample(range(len(words) - max(4, len(words) // 4)), int(len(words) * 0.38)):
            words[place] = rng.choice(pool)
        before, after = (" ".join(rng.choices(pool, k=rng.randint(5, 60))) for _ in range(2))
        texts.append(f"{before} {' '.join(words)} {after}")
    wanted = leaks_of_all_windows(items, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(wanted) == 90 and found <= wanted
    assert len(found) >= 0.95 * len(wanted), len(found)


def test_leaks_that_stand_nearly_everywhere(spark):
    rng = random.Random(12)
    items = [prose(rng, rng.randint(8, 40)) for _ in range(6)]
    texts = []
    for i in range(90):
        words = items[i % 3].split()
        for place in rng.sample(range(len(words)), i % 4):
            words[place] = prose(rng, 1)
        texts.append(f"{prose(rng, rng.randint(0, 30))} {' '.join(words)} {prose(rng, rng.randint(0, 30))}")
    texts[4] += " " + items[4]
    wanted = leaks_of_all_windows(items, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(wanted) > 80 and (4, 4) in wanted and found == wanted


def test_short_items_as_whole_runs(spark):
    texts = ["x Red - green, BLUE y", "red green", "blue red", "y green blue red green blue", None, "red green", "alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = [(0, "red green blue"), (1, "Red, green: blue!"), (2, "alone"), (3, "- !"), (4, "y green blue red green blue more")]
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id, r.common, r.start, r.end) for r in found}
    assert len(found) == len(got)
    assert got == {(0, 0, 1.0, 1, 5), (0, 1, 1.0, 1, 5), (3, 0, 1.0, 3, 6), (3, 1, 1.0, 3, 6), (6, 2, 1.0, 0, 1)}


def test_more_languages_than_a_batch(monkeypatch):
    rng = random.Random(3)
    names = [f"l{i:03}" for i in range(70)]
    seen = set()

    def gradients(self, windows, wanted):
        seen.update(wanted.tolist())
        return [np.zeros_like(p) for p in self.parameters()]

    monkeypatch.setattr(language.ByteNetwork, "gradients", gradients)
    language.train([[prose(rng, 20).encode()] for _ in names], names, steps=2)
    assert seen == set(range(70))


def test_long_texts_are_sampled_in_windows(spark):
    rows = [(1, "ab " * 500_000, "xx"), (2, "short one", "yy"), (3, "é" * 3000, "yy")]
    texts, labels = language.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5)
    assert sum(len(part) for parts in texts for part in parts) <= 3 * language.WINDOWS_PER_TEXT * language.WINDOW
    assert [b"short one"] in texts and set(labels) == {"xx", "yy"} and len(labels) == len(texts)


def test_signatures_never_miss_words_in_common():
    draw = np.random.RandomState(5)
    for terms in (300, 3 * decontaminate.SLOTS):  # without and with words that share a slot
        texts = [draw.choice(np.arange(2, terms), 20, replace=False) for _ in range(7)]
        words, others = draw.choice(np.concatenate(texts), 5000), draw.randint(0, terms, 5000)
        codes = np.where(draw.rand(5000) < 0.3, words, others).astype(np.int32)
        low = draw.randint(0, 4900, 3000)
        high = low + draw.randint(1, 100, 3000)
        items = np.sort(draw.randint(0, 7, 3000))
        common = np.array([len(set(codes[a:b]) & set(texts[i])) for a, b, i in zip(low, high, items, strict=True)])
        slots = [x % decontaminate.SLOTS for x in texts]
        found = decontaminate.may_hold_words(codes, low, high, items, slots, np.full(7, 3.0))
        assert found[common >= 3].all() and (common >= 3).any()
        assert terms > decontaminate.SLOTS or (found == (common >= 3)).all()
    none = np.empty(0, np.int64)
    assert len(decontaminate.may_hold_words(codes, none, none, none, slots, np.full(7, 3.0))) == 0
