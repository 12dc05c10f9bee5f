"""Byte-level BPE against tiktoken; ranked search and hash trees against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillrec.llm import byte_bpe, lexical, merkle
from tests.llm.cases import collected, documents, empty, prose, texts

P = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_50k.tiktoken"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path(RANKS))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_decoding(spark, model):
    rng = random.Random(3)
    # Characters that are letters or numbers for one Unicode version only, long words, white space before words.
    odd = ["a࢏b \U00011de0\U00011de1 x", "-" * 999, "ab" * 400, "".join(rng.choices("abcdefgh", k=2000)), "  a\n\n \t b   ", "<|endoftext|>"]
    odd += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000)])) for _ in range(40)) for _ in range(50)]
    docs = documents(spark, texts() + odd)
    again = docs.unionByName(docs.where("doc_id % 2 = 0")).withColumn("bytes", F.lit("own"))
    encoded = byte_bpe.encode(again, P.path(RANKS), P.PATTERN, "doc_id", "n")
    assert encoded.columns == ["doc_id", "n", "ids"]
    rows = byte_bpe.decode(encoded, P.path(RANKS)).collect()
    text_of = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in again.select("doc_id").collect())
    for row in rows:
        text = text_of[row.doc_id] or ""
        assert row.ids == model.encode_ordinary(text), text
        assert bytes(row.bytes) == text.encode()
    assert collected(byte_bpe.encode(empty(spark), P.path(RANKS), P.PATTERN, "doc_id")) == []


def test_decoding_of_other_lists(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [0, 60000], "z"), (4, [64, None], "z"), (5, [64, 65], "")], "k int, ids array<int>, bytes string")
    ranks = {v: k for k, v in byte_bpe.read_ranks(P.path(RANKS)).items()}
    found = {r.k: r.bytes for r in byte_bpe.decode(rows, P.path(RANKS)).collect()}
    assert found == {1: b"", 2: b"", 3: None, 4: None, 5: ranks[64] + ranks[65]}


def test_merges_taken_together_are_those_taken_one_by_one():
    """A small rank file in which a merge opens a lower one: long words must still go leftmost first."""
    rng = random.Random(5)
    tokens = [bytes([x]) for x in b"abc"] + [b"".join(rng.choices([b"a", b"b", b"c"], k=rng.randint(2, 5))) for _ in range(60)]
    ranks = {x: i for i, x in enumerate(dict.fromkeys(tokens))}
    book = byte_bpe.Encoder(ranks)
    assert len(set(book.db.sql("SELECT everywhere, apart FROM merges").fetchall())) == 4
    words = [bytes(rng.choices(b"abc", k=rng.choice([3, 20, 64, 65, 200]))) for _ in range(150)] + [b"a" * 70, b"ab" * 50]

    def plain(word: bytes) -> list[int]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while word not in ranks:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[word]] if word in ranks else [ranks[x] for x in parts]

    for word, code in zip(words, book.encode(words), strict=True):
        assert [int.from_bytes(code[i : i + 4], "little") for i in range(0, len(code), 4)] == plain(word), word


def ranked_plainly(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    own = [(doc, counts) for doc, counts in own if counts]
    total, count = sum(sum(c.values()) for _, c in own), len(own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in own:
            n = sum(counts.values())
            norm, score = 100 - 25 + (25 * n * count) // total, 0
            for term in terms(text):
                if counts[term]:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                    score += weight * ((1000000000 * counts[term]) // (1000 * counts[term] + 12 * norm))
            if score > 0:
                scored.append((-score, -1 if doc is None else doc, doc))
        scored.sort(key=lambda x: x[:2])
        out += [(item, i, doc, -score) for i, (score, _, doc) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1 << 23, 1 << 12])
def test_ranked_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(lexical, "BLOCK_BITS", blocks)
    monkeypatch.setattr(lexical, "PASS_ITEMS", 3)
    rng = random.Random(11)
    own = texts() + [" ".join(prose(rng, rng.randint(1, 40)) for _ in range(2)) + " zu zu zu zu zu" for _ in range(60)]
    rows = [(None if i == 20 else i // 2 if i in (30, 31) else i, x) for i, x in enumerate(own)]
    items = [(1, prose(rng, 12)), (2, "zu ba ba nothing"), (3, None), (4, ""), (5, own[15]), (5, own[15]), (None, "ÉTÉ Été 12"), (7, "unheard")]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, rank string").repartition(2)
    found = lexical.rank_documents(docs, asked, 5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(collected(found), key=repr) == ranked_plainly(rows, items, 5)
    for a, b in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.where("text = ''"), asked)):
        assert collected(lexical.rank_documents(a, b, 5)) == []


def test_no_score_is_above_its_bound():
    rng = random.Random(4)
    own = [prose(rng, rng.randint(1, 300)) + " ba" * rng.randint(0, 70) for _ in range(40)]
    terms = {x.encode(): i for i, x in enumerate(dict.fromkeys(" ".join(own).split()))}
    stats = lexical.Statistics(len(own), sum(len(x.split()) for x in own))
    queries = lexical.Queries([0], terms, [7] * len(terms), [{i: 2 for i in range(0, len(terms), 3)}])
    bounds = lexical.Bounds(queries, stats)
    for text in own:
        hashes = lexical.hashed_words([text.encode()])[0]
        bits, _, _, _, sizes, slices = lexical._block(1 << 14, [(1, len(hashes), lexical.entries_of(hashes))])
        counts, norm = Counter(terms[x.encode()] for x in text.split()), lexical.norms(len(hashes), stats)
        score = sum(14 * lexical.least_score(n, norm) for i, n in counts.items() if i % 3 == 0)
        bound = bounds.of(bits, lexical.np.frombuffer(sizes, "i8"), slices)[0, 0]
        assert score <= bound <= 2 * score + 14 * 5 * 1_000_000


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree_plainly(leaves: list[str], arity: int) -> tuple[str, list[list[str]], list[list[int]]]:
    """Top, siblings of each leaf level by level, and how many of them stand to the left."""
    proofs, left, level, at = [[] for _ in leaves], [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for own, sides, place in zip(proofs, left, at, strict=True):
            run, slot = runs[place // arity], place % arity
            own.append([x for i, x in enumerate(run) if i != slot])
            sides.append(slot)
        level, at = [sha("".join(x)) for x in runs], [x // arity for x in at]
    return level[0], proofs, left


@pytest.mark.parametrize(("arity", "rows", "langs"), [(2, 300, 3), (3, 100, 5), (5, 40, 1), (2, 1, 1), (2, 9, 9)])
def test_manifest(spark, arity, rows, langs):
    rng = random.Random(rows)
    names = [None, "", "é", "z", "aa", "ab", "a", "b", "c"][:langs]
    # A third of the rows in one group, repeated and null ids, equal rows, long and null texts.
    data = [(None if i % 17 == 5 else i // 2 if i % 11 == 0 else i, rng.choice([names[0], *names]), None if i % 7 == 0 else "x" * (i % 5) * 500, i % 3) for i in range(rows)]
    data += data[:1] * (rows > 1)
    docs = spark.createDataFrame([(*x, "own") for x in data], "doc_id long, lang string, text string, n long, _idx string").repartition(3)
    leaf = merkle.digest_of([F.col("doc_id"), F.col("lang"), F.col("text"), F.col("n")])
    now = merkle.digest_of([F.col("doc_id"), F.col("lang"), F.col("text"), F.col("n") + F.when(F.col("n") == 2, 1).otherwise(0)])
    found = merkle.verified_rows(docs, "lang", "doc_id", leaf, now, arity)
    groups: dict = {}
    for doc, lang, text, n in data:
        digests = (sha("".join(map(field, (doc, lang, text, n)))), sha("".join(map(field, (doc, lang, text, n + (n == 2))))))
        groups.setdefault(lang, []).append((-1 if doc is None else doc, *digests, doc))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree_plainly([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in order]
    root, upper, upper_left = tree_plainly([x[0] for x in trees], arity)
    wanted = []
    for g, (top, proofs, left), above, above_left in zip(order, trees, upper, upper_left, strict=True):
        for (_, old, new, doc), proof, sides in zip(sorted(groups[g], key=lambda x: x[:2]), proofs, left, strict=True):
            digest = new
            for run, slot in zip(proof + above, sides + above_left, strict=True):
                digest = sha("".join(run[:slot]) + digest + "".join(run[slot:]))
            text = "".join(x for run in proof + above for x in run)
            wanted.append((doc, old, top, root, sha(text), digest, digest == root))
            assert (old == new) == (digest == root)
    assert sorted(collected(found), key=repr) == sorted(wanted, key=repr)


def test_manifest_of_nothing(spark):
    leaf = merkle.digest_of([F.col("doc_id")])
    assert collected(merkle.verified_rows(empty(spark), "lang", "doc_id", leaf, leaf)) == []
