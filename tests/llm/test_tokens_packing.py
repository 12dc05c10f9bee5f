"""Token counts and packing against the tokenizers themselves."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillrec.llm import packing, tokens
from tests.llm.cases import collected, documents, empty, texts

P = pytest.importorskip("public_tokenizers")


def test_counts_are_the_models(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    odd = ["", " ", "  a  b ", "▁x ▁", "a\n\n  b \n", "\x00 a\tb\r\nc", " " * 3000, "é é 　 x\x1cy", None]
    docs = documents(spark, texts() + odd)
    found = {r.doc_id: r for r in tokens.count_tokens(docs, P.path("piece_bpe_32k.model"), 100).collect()}
    for row in docs.select("doc_id", "text").collect():
        n = len(model.encode(row.text or ""))
        got = found[row.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len((row.text or "").encode()), n, n > 100), row.text
    assert collected(tokens.count_tokens(empty(spark), P.path("piece_bpe_32k.model"), 100)) == []


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["<|endoftext|>x", "a<|b c|>", "É×÷ ÀÿŸ ßẞ", "a_b-c3 ١٢ x²", "l'été d'un it's", "a\x0bb\x0cc", "İI ΑΣ"]
    docs = documents(spark, texts() + odd)
    capacity = 50
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), capacity, end_id=1).collect()
    wanted = []
    for row in docs.select("doc_id", "text").collect():
        ids = [*model.encode(row.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted.append((row.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(wanted)
    places = defaultdict(list)
    for row in rows:
        places[row.sequence_id].append((row.offset, row.length))
    for own in places.values():
        own.sort()
        assert [x for x, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    assert collected(packing.pack(empty(spark), P.path("word_bpe_49k.json"))) == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(20):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        free: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [i for i, space in enumerate(free) if space >= length]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= length
            else:
                free.append(capacity - length)
        slots = packing.plan_slots(Counter(lengths), capacity)
        assert sum(s.count for s in slots) == len(lengths)
        used = {s.sequence + i // s.each for s in slots for i in range(s.count)}
        assert len(used) == len(free)
