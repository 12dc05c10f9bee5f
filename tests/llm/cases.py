"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, key string, found string, held string"
LATIN = "ba be bi bo bu da de di do du la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(LATIN, k=rng.randint(1, 4))) for _ in range(words))


def texts(seed: int = 0) -> list[str | None]:
    """Nulls, empty and blank texts, one word, repeats, near copies, shared passages, a very long text."""
    rng = random.Random(seed)
    passage, base = prose(rng, 40), prose(rng, 120).split()
    out: list[str | None] = [None, "", " \t\n ", "one", "One", "a b c d", "A b c d", "x" * 3000, "é" * 500, "ab " * 400]
    for _ in range(12):
        out.append(f"{prose(rng, rng.randint(5, 90))} {passage} {prose(rng, rng.randint(0, 90))}")
    for _ in range(12):
        copy = list(base)
        for place in rng.sample(range(len(copy)), rng.randint(0, 4)):
            copy[place] = prose(rng, 1)
        out.append(" ".join(copy))
    out += [" ".join(base).upper(), " ".join(base), " ".join(base)]
    out += [prose(rng, rng.randint(1, 60)) for _ in range(10)]
    out.append(" ".join(prose(rng, 500) for _ in range(8)) + " " + passage)
    out += ["Çà été 12 'il <|endoftext|> <s> ▁x", "中文文本没有空格", "a\x0bb\x0cc\x85d e f"]
    return out


def documents(spark, own: list[str | None] | None = None):
    """A table with columns that clash with names used inside the operators; some lang and source are null."""
    rows = []
    for i, text in enumerate(texts() if own is None else own):
        lang = ["xx", "yy", None][i % 3]
        rows.append((7 * i % 1009, text, lang, None if i % 5 == 0 else f"s{i % 4}", len(text or ""), i, "n", "k", "f", "h"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
