"""Token counts without ids: count each distinct pre-token once, then sum over pre-token frequencies.

No piece of the model has a space after another character or holds a line feed, so no merge crosses the start of
a run of spaces or a line feed. Parts between those places are pre-tokens, and a text's count is the sum of theirs.
Groups of documents are counted in place: a group's new pre-tokens are counted once and joined to the frequencies of
its documents; a task remembers the pre-tokens of earlier groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
SPACE = "▁"  # how the model writes a space; in a text it means the same
GROUP_CHARS = 4_000_000
HELD = 400_000  # pre-tokens a task remembers
HELD_CHARS = 64


def pre_tokens(text: str) -> list[str]:
    """The text, with the space the model puts before it, cut where no merge can cross."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def _counter(model_path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        pieces: dict[str, int] = {}  # of each pre-token

        def join(frequencies: list[Counter[str]]) -> list[int]:
            """Tokens of each document of a group."""
            new = list({token for own in frequencies for token in own if token not in pieces})
            # The line feed keeps the model's own leading space apart: both are counted and taken off.
            counts = [len(x) - 2 for x in model.encode(["\n" + x for x in new], num_threads=1)]
            pieces.update(zip(new, counts, strict=True))
            sums = [sum(map(mul, map(pieces.__getitem__, own), own.values())) for own in frequencies]
            if len(pieces) > HELD:
                pieces.clear()
            for token in new:
                if len(token) > HELD_CHARS:
                    pieces.pop(token, None)
            return sums

        for batch in batches:
            sizes, sums, group, chars = [], [], [], 0
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                group.append(Counter(pre_tokens(text)))
                chars += len(text)
                if chars >= GROUP_CHARS:
                    sums += join(group)
                    group, chars = [], 0
            sums += join(group)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                    pa.array([n > limit for n in sums], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of `docs` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated or null ids are counted row by row;
    other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(_counter(model_path, limit), schema)
