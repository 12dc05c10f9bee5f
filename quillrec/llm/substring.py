"""Exact substring dedup over words with fixed-block anchors.

Non-overlapping blocks of every document are the index; every rolling window of the same width probes it. Any run of
`window` words holds a whole block of `(window + 1) // 2` words at a multiple of its width, so a run that repeats
always has a hit. Windows around hits, on both sides, are then compared whole; overlapping ones merge to maximal runs.

Entries travel as packed arrays to the shard of their hash. A hash's occurrences meet as fixed-width numbers (12
bytes each); what is made from them is one entry an occurrence, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillrec.llm.shards import (
    PACKED,
    SHARDS_PER_PART,
    by_owner,
    deltas,
    filter_bits,
    gathered,
    groups,
    id_key,
    may_hold,
    packed,
    parts_for,
    runs_of,
    scattered,
    to_owners,
)
from quillrec.llm.words import hashed_words, run_hashes, split_words, with_words

GROUP_WORDS = 300_000  # words whose windows a task holds before it hands them on
BYTES_PER_PART = 8_000_000
KEY_BITS = np.uint64(31)
LAST_ID = np.int64((1 << 63) - 1)


def anchor_keys(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a block hash, and the 31 bits that tell blocks of a shard apart; what collides is compared later."""
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), hashes & np.uint64((1 << 31) - 1)


def _probes(block: int, shards: int):
    """Rolling blocks of each text, marked where they are index blocks."""

    def emit(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        hashes = np.concatenate([x for _, x in held] or [np.empty(0, np.uint64)])
        ids = np.repeat(np.array([x for x, _ in held], np.int64), [len(x) for _, x in held])
        marks = np.concatenate([(np.arange(len(x)) % block == 0) for _, x in held] or [np.empty(0, bool)])
        shard, keys = anchor_keys(hashes, shards)
        entries = (keys << np.uint64(1) | marks.astype(np.uint64)).astype("<u4")
        rows = [(s, e.tobytes(), deltas(d)) for s, (e, d) in scattered(shard, entries, ids)]
        return packed(rows)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, words in with_words(batch, 1):
                hashes = run_hashes(words, block)
                if len(hashes):
                    held.append((row[0], hashes))
                    size += len(hashes)
                if size >= GROUP_WORDS:
                    yield emit(held)
                    held, size = [], 0
        yield emit(held)

    return probe


def _hits(shards: int):
    """Blocks that are an index block of a smaller document, and index blocks that a greater document probes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield to_owners(*_hit_blocks(batches), shards)

    return find


def _hit_blocks(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    shard, entries, ids = gathered(batches, "<u4")
    keys, marked = shard << KEY_BITS | entries >> np.uint64(1), (entries & np.uint64(1)).astype(bool)
    order, first, group = groups(keys)
    if len(keys):
        keys, marked, ids = keys[order], marked[order], ids[order]
        smallest = np.minimum.reduceat(np.where(marked, ids, LAST_ID), first)[group]
        greatest = np.maximum.reduceat(ids, first)[group]
        hit = (ids > smallest) | (marked & (ids < greatest))
        keys, ids = keys[hit], ids[hit]
    return ids, keys


def _candidates(window: int, block: int, shards: int):
    """Whole windows around the hits of each text."""

    def emit(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        hashes = np.concatenate([x for _, x in held] or [np.empty(0, np.uint64)])
        ids = np.repeat(np.array([x for x, _ in held], np.int64), [len(x) for _, x in held])
        shard = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        rows = [(s, h.astype("<u8").tobytes(), deltas(d)) for s, (h, d) in scattered(shard, hashes, ids)]
        return packed(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for (key, _, found), words in with_words(batch, 1):
                blocks, windows = run_hashes(words, block), run_hashes(words, window)
                if not len(windows):
                    continue
                shard, rest = anchor_keys(blocks, shards)
                keys = shard.astype(np.uint64) << KEY_BITS | rest
                hit = np.isin(keys, np.frombuffer(found, "<u8"))
                near = np.cumsum(np.concatenate([[0], hit]))
                at = np.arange(len(windows))
                windows = windows[near[at + window - block + 1] > near[at]]
                if len(windows):
                    held.append((key, windows))
                    size += len(windows)
                if size >= GROUP_WORDS:
                    yield emit(held)
                    held, size = [], 0
        yield emit(held)

    return find


def _repeats(shards: int):
    """Windows that also start in a smaller document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield to_owners(*_repeated(batches), shards)

    return find


def _repeated(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    _, hashes, ids = gathered(batches, "<u8")
    order, first, group = groups(hashes)
    if len(hashes):
        hashes, ids = hashes[order], ids[order]
        again = ids > np.minimum.reduceat(ids, first)[group]
        hashes, ids = hashes[again], ids[again]
        kept = np.ones(len(ids), bool)
        kept[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
        hashes, ids = hashes[kept], ids[kept]
    return ids, hashes


def _finish(window: int, names: list[str], carried: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, starts, ends = [], [], [], []
            found = batch.column(carried + 1).to_pylist() if batch.num_columns > carried + 1 else None
            for i, data in enumerate(batch.column(carried).to_pylist()):
                words = split_words(data or b"")
                spans = np.empty((0, 2), int)
                if found is not None and found[i]:
                    hashes = run_hashes(hashed_words([data])[0], window)
                    again = np.isin(hashes, np.frombuffer(found[i], "<u8"))
                    steps = np.zeros(len(words) + 1, int)
                    at = np.flatnonzero(again)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    spans = runs_of(np.cumsum(steps[:-1]) > 0)
                sizes.append(len(words))
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
                for a, b in spans[::-1].tolist():
                    del words[a:b]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:carried], pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()),
                    pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                ],
                names,
            )

    return finish


def repeated_windows(docs: DataFrame, window: int, block: int) -> DataFrame:
    """(id, found): for each document the hashes of its windows that also start in a smaller one, staged."""
    parts = parts_for(docs, BYTES_PER_PART)
    shards = SHARDS_PER_PART * parts
    rows = docs.select(id_key().alias("id"), F.col("text").cast("binary").alias("text"))
    probes = rows.mapInArrow(_probes(block, shards), PACKED).repartition(parts, "shard")
    hits = by_owner(probes.mapInArrow(_hits(shards), PACKED), parts)
    wanted = rows.where(may_hold(docs.sparkSession, filter_bits(hits, docs.count()), F.col("id")))
    windows = wanted.join(hits, "id").mapInArrow(_candidates(window, block, shards), PACKED)
    return by_owner(windows.repartition(parts, "shard").mapInArrow(_repeats(shards), PACKED), parts)


def dedup_substrings(docs: DataFrame, *keep: str, window: int = 13) -> DataFrame:
    """Remove each word covered by a run of `window` words that also starts in a document of smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+`; runs are judged on the input. Returns the columns `keep` of `docs` (doc_id,
    text, ...) with n_words, kept (the words left, joined by one space) and the maximal removed runs as spans,
    array<struct<start, end>> in words. Null and empty texts have no words; a null doc_id is below all others; rows
    of one doc_id never take from each other; an empty table gives none. Names of carried columns cannot clash.
    """
    block = (window + 1) // 2
    found = repeated_windows(docs, window, block)
    held = may_hold(docs.sparkSession, filter_bits(found, docs.count()), id_key())
    carried = [f"k{i}" for i in range(len(keep))]
    marked = docs.select(
        *[F.col(x).alias(k) for x, k in zip(keep, carried, strict=True)],
        F.col("text").cast("binary").alias("data"), id_key().alias("id"), held.alias("held"),
    )
    schema = marked.select(*carried).schema
    for field in StructType.fromDDL("n_words long, kept binary, starts array<long>, ends array<long>").fields:
        schema = schema.add(field)
    finish = _finish(window, schema.names, len(carried))
    clean = marked.where(~F.col("held")).select(*carried, "data").mapInArrow(finish, schema)
    cut = marked.where("held").join(found, "id", "left").select(*carried, "data", "found").mapInArrow(finish, schema)
    spans = F.transform(
        F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"))
    )
    names = [F.col(k).alias(x) for x, k in zip(keep, carried, strict=True)]
    kept = F.col("kept").cast("string").alias("kept")
    return clean.unionByName(cut).select(*names, "n_words", kept, spans.alias("spans"))
