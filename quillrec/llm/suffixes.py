"""Repeated byte strings by depth-limited radix sorting of suffixes.

Every suffix is ordered through its first `length` bytes only; suffixes that stay together are repeated strings. To
spread the sort, a string's shard is the least hash of its `anchor`-byte parts: equal strings have equal shards, and
neighbouring starts mostly share one, so they travel together as one stretch of text. Stretches whose anchor occurs
only once in the table cannot hold a repeat and are not sent. Equal stretches of a group of documents travel once.
In a task, starts are sorted by most-significant-digit passes of eight bytes; only groups that are still together
go on, and only groups whose digits differ are sorted.
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
    undeltas,
)
from quillrec.llm.words import BASE, mixed

ANCHOR = 32
GROUP_BYTES = 1_000_000
ROWS_AT_ONCE = 4096
BYTES_PER_PART = 8_000_000
STRETCHES = "shard int, anchor long, text binary, ids binary, starts binary"


def anchors(data: np.ndarray, anchor: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `anchor`-byte part, and for each start the least of the next `places` hashes."""
    n = len(data) - anchor - places + 2
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    hashes, width, power = data.astype(np.uint64), 1, int(BASE)
    while width < anchor:  # anchor is a power of two
        hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
        width, power = 2 * width, power * power % (1 << 64)
    hashes = mixed(hashes)
    least, width = hashes, 1
    while 2 * width <= places:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return hashes, np.minimum(least[:n], least[places - width : places - width + n])


class Stretches:
    """Maximal runs of starts with one anchor, of a group of documents laid end to end."""

    def __init__(self, held: list[tuple[int, bytes]], length: int, anchor: int) -> None:
        sizes = np.array([len(x) for _, x in held], np.int64)
        self.data = b"".join(x for _, x in held)
        self.base = np.cumsum(sizes) - sizes  # where each document begins
        places = length - anchor + 1
        hashes, least = anchors(np.frombuffer(self.data, np.uint8), anchor, places)
        own = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        inside = np.arange(len(least)) + length <= (self.base + sizes)[own]
        change = np.ones(len(least) + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:]
        usable = inside[first]
        self.first, self.last = first[usable], last[usable]
        self.document = own[self.first]
        self.ids = np.array([x for x, _ in held], np.int64)[self.document]
        wanted = least[self.first]
        self.anchor = wanted >> np.uint64(1)
        self.twice = np.zeros(len(wanted), bool)  # whether the anchor stands at two places of the stretch
        if len(wanted):
            around = np.lib.stride_tricks.sliding_window_view(hashes, places)
            for at in range(0, len(wanted), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                head = around[self.first[part]] == wanted[part, None]
                tail = around[self.last[part] - 1] == wanted[part, None]
                moved = self.first[part] + head.argmax(1) != self.last[part] - 1 + tail.argmax(1)
                self.twice[part] = moved | (head.sum(1) > 1) | (tail.sum(1) > 1)


def _grouped(batches: Iterator[pa.RecordBatch], columns: int):
    """Documents in groups of about GROUP_BYTES, as lists of rows."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[1]:
                held.append(row)
                size += len(row[1])
            if size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    yield held


def _anchors(length: int, anchor: int, shards: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, 2):
            found = Stretches(held, length, anchor)
            entries = found.anchor << np.uint64(1) | found.twice.astype(np.uint64)
            shard = (found.anchor % np.uint64(shards)).astype(np.int32)
            rows = [(s, e.astype("<u8").tobytes(), deltas(d)) for s, (e, d) in scattered(shard, entries, found.ids)]
            yield packed(rows)

    return find


def _repeated_anchors(shards: int):
    """Anchors that stand at more than one place, by document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield to_owners(*_standing_twice(batches), shards)

    return find


def _standing_twice(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    _, entries, ids = gathered(batches, "<u8")
    keys, twice = entries >> np.uint64(1), entries & np.uint64(1)
    order, first, group = groups(keys)
    if len(keys):
        keys, ids = keys[order], ids[order]
        weight = np.add.reduceat(1 + twice[order].astype(np.int64), first)
        again = (weight > 1)[group]
        keys, ids = keys[again], ids[again]
    return ids, keys


def _stretches(length: int, anchor: int, shards: int):
    """Stretches with repeated anchors; equal ones of a group as one row with all their places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, 3):
            found = Stretches([x[:2] for x in held], length, anchor)
            wanted = np.zeros(len(found.first), bool)
            edges = np.searchsorted(found.document, np.arange(len(held) + 1))
            for i, row in enumerate(held):
                a, b = edges[i], edges[i + 1]
                wanted[a:b] = np.isin(found.anchor[a:b], np.frombuffer(row[2], "<u8"))
            places: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(wanted).tolist():
                text = found.data[found.first[k] : found.last[k] + length - 1]
                places.setdefault(text, []).append(k)
            rows = [[], [], [], [], []]
            for text, own in places.items():
                key = int(found.anchor[own[0]])
                starts = found.first[own] - found.base[found.document[own]]
                values = (key % shards, key, text, deltas(found.ids[own]), starts.astype("<i8").tobytes())
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)],
                ["shard", "anchor", "text", "ids", "starts"],
            )

    return send


def together(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of `starts` share their next `length` bytes with another start of the same group.

    `group` is in ascending order. `data` reaches `length` bytes beyond every start, and seven more.
    """
    digits = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    kept = np.arange(len(starts))
    at, group = starts, group.astype(np.int64)
    for done in range(0, length, 8):
        # A last digit that would reach too far begins earlier; its first bytes are equal anyway.
        digit = digits[at + min(done, max(0, length - 8))].astype(np.uint64)
        if length < 8:
            digit >>= np.uint64(8 * (8 - length))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, int)
        if not len(first):
            break
        sizes = np.diff(np.append(first, len(group)))
        mixed_groups = np.minimum.reduceat(digit, first) != np.maximum.reduceat(digit, first)
        if mixed_groups.any():
            apart = np.flatnonzero(np.repeat(mixed_groups, sizes))
            order = apart[np.lexsort((digit[apart], group[apart]))]
            kept[apart], at[apart], digit[apart] = kept[order], at[order], digit[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        if alone.any():
            kept, at, group = kept[~alone], at[~alone], group[~alone]
    out = np.zeros(len(starts), bool)
    out[kept] = True
    return out


def _sorted(length: int, shards: int):
    """Covered places of every document from the stretches of a shard."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
        keys: dict[bytes, int] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            for key, text, ids, starts in zip(*columns, strict=True):
                texts.setdefault(text, []).append((undeltas(ids), np.frombuffer(starts, "<i8")))
                keys[text] = key
        found = sorted(texts, key=keys.__getitem__)
        anchor_of = np.array([keys[x] for x in found], np.int64)
        sizes = np.array([len(x) for x in found], np.int64)
        base = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(found) + b"\0" * 8, np.uint8)
        counts = sizes - length + 1
        own = np.repeat(np.arange(len(found)), counts)
        begins = np.cumsum(counts) - counts
        starts = np.arange(len(own)) - np.repeat(begins - base, counts)
        again = together(data, starts.copy(), anchor_of[own], length) if len(own) else np.empty(0, bool)
        out_ids, out_from, out_to = [], [], []
        for i, text in enumerate(found):
            places = texts[text]
            if len(places) > 1 or len(places[0][0]) > 1:
                runs = np.array([[0, counts[i]]])  # the whole stretch repeats
            else:
                runs = runs_of(again[begins[i] : begins[i] + counts[i]])
            for ids, at in places if len(runs) else ():
                out_ids.append(np.repeat(ids, len(runs)))
                out_from.append((at[:, None] + runs[:, 0]).ravel())
                out_to.append((at[:, None] + runs[:, 1] + length - 1).ravel())
        if out_ids:
            ids = np.concatenate(out_ids)
            spans = np.concatenate(out_from).astype(np.uint64) << np.uint64(32) | np.concatenate(out_to).astype(np.uint64)
            yield to_owners(ids, spans, shards)

    return sort


def _finish(names: list[str], carried: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, starts, ends = [], [], [], []
            found = batch.column(carried + 1).to_pylist() if batch.num_columns > carried + 1 else None
            for i, data in enumerate(batch.column(carried).to_pylist()):
                data = data or b""
                spans = np.empty((0, 2), np.int64)
                if found is not None and found[i]:
                    both = np.frombuffer(found[i], "<u8")
                    steps = np.zeros(len(data) + 1, np.int64)
                    np.add.at(steps, np.minimum(both >> np.uint64(32), len(data)).astype(np.int64), 1)
                    np.add.at(steps, np.minimum(both & np.uint64(0xFFFFFFFF), len(data)).astype(np.int64), -1)
                    covered = np.cumsum(steps[:-1]) > 0
                    spans = runs_of(covered)
                    kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
                else:
                    kept.append(data)
                sizes.append(len(data))
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:carried], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                    pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                ],
                names,
            )

    return finish


def dedup_suffixes(docs: DataFrame, *keep: str, length: int = 200) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts anywhere else, same document included.

    Texts are UTF-8 bytes; strings stay inside documents, may overlap and are judged on the input. Returns the
    columns `keep` of `docs` (doc_id, text, ...) with n_bytes, kept (binary: the bytes left, which may split a
    character) and the maximal removed runs as spans, array<struct<start, end>> in bytes. Null and empty texts
    have no bytes; repeated rows are occurrences of their own; rows of one doc_id (null is one of them) are expected
    to have one text and share their removals; texts are shorter than 4 GB; an empty table gives none. `length` is
    at least twice the anchor.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    spark = docs.sparkSession
    parts = parts_for(docs, BYTES_PER_PART)
    shards = SHARDS_PER_PART * parts
    rows = docs.select(id_key().alias("id"), F.col("text").cast("binary").alias("text"))
    n = docs.count()
    anchored = rows.mapInArrow(_anchors(length, ANCHOR, shards), PACKED).repartition(parts, "shard")
    repeated = by_owner(anchored.mapInArrow(_repeated_anchors(shards), PACKED), parts)
    wanted = rows.where(may_hold(spark, filter_bits(repeated, n), F.col("id")))
    sent = wanted.join(repeated, "id").mapInArrow(_stretches(length, ANCHOR, shards), STRETCHES)
    covered = by_owner(sent.repartition(parts, "shard").mapInArrow(_sorted(length, shards), PACKED), parts)
    carried = [f"k{i}" for i in range(len(keep))]
    marked = docs.select(
        *[F.col(x).alias(k) for x, k in zip(keep, carried, strict=True)],
        F.col("text").cast("binary").alias("data"), id_key().alias("id"),
        may_hold(spark, filter_bits(covered, n), id_key()).alias("held"),
    )
    schema = marked.select(*carried).schema
    for field in StructType.fromDDL("n_bytes long, kept binary, starts array<long>, ends array<long>").fields:
        schema = schema.add(field)
    finish = _finish(schema.names, len(carried))
    clean = marked.where(~F.col("held")).select(*carried, "data").mapInArrow(finish, schema)
    cut = marked.where("held").join(covered, "id", "left").select(*carried, "data", "found").mapInArrow(finish, schema)
    spans = F.transform(
        F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"))
    )
    names = [F.col(k).alias(x) for x, k in zip(keep, carried, strict=True)]
    return clean.unionByName(cut).select(*names, "n_bytes", "kept", spans.alias("spans"))
