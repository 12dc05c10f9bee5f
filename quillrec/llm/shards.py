"""Moving many small fixed-width entries between tasks as packed arrays, and filters of row ids of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.llm.words import mixed
from quillrec.session import stage

FIRST_ID = -(1 << 63)  # stands for a null id: it comes before all others
SHARDS_PER_PART = 8
MAX_FILTER_BITS = 1 << 28


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(FIRST_ID))


def from_key(name: str) -> Column:
    """The id behind a key."""
    return F.when(F.col(name) != FIRST_ID, F.col(name))


def parts_for(docs: DataFrame, bytes_per_part: int) -> int:
    """Number of tasks that gives each about so many bytes of text, whatever the size of the table."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(1, -(-total // bytes_per_part))


def scattered(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The entries of each shard, in their order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    sorted_shard = shard[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(sorted_shard[1:] != sorted_shard[:-1]) + 1
    edges = [0, *cuts.tolist(), len(shard)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(sorted_shard[a]), [c[a:b] for c in columns]


def deltas(ids: np.ndarray) -> bytes:
    """Ids as differences; runs of near ids shrink in the shuffle's compression."""
    return np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i8"))


def packed(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    shard, entries, ids = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(entries, pa.binary()), pa.array(ids, pa.binary())],
        ["shard", "entries", "ids"],
    )


PACKED = "shard int, entries binary, ids binary"


def gathered(batches: Iterator[pa.RecordBatch], width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries that came to a task: shard, entry, id."""
    shard, entries, ids = [], [], []
    for batch in batches:
        for s, e, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            entries.append(np.frombuffer(e, width))
            ids.append(undeltas(d))
            shard.append(np.full(len(entries[-1]), s, np.uint64))
    if not shard:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(shard), np.concatenate(entries).astype(np.uint64), np.concatenate(ids)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal keys together, first place of each group, group of each place."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    return order, first, np.repeat(np.arange(len(first)), sizes)


def by_id(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row an id with its values."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    edges = [0, *cuts.tolist(), len(ids)] if len(ids) else [0]
    data = values.astype("<u8").tobytes()
    parts = [data[8 * a : 8 * b] for a, b in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[edges[:-1]], pa.int64()), pa.array(parts, pa.binary())], ["id", "found"]
    )


def to_owners(ids: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    """Values packed for the shards of the documents they are of."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    shard = (mixed(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
    return packed([(s, v.astype("<u8").tobytes(), deltas(d)) for s, (v, d) in scattered(shard, values, ids)])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, values, ids = gathered(batches, "<u8")
    yield by_id(ids, values)


def by_owner(found: DataFrame, parts: int) -> DataFrame:
    """(id, found): what `to_owners` sent to each document, one row a document, staged."""
    return stage(found.repartition(parts, "shard").mapInArrow(_owned, "id long, found binary"))


def runs_of(covered: np.ndarray) -> np.ndarray:
    """Starts and ends (n, 2) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def filter_bits(ids: DataFrame, rows: int) -> np.ndarray:
    """Bit map of hashed `id`s: eight bits a row of the table they are of, at most MAX_FILTER_BITS (32 MB).

    Beyond that size it lets more rows through; it never holds back a row whose id is in `ids`.
    """
    bits = 1 << max(10, min(MAX_FILTER_BITS.bit_length() - 1, (8 * max(1, rows)).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = ids.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint8)


def may_hold(session, bits: np.ndarray, key: Column) -> Column:
    """Whether the filter lets an id through."""
    shared = session.sparkContext.broadcast(bits)
    slots = 8 * len(bits)

    @F.pandas_udf("boolean")
    def test(slot):
        import pandas as pd

        at = slot.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.pmod(F.xxhash64(key), F.lit(slots)))


def without(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id key is not in `ids` (id). Only rows that the filter lets through are joined."""
    key, columns = id_key(name), docs.columns
    own = "_" + max([*columns, ""], key=len)  # longer than any column's name
    marked = docs.withColumn(own, may_hold(docs.sparkSession, filter_bits(ids, docs.count()), key))
    doubtful = marked.where(F.col(own)).withColumn(own, key)
    doubtful = doubtful.join(ids.select(F.col("id").alias(own)), own, "left_anti")
    return marked.where(~F.col(own)).select(*columns).unionByName(doubtful.select(*columns))
