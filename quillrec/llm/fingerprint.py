"""Document fingerprints: quartile codes of hashed byte-triplet counts, and their likeness.

The bytes of a text are read in windows of four; three triplets of each window are hashed into 256 buckets. A
bucket's code (0 to 3) is the number of quartiles of all 256 counts that its count is above. The fingerprint is the
length on a logarithmic scale and the codes, as hex. Two fingerprints differ by the sum of their code differences
and, up to a bound, their length difference; the difference of unrelated texts or more counts as likeness 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.llm.words import mixed

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
FAR = 320  # two independent sets of codes differ by 1.25 a bucket on average
LENGTH_FAR = 24
LENGTH_STEP = 8  # codes for each doubling of the length
ROWS_PER_RANGE = 1_000
MAX_RANGES = 10_000
FIRST_ID = -(1 << 63)


def _tables() -> np.ndarray:
    """A byte permutation-like table for each place of each triplet."""
    n = len(TRIPLETS) * 3 * 256
    return (mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(7)).astype(np.uint8).reshape(-1, 3, 256)


def codes(data: bytes, tables: np.ndarray) -> np.ndarray:
    """Length code and 256 quartile codes."""
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    n = max(0, len(raw) - 3)
    if n:
        for places, table in zip(TRIPLETS, tables, strict=True):
            hashed = table[0][raw[places[0] : places[0] + n]]
            for place, column in zip(places[1:], table[1:], strict=True):
                hashed = hashed ^ column[raw[place : place + n]]
            counts += np.bincount(hashed, minlength=BUCKETS)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.empty(BUCKETS + 1, np.int16)
    out[0] = min(255, int(math.log2(len(raw) + 1) * LENGTH_STEP))
    out[1:] = (counts[:, None] > quartiles).sum(axis=1)
    return out


def encoded(code: np.ndarray) -> str:
    """130 hex digits: length code, then four quartile codes a byte."""
    four = code[1:].reshape(-1, 4).astype(np.uint8)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{int(code[0]):02x}{packed.tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal codes, 0 for a difference of FAR or more."""
    apart = np.abs(a - b)
    return 1.0 - min(FAR, min(LENGTH_FAR, int(apart[0])) + int(apart[1:].sum())) / FAR


def fingerprint(text: str) -> str:
    return encoded(codes(text.encode(), _tables()))


def _compare(tables: np.ndarray, kind: str):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # range, id, text, codes of the row whose next row is not known yet
        for batch in batches:
            rows: list[tuple] = []
            id_type = batch.schema.field("doc_id").type
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for part, peek, doc_id, text in zip(*columns, strict=True):
                text = text or ""
                own = None
                if waiting is None or waiting[0] != part or not peek:
                    own = codes(text.encode(), tables)
                if waiting is not None and waiting[0] == part:
                    _, before_id, before, before_codes = waiting
                    if own is None:
                        own = codes(text.encode(), tables)
                    half = len(before) // 2
                    edited = (before[: len(before) - half] + text[:half]).encode()
                    edited_codes = codes(edited, tables)
                    rows.append((
                        before_id, len(before), hashlib.sha256(edited).hexdigest(), encoded(before_codes),
                        encoded(edited_codes), likeness(before_codes, edited_codes), likeness(before_codes, own),
                    ))
                waiting = None if peek else (part, doc_id, text, own)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k or id_type) for x, k in zip(columns, kinds, strict=True)], names
            )

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    return compare, schema + "near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of `docs` (doc_id, text) and compare it with its edited text and the next row.

    The next row is by ascending doc_id, after the last the first; the edited text has its last half replaced by
    the start of the next one's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty (n_chars 0), a null id comes first, rows with equal ids follow
    the hash of their text; other columns are ignored. A single row is its own next one; no row gives none.

    Rows are cut into ranges of ids, one shuffle of the texts; the first row of each range is also sent to the end
    of the range before. Bounded in size: the ranges' limits and first ids. One id's rows stay in one range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    points = [i / ranges for i in range(1, ranges)]
    limits = np.empty(0, np.int64)
    if points and n:
        limits = np.unique(docs.agg(F.percentile_approx(key, points, 10 * MAX_RANGES).alias("p")).first().p)

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(limits, ids.to_numpy(), side="left").astype(np.int32))

    rows = docs.select("doc_id", "text", key.alias("_key")).withColumn("_range", range_of("_key"))
    firsts = docs.select(key.alias("_key")).withColumn("_range", range_of("_key"))
    firsts = sorted((x[0], x[1]) for x in firsts.groupBy("_range").agg(F.min("_key").alias("k")).collect())
    ahead = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first range follows the last
    ahead = docs.sparkSession.createDataFrame(ahead, "_key long, _before int")
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("peek"))
    there = F.struct(F.col("_before").alias("r"), F.lit(1).alias("peek"))
    copies = F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))
    rows = rows.join(F.broadcast(ahead), "_key", "left")  # at most MAX_RANGES rows
    rows = rows.select("doc_id", "text", "_key", F.explode(copies).alias("x"))
    rows = rows.select(F.col("x.r").alias("_range"), F.col("x.peek").alias("_peek"), "doc_id", "text", "_key")
    order = ["_range", "_peek", "_key", F.xxhash64("text"), "text"]
    dealt = rows.repartition("_range").sortWithinPartitions(*order)
    compare, schema = _compare(_tables(), kind)
    return dealt.select("_range", "_peek", "doc_id", "text").mapInArrow(compare, schema)
