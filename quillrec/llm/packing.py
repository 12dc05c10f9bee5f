"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most `capacity` tokens. How many pieces each length has (at most `capacity` numbers)
is all the plan needs: it runs best fit, longest first, over counts and gives each length a few ranges of slots.
Pieces then take the slot of their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrec.session import stage

MAX_CACHED = 400_000
MAX_CHUNK = 64
# Chunks whose parts can be told without the tokenizer's normaliser: ASCII without apostrophes, and Latin-1 letters.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PIECE_SCHEMA = "doc_id {}, piece int, start long, length long, ids_crc32 long"


class Slots(NamedTuple):
    """Places for the pieces of one length from rank `first` on: `each` per sequence, from `sequence` on."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int
    each: int


def plan_slots(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over the number of pieces of each length.

    Sequences with the same free space are kept as ranges of numbers. A piece goes where it leaves the least
    space; the sequence it went to is then the tightest for the next of its length, so a range takes
    `free // length` pieces a sequence before the next range is looked at.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, length
        while left:
            while space < capacity and not free[space]:
                space += 1
            each = space // length
            if free[space]:
                first, n = free[space].pop()
            else:
                first, n = sequences, -(-left // each)
                sequences += n
            take = min(left, n * each)
            slots.append(Slots(length, rank, take, first, capacity - space, each))
            full, part = divmod(take, each)
            for start, number, used in (
                (first, full, each * length),
                (first + full, 1 if part else 0, part * length),
                (first + full + bool(part), n - full - bool(part), 0),
            ):
                if number and space > used:
                    free[space - used].append((start, number))
            left, rank = left - take, rank + take
    return slots


class PartIds(dict):
    """Little-endian ids of a lower-case run of letters, a digit or a run of punctuation."""

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.level = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: str) -> bytes:
        symbols = part if part.isascii() else self.level.pre_tokenize_str(part)[0][0]
        value = array("I", [x.id for x in self.model.tokenize(symbols)]).tobytes()
        if len(self) >= MAX_CACHED:
            self.clear()
        if len(part) <= MAX_CHUNK:
            self[part] = value
        return value


class ChunkIds(dict):
    """Little-endian ids of a run of text without white space; no token crosses white space.

    Plain chunks go to the tokenizer's own model part by part, so that new words cost one merge run and no
    normalising; all others go through the whole tokenizer.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.parts = tokenizer, PartIds(tokenizer)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            value = b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        else:
            value = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= MAX_CACHED:
            self.clear()
        if len(chunk) <= MAX_CHUNK:
            self[chunk] = value
        return value


def _cutter(tokenizer_path: str, capacity: int, end_id: int, kind: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        known, end = ChunkIds(tokenizer), int(end_id).to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            where, numbers, starts, lengths, sums = [], [], [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                ids = b"".join([*map(known.__getitem__, (data or b"").split()), end])
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    where.append(i)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(where, pa.int64())), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32 (of little-endian ids)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _cutter(tokenizer_path, capacity, end_id, kind)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(cut, PIECE_SCHEMA.format(kind))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack every row of `docs` (doc_id, text) into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    its end id alone. Repeated rows and repeated or null ids are packed row by row; other columns are ignored;
    an empty table gives an empty result.
    """
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = stage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    # At most `capacity` rows reach the driver, however many documents there are.
    histogram = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(
        [tuple(x) for x in plan_slots(histogram, capacity)],
        "length long, first long, count long, sequence long, place long, each long",
    )
    # Rank within a length: by part of the staged table, so that no length has to fit into one task.
    pieces = pieces.withColumn("_part", F.shiftright("_row", 33))
    sizes = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    ranked = pieces.withColumn("_local", local).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_local"))
    # The plan has a few ranges for each of at most `capacity` lengths.
    inside = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("count"))
    placed = ranked.join(F.broadcast(slots), "length").where(inside)
    step = F.col("_rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
