"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom signature of its terms; a term that stands 2, 4, 8, ... times in it is entered once more
for each of these levels. The signatures of a block of documents are stored as slices: for each bit of the signature one
bitmap over the documents. The slices of a term, intersected, are the documents that may hold it, with an upper bound of
its frequency from the highest level that may be there. Weighted sums of these bitmaps bound every score from above.

A search takes the documents of highest bound, scores their texts exactly, and so has a score that the last row of the
result reaches at least; then it scores the texts of all documents whose bound reaches that score. No others can rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrec.llm.shards import deltas, filter_bits, id_key, may_hold, undeltas
from quillrec.llm.words import hashed_words, mixed
from quillrec.session import stage

# A-Z to a-z; ASCII bytes that belong to no term to a space; digits, letters and all bytes of longer characters stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
GROUP_BYTES = 2_000_000
PROBES = 4
BITS_PER_ENTRY = 12  # at least; below 24
BLOCK_BITS = 1 << 23  # of all slices of a block
BLOCK_DOCS = 4096
PASS_ITEMS = 1000
PASS_BYTES = 16_000_000  # of queries sent to tasks at once
LEVEL = np.uint64(0x9E3779B97F4A7C15)
INDEX = "bits int, docs long, terms long, ids binary, sizes binary, slices binary"


class Statistics(NamedTuple):
    """Number of documents that have a term, and of all their terms."""

    docs: int
    terms: int


class Queries(NamedTuple):
    """Queries of one pass: their numbers, distinct terms with weights, and each query's terms with their repeats."""

    numbers: list[int]
    terms: dict[bytes, int]
    weights: list[int]
    asked: list[dict[int, int]]


def split_terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z as a-z."""
    return (text or b"").translate(PLAIN).split()


def probes(entries: np.ndarray, bits: int) -> np.ndarray:
    """Bits (n, PROBES) of hashed entries in a signature of `bits` bits."""
    entries = mixed(entries)
    first, step = entries & np.uint64(0xFFFFFFFF), (entries >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def entries_of(hashes: np.ndarray) -> np.ndarray:
    """A document's entries: each term, and once more for each power of two from 2 that its frequency reaches."""
    terms, counts = np.unique(hashes, return_counts=True)
    levels = np.frexp(counts)[1]  # 1 for one, 2 for 2 or 3, 3 for 4 to 7, ...
    owner = np.repeat(np.arange(len(terms)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    return terms[owner] + level.astype(np.uint64) * LEVEL


def least_score(frequency, norm):
    """The share of a term's weight that a document of this norm gets for this frequency."""
    return 1_000_000_000 * frequency // (1000 * frequency + 12 * norm)


def norms(sizes, stats: Statistics):
    return 75 + 25 * sizes * stats.docs // stats.terms


def _block(bits: int, docs: list[tuple[int, int, np.ndarray]]) -> tuple:
    ids, sizes = np.array([x[0] for x in docs], np.int64), np.array([x[1] for x in docs], np.int64)
    width = -(-len(docs) // 8)
    cells = np.zeros((bits, 8 * width), bool)
    for at, (_, _, entries) in enumerate(docs):
        cells[probes(entries, bits), at] = True
    slices = np.packbits(cells, axis=1, bitorder="little").tobytes()
    return bits, len(docs), int(sizes.sum()), deltas(ids), sizes.tobytes(), slices


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bits", "docs", "terms", "ids", "sizes", "slices"])

    def add(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for key, hashes in zip(ids, hashed_words(texts), strict=True):
            if not len(hashes):
                continue
            entries = entries_of(hashes)
            bits = BITS_PER_ENTRY << max(3, (len(entries) - 1).bit_length())
            same = waiting.setdefault(bits, [])
            same.append((key, len(hashes), entries))
            if len(same) >= min(BLOCK_DOCS, max(8, BLOCK_BITS // bits)):
                yield batch_of([_block(bits, waiting.pop(bits))])

    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append((text or b"").translate(PLAIN))
            size += len(texts[-1])
            if size >= GROUP_BYTES:
                yield from add(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield from add(ids, texts)
    for bits, docs in waiting.items():
        yield batch_of([_block(bits, docs)])


def build_index(docs: DataFrame) -> DataFrame:
    """Signature blocks of `docs` (doc_id, text), staged. A row without a term is in no block.

    Documents of about the same number of entries share a block, so a signature is 12 to 24 bits an entry, however long
    the text is.
    """
    return stage(docs.select(id_key().alias("id"), F.col("text").cast("binary")).mapInArrow(_blocks, INDEX))


def statistics(index: DataFrame) -> Statistics:
    found = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return Statistics(found.docs or 0, found.terms or 0)


def _frequency_counter(terms: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = terms.keys(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(asked & set(split_terms(text)))
        rows = [(terms[x], n) for x, n in total.items()]
        places, counts = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(counts, pa.int64())], ["term", "n"])

    return count


def weighed(docs: DataFrame, items: list[tuple[int, bytes | None]], stats: Statistics) -> Queries:
    """Queries of one pass with the weights of their terms, from the documents that hold each of them."""
    terms: dict[bytes, int] = {}
    asked = [Counter(terms.setdefault(x, len(terms)) for x in split_terms(text)) for _, text in items]
    counted = docs.select(F.col("text").cast("binary")).mapInArrow(_frequency_counter(terms), "term int, n long")
    holders = {x.term: x.n for x in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = [
        math.floor(1000 * math.log((2 * stats.docs + 2) / (2 * holders[i] + 1))) if i in holders else 0
        for i in range(len(terms))
    ]
    return Queries([x for x, _ in items], terms, weights, [dict(x) for x in asked])


class Bounds:
    """Upper bounds of the scores of a block's documents."""

    def __init__(self, queries: Queries, stats: Statistics) -> None:
        self.stats, self.count = stats, len(queries.numbers)
        terms = list(queries.terms)
        hashes = hashed_words([b" ".join(terms)])[0] if terms else np.empty(0, np.uint64)
        holders: list[list[tuple[int, int]]] = [[] for _ in terms]
        for i, own in enumerate(queries.asked):
            for term, times in own.items():
                holders[term].append((i, times))
        self.terms = [
            (hashes[t], np.array([i for i, _ in own], np.int64), np.array([queries.weights[t] * n for _, n in own], np.int64))
            for t, own in enumerate(holders)
            if queries.weights[t]
        ]

    def of(self, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """(queries, documents): no score is above its bound."""
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        norm = norms(sizes, self.stats)
        total = np.zeros((self.count, len(sizes)), np.int64)

        def holding(term: np.uint64, level: int) -> np.ndarray:
            entry = np.array([term], np.uint64) + np.array([level], np.uint64) * LEVEL
            return np.bitwise_and.reduce(table[probes(entry, bits)[0]], axis=0)

        for term, who, weight in self.terms:
            here, level = holding(term, 0), 0
            at = np.flatnonzero(np.unpackbits(here, bitorder="little"))
            if not len(at):
                continue
            most = np.ones(len(at), np.int64)
            while True:
                level += 1
                here = here & holding(term, level)
                if not here.any():
                    break
                higher = np.unpackbits(here, bitorder="little")[at].astype(bool)
                most[higher] = (2 << level) - 1
                if level >= 32:
                    break
            most = np.minimum(most, sizes[at])
            total[np.ix_(who, at)] += weight[:, None] * least_score(most, norm[at])[None, :]
        return total


def _bounded(queries, stats: Statistics, k: int, reached: dict[int, int] | None):
    """Candidates (item, id, bound): the `k` highest of each task, or with `reached` all that may reach that score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        bounds, numbers = Bounds(own, stats), np.array(own.numbers, np.int64)
        least = None if reached is None else np.array([max(1, reached.get(x, 1)) for x in own.numbers], np.int64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in numbers]

        def batch_of(item, ids, bound) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, ids, bound)], ["item", "id", "bound"])

        for batch in batches:
            for i in range(batch.num_rows):
                bits, _, _, ids, sizes, slices = (batch.column(c)[i].as_py() for c in range(6))
                ids, found = undeltas(ids), bounds.of(bits, np.frombuffer(sizes, np.int64), slices)
                if least is not None:
                    item, at = np.nonzero(found >= least[:, None])
                    yield batch_of(numbers[item], ids[at], found[item, at])
                    continue
                for q in range(len(numbers)):
                    bound, held = np.concatenate([best[q][0], found[q]]), np.concatenate([best[q][1], ids])
                    if len(bound) > k:
                        top = np.argpartition(-bound, k - 1)[:k]
                        bound, held = bound[top], held[top]
                    best[q] = bound[bound > 0], held[bound > 0]
        if least is None:
            for q, (bound, held) in enumerate(best):
                yield batch_of(np.full(len(held), numbers[q]), held, bound)

    return search


def _scorer(queries, stats: Statistics):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        place = {x: i for i, x in enumerate(own.numbers)}
        for batch in batches:
            rows, items, scores = [], [], []
            for at, (text, wanted) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)):
                words = split_terms(text)
                norm = norms(len(words), stats)
                counts = Counter(filter(own.terms.__contains__, words))
                shares = {own.terms[x]: least_score(n, norm) * own.weights[own.terms[x]] for x, n in counts.items()}
                for item in wanted:
                    total = sum(times * shares.get(term, 0) for term, times in own.asked[place[item]].items())
                    if total:
                        rows.append(at)
                        items.append(item)
                        scores.append(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scores, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return score


def _rescored(docs: DataFrame, count: int, candidates: DataFrame, queries, stats: Statistics) -> DataFrame:
    """(item, doc_id, score) of the rows of `docs` whose ids are candidates (item, id), from their whole texts."""
    wanted = stage(candidates.groupBy("id").agg(F.collect_set("item").alias("items")))
    key = id_key()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), key.alias("id"))
    rows = rows.where(may_hold(docs.sparkSession, filter_bits(wanted, count), key)).join(wanted, "id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text", "items").mapInArrow(_scorer(queries, stats), f"item long, doc_id {kind}, score long")
    return stage(found)


def _numbered(items: DataFrame) -> tuple[DataFrame, int, int]:
    """Items with `_number` from 0 without gaps, how many there are, and the most of them sent to tasks at once."""
    rows = stage(items.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_least"), F.max(F.octet_length("text")).alias("_bytes")
    )
    found = sizes.orderBy("_part").collect()  # one row for each task that read the items
    starts, total = [], 0
    for x in found:
        starts.append((x._part, total - x._least))
        total += x._n
    largest = max([x._bytes or 0 for x in found], default=0)
    if not starts:
        return rows.withColumn("_number", F.lit(0).cast("long")), 0, 1
    offsets = items.sparkSession.createDataFrame(starts, "_part long, _offset long")
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = stage(numbered.withColumn("_number", F.col("_row") + F.col("_offset")))
    return numbered, total, max(1, min(PASS_ITEMS, PASS_BYTES // max(1, largest)))


def _search(docs: DataFrame, index: DataFrame, stats: Statistics, items: list[tuple[int, bytes | None]], k: int) -> DataFrame:
    session = docs.sparkSession
    found = weighed(docs, items, stats)
    queries = session.sparkContext.broadcast(found)
    fields = "item long, id long, bound long"
    highest = index.mapInArrow(_bounded(queries, stats, k, None), fields)
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "id")
    first = highest.withColumn("_n", F.row_number().over(by_bound)).where(F.col("_n") <= k).select("item", "id")
    scored = _rescored(docs, stats.docs, first, queries, stats)
    # The k-th best score among some rows is one that the k-th best of all rows reaches. At most PASS_ITEMS rows.
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = scored.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") == k)
    reached = {x.item: x.score for x in kth.select("item", "score").collect()}
    rest = index.mapInArrow(_bounded(queries, stats, k, reached), fields).select("item", "id")
    scored = _rescored(docs, stats.docs, rest, queries, stats)
    in_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scored.withColumn("rank", F.row_number().over(in_item)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best rows of `docs` (doc_id, text) for each row of `items` (item_id, text).

    Scores above 0 only; ties go by ascending doc_id, null first. Rows of one doc_id are ranked each by itself, and so
    are repeated items. Null and empty texts have no terms: such items get no rows, such documents are never found and
    do not count in the statistics. Other columns are ignored; an empty table gives an empty result.

    Items are searched in passes of at most PASS_ITEMS rows and PASS_BYTES of text, one of which is sent to all tasks.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    index = build_index(docs)
    stats = statistics(index)
    numbered, total, each = _numbered(items)
    out = numbered.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    out = out.withColumn("score", F.lit(0).cast("long")).limit(0)
    for first in range(0, total if stats.docs else 0, each):
        own = numbered.where(F.col("_number").between(first, first + each - 1))
        texts = own.select("_number", F.col("text").cast("binary").alias("text")).orderBy("_number").collect()
        found = _search(docs, index, stats, [(x._number, x.text) for x in texts], k)
        named = found.join(own.select(F.col("_number").alias("item"), "item_id"), "item")
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out
