"""Benchmark decontamination by latent semantic retrieval.

Texts are coded over the words of the benchmark. Passages of the corpus give term weights (TF-IDF) and, by a
distributed randomised SVD, a latent space whose axes are scaled to equal spread. Overlapping windows of about an
item's length are compared with the items by cosine there; candidates count as leaks if the longest common
subsequence covers most of the item, or a good part of it together with its end, which holds the answer. Items whose leaks may be
left with too few weighted words for a direction are compared with every window that has enough of their words; short
items are found as whole runs of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.llm.words import split_words
from quillrec.session import stage

PUNCTUATION = b""".,;:!?"'()[]{}<>|*#$%&-_/\\`~"""
MAX_ITEMS = 50_000  # of a benchmark; its words and vectors travel to every task
MAX_ITEM_BYTES = 64_000_000
PASSAGE = 64
RANK = 64
MAX_SHARE = 0.05  # words in more passages than this carry no weight
MIN_WORDS = 8  # shorter items are searched for as whole runs only
MIN_TERMS = 3  # weighted words that a window or item needs for a direction
COSINE = 0.4
STRONG, WEAK, ANSWER = 0.75, 0.6, 0.75
GROUP_WORDS = 100_000
TERM_BLOCK = 512
MAX_CACHED = 1_000_000
SLOTS = 4096  # of the signature of a region's words
REGIONS = 1024  # signatures held at once
WINDOWS = 8192  # compared with
ITEMS = 1024  # items at once
BLANK = 1


def tokens(data: bytes) -> list[bytes]:
    """Words in lower case with outer punctuation taken off; positions count words as split."""
    return [w.strip(PUNCTUATION) for w in lower_words(data)]


def lower_words(data: bytes) -> list[bytes]:
    return split_words(data.decode().lower().encode())


class WordCodes(dict):
    """Code of a word as it stands in a text; 0 for words that no item has."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        code = self.vocabulary.get(word.strip(PUNCTUATION), 0)
        if len(self) >= MAX_CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


@dataclass
class Benchmark:
    """Items as codes of their words; code 0 is a word of no item, code BLANK is punctuation alone."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_benchmark(benchmark: DataFrame) -> Benchmark:
    """Collect (item_id, text), which must be small; null texts and items without a word are left out."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > MAX_ITEMS or size > MAX_ITEM_BYTES:
        raise ValueError(f"at most {MAX_ITEMS} items of {MAX_ITEM_BYTES} bytes in all")
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").collect()
    vocabulary: dict[bytes, int] = {b"": BLANK}
    ids, items = [], []
    for row in sorted(rows, key=lambda x: (x.item_id is None, x.item_id, bytes(x.text))):
        words = [w for w in tokens(bytes(row.text)) if w]
        if words:
            ids.append(row.item_id)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32))
    return Benchmark(ids, items, vocabulary)


def _coder(vocabulary: dict[bytes, int]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes(vocabulary)
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                words = lower_words(data or b"")
                out.append(np.fromiter(map(known.__getitem__, words), "<i4", len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "codes"])

    return code


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents in groups: ids, their codes end to end, lengths."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            held.append(np.frombuffer(data, "<i4"))
            size += len(held[-1])
            if size >= GROUP_WORDS:
                yield ids, np.concatenate(held), np.array([len(x) for x in held])
                ids, held, size = [], [], 0
    if ids:
        yield ids, np.concatenate(held), np.array([len(x) for x in held])


def _passages(lengths: np.ndarray) -> np.ndarray:
    """Passage number of every word of documents laid end to end."""
    counts = -(-lengths // PASSAGE)
    first = np.repeat(np.cumsum(counts) - counts, lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first + place // PASSAGE


def _frequencies(terms: int):
    """Passages that hold each term; term 0 counts all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for _, codes, lengths in _groups(batches):
            passage = _passages(lengths)
            if len(passage):
                total[0] += passage[-1] + 1
            seen = np.unique((passage * terms + codes)[codes > 0])
            total += np.bincount(seen % terms, minlength=terms)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    return count


def term_weights(coded: DataFrame, terms: int) -> np.ndarray:
    """Inverse passage frequency of each term over the whole corpus; 0 for very frequent ones."""
    rows = coded.mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(terms)
    for row in rows:  # one row a term
        counts[row.term] = row.n
    weights = np.log((counts[0] + 1) / (counts + 1))
    weights[counts > MAX_SHARE * counts[0]] = 0
    weights[[0, BLANK]] = 0
    return weights.astype(np.float32)


def _multiply(shared):
    """Each task's part of A'A X, for the matrix A of normalised passages, as blocks of terms."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        scaled = basis * weights[:, None]
        total = np.zeros(basis.shape, np.float64)
        for _, codes, lengths in _groups(batches):
            own = weights[codes]
            at = np.flatnonzero(own)
            if not len(at):
                continue
            code, own, passage = codes[at], own[at], _passages(lengths)[at]
            first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            rows = np.add.reduceat(scaled[code], first, axis=0)
            rows /= np.add.reduceat(own * own, first)[:, None]
            order = np.argsort(code, kind="stable")
            ends = code[order]
            starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            total[ends[starts]] += np.add.reduceat(rows[row[order]], starts, axis=0)
        total *= weights[:, None]
        blocks = range(0, len(total), TERM_BLOCK)
        data = [total[b : b + TERM_BLOCK].tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    return multiply


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, np.float64)
            total[block] = total[block] + part if block in total else part
    data = [x.tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def gram_product(coded: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A X over all passages, summed by blocks of terms in the cluster."""
    shared = coded.sparkSession.sparkContext.broadcast((weights, basis.astype(np.float32)))
    parts = coded.mapInArrow(_multiply(shared), "block int, data binary").repartition("block")
    out = np.zeros(basis.shape)
    for row in parts.mapInArrow(_sum, "block int, data binary").collect():  # one row a block
        part = np.frombuffer(row.data, np.float64).reshape(-1, basis.shape[1])
        out[row.block : row.block + len(part)] = part
    return out


def latent_axes(coded: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the passages over their singular values (terms x rank), by a randomised SVD.

    A random start is multiplied by A'A and made orthogonal; a second product gives the singular values within it.
    """
    rank = min(rank, len(weights))
    start = np.random.RandomState(0).standard_normal((len(weights), rank))
    basis, _ = np.linalg.qr(gram_product(coded, weights, start))
    values, turn = np.linalg.eigh(basis.T @ gram_product(coded, weights, basis))
    kept = values > max(1e-9, values.max(initial=0) * 1e-6)
    return (basis @ turn[:, kept] / np.sqrt(values[kept])).astype(np.float32)


def lcs_masks(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for place, code in enumerate(item.tolist()):
        masks[code] = masks.get(code, 0) | 1 << place
    return masks


def lcs(masks: dict[int, int], size: int, region: list[int]) -> int:
    """Length of the longest common subsequence, with one bit a word of the item."""
    full = (1 << size) - 1
    row = full
    for code in region:
        mask = masks.get(code)
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def spans_of(lengths: list[int]) -> list[int]:
    """Window sizes: 16, 24, 32, 48, 64, ... as far as the longest item needs."""
    sizes = [16]
    while sizes[-1] < max(lengths, default=0):
        sizes.append(sizes[-1] * 3 // 2 if len(sizes) % 2 else sizes[-1] * 4 // 3)
    return sizes


def needs_all_windows(item: np.ndarray, weights: np.ndarray) -> bool:
    """Whether a leak of the item may be left with too few weighted words for a direction."""
    changed = len(item) - int(np.ceil(WEAK * len(item)))
    return np.count_nonzero(weights[item]) - changed < MIN_TERMS


def may_hold_words(
    codes: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray, slots: list[np.ndarray], needed: np.ndarray
) -> np.ndarray:
    """Which regions low..high of `codes` may hold `needed` distinct words of their item; these come in order of items.

    Words are looked up in a signature of the region, one slot a word, so at least the words in common are counted.
    """
    out = np.zeros(len(low), bool)
    for first in range(0, len(low), REGIONS):
        part = slice(first, first + REGIONS)
        place = np.minimum(low[part, None] + np.arange((high[part] - low[part]).max()), high[part, None] - 1)
        seen = np.zeros((len(place), SLOTS), np.uint8)
        seen.ravel()[codes[place] % SLOTS + np.arange(len(place))[:, None] * SLOTS] = 1
        own = items[part]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held = seen[a:b].take(slots[own[a]], axis=1).sum(axis=1, dtype=np.int64)
            out[first + a : first + b] = held >= needed[own[a]]
    return out


def whole_runs(runs: dict[int, dict[bytes, list[int]]], terms: int):
    """Finds each item of `runs` (by length, then by codes) as a run of words, punctuation between them aside."""
    heads = {n: np.zeros(terms, bool) for n in runs}
    for n, own in runs.items():
        heads[n][[np.frombuffer(x, "<i4")[0] for x in own]] = True

    def find(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        place = np.flatnonzero(codes != BLANK)
        words, doc = codes[place], np.repeat(np.arange(len(lengths)), lengths)[place]
        for n, own in runs.items():
            at = np.flatnonzero(heads[n][words[: max(0, len(words) - n + 1)]])
            at = at[doc[at] == doc[at + n - 1]]
            for part in range(0, len(at), 65_536):
                some = at[part : part + 65_536]
                data = words[some[:, None] + np.arange(n)].astype("<i4").tobytes()
                for k, first in enumerate(some.tolist()):
                    for item in own.get(data[4 * n * k : 4 * n * (k + 1)], ()):
                        yield int(doc[first]), item, int(place[first]), int(place[first + n - 1]) + 1

    return find


def _searcher(shared, kind: str):
    names = ["doc_id", "item", "common", "answer", "cosine", "start", "end"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, axes, items = shared.value
        scaled = axes * weights[:, None]
        vectors = np.zeros((len(items), axes.shape[1]), np.float32)
        short: dict[int, dict[bytes, list[int]]] = {}
        for i, item in enumerate(items):
            if len(item) < MIN_WORDS:
                short.setdefault(len(item), {}).setdefault(item.astype("<i4").tobytes(), []).append(i)
            elif np.count_nonzero(weights[item]) >= MIN_TERMS:
                own = weights[item] @ axes[item]
                vectors[i] = own / (np.linalg.norm(own) or 1)
        sizes = spans_of([len(x) for x in items])
        size_of = np.searchsorted(sizes, [len(x) for x in items])
        long = np.array([len(x) >= MIN_WORDS for x in items], bool)
        everywhere = np.array([len(x) >= MIN_WORDS and needs_all_windows(x, weights) for x in items], bool)
        short_runs = whole_runs(short, len(weights))
        masks = [lcs_masks(x) for x in items]
        words_of = [frozenset(x.tolist()) for x in items]
        # A subsequence has at most the distinct words in common and all of the item's repeats.
        needed = [WEAK * len(x) - (len(x) - len(own)) for x, own in zip(items, words_of, strict=True)]
        slots = [np.array(sorted(x), np.int64) % SLOTS for x in words_of]
        least = np.array(needed)
        tails = [x[-max(4, len(x) // 4) :] for x in items]
        tail_masks = [lcs_masks(x) for x in tails]
        for ids, codes, lengths in _groups(batches):
            ends = np.cumsum(lengths)
            at = np.flatnonzero(weights[codes])
            sums = np.zeros((len(at) + 1, axes.shape[1]))
            np.cumsum(scaled[codes[at]], axis=0, out=sums[1:])
            best: dict[tuple[int, int], tuple] = {}

            def compare(d: int, item: int, cosine: float | None, start: int, end: int, size: int) -> None:
                known = best.get((d, item))
                if known and known[0] == 1.0:
                    return
                low, high = ends[d] - lengths[d], ends[d]
                region = codes[max(low, start - size // 2) : min(high, end + size // 2)].tolist()
                if len(words_of[item].intersection(region)) < needed[item]:
                    return
                common = lcs(masks[item], len(items[item]), region) / len(items[item])
                if common < WEAK or (known and known[0] >= common):
                    return
                answer = lcs(tail_masks[item], len(tails[item]), region) / len(tails[item])
                if common >= STRONG or answer >= ANSWER:
                    best[d, item] = (common, answer, cosine, int(start - low), int(end - low))

            for d, item, start, end in short_runs(codes, lengths):
                low = ends[d] - lengths[d]
                best.setdefault((d, item), (1.0, 1.0, None, int(start - low), int(end - low)))
            for k, size in enumerate(sizes):
                wanted = np.flatnonzero((size_of == k) & long & ~everywhere)
                others = np.flatnonzero((size_of == k) & everywhere)
                if not len(wanted) and not len(others):
                    continue
                counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - size) // (size // 4))) + 1, 0)
                doc = np.repeat(np.arange(len(lengths)), counts)
                step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = ends[doc] - lengths[doc] + step * (size // 4)
                end = np.minimum(start + size, ends[doc])
                if len(others):
                    low, high = np.maximum(ends[doc] - lengths[doc], start - size // 2), np.minimum(ends[doc], end + size // 2)
                for item in others.tolist():
                    member = np.zeros(len(weights), bool)
                    member[items[item]] = True
                    held = np.concatenate([[0], np.cumsum(member[codes], dtype=np.int32)])
                    rows = np.flatnonzero(held[high] - held[low] >= WEAK * len(items[item]))
                    same = np.full(len(rows), item)
                    for row in rows[may_hold_words(codes, low[rows], high[rows], same, slots, least)].tolist():
                        compare(int(doc[row]), item, None, int(start[row]), int(end[row]), size)
                if not len(wanted):
                    continue
                a, b = np.searchsorted(at, start), np.searchsorted(at, end)
                full = b - a >= MIN_TERMS
                doc, start, end, a, b = (x[full] for x in (doc, start, end, a, b))
                for part in range(0, len(doc), WINDOWS):
                    p = slice(part, part + WINDOWS)
                    latent = (sums[b[p]] - sums[a[p]]).astype(np.float32)
                    length = np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), np.float32(1e-12))
                    for block in (wanted[x : x + ITEMS] for x in range(0, len(wanted), ITEMS)):
                        products = vectors[block] @ latent.T
                        near, w = np.nonzero(products >= COSINE * length)
                        row, near_item = part + w, block[near]
                        low = np.maximum(ends[doc[row]] - lengths[doc[row]], start[row] - size // 2)
                        high = np.minimum(ends[doc[row]], end[row] + size // 2)
                        some = np.flatnonzero(may_hold_words(codes, low, high, near_item, slots, least))
                        cosines = products[near[some], w[some]] / length[w[some]]
                        for r, i, cosine in zip(row[some].tolist(), near_item[some].tolist(), cosines.tolist(), strict=True):
                            compare(int(doc[r]), i, cosine, start[r], end[r], size)
            rows = [(ids[d], i, *found) for (d, i), found in sorted(best.items())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            first = pa.array(columns[0]) if any(x is not None for x in columns[0]) else pa.nulls(len(rows), pa.int64())
            others = [pa.array(x, t) for x, t in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([first, *others], names)

    return search, f"doc_id {kind}, item int, common double, answer double, cosine double, start long, end long"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold items of a benchmark, whole or paraphrased.

    `docs` (doc_id, text), `benchmark` (item_id, text). Returns a row for each document and item found: doc_id,
    item_id, common (share of the item's words in the longest common subsequence), answer (the same for its end),
    cosine, start and end (words of the window). Null and empty texts hold nothing; items under MIN_WORDS words must
    stand as a whole run (one word is a run too); cosine is null for these and for items that are compared with all
    windows, whose leaks may keep fewer than MIN_TERMS weighted words; repeated rows and repeated items are each reported; other
    columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    bench = read_benchmark(benchmark)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    coder = _coder(bench.vocabulary)
    rows = docs.where(F.length("text") > 0).select("doc_id", F.col("text").cast("binary"))
    coded = stage(rows.mapInArrow(coder, f"doc_id {kind}, codes binary"))
    weights = term_weights(coded, len(bench.vocabulary) + 1)
    axes = latent_axes(coded, weights)
    shared = spark.sparkContext.broadcast((weights, axes, bench.items))
    search, schema = _searcher(shared, kind)
    names = spark.createDataFrame(list(enumerate(bench.ids)), f"item int, item_id {item_kind}")
    found = coded.mapInArrow(search, schema).join(F.broadcast(names), "item")  # at most MAX_ITEMS rows
    return found.select("doc_id", "item_id", "common", "answer", "cosine", "start", "end")
