"""N-gram Jaccard join with count-vector R-trees.

The shingles of a document are hashed into groups; how many fall into each group makes it a point. Two documents
share at most the sum of the smaller coordinates, so a tree of boxes over the points (sizes and greatest coordinates
of what lies below) leaves out whatever cannot reach the wanted overlap. What survives is compared shingle by shingle.

One tree for all documents would have boxes that hold nearly everything, so a forest stands over blocks: any two
similar documents share one of their rarest shingles (as many as could differ, and one), and each shingle is a block.
Equal sets are joined first. Then each document looks for its best partner in the blocks of its two least shingle
hashes, which gathers most groups of copies. After that only blocks with different components remain; there each
document looks for its best partner once more, and in what is then left every surviving pair across components is
compared, so no link between components is lost. Survivors of a tree are bounded again by finer points before they
leave the task, and their texts are compared last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.llm.components import components
from quillrec.llm.shards import (
    PACKED,
    SHARDS_PER_PART,
    deltas,
    filter_bits,
    gathered,
    groups,
    id_key,
    may_hold,
    packed,
    parts_for,
    scattered,
)
from quillrec.llm.words import hashed_words, mixed, run_hashes, with_words
from quillrec.operators.skew import salted_join
from quillrec.session import stage

GROUPS = 64  # coordinates of a point
KINDS = ("<u1", "<u2", "<u4")
FANOUT = 16
KEYS = 2  # least hashes whose blocks are searched first
BLOCK_ROWS = 4_000  # rows of a block in one task; larger blocks are cut
AT_ONCE = 50_000  # pairs whose bounds are computed at once
GROUP_WORDS = 1_000_000
HELD_BYTES = 16_000_000  # of points taken apart at once
COMPARED = 200  # pairs of texts unpacked at once
BYTES_PER_PART = 24_000_000
FREQUENCY_GROUPS = 1 << 22
MAX_FREQUENT = 200_000
SALT = np.uint64(0x2545F4914F6CDD1D)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle, an empty one none."""
    return np.unique(run_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def fine_groups(n: int) -> int:
    """Coordinates of the finer point of a document of n shingles: a power of two, two to four shingles each."""
    return max(GROUPS, 1 << (max(1, n) // 4).bit_length())


def _point(hashes: np.ndarray, groups_: int) -> bytes:
    """Shingles in each group: half a byte each, or one, two or four bytes as the greatest needs."""
    counts = np.bincount(hashes % np.uint64(groups_), minlength=groups_)
    if counts.max() < 16:
        return (counts[0::2] | counts[1::2] << 4).astype("u1").tobytes()
    return counts.astype(KINDS[np.searchsorted([1 << 8, 1 << 16], counts.max(), side="right")]).tobytes()


def _opened(data: list[bytes], coordinates: int) -> np.ndarray:
    """Counts (n, coordinates) of points of one width."""
    joined = b"".join(data)
    width = len(data[0]) // coordinates
    if width:
        return np.frombuffer(joined, f"<u{width}").reshape(len(data), coordinates).astype(np.int32)
    halves = np.frombuffer(joined, "u1").reshape(len(data), -1)
    return np.stack([halves & 15, halves >> 4], axis=2).reshape(len(data), coordinates).astype(np.int32)


def _points(fine: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points of GROUPS coordinates: the finer ones, whose number of coordinates is a multiple of it, folded."""
    out = np.empty((len(fine), GROUPS), np.uint32)
    wide = np.array([fine_groups(n) for n in sizes.tolist()], np.int64)
    lengths = np.array([len(x) for x in fine], np.int64)
    for coordinates, length in {*zip(wide.tolist(), lengths.tolist(), strict=True)}:
        at = np.flatnonzero((wide == coordinates) & (lengths == length))
        rows = max(1, HELD_BYTES // (4 * coordinates))
        for some in (at[i : i + rows] for i in range(0, len(at), rows)):
            counts = _opened([fine[i] for i in some.tolist()], coordinates)
            out[some] = counts.reshape(len(some), -1, GROUPS).sum(axis=1, dtype=np.uint32)
    return out


def finer_bounds(i: np.ndarray, j: np.ndarray, fine: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Most shingles that each pair can share by its finer points; the larger point is folded onto the other."""
    wide: dict[int, np.ndarray] = {}
    held = 0

    def point(k: int) -> np.ndarray:
        nonlocal held
        if k not in wide:
            if held > HELD_BYTES:
                wide.clear()
                held = 0
            wide[k] = _opened([fine[k]], fine_groups(int(sizes[k])))[0]
            held += wide[k].nbytes
        return wide[k]

    out = np.empty(len(i), np.int64)
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        one, other = point(a), point(b)
        if len(one) > len(other):
            one = one.reshape(-1, len(other)).sum(axis=0)
        elif len(other) > len(one):
            other = other.reshape(-1, len(one)).sum(axis=0)
        out[at] = np.minimum(one, other).sum()
    return out


def _features(width: int):
    names = ["id", "n", "s1", "s2", "keys", "fine"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, keys, fine = [], [], [], [], []
            for _, words in with_words(batch, 1, lower=True):
                own = shingles(words, width)
                sizes.append(len(own))
                first.append(int(mixed(own).sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mixed(own ^ SALT).sum(dtype=np.uint64).astype(np.int64)))
                keys.append(own[:KEYS].astype(np.int64))
                fine.append(_point(own, fine_groups(len(own))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fine, pa.binary()),
                ],
                names,
            )

    return describe


class CountTree:
    """R-tree over count vectors, loaded in the order of sizes.

    A box keeps the least and greatest size and the greatest coordinates of what is below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][1]) > FANOUT:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            )

    def pairs(self, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i < j) of the tree's own points whose bound reaches the threshold, with their bounds."""
        points, sizes, _ = self.levels[0]
        out = []
        for a in range(0, len(sizes), FANOUT):
            own = np.arange(a, min(a + FANOUT, len(sizes)))
            level = len(self.levels) - 1
            nodes = len(self.levels[level][1])
            i, j = np.repeat(np.arange(nodes), len(own)), np.tile(own, nodes)
            while True:
                top, low, high = self.levels[level]
                bound = np.minimum(reach(top, i, points, j), np.minimum(high[i], sizes[j]))
                far = (100 + threshold) * bound >= threshold * (low[i] + sizes[j])
                i, j, bound = i[far], j[far], bound[far]
                if level == 0:
                    break
                level -= 1
                children = i[:, None] * FANOUT + np.arange(FANOUT)
                # Points stand in the order of sizes: boxes that begin after the point itself hold no earlier one.
                first = children * FANOUT**level
                real = (children < len(self.levels[level][1])) & (first < j[:, None])
                i, j = children[real], np.repeat(j, real.sum(axis=1))
            earlier = i < j
            out.append((i[earlier], j[earlier], bound[earlier]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def reach(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates of a[i] and b[j]."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        out[part] = np.minimum(a[i[part]], b[j[part]]).sum(axis=1, dtype=np.int64)
    return out


def survivors(
    block: np.ndarray, points: np.ndarray, sizes: np.ndarray, threshold: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, bound) within blocks; rows come by block, then size. Small blocks are one leaf each."""
    _, first, group = groups(block)
    counts = np.diff(np.append(first, len(block)))
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0, np.int64))]
    small = counts[group] <= FANOUT
    for step in range(1, FANOUT):
        i = np.flatnonzero(small[: len(block) - step] & (group[: len(block) - step] == group[step:]))
        if not len(i):
            break
        near = (100 + threshold) * sizes[i] >= threshold * (sizes[i] + sizes[i + step])
        i = i[near]
        bound = reach(points, i, points, i + step)
        far = (100 + threshold) * bound >= threshold * (sizes[i] + sizes[i + step])
        out.append((i[far], i[far] + step, bound[far]))
    for at, n in zip(first[counts > FANOUT].tolist(), counts[counts > FANOUT].tolist(), strict=True):
        i, j, bound = CountTree(points[at : at + n], sizes[at : at + n]).pairs(threshold)
        out.append((i + at, j + at, bound))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(threshold: int, best: bool):
    """Surviving pairs (a, b) across components; with `best` only each row's closest earlier partner."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pa.Table.from_batches(list(batches), pa.schema(BLOCK_FIELDS)).combine_chunks()
        if not len(tables):
            return
        key, low, high, chunk, ids, sizes, component = (tables.column(i).to_numpy() for i in range(7))
        fine = tables.column(7).to_pylist()
        points = _points(fine, sizes)
        order = np.lexsort((ids, sizes, high, low, key))
        key, low, high, chunk, ids, sizes, component = (
            x[order] for x in (key, low, high, chunk, ids, sizes, component)
        )
        block = np.zeros(len(ids), np.int64)
        block[1:] = np.cumsum((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        i, j, bound = survivors(block, points[order], sizes, threshold)
        # Of a block that was cut in two, each half's own pairs belong to another task.
        wanted = (component[i] != component[j]) & ((low[i] == high[i]) | (chunk[i] != chunk[j]))
        i, j, bound = i[wanted], j[wanted], bound[wanted]
        if best:
            closest = np.lexsort((-bound / (sizes[i] + sizes[j]), j))
            i, j = i[closest], j[closest]
            first = np.ones(len(j), bool)
            first[1:] = j[1:] != j[:-1]
            i, j = i[first], j[first]
        bound = finer_bounds(i, j, [fine[k] for k in order.tolist()], sizes)
        near = (100 + threshold) * bound >= threshold * (sizes[i] + sizes[j])
        i, j = i[near], j[near]
        pairs = np.unique(np.stack([ids[j], ids[i]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return search


BLOCKS = "key long, low int, high int, chunk int, id long, n long, component long, fine binary"
BLOCK_FIELDS = [
    ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("chunk", pa.int32()),
    ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("fine", pa.binary()),
]


def _frequencies(width: int):
    """Groups of shingle hashes that are far more frequent than others in a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(FREQUENCY_GROUPS, np.int64), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                counts[:] += np.bincount(np.concatenate(held) % np.uint64(FREQUENCY_GROUPS), minlength=FREQUENCY_GROUPS)
            held, size = [], 0

        for batch in batches:
            for _, words in with_words(batch, 0, lower=True):
                held.append(shingles(words, width) >> np.uint64(8))
                size += len(held[-1])
                if size >= GROUP_WORDS:
                    add()
        add()
        found = np.flatnonzero(counts >= 8 + 4 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["g", "c"])

    return count


def frequent_groups(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of frequent shingles and their counts, at most MAX_FREQUENT; only the order of shingles rests on it."""
    found = docs.select(F.col("text").cast("binary")).mapInArrow(_frequencies(width), "g long, c long")
    rows = found.groupBy("g").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(MAX_FREQUENT).toArrow()
    order = np.argsort(rows.column("g").to_numpy())
    return rows.column("g").to_numpy()[order].astype(np.uint64), rows.column("c").to_numpy()[order]


def rarest(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: int) -> np.ndarray:
    """As many of the rarest shingles as a similar document could lack, and one."""
    wanted = len(own) - -(-threshold * len(own) // 100) + 1
    where, counts = frequent
    rank = np.zeros(len(own), np.int64)
    if len(where):
        group = (own >> np.uint64(8)) % np.uint64(FREQUENCY_GROUPS)
        at = np.minimum(np.searchsorted(where, group), len(where) - 1)
        rank = np.where(where[at] == group, counts[at], 0)
    return own[np.lexsort((own, rank))[:wanted]]


def _rarest(width: int, threshold: int, shards: int, shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, size = shared.value, [], 0

        def emit() -> pa.RecordBatch:
            tokens = np.concatenate([x for _, x in held] or [np.empty(0, np.uint64)])
            ids = np.repeat(np.array([x for x, _ in held], np.int64), [len(x) for _, x in held])
            shard = ((tokens >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
            return packed([(s, t.astype("<u8").tobytes(), deltas(d)) for s, (t, d) in scattered(shard, tokens, ids)])

        for batch in batches:
            for row, words in with_words(batch, 1, lower=True):
                own = shingles(words, width)
                if len(own):
                    held.append((row[0], rarest(own, frequent, threshold)))
                    size += len(held[-1][1])
                if size >= GROUP_WORDS:
                    yield emit()
                    held, size = [], 0
        yield emit()

    return find


def _shared_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of the shingles that more than one document sent."""
    _, tokens, ids = gathered(batches, "<u8")
    order, first, group = groups(tokens)
    tokens, ids = tokens[order], ids[order]
    often = np.diff(np.append(first, len(tokens)))[group] > 1 if len(tokens) else np.empty(0, bool)
    tokens, ids = tokens[often].astype(np.int64), ids[often]
    for at in range(0, len(ids), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[part]), pa.array(ids[part])], ["key", "id"])


def _compare(width: int, threshold: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in (x.slice(at, COMPARED) for x in batches for at in range(0, x.num_rows, COMPARED)):
            linked = []
            for (_, b, _, other), words in with_words(batch, 2, lower=True):
                if last != b:
                    last, last_set = b, shingles(hashed_words([other or b""], lower=True)[0], width)
                own = shingles(words, width)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                linked.append(100 * both >= threshold * (len(own) + len(last_set) - both))
            keep = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    return compare


def linked(docs: DataFrame, pairs: DataFrame, rows: int, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, staged."""
    pairs = stage(pairs.distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    wanted = docs.where(may_hold(docs.sparkSession, filter_bits(ids, rows), id_key()))
    wanted = wanted.select(id_key().alias("id"), F.col("text").cast("binary").alias("text"))
    one = wanted.select(F.col("id").alias("a"), F.col("text").alias("one"))
    other = wanted.select(F.col("id").alias("b"), F.col("text").alias("other"))
    texts = pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other")
    return stage(texts.mapInArrow(_compare(width, threshold), "a long, b long"))


def _cut(blocks: DataFrame, sizes: DataFrame, crossed: bool) -> DataFrame:
    """Blocks (key, id, n, component, fine) with parts of large ones: `sizes` has (key, rows) of those.

    With `crossed` every two parts of a block meet; else each part is searched alone.
    """
    parts = F.ceil(F.coalesce("rows", F.lit(0)) / BLOCK_ROWS).cast("int")
    chunk = F.pmod(F.xxhash64("id", "key"), F.greatest(parts, F.lit(1))).cast("int")
    rows = salted_join(blocks, sizes, "key", "left").withColumn("chunk", chunk)
    cells = F.array(F.struct(F.col("chunk").alias("low"), F.col("chunk").alias("high")))
    if crossed:
        others = F.transform(
            F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1),
            lambda x: F.struct(F.least("chunk", x).alias("low"), F.greatest("chunk", x).alias("high")),
        )
        cells = F.when(parts > 1, others).otherwise(cells)
    rows = rows.withColumn("cell", F.explode(cells))
    return rows.select("key", "cell.low", "cell.high", "chunk", "id", "n", "component", "fine")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """(id, n_shingles, component) of every row of `docs` (doc_id, text): groups linked by similar word shingles.

    A document's set has the distinct runs of `width` words `[^\\x20\\x09-\\x0D]+` of its text with A-Z lower-cased;
    with fewer words the whole sequence is its one member; null or empty texts have an empty set and stay alone.
    Two documents link if 100 * common >= threshold * all of their members. The component is the least doc_id in
    reach. `id` stands for doc_id, with the least long for null; rows of one doc_id are one document and are expected
    to have one text. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("id"), F.col("text").cast("binary").alias("text"))
    kinds = "id long, n long, s1 long, s2 long, keys array<long>, fine binary"
    features = stage(rows.mapInArrow(_features(width), kinds).withColumn("sets", F.concat_ws("/", "s1", "s2")))
    count = features.count()
    first = features.where("n > 0").groupBy("sets").agg(F.min("id").alias("rep"))
    members = salted_join(features.select("id", "n", "sets"), first, "sets", "left")
    members = stage(members.select("id", "n", F.coalesce("rep", "id").alias("rep")))
    points = features.where("n > 0").select("id", "n", "fine", "keys")
    points = points.join(members.where("id = rep").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    points = stage(points)

    def searched(blocks: DataFrame, large: DataFrame, best: bool) -> DataFrame:
        cut = _cut(blocks, large.where(F.col("rows") > BLOCK_ROWS), crossed=not best).repartition("key", "low", "high")
        near = cut.mapInArrow(_search(threshold, best), "a long, b long")
        return linked(docs, near, count, width, threshold)

    blocks = points.select("id", "n", F.col("id").alias("component"), "fine", F.explode("keys").alias("key"))
    links = searched(blocks, blocks.groupBy("key").agg(F.count("*").alias("rows")), best=True)

    parts = parts_for(docs, BYTES_PER_PART)
    frequent = spark.sparkContext.broadcast(frequent_groups(docs, width))
    found = rows.mapInArrow(_rarest(width, threshold, SHARDS_PER_PART * parts, frequent), PACKED)
    found = stage(found.repartition(parts, "shard").mapInArrow(_shared_shingles, "key long, id long"))
    for best in (True, False):
        known = points.select("id").join(components(links), "id", "left")
        placed = found.join(known.select("id", F.coalesce("component", "id").alias("component")), "id")
        open_blocks = placed.groupBy("key").agg(
            F.min("component").alias("least"), F.max("component").alias("greatest"), F.count("*").alias("rows")
        )
        open_blocks = stage(open_blocks.where("least < greatest").select("key", "rows"))
        found = stage(salted_join(found, open_blocks.select("key", F.lit(True).alias("open")), "key").drop("open"))
        blocks = found.join(known.select("id", F.coalesce("component", "id").alias("component")), "id")
        blocks = blocks.join(points.select("id", "n", "fine"), "id")
        blocks = blocks.select("id", "n", "component", "fine", "key")
        links = links.unionByName(searched(blocks, open_blocks, best))
    found = components(links).withColumnRenamed("id", "rep")
    return members.join(found, "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component")
    )
