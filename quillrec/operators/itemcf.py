"""Item co-occurrence recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.operators.skew import dealt, salted_join
from quillrec.operators.topk import top_k
from quillrec.session import stage

LIKED = 4.0
CHUNK = 100  # likes of a user that are paired in one row
TASK_LIKES = 50_000  # likes whose neighbours meet in one task
PART = 10_000  # users whose likes are counted for an item in one task
TOP_SIMILAR = 50
SCORE_DIGITS = 6


def liked_pairs(train: DataFrame, min_rating: float = LIKED, max_liked: int | None = None) -> DataFrame:
    """Distinct (user, item) with a rating of at least `min_rating`; with `max_liked`, of each user's best so many."""
    liked = train.where(F.col("rating") >= min_rating)
    if max_liked is None:
        return liked.select("user_id", "item_id").distinct()
    order = [F.desc("rating"), F.desc("ts"), F.desc("item_id")]
    return top_k(liked, ["user_id"], order, max_liked).select("user_id", "item_id").distinct()


def _packed_likes(liked: DataFrame) -> DataFrame:
    """(user_id, chunk, chunks, likes): each user's liked items and their like counts, in chunks of about CHUNK."""
    counts = liked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = liked.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = salted_join(liked, counts, "item_id").join(sizes, "user_id")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.col("chunks")).cast("int"))
    entries = F.array_sort(F.collect_list(F.struct("item_id", "n")))
    return dealt.groupBy("user_id", "chunk").agg(F.first("chunks").alias("chunks"), entries.alias("likes"))


def cooccurrence(liked: DataFrame) -> DataFrame:
    """(item_i, item_j, common, n_i, n_j) for i < j: users who like both, and who like each.

    Each user's likes are dealt into chunks of about CHUNK, and pairs are produced in place, within a chunk and
    between two: no row holds or makes more than a few chunks' worth, however many likes a user has, and the
    counts combine before the shuffle. The like count of an item travels with it.
    """
    packed = _packed_likes(liked)
    first = packed.select("likes", F.posexplode("likes").alias("pos", "a"))
    within = first.select("a", F.explode(F.slice("likes", F.col("pos") + 2, F.size("likes"))).alias("b"))
    # Each chunk is sent to meet every later chunk of its user.
    heavy = packed.where("chunks > 1")
    early = heavy.where("chunk < chunks - 1").select(
        "user_id", "likes", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk")
    )
    late = heavy.select("user_id", "chunk", F.col("likes").alias("others"))
    across = early.join(late, ["user_id", "chunk"]).select(F.explode("likes").alias("x"), "others")
    across = across.select("x", F.explode("others").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within.unionByName(across).groupBy(
        F.col("a.item_id").alias("item_i"),
        F.col("b.item_id").alias("item_j"),
        F.col("a.n").alias("n_i"),
        F.col("b.n").alias("n_j"),
    ).agg(F.count(F.lit(1)).alias("common"))


def _flat(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and joined values of a list column."""
    column = batch.column(at)
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """First place of every run of equal keys."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def _within(group: np.ndarray) -> np.ndarray:
    """Place of each entry in its group; groups stand together."""
    starts = _runs(group)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _order(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by group and id."""
    if not len(ids):
        return np.zeros(0, np.int64)
    low = int(ids.min())
    span = int(ids.max()) - low + 1
    if (int(group.max()) + 1) * span < 1 << 62:
        return np.argsort(group * span + (ids - low))  # one key is sorted several times faster than two
    return np.lexsort((ids, group))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _neighbours_of(k: int):
    """Rows (item_id, part, n, parts, ids, counts of likes), ordered by the first two: likes counted by item and part.

    The last item of a batch is held, counted, until its next rows have come.
    """

    def emitted(keys: np.ndarray, group, ids, likes, common) -> pa.RecordBatch:
        """Of each item in `keys` its k closest ones; of an item in several parts all, with counts for likeness."""
        several = keys[group, 3] > 1
        likeness = common / np.sqrt(keys[group, 2].astype(float) * likes)
        order = np.lexsort((ids, -likeness, group))
        order = order[several[order] | (_within(group[order]) < k)]
        sizes = np.bincount(group[order], minlength=len(keys))
        values = np.where(several, common, likeness)[order]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(keys[:, c]) for c in (0, 2, 3)), _lists(ids[order], sizes), _lists(likes[order], sizes), _lists(values, sizes)],
            ["item_id", "n", "parts", "ids", "likes", "similarity"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros((0, 4), np.int64)
        held = [np.zeros(0, np.int64)] * 4  # group, id, its likes, common
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            if not len(rows):
                continue
            sizes, ids = _flat(batch, 4)
            likes = _flat(batch, 5)[1]
            every = np.concatenate([keys, rows])
            starts = _runs(every[:, 0], every[:, 1])
            group_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(every))))[len(keys) :]
            keys, group = every[starts], np.repeat(group_of, sizes)
            other = ids != keys[group, 0]
            group, ids, likes, common = (
                np.concatenate([old, new[other]]) for old, new in zip(held, (group, ids, likes, np.ones_like(ids)), strict=True)
            )
            order = _order(group, ids)
            group, ids, likes = group[order], ids[order], likes[order]
            first = _runs(group, ids)
            common = np.add.reduceat(common[order], first) if len(first) else common
            group, ids, likes = group[first], ids[first], likes[first]
            done = np.searchsorted(group, len(keys) - 1)
            yield emitted(keys[:-1], group[:done], ids[:done], likes[:done], common[:done])
            keys = keys[-1:]
            held = [np.zeros(len(group) - done, np.int64), ids[done:], likes[done:], common[done:]]
        if len(keys):
            yield emitted(keys, *held)

    return count


def neighbours(liked: DataFrame, k: int = TOP_SIMILAR) -> DataFrame:
    """(item_id, ids, similarity): of every item the k most similar ones, best first, and how similar, as two arrays.

    An item is sent one row for each chunk of likes of each user who likes it, and its pairs are counted where the rows
    arrive, so pairs never move. The rows of an item with more than PART users go to several tasks; only its counts move.
    """
    packed = _packed_likes(liked)
    several = packed.where("chunks > 1")
    early = several.select(
        "user_id", F.col("likes").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    across = early.join(several.select("user_id", "chunk", "likes"), ["user_id", "chunk"])
    alone = packed.where("chunks = 1").select("user_id", F.col("likes").alias("own"), "likes")
    sent = alone.unionByName(across.select("user_id", "own", "likes")).select("user_id", F.explode("own").alias("a"), "likes")
    parts = F.ceil(F.col("a.n") / PART)
    rows = sent.select(
        F.col("a.item_id").cast("long").alias("item_id"),
        F.pmod(F.xxhash64("user_id"), parts).cast("long").alias("part"),
        F.col("a.n").alias("n"),
        parts.cast("long").alias("parts"),
        F.col("likes.item_id").cast("array<long>").alias("ids"),
        F.col("likes.n").alias("counts"),
    )
    counted = (
        rows.repartition("item_id", "part")
        .sortWithinPartitions("item_id", "part")
        .mapInArrow(
            _neighbours_of(k),
            "item_id long, n long, parts long, ids array<long>, likes array<long>, similarity array<double>",
        )
    )
    counted = stage(counted.where(F.size("ids") > 0))
    whole = counted.where("parts = 1").select("item_id", "ids", "similarity")
    pieces = counted.where("parts > 1").select("item_id", "n", F.explode(F.arrays_zip("ids", "likes", "similarity")).alias("x"))
    totals = pieces.groupBy("item_id", "n", F.col("x.ids").alias("id"), F.col("x.likes").alias("likes")).agg(
        F.sum("x.similarity").alias("common")
    )
    likeness = F.col("common") / F.sqrt(F.col("n").cast("double") * F.col("likes"))
    best = top_k(totals.withColumn("similarity", likeness), ["item_id"], [F.desc("similarity"), F.asc("id")], k)
    lists = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "similarity"))).alias("x"))
    return whole.unionByName(
        lists.select("item_id", F.col("x.id").alias("ids"), F.col("x.similarity").alias("similarity"))
    )


def similar_items(liked: DataFrame, k: int = TOP_SIMILAR) -> DataFrame:
    """(item_id, similar_id, similarity): the k most similar items of every item."""
    each = neighbours(liked, k).select("item_id", F.explode(F.arrays_zip("ids", "similarity")).alias("x"))
    return each.select("item_id", F.col("x.ids").alias("similar_id"), F.col("x.similarity").alias("similarity"))


def _best_sums(top_n: int):
    """Rows (user_id, seen id, ids, values), ordered by user: each user's top_n ids by their sum of values; none seen.

    A seen id counts as the value -inf; rows without lists only tell of a seen id.
    The last user of a batch is held, summed, until its next rows have come.
    """

    def emitted(users: np.ndarray, group, ids, sums) -> pa.RecordBatch:
        scores = np.floor(sums * 10.0**SCORE_DIGITS + 0.5) / 10.0**SCORE_DIGITS
        order = np.lexsort((ids, -scores, group))
        order = order[scores[order] > -np.inf]
        order = order[_within(group[order]) < top_n]
        return pa.RecordBatch.from_arrays(
            [pa.array(users[group[order]]), pa.array(ids[order]), pa.array(scores[order])], ["user_id", "item_id", "score"]
        )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users = np.zeros(0, np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # group, id, sum
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, ids = _flat(batch, 2)
            every = np.concatenate([users, batch.column(0).to_numpy()])
            starts = _runs(every)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(every))))[len(users) :]
            users = every[starts]
            own = batch.column(1).to_numpy()
            new = [(np.repeat(group, sizes), ids, _flat(batch, 3)[1]), (group, own, np.full(len(own), -np.inf))]
            group, ids, values = (np.concatenate(parts) for parts in zip(held, *new, strict=True))
            order = _order(group, ids)
            group, ids = group[order], ids[order]
            first = _runs(group, ids)
            sums = np.add.reduceat(values[order], first)
            group, ids = group[first], ids[first]
            done = np.searchsorted(group, len(users) - 1)
            yield emitted(users, group[:done], ids[:done], sums[:done])
            users = users[-1:]
            held = [np.zeros(len(group) - done, np.int64), ids[done:], sums[done:]]
        if len(users):
            yield emitted(users, *held)

    return best


def itemcf_recall(
    train: DataFrame,
    top_n: int = 50,
    min_rating: float = LIKED,
    max_liked: int | None = None,
    k_similar: int = TOP_SIMILAR,
) -> DataFrame:
    """Top unseen items per user by summed similarity to the user's likes.

    The neighbours of each like move to the user as one row of arrays, with the liked item itself as seen, and are summed
    where they arrive. Other seen items move alone.
    """
    liked = stage(liked_pairs(train, min_rating, max_liked))
    likes = salted_join(liked, neighbours(liked, k_similar), "item_id", "left").select("user_id", "item_id", "ids", "similarity")
    others = train if max_liked is not None else train.where(~F.coalesce(F.col("rating") >= min_rating, F.lit(False)))
    rows = likes.unionByName(others.select("user_id", "item_id"), allowMissingColumns=True)
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("user_id", "item_id")})
    best = dealt(rows, liked.count(), "user_id", task_rows=TASK_LIKES).sortWithinPartitions("user_id").mapInArrow(
        _best_sums(top_n), "user_id long, item_id long, score double"
    )
    return best.select("user_id", "item_id", F.lit("itemcf").alias("channel"), "score")
