"""Dense global ranks and exact quantiles that never pull the data into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrec.session import stage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
CHUNK = 32  # cuts of a chunk; CHUNK * CHUNK cuts part the distinct values of a key
SKETCH_ACCURACY = 20 * CHUNK * CHUNK
HASH_RANGES = 1 << 16


def with_global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Add the 1-based position of every row under a total order.

    A range sort numbers rows inside each partition; one small aggregate (a row per partition)
    gives the offsets. The numbered rows are staged in between, so a lost executor cannot
    change the range boundaries the offsets were counted for.
    """
    numbered = stage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", ROW_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the sort
        .withColumn(rank, (F.col("_offset") + within + 1).cast("long"))
        .drop("_part", "_mid", "_offset")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as (keys, q, quantile) rows.

    Values are counted. A mergeable quantile sketch of each key's distinct values gives cuts of about equal depth, so no
    bucket between two cuts holds more than a small part of them, however they are spread; only the buckets that hold a
    wanted rank are ordered. Map-side counting keeps repeated values and hot keys cheap.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    everywhere = F.lit(1).alias("_all")
    counts = stage(counts.select(everywhere, *keys, "_v", "_c"))
    keys = ["_all", *keys]
    points_cut = F.array(*[F.lit((i + 1) / (CHUNK * CHUNK + 1)) for i in range(CHUNK * CHUNK)])
    sketch = F.percentile_approx("_v", points_cut, SKETCH_ACCURACY)
    spans = counts.groupBy(*keys).agg(F.array_sort(F.array_distinct(sketch)).alias("_cuts"), F.sum("_c").alias("_total"))
    ends = F.filter("_cuts", lambda c, i: i % CHUNK == CHUNK - 1)
    spans = spans.withColumn("_ends", ends)
    # Cuts below the value: whole chunks first, then those of the chunk it falls in.
    whole = F.size(F.filter("_ends", lambda c: c < F.col("_v"))) * CHUNK
    within = F.size(F.filter(F.slice("_cuts", F.col("_b") + 1, CHUNK), lambda c: c < F.col("_v")))
    bucketed = counts.join(spans, keys).withColumn("_b", whole).withColumn("_b", F.col("_b") + within)
    bucketed = bucketed.drop("_cuts", "_ends")
    running = Window.partitionBy(*keys).orderBy("_b")
    histogram = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"), F.max("_total").alias("_total"))
        .withColumn("_upto", F.sum("_bc").over(running))  # at most CHUNK * CHUNK + 1 rows per key
    )
    # The two order statistics around each point, as 1-based ranks.
    wanted = F.array(*[F.lit(float(q)) for q in points])
    ranked = histogram.withColumn("q", F.explode(wanted)).withColumn("_pos", F.col("q") * (F.col("_total") - 1))
    ranked = ranked.withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.floor("_pos") + 1, F.ceil("_pos") + 1)))
    ).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_bc")))
    picks = ranked.select(*keys, "_b", "q", "_pos", "_rank", (F.col("_upto") - F.col("_bc")).alias("_before"))
    inside = bucketed.join(picks.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    ordered = inside.withColumn(
        "_in", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    ).select(*keys, "_b", "_v", "_c", "_in")
    local = F.col("_rank") - F.col("_before")
    statistics = ordered.join(picks, [*keys, "_b"]).where(
        (local <= F.col("_in")) & (local > F.col("_in") - F.col("_c"))
    )
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    fraction = F.max("_pos") - F.floor(F.max("_pos"))
    return (
        statistics.groupBy(*keys, "q")
        .agg((low + (high - low) * fraction).alias("quantile"))
        .drop("_all")
    )


def quantile_of(df: DataFrame, value: str, point: float) -> Column:
    """One global quantile as a scalar subquery."""
    return quantiles(df, [], value, [point]).select("quantile").scalar()


def lowest_hashes(df: DataFrame, digest: Column, ties: Sequence[Column], n: int) -> DataFrame:
    """The n rows of lowest hex digest, equal ones by `ties`.

    Rows are counted by ranges of the digest; ranges below the one that holds the n-th row are kept whole, and only the
    rows of that one, about a HASH_RANGES-th, are ordered. If n is not below the number of rows, nothing is.
    """
    ranged = df.withColumn("_range", F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = counts.withColumn("_upto", upto)  # at most HASH_RANGES rows
    edge = sums.where(F.col("_upto") > n).orderBy("_range").limit(1).collect()
    if not edge:
        return df
    edge, before = edge[0]._range, edge[0]._upto - edge[0]._n
    last = with_global_rank(ranged.where(F.col("_range") == edge), [digest, *ties], "_rank")
    last = last.where(F.col("_rank") <= n - before).drop("_rank")
    return ranged.where(F.col("_range") < edge).unionByName(last).drop("_range")


def lowest_per_label(df: DataFrame, label: str, digest: Column, ties: Sequence[Column], n: int) -> DataFrame:
    """About n rows in the proportions of the labels, at least one of each: those of lowest hex digest, equal ones by `ties`.

    Rows are counted by label and range of the digest. Ranges below the one that holds a label's last row are kept whole; only
    the rows of that one, about a HASH_RANGES-th, meet in a task and are ordered.
    """
    ranged = df.withColumn("_range", F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"))
    counts = ranged.groupBy(F.col(label).alias("_label"), "_range").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy("_label")
    upto = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.floor(F.lit(n) * F.sum("_n").over(every) / df.agg(F.count(F.lit(1))).scalar())
    sums = counts.withColumns({"_quota": F.greatest(share, F.lit(1)), "_upto": F.sum("_n").over(upto)})  # at most HASH_RANGES rows a label
    before = F.col("_upto") - F.col("_n")
    last = sums.where((F.col("_upto") >= F.col("_quota")) & (before < F.col("_quota")))
    edges = F.broadcast(last.select("_label", F.col("_range").alias("_edge"), (F.col("_quota") - before).alias("_left")))  # one row a label
    near = ranged.join(edges, F.col(label).eqNullSafe(F.col("_label"))).where(F.col("_range") <= F.col("_edge"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy(digest, *ties))
    ordered = near.where(F.col("_range") == F.col("_edge")).withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    names = df.columns
    return near.where(F.col("_range") < F.col("_edge")).select(names).unionByName(ordered.select(names))
