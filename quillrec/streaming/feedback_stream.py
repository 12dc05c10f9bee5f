"""Structured Streaming over feedback: parsing, live profiles in keyed state, counters, live recommendations."""

from __future__ import annotations

from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillrec.operators.feedback import (
    LIST_LENGTH,
    NEGATIVE,
    POSITIVE,
    RECENT_LENGTH,
    VALID_TYPES,
    live_recommendations,
    seed_weights,
)

STATE_TTL_MS = 3_600_000
MESSAGE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("recipe_id", T.StringType()),
        T.StructField("movie_id", T.StringType()),
        T.StructField("feedback_type", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("feedback_value", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
    ]
)


def read_messages(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Stream of raw messages as one `value` text column.

    source "kafka" takes the usual subscribe and kafka.bootstrap.servers options (its connector must
    be on the class path); any other source is a file format that yields `value` lines, e.g. "text".
    """
    reader = spark.readStream.format(source).options(**options)
    raw = reader.load()
    return raw.select(F.col("value").cast("string").alias("value"))


def parse_messages(raw: DataFrame) -> DataFrame:
    """Typed events plus `problem`: null for good rows, else why the row must be dropped.

    A valid row has integer user and item ids (recipe_id, else movie_id). Type is feedback_type,
    else event_type, lower-cased. A missing creation time becomes the processing time.
    """
    parsed = raw.select("value", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("m"))
    user = F.col("m.user_id").try_cast("long")
    item = F.coalesce("m.recipe_id", "m.movie_id").try_cast("long")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = F.lower(F.trim(F.coalesce(blank("m.feedback_type"), blank("m.event_type"), F.lit(""))))
    created = F.coalesce(F.try_to_timestamp(F.col("m.created_at")), F.current_timestamp())
    problem = F.when(
        F.col("m").isNull() | (F.col("m.user_id").isNull() & item.isNull()), "not an event"
    ).when(user.isNull() | item.isNull(), "bad id")
    return parsed.select(
        F.col("m.event_id").alias("event_id"),
        user.alias("user_id"),
        item.alias("item_id"),
        kind.alias("feedback_type"),
        F.col("m.feedback_value").alias("feedback_value"),
        created.alias("created_at"),
        F.unix_micros(created).alias("ts"),
        problem.alias("problem"),
        "value",
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull()).drop("problem", "value")


def with_known_type(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, rejected) by feedback type."""
    known = F.col("feedback_type").isin(*VALID_TYPES)
    return events.where(known), events.where(~known)


# --- keyed state -----------------------------------------------------------------------------------

EVENT_KEY = ["ts", "event_id"]
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("recent_events", T.ArrayType(T.LongType())),
        T.StructField("recent_items", T.ArrayType(T.LongType())),
        T.StructField("recent_types", T.ArrayType(T.StringType())),
        T.StructField("recent_values", T.ArrayType(T.DoubleType())),
        T.StructField("positive_items", T.ArrayType(T.LongType())),
        T.StructField("negative_items", T.ArrayType(T.LongType())),
        T.StructField("updated_ts", T.LongType()),
    ]
)
STATE_SCHEMA = ", ".join(
    f"{name} array<{kind}>"
    for name, kind in (
        ("ts", "bigint"), ("event_id", "bigint"), ("item_id", "bigint"), ("feedback_type", "string"), ("value", "double"),
        *((f"{part}_{name}", "bigint") for part in ("positive", "negative") for name in ("ts", "event_id", "item_id")),
    )
)
MERGED_ROWS = 1_000  # events of a user that are merged at a time


def newest(events: list[tuple], n: int) -> list[tuple]:
    """The n newest of events (ts, event_id, ...), newest first."""
    return sorted(events, key=itemgetter(0, 1), reverse=True)[:n]


def newest_items(events: list[tuple], n: int) -> list[tuple]:
    """Last event (ts, event_id, item_id) of each item, newest first: what moving an item to the front of a list amounts to."""
    last: dict = {}
    for event in sorted(events, key=itemgetter(0, 1), reverse=True):
        last.setdefault(event[2], event)
    return list(last.values())[:n]


def columns(events: list[tuple], width: int) -> list[list]:
    return [list(x) for x in zip(*events, strict=True)] if events else [[] for _ in range(width)]


class LiveProfile(StatefulProcessor):
    """Per user: 50 newest events and up to 100 distinct positive and negative items, newest first.

    State holds bounded lists with their event keys, so the result does not depend on how events
    are cut into batches or ordered within one. State of an idle user expires after the TTL. A user costs one reading and
    one writing of one state value a batch.
    """

    def __init__(self, ttl_ms: int | None = STATE_TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lists = handle.getValueState("lists", STATE_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        state = self.lists.get() or [[]] * 11
        recent, positive, negative = (list(zip(*state[a:b], strict=True)) for a, b in ((0, 5), (5, 8), (8, 11)))
        rows = iter(rows)
        while some := list(islice(rows, MERGED_ROWS)):  # merged piece by piece, so memory stays bounded
            events = [(r["ts"], r["event_id"], r["item_id"], r["feedback_type"], r["feedback_value"]) for r in some]
            recent = newest(recent + events, RECENT_LENGTH)
            positive = newest_items(positive + [e[:3] for e in events if e[3] in POSITIVE], LIST_LENGTH)
            negative = newest_items(negative + [e[:3] for e in events if e[3] in NEGATIVE], LIST_LENGTH)
        lists = [*columns(recent, 5), *columns(positive, 3), *columns(negative, 3)]
        self.lists.update(tuple(lists))
        yield Row(
            user_id=key[0], recent_events=lists[1], recent_items=lists[2], recent_types=lists[3], recent_values=lists[4],
            positive_items=lists[7], negative_items=lists[10], updated_ts=recent[0][0],
        )

    def close(self) -> None:
        pass


def live_profile_stream(events: DataFrame, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Updated profile of every user with new events in the batch."""
    wanted = events.select("user_id", "item_id", "feedback_type", "feedback_value", "ts", "event_id")
    return wanted.groupBy("user_id").transformWithState(
        statefulProcessor=LiveProfile(ttl_ms),
        outputStructType=PROFILE_SCHEMA,
        outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


# --- sinks -------------------------------------------------------------------------------------------


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", transform=None, **trigger):
    """Write each micro-batch to its own folder <path>/batch_id=<n>; a repeated batch overwrites itself.

    The default trigger drains the source and stops. State with a TTL keeps scheduling batches to
    expire itself, so such a stream needs a standing trigger (processingTime="10 seconds").
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_per_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest row per key over the batch folders."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (key, "batch_id")]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return best.select(key, "r.*")


def profile_seeds(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, blocked) of live recommendations from a table of profiles."""
    arrays = F.arrays_zip(
        F.col("recent_items").alias("item_id"),
        F.col("recent_types").alias("feedback_type"),
        F.col("recent_values").alias("feedback_value"),
    )
    recent = profiles.select("user_id", F.posexplode(arrays).alias("p", "e")).select(
        "user_id",
        F.col("e.item_id"),
        F.col("e.feedback_type"),
        F.col("e.feedback_value"),
        (F.col("p") + 1).alias("rn"),
    )
    positives = profiles.select("user_id", F.posexplode("positive_items").alias("p", "item_id")).select(
        "user_id", "item_id", (F.col("p") + 1).alias("rn")
    )
    weighted = seed_weights(recent, positives)
    disliked = profiles.select("user_id", F.explode("negative_items").alias("item_id"))
    return weighted, weighted.select("user_id", "item_id").unionByName(disliked).distinct()


def live_lists(profiles: DataFrame, similar: DataFrame, k: int = 20) -> DataFrame:
    """Live recommendations of the users in `profiles`, from a precomputed neighbour table."""
    seeds, blocked = profile_seeds(profiles)
    return live_recommendations(seeds, blocked, similar, k)


def replacing_lists(profiles: DataFrame, similar: DataFrame, k: int = 20) -> DataFrame:
    """Live lists for a sink that keeps each user's newest list: a user without one gets a row without an item."""
    return profiles.select("user_id").distinct().join(live_lists(profiles, similar, k), "user_id", "left")


def windowed_rates(events: DataFrame, size: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Clicks, likes, dislikes and their share of events per sliding window; late rows within the delay count."""
    kind = F.col("feedback_type")
    counted = (
        events.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", size, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "like").alias("likes"),
            F.count_if(kind.isin(*NEGATIVE)).alias("dislikes"),
        )
    )
    rate = lambda c: F.round(F.col(c) / F.col("events"), 6).alias(f"{c}_rate")
    return counted.select(
        F.unix_seconds("w.start").alias("window_start"),
        F.unix_seconds("w.end").alias("window_end"),
        "events",
        "clicks",
        "likes",
        "dislikes",
        rate("clicks"),
        rate("likes"),
        rate("dislikes"),
    )
