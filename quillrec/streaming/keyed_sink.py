"""Keyed state that expires in event time, and a compacted sink that keeps each key's newest rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec.streaming.feedback_stream import PROFILE_SCHEMA, LiveProfile

IDLE_MS = 3_600_000
EXPIRING_SCHEMA = T.StructType([*PROFILE_SCHEMA.fields, T.StructField("expired", T.BooleanType())])


class ExpiringProfile(LiveProfile):
    """A live profile that is dropped once the watermark is `idle_ms` past the user's newest event.

    One event-time timer per user moves with the newest event. When it fires, the lists are cleared and a row without
    them is sent, so that a keyed sink forgets the user, too. A user who comes back starts with empty lists.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        super().__init__(ttl_ms=None)
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues):
        for profile in super().handleInputRows(key, rows, timerValues):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(profile["updated_ts"] // 1000 + self.idle_ms)
            yield Row(**profile.asDict(), expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.lists.clear()
        row = {name: [] for name in PROFILE_SCHEMA.fieldNames()}
        yield Row(**row | {"user_id": key[0], "updated_ts": expiredTimerInfo.getExpiryTimeInMs() * 1000, "expired": True})


def expiring_profile_stream(events: DataFrame, idle_ms: int = IDLE_MS, delay: str = "10 minutes") -> DataFrame:
    """Updated or expired profile of every user concerned by a batch; events later than `delay` are dropped."""
    columns = events.withWatermark("created_at", delay).select(
        "user_id", "item_id", "feedback_type", "feedback_value", "ts", "event_id", "created_at"
    )
    return columns.groupBy("user_id").transformWithState(
        statefulProcessor=ExpiringProfile(idle_ms),
        outputStructType=EXPIRING_SCHEMA,
        outputMode="Update",
        timeMode="EventTime",
    )


@dataclass
class KeyedSink:
    """The rows of each key's newest batch, as Parquet in a shared folder.

    `delta-<n>` holds the rows of batch n, `base-<n>` all that was left after it. Every `every` batches a base is
    written, so readers open one base and fewer than `every` deltas, however long the stream has run. What the base
    before the newest already holds is deleted; the newest two generations stay for readers that have begun.
    A folder counts once its write has succeeded. A batch that is run again overwrites its delta, or is left out if
    a base holds it. Of a key whose newest rows do not meet `alive` (an SQL condition) none is left.
    """

    path: str
    key: str
    alive: str | None = None
    every: int = 10

    def _files(self, spark: SparkSession):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root

    def _complete(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers of the folders whose write has succeeded, by kind."""
        files, root = self._files(spark)
        found: dict[str, list[int]] = {"base": [], "delta": []}
        for status in files.listStatus(root) if files.exists(root) else []:
            kind, _, number = status.getPath().getName().partition("-")
            marker = status.getPath().suffix("/_SUCCESS")
            if kind in found and number.isdigit() and files.exists(marker):
                found[kind].append(int(number))
        return found

    def folders(self, spark: SparkSession) -> list[str]:
        """The folders that a reader opens."""
        found = self._complete(spark)
        base = max(found["base"], default=-1)
        deltas = [f"{self.path}/delta-{n}" for n in sorted(found["delta"]) if n > base]
        return ([f"{self.path}/base-{base}"] if base >= 0 else []) + deltas

    def _newest(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(*self.folders(spark))
        newest = F.max("batch_id").over(Window.partitionBy(self.key))
        rows = rows.withColumn("newest", newest).where("batch_id = newest").drop("newest")
        return rows.where(self.alive) if self.alive else rows

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._newest(spark).drop("batch_id")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = max(self._complete(spark)["base"], default=-1)
        if batch_id <= base:
            return
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id}")
        if batch_id - base >= self.every:
            self._newest(spark).write.mode("overwrite").parquet(f"{self.path}/base-{batch_id}")
            self._delete_before(spark, base)

    def _delete_before(self, spark: SparkSession, base: int) -> None:
        files, root = self._files(spark)
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = self._complete(spark)
        old = [f"delta-{n}" for n in found["delta"] if n <= base] + [f"base-{n}" for n in found["base"] if n < base]
        for name in old:
            files.delete(jvm_path(root, name), True)


def write_keyed(
    stream: DataFrame,
    sink: KeyedSink,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
):
    """Start a query that keeps `sink` up to date; started again with the same checkpoint it goes on where it ended.

    The default trigger drains the source and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(transform(batch) if transform else batch, batch_id)

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
