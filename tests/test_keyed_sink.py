"""Keyed state expires, killed runs resume, and batch cuts and compaction do not change what readers see."""

import pytest
from pyspark.sql import functions as F

from quillrec.operators.feedback import live_profiles
from quillrec.streaming import feedback_stream as fs
from quillrec.streaming.keyed_sink import KeyedSink, expiring_profile_stream, write_keyed

SCHEMA = "event_id long, user_id long, item_id long, feedback_type string, feedback_value double, ts long"
HOUR = 3_600_000_000
START = 1000 * HOUR  # no event may stand at the epoch, the first watermark
NAMES = ("user_id", "recent_events", "positive_items", "negative_items")


def add(spark, folder, events):
    rows = spark.createDataFrame(events, SCHEMA).withColumn("created_at", F.timestamp_micros("ts"))
    rows.coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, files=1):
    schema = f"{SCHEMA}, created_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def drain(query):
    assert query.awaitTermination(180)


def seen(df):
    return sorted(map(str, df.select(*NAMES).collect()))


def test_idle_user_expires_and_starts_anew(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    sink = KeyedSink(str(tmp_path / "out"), "user_id", alive="not expired", every=2)

    def run():
        profiles = expiring_profile_stream(stream_of(spark, folder), idle_ms=3_600_000, delay="1 minute")
        drain(write_keyed(profiles, sink, checkpoint))
        return {r.user_id: r.recent_events for r in sink.rows(spark).collect()}

    add(spark, folder, [(1, 1, 5, "like", None, START), (2, 2, 6, "click", None, START + HOUR // 2)])
    assert run() == {1: [1], 2: [2]}
    add(spark, folder, [(3, 2, 7, "click", None, START + HOUR)])
    add(spark, folder, [(4, 3, 8, "like", None, START + HOUR * 3 // 2)])
    # The watermark is 1:29 after the start: user 1 was last seen 1:29 before it, user 2 only 0:29.
    assert run() == {2: [3, 2], 3: [4]}
    add(spark, folder, [(5, 1, 9, "dislike", None, START + 2 * HOUR - 1)])
    assert run() == {1: [5], 2: [3, 2], 3: [4]}
    add(spark, folder, [(6, 4, 9, "like", None, START + 10 * HOUR)])
    assert run() == {4: [6]}


def feedback(n):
    kinds = ["click", "like", "dislike", "seen", "rating"]
    return [(i, i % 3, (i * i) % 11, kinds[i % 5], float(i % 5), (i * 37) % 400) for i in range(n)]


def test_killed_run_resumes_with_the_same_lists(spark, tmp_path):
    folder, events = str(tmp_path / "in"), feedback(120)
    for at in range(0, 120, 20):
        add(spark, folder, events[at : at + 20])
    sink = KeyedSink(str(tmp_path / "out"), "user_id", every=2)
    calls = []

    def failing(batch):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("killed")
        return batch

    def start(transform=None):
        profiles = fs.live_profile_stream(stream_of(spark, folder), ttl_ms=None)
        return write_keyed(profiles, sink, str(tmp_path / "checkpoint"), transform)

    with pytest.raises(Exception, match="killed"):
        start(failing).awaitTermination(180)
    assert seen(sink.rows(spark)) != seen(live_profiles(spark.createDataFrame(events, SCHEMA)))
    drain(start())
    assert seen(sink.rows(spark)) == seen(live_profiles(spark.createDataFrame(events, SCHEMA)))


def test_batch_cuts_give_the_same_lists_and_readers_open_few_folders(spark, tmp_path):
    folder, events = str(tmp_path / "in"), feedback(160)
    for at in range(0, 160, 20):
        add(spark, folder, events[at : at + 20])
    found = []
    for files in (1, 3):
        sink = KeyedSink(str(tmp_path / f"out{files}"), "user_id", every=3)
        profiles = fs.live_profile_stream(stream_of(spark, folder, files), ttl_ms=None)
        drain(write_keyed(profiles, sink, str(tmp_path / f"checkpoint{files}")))
        assert len(sink.folders(spark)) <= 3
        found.append(seen(sink.rows(spark)))
    assert found[0] == found[1] == seen(live_profiles(spark.createDataFrame(events, SCHEMA)))


def test_repeated_and_unfinished_batches(spark, tmp_path):
    sink = KeyedSink(str(tmp_path / "out"), "k", alive="v is not null", every=3)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    sink.write(batch((1, "a"), (1, "b"), (2, "c")), 0)
    sink.write(batch((2, None)), 1)
    sink.write(batch((2, None)), 1)  # run again
    (tmp_path / "out" / "delta-2").mkdir()  # not finished
    read = lambda: sorted((r.k, r.v) for r in sink.rows(spark).collect())
    assert read() == [(1, "a"), (1, "b")]
    sink.write(batch((3, "d")), 2)
    assert read() == [(1, "a"), (1, "b"), (3, "d")] and sink.folders(spark) == [f"{tmp_path}/out/base-2"]
    sink.write(batch((3, "x")), 2)  # held by the base already
    assert read() == [(1, "a"), (1, "b"), (3, "d")]
    sink.write(batch().limit(0), 3)
    assert read() == [(1, "a"), (1, "b"), (3, "d")]
