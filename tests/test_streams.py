"""Stream results equal their batch twins, whatever the batch boundaries."""

import json

from pyspark.sql import functions as F

from quillrec.operators.feedback import live_profiles
from quillrec.streaming import feedback_stream as fs


def test_parse_rejects_bad_rows(spark):
    lines = [
        json.dumps({"event_id": 1, "user_id": 7, "movie_id": "9", "event_type": " Click "}),
        json.dumps({"event_id": 2, "user_id": "x", "recipe_id": 9, "feedback_type": "like"}),
        "not json",
    ]
    out = fs.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.user_id, r.item_id, r.feedback_type, r.problem) for r in out[:1]] == [(7, 9, "click", None)]
    assert out[1].problem == "bad id" and out[2].problem == "not an event"


def test_live_profiles_equal_batch(spark, tmp_path):
    kinds = ["click", "like", "dislike", "seen", "rating"]
    data = [(i, i % 3, (i * i) % 11, kinds[i % 5], float(i % 5), (i * 37) % 400) for i in range(240)]
    schema = "event_id long, user_id long, item_id long, feedback_type string, feedback_value double, ts long"
    events = spark.createDataFrame(data, schema)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    handle = fs.write_batches(fs.live_profile_stream(stream, ttl_ms=None), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert handle.awaitTermination(120)
    names = ("user_id", "recent_events", "positive_items", "negative_items")
    latest = fs.latest_per_key(spark, str(tmp_path / "out"), "user_id").select(*names)
    batch = live_profiles(events).select(*names)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(latest) == key(batch)
    assert batch.agg(F.max(F.size("recent_events"))).first()[0] == 50


def test_a_user_costs_one_state_value(spark):
    """A user's lists are read and written once a batch, whatever the number of events."""
    calls = []

    class Value:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

    profile = fs.LiveProfile(None)
    profile.init(type("Handle", (), {"getValueState": lambda self, *a: Value()})())
    event = lambda i: {"ts": i, "event_id": i, "item_id": i % 7, "feedback_type": "click", "feedback_value": None}
    (row,) = profile.handleInputRows((5,), map(event, range(2500)), None)
    assert calls == ["get", "update"]
    assert row["recent_events"] == list(range(2499, 2449, -1)) and sorted(row["positive_items"]) == list(range(7))
