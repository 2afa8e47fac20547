"""Each stream, run over files in time order, against its batch query."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from joblattice.operators import intake, matching, state
from joblattice.plans import bindings as b
from joblattice.sources.requests import stream_requests
from joblattice.streaming import jobs

FILES = 4
ONCE = {"availableNow": True}


@pytest.fixture()
def run(tmp_path):
    """Settings of one run: a job name of its own."""
    return {"job": f"test_{uuid.uuid4().hex}", **ONCE}


@pytest.fixture(scope="module")
def event_files(spark, sf, tmp_path_factory):
    """The events as four files in time order, one per micro-batch."""
    path = tmp_path_factory.mktemp("events")
    table = b.table(spark, sf, "events")
    bounds = table.approxQuantile("event_id", [i / FILES for i in range(FILES + 1)], 0.0)
    bounds[-1] += 1
    for i in range(FILES):
        part = table.where((F.col("event_id") >= bounds[i]) & (F.col("event_id") < bounds[i + 1]))
        part.coalesce(1).write.parquet(str(path / f"part{i}"))
        for name in os.listdir(path / f"part{i}"):
            if name.endswith(".parquet"):
                stamp = 1_700_000_000 + i
                os.utime(path / f"part{i}" / name, (stamp, stamp))
    return str(path / "*"), table.schema


def stream(spark, event_files):
    path, schema = event_files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(left, right):
    columns = sorted(right.columns)
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(left) == rows(right)


def test_bookmarks(spark, sf, event_files, run, tmp_path):
    toggles = b.toggles_of(b.events_of(stream(spark, event_files)))
    listings = b.listings(spark, sf)
    query = jobs.run_bookmarks(toggles, listings, str(tmp_path / "out"), **run)
    query.awaitTermination()
    assert len(query.recentProgress) >= FILES
    keys, batch = ["user_id", "id_num"], state.bookmark_state(b.toggles(spark, sf), listings)
    same(jobs.latest(spark, str(tmp_path / "out"), keys), batch)


def test_profiles(spark, sf, event_files, run, tmp_path):
    updates = b.profile_updates_of(b.events_of(stream(spark, event_files)))
    seed = {f: v for f, v in state.profile_seed().items() if f in updates.columns}
    jobs.run_profiles(updates, seed, str(tmp_path / "out"), **run).awaitTermination()
    batch = state.fold_profile(b.profile_updates(spark, sf), seed)
    same(jobs.latest(spark, str(tmp_path / "out"), ["user_id"]), batch)


def test_rate_limit_flags_at_once(spark, sf, event_files, run, tmp_path):
    events = b.events_of(stream(spark, event_files))
    jobs.run_rate_limit(events, str(tmp_path / "out"), **run).awaitTermination()
    flagged = jobs.latest(spark, str(tmp_path / "out"), ["user_id", "window_start"])
    same(flagged, state.requests_per_window(b.events(spark, sf)))


def test_rate_limit_drops_late_rows(spark, run, tmp_path):
    schema = "user_id bigint, ts timestamp, event_id bigint"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    batches = [
        [(1, day(1, h), h) for h in range(4)] + [(1, day(2, 5), 50)],
        [(2, day(2, h), 70 + h) for h in range(5)],
        [(1, day(1, 23), 60), (2, day(1, 23), 61), (3, day(5, 1), 90)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        for name in os.listdir(tmp_path / f"in{i}"):
            os.utime(tmp_path / f"in{i}" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    jobs.run_rate_limit(events, str(tmp_path / "out"), **run).awaitTermination()
    rows = jobs.latest(spark, str(tmp_path / "out"), ["user_id", "window_start"]).collect()
    # the fifth request of user 1 on day 1 came after the window had closed
    assert sorted((r["user_id"], r["requests"]) for r in rows) == [(1, 4), (2, 5)]


def test_intake(spark, run, tmp_path):
    good = json.dumps({"workPreference": "remote", "field": "x", "skills": ["a"], "apiKey": "k1"})
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(good + "\n{bad\n")
    (source / "b.txt").write_text("null\n" + good + "\n" + good.replace('["a"]', "[]") + "\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    requests = lines.select(F.col("value").alias("body"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    jobs.run_intake(requests, str(tmp_path / "out"), **run).awaitTermination()
    payloads = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/payloads")).select("value").collect()]
    rejects = spark.read.json(str(tmp_path / "out/rejects")).collect()
    assert len(payloads) == 2 and all("apiKey" not in p for p in payloads)
    assert sorted(r["status"] for r in rejects) == [400, 500, 500]
    everything = spark.read.text(str(source)).select(F.col("value").alias("body"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    same(
        spark.read.text(str(tmp_path / "out/payloads")).select(F.col("value").alias("payload")),
        intake.payloads(intake.classify(everything)).select("payload"),
    )


def test_intake_from_text_files(spark, run, tmp_path):
    """Requests without an event time take the time of their file."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(json.dumps({"workPreference": "remote", "field": "x", "skills": ["a"]}) + "\n")
    os.utime(source / "a.txt", (1_700_000_000, 1_700_000_000))
    jobs.run_intake(stream_requests(spark, str(source)), str(tmp_path / "out"), **run).awaitTermination()
    payload = json.loads(spark.read.text(str(tmp_path / "out/payloads")).first()["value"])
    assert payload["userId"].startswith("user_1700000000000_")
    assert payload["timestamp"] == "2023-11-14T22:13:20.000Z"


def test_alerts_once_per_user_and_listing(spark, sf, run, tmp_path):
    listings, profiles = b.listings(spark, sf), b.profiles(spark, sf)
    columns = ["id_num", "title", "field", "work_mode", "country", "band", "posted_on"]
    third = F.col("id_num") % 3
    parts = [listings.where(third == 0), listings.where(third <= 1), listings]  # overlapping pulls
    for i, part in enumerate(parts):
        part.select(columns).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        for name in os.listdir(tmp_path / f"in{i}"):
            os.utime(tmp_path / f"in{i}" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = str(tmp_path / "out")
    jobs.run_alerts(new, profiles, out, **run).awaitTermination()
    sent = jobs.sent_alerts(spark, out)
    assert sent.select(jobs.BATCH).distinct().count() == 3
    expected = matching.matches_at_least(listings, profiles, 90).select("user_id", "id_num", "score")
    assert expected.count() > 0
    same(sent.drop("bucket", jobs.BATCH), expected)

    # another job, with no progress of its own, finds everything sent already
    other = {**run, "job": f"{run['job']}_other"}
    again = spark.readStream.schema(schema).parquet(str(tmp_path / "in*"))
    jobs.run_alerts(again, profiles, out, **other).awaitTermination()
    same(jobs.sent_alerts(spark, out).drop("bucket", jobs.BATCH), expected)


def test_a_repeated_alert_batch_writes_the_same_rows(spark, sf, tmp_path, monkeypatch):
    """The batch function run twice with one number, as after a lost driver."""
    captured = {}
    monkeypatch.setattr(jobs, "_start", lambda stream, job, write, *rest: captured.update(write=write))
    out = str(tmp_path / "out")
    listings, profiles = b.listings(spark, sf), b.profiles(spark, sf)
    jobs.run_alerts(listings, profiles, out, job="j")
    for number in (0, 1, 1, 0):
        captured["write"](listings if number == 0 else listings.where("id_num < 0"), number)
    sent = jobs.sent_alerts(spark, out)
    assert [r["batch"] for r in sent.select("batch").distinct().collect()] == [0]
    same(sent.drop("bucket", "batch"), matching.matches_at_least(listings, profiles, 90).select("user_id", "id_num", "score"))


def test_checkpoint_location(spark):
    class Session:
        def __init__(self, master, **settings):
            self.conf, self.sparkContext = settings, type("Context", (), {"master": master})

    with pytest.raises(ValueError):
        jobs.checkpoint_location(Session("spark://host"), "job")
    named = Session("spark://host", **{"spark.checkpoint.dir": "/shared/"})
    assert jobs.checkpoint_location(named, "job") == "/shared/job"
    assert jobs.checkpoint_location(spark, "job").endswith("/job")


def test_a_batch_with_two_versions_takes_the_newest(spark, sf, tmp_path, monkeypatch):
    captured = {}
    monkeypatch.setattr(jobs, "_start", lambda stream, job, write, *rest: captured.update(write=write))
    listings, profiles = b.listings(spark, sf), b.profiles(spark, sf)
    older = listings.withColumn("posted_on", F.date_add("posted_on", -1)).withColumn("title", F.lit("nothing"))
    jobs.run_alerts(listings, profiles, str(tmp_path), job="j")
    captured["write"](older.unionByName(listings), 0)
    expected = matching.matches_at_least(listings, profiles, 90).select("user_id", "id_num", "score")
    same(jobs.sent_alerts(spark, str(tmp_path)).drop("bucket", "batch"), expected)
