"""Stored tables: round trips, encryption, partition pruning."""

import datetime as dt

from pyspark.sql import functions as F

from joblattice import schemas
from joblattice.functions import secrets
from joblattice.sources import tables

NOW = dt.datetime(2024, 1, 1, 12)


def test_users(spark, tmp_path):
    users = spark.createDataFrame([(1, "a@example.org", NOW)], schemas.USERS)
    tables.write_users(users, str(tmp_path / "users"))
    assert tables.read_users(spark, str(tmp_path / "users")).collect() == users.collect()


def test_profiles_hold_no_clear_key(spark, tmp_path):
    path, key = tmp_path / "profiles", F.lit("0123456789abcdef")
    preferences = ("remote", ("Egypt", "Cairo"), "QA", ["Go"], 3, ["full-time"], "mid", (1, 2, "USD"), "clear-key-77")
    profiles = spark.createDataFrame([(1, preferences, "clear-key-77")], "user_id bigint, preferences struct<%s>, api_key string" % ", ".join(
        f"{f.name}: {f.dataType.simpleString()}" for f in schemas.PROFILE.fields
    ))
    tables.write_profiles(profiles, str(path), key)
    files = [f for f in path.iterdir() if f.suffix == ".parquet"]
    assert files and all(b"clear-key-77" not in f.read_bytes() for f in files)
    row = tables.read_profiles(spark, str(path)).select(
        "user_id", "skills", "preferences", secrets.decrypt(F.col("api_key"), key).alias("k")
    ).first()
    assert (row["user_id"], row["skills"], row["k"]) == (1, ["Go"], "clear-key-77")
    assert row["preferences"]["apiKey"] is None and row["preferences"]["field"] == "QA"


def test_jobs_of_one_user_read_one_directory(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = [
        (str(i), u, "t", "c", "l", "full-time", "$1", "Indeed", NOW.date(), 90, "#", NOW) for u in range(20) for i in range(3)
    ]
    tables.write_jobs(spark.createDataFrame(rows, schemas.JOBS), path)
    assert tables.read_jobs(spark, path).count() == 60
    mine = tables.read_jobs(spark, path, user_id=7)
    assert sorted(r["id"] for r in mine.collect()) == ["0", "1", "2"]
    assert mine.columns == schemas.JOBS.names
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_bucket" in plan


def test_documents_are_json_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"jobs":[]}')], "user_id int, document string")
    tables.write_documents(docs, str(tmp_path / "docs"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "docs")).collect()] == ['{"jobs":[]}']
