"""The bucketed listing store: refreshes, plans, broken refreshes, cleaning."""

import datetime as dt
import os
import random

import pytest

from joblattice.sources import listings, store

SCHEMA = "id_num bigint, title string, posted_on date, score int"
DAY = lambda d: dt.date(2024, 1, d) if d else None


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_refreshes_equal_the_plain_merge(spark, tmp_path):
    rng = random.Random(1)
    path = str(tmp_path)
    some = lambda n, ids: [(i, f"t{rng.randint(0, 9)}", DAY(rng.choice([None, 1, 2, 3])), rng.randint(0, 9)) for i in rng.sample(ids, n)]
    now = frame(spark, some(60, range(100)))
    store.create(now, path, buckets=8)
    assert rows_of(store.read(spark, path)) == rows_of(now)
    now = now.collect()
    for n in (1, 5, 40):
        pull = frame(spark, some(n, range(140)) + some(n, range(140)))
        touched = store.refresh(spark, path, pull)
        expected = listings.refresh(frame(spark, now), pull).collect()
        assert rows_of(store.read(spark, path)) == sorted(map(repr, expected))
        assert 1 <= len(touched) <= min(8, 2 * n)
        now = expected
    assert store.refresh(spark, path, frame(spark, [])) == []
    assert rows_of(store.read(spark, path)) == sorted(map(repr, now))


def test_a_pull_reads_its_buckets_without_an_exchange(spark, tmp_path):
    path = str(tmp_path)
    store.create(spark.range(1000).selectExpr("id id_num", "'t' title", "date'2024-01-01' posted_on", "1 score"), path, buckets=8)
    pull = frame(spark, [(5, "new", DAY(2), 9)])
    files = store.Files(spark, path)
    touched = [r.b for r in pull.select(store.bucket_of(8).alias("b")).collect()]
    old = store._read(spark, path, store._manifest(files), touched)
    used = {f.split("bucket=")[1].split("/")[0] for f in old.inputFiles()}
    joined = store.merged(old.drop("version", "bucket"), listings.newest_versions(pull))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("Join") :].split("\n")
    scan = next(i for i, line in enumerate(side) if "FileScan" in line)
    # From the join down to the stored scan there is no exchange; the pull has one.
    assert not any("Exchange" in line for line in side[:scan]), plan
    assert "Bucketed: true" in side[scan]
    assert "bucket" in side[scan].split("PartitionFilters: [")[1].split("]")[0]
    assert joined.where("id_num = 5").first().title == "new"
    read = {r.f for r in old.selectExpr("input_file_name() f").distinct().collect()}
    assert {f.split("/bucket=")[1].split("/")[0] for f in read} == {str(b) for b in touched}
    assert used >= {str(b) for b in touched}


def test_a_broken_refresh_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.create(frame(spark, [(i, "old", DAY(1), 0) for i in range(20)]), path, buckets=4)
    before = rows_of(store.read(spark, path))
    pull = frame(spark, [(i, "new", DAY(2), 1) for i in range(5, 25)])

    def broken(*_):
        raise OSError("lost driver")

    with monkeypatch.context() as patch:
        patch.setattr(store.Files, "put", broken)
        with pytest.raises(OSError):
            store.refresh(spark, path, pull)
    assert rows_of(store.read(spark, path)) == before
    store.refresh(spark, path, pull)
    assert sorted((r.id_num, r.title) for r in store.read(spark, path).collect()) == [(i, "old" if i < 5 else "new") for i in range(25)]


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path)
    store.create(frame(spark, [(i, "v0", DAY(1), 0) for i in range(12)]), path, buckets=2)
    for n in range(store.KEEP + 3):
        store.refresh(spark, path, frame(spark, [(i, f"v{n}", DAY(2), n) for i in range(12)]))
    versions = [n for n in os.listdir(tmp_path / "data") if n.startswith("version=")]
    assert len(versions) <= store.KEEP + 1
    assert {r.title for r in store.read(spark, path).collect()} == {f"v{store.KEEP + 2}"}


def test_missing_store(spark, tmp_path):
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.refresh(spark, str(tmp_path / "none"), frame(spark, []))
    store.create(frame(spark, []), str(tmp_path / "empty"), buckets=2)
    assert store.read(spark, str(tmp_path / "empty")).isEmpty()
    with pytest.raises(ValueError):
        store.create(frame(spark, []), str(tmp_path / "empty"), buckets=2)
    store.refresh(spark, str(tmp_path / "empty"), frame(spark, [(None, "x", None, 1), (1, "y", None, 2)]))
    assert store.read(spark, str(tmp_path / "empty")).count() == 2
