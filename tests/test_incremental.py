"""Incremental top-k, alerts by class, bands as data and file-skipping search."""

import random

import pytest
from pyspark.sql import functions as F

from joblattice.operators import alerts, bands, filters, matching
from joblattice.sources import search_files
from tests.test_matching import LISTING, PROFILE, make


def rows_of(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("seed, k", [(12, 4)])
def test_refreshed_top_equals_the_full_run(spark, seed, k):
    rng = random.Random(seed)
    listings, profiles = make(seed, 70, 25, 0.3)
    listings = [r for r in listings]
    old = [r for r in listings if r[0] % 4]  # inserts
    changed = {r[0] for r in listings if r[0] % 4 == 0}
    for i, r in enumerate(old):  # updates and removals
        if rng.random() < 0.15:
            old[i] = (r[0], "react java go", *r[2:])
            changed.add(r[0])
    gone = [(1000 + i, "react web", *listings[0][2:]) for i in range(6)]
    changed |= {g[0] for g in gone}
    people = spark.createDataFrame(profiles, PROFILE)
    now = spark.createDataFrame(listings, LISTING)
    top = matching.top_matches(spark.createDataFrame(old + gone, LISTING), people, k)
    ids = spark.createDataFrame([(i,) for i in sorted(changed)], "id_num bigint")
    full = matching.top_matches(now, people, k)
    assert rows_of(matching.refreshed_top(top, now, ids, people, k), full.columns) == rows_of(full, full.columns)


def test_class_alerts_grow_with_classes(spark, tmp_path):
    """Twenty listings and thirty users of one kind: 600 alerts from one stored pair."""
    one = ("react web", "c", "l", "#", "f1", "remote", "A", 3, None, "Indeed")
    listings = spark.createDataFrame([(i, *one) for i in range(20)], LISTING)
    profiles = spark.createDataFrame([(u, "f1", ["React", "web"], "remote", "A", 11, "Free") for u in range(30)], PROFILE)
    found = matching.class_matches_at_least(listings, profiles, 90)
    alerts.write_class_alerts(*found, str(tmp_path), buckets=4)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1
    whole = alerts.class_alerts(spark, str(tmp_path))
    columns = ["user_id", "id_num", "score"]
    assert rows_of(whole, columns) == rows_of(matching.matches_at_least(listings, profiles, 90), columns)
    assert whole.count() == 600
    some = alerts.class_alerts(spark, str(tmp_path), [1])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    parts = [alerts.class_alerts(spark, str(tmp_path), [b]).count() for b in range(4)]
    assert sum(parts) == 600 and max(parts) < 600


BANDS = "lo bigint, hi bigint, name string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_band_table(spark, seed):
    rng = random.Random(seed)
    edges = sorted(rng.sample(range(-500, 10 ** rng.randint(3, 6)), 40))
    rows = [(a, b - rng.choice([0, 0, 1]), f"b{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    rows = [r for r in rows if r[0] < r[1]] + [(edges[-1] + 5, None, "top")]
    values = [None, *range(-510, -480), *edges, *(e - 1 for e in edges), edges[-1] + 5, 10**15, *rng.sample(range(edges[0], edges[-1]), 50)]
    table = spark.createDataFrame(rows, BANDS)
    given = spark.createDataFrame([(v,) for v in values], "v bigint")
    joined = bands.in_bands(given, "v", table)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    name = lambda v: None if v is None else next((n for a, b, n in rows if a <= v and (b is None or v < b)), None)
    assert sorted(map(repr, joined.select("v", "name").collect())) == sorted(
        f"Row(v={v!r}, name={name(v)!r})" for v in values
    )


@pytest.mark.parametrize("rows", [[(0, 5, "a"), (4, 9, "b")], [(0, None, "a"), (100, 101, "b")], [(3, 4, "a"), (3, 4, "b")]])
def test_overlapping_bands_are_refused(spark, rows):
    with pytest.raises(ValueError):
        bands.in_bands(spark.range(3), "id", spark.createDataFrame(rows, BANDS))


def test_odd_band_tables(spark):
    none = bands.in_bands(spark.range(2), "id", spark.createDataFrame([], BANDS))
    assert none.columns == ["id", "lo", "hi", "name"] and [r.name for r in none.collect()] == [None, None]
    rows = [(None, 3, "x"), (1, 1, "empty"), (1, None, "one")]
    got = bands.in_bands(spark.range(3), "id", spark.createDataFrame(rows, BANDS)).orderBy("id").collect()
    assert [r.name for r in got] == [None, "one", "one"]


def test_search_opens_files_that_can_hold_the_term(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()}", rng.choice(["Firm", "Öl AG", None])) for i in range(400)] + [(900, None, "zzTop"), (901, "xy", "")]
    df = spark.createDataFrame(rows, "id_num bigint, title string, company string")
    path = str(tmp_path / "t")
    search_files.write_searchable(df, path, files=16)
    everything = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert everything > 8
    for term in (rows[7][1], rows[7][1][:4].upper(), "ZZTOP", "öl a", "firm", "", "a", "xy", "no such term", "%_"):
        found = search_files.search_stored(spark, path, term)
        assert rows_of(found, df.columns) == rows_of(filters.search(df, term), df.columns), term
    assert len(search_files.files_with(spark, path, rows[7][1])) <= everything // 4
    assert len(search_files.files_with(spark, path, "zztop")) == 1
    assert search_files.files_with(spark, path, "no such term") == []
    assert search_files.files_with(spark, path, "ab") is None
