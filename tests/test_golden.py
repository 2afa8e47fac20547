"""Dashboard results on the eight sample listings."""

import pytest
from golden import LISTINGS, SAMPLE_RUN, SAMPLE_RUN_TOTAL
from pyspark.sql import functions as F

from joblattice import schemas
from joblattice.functions.listing import display_line, initial, salary_parts, score_tier
from joblattice.operators import dashboard, filters, state
from joblattice.sources import listings as boards


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(LISTINGS, schemas.LISTING).coalesce(1)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_stats(golden):
    row = dashboard.stats(golden).first()
    assert (row["total"], row["top_matches"], row["bookmarked"], row["sources"]) == (8, 3, 1, 5)


def test_tiers(golden):
    tiers = {r["tier"]: r["listings"] for r in dashboard.tier_counts(golden).collect()}
    assert tiers == {"high": 3, "medium": 5}


@pytest.mark.parametrize(
    "score, tier",
    [("100.0", "high"), ("90.0", "high"), ("89.9", "medium"), ("75.0", "medium"), ("74.0", "low"), ("NaN", "low")],
)
def test_tier_edges(spark, score, tier):
    df = spark.range(1).select(score_tier(F.lit(score).cast("double")).alias("t"))
    assert df.first()["t"] == tier


@pytest.mark.parametrize(
    "term, expected",
    [("react", ["2", "6"]), ("FIG", ["4"]), ("remote", []), (" react", []), ("%", []), ("_", []), ("", list("12345678"))],
)
def test_search(golden, term, expected):
    assert ids(filters.search(golden, term)) == expected


def test_dashboard_controls_keep_order(golden):
    assert ids(filters.from_source(golden, "RemoteOK")) == ["2", "6"]
    assert ids(filters.dashboard(golden, "engineer", "LinkedIn")) == ["1", "3"]
    assert ids(filters.dashboard(golden, "developer", "all")) == ["2", "6", "8"]


def test_empty_result(golden):
    assert filters.dashboard(golden, "nothing like it").isEmpty()
    assert not filters.dashboard(golden).isEmpty()


def test_facets_and_score(golden):
    assert ids(filters.facets(golden, {"type": ["contract"], "location": ["Remote"]})) == ["6"]
    assert len(ids(filters.facets(golden, {"type": []}))) == 8
    assert ids(filters.score_at_least(golden, 91)) == ["1", "2", "3"]


def test_salary(golden):
    rows = {r["id"]: tuple(r["pay"]) for r in golden.select("id", salary_parts(F.col("salary")).alias("pay")).collect()}
    assert rows["1"] == (120_000, 160_000, "USD", "year")
    assert rows["6"] == (80, 100, "USD", "hour")
    assert rows["8"] == (25_000, 40_000, "EGP", "year")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$85k", (85_000, 85_000, "USD", "year")),
        ("$1.5k", (1_500, 1_500, "USD", "year")),
        ("€80,000–€90,000", (80_000, 90_000, "EUR", "year")),
        ("£20/hr", (20, 20, "GBP", "hour")),
        ("$80–120k", (80_000, 120_000, "USD", "year")),
        ("$120K–$160K", (120_000, 160_000, "USD", "year")),
        ("$1.2M", (1_200_000, 1_200_000, "USD", "year")),
        ("$50/hour", (50, 50, "USD", "hour")),
        ("50 - 60 EUR / h", (50, 60, "EUR", "hour")),
        ("85k €", (85_000, 85_000, "EUR", "year")),
        ("E£25k–E£40k", (25_000, 40_000, "EGP", "year")),
        ("usd 90,500", (90_500, 90_500, "USD", "year")),
        ("100k to 90k", (90_000, 100_000, None, "year")),
        ("$80k–€90k", (80_000, 90_000, None, "year")),
        ("$5 a day", (None, None, None, None)),
        ("401k match", (None, None, None, None)),
        ("9" * 30, (None, None, None, None)),
        ("", (None, None, None, None)),
        ("Competitive", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_salary_forms(spark, text, expected):
    row = spark.range(1).select(salary_parts(F.lit(text).cast("string")).alias("pay")).first()
    assert tuple(row["pay"]) == expected


def test_salary_filter(golden):
    assert ids(filters.salary_between(golden, 150_000, 0)) == ["1", "4", "7"]
    assert ids(filters.salary_between(golden, 0, 90_000)) == ["2"]
    assert ids(filters.salary_between(golden, 30_000, 0, currency="EGP")) == ["8"]
    assert ids(filters.salary_between(golden, 90, 0, period="hour")) == ["6"]


def test_card_texts(golden):
    row = golden.select(
        initial(F.col("company")).alias("i"), display_line(F.col("company"), F.col("location")).alias("l")
    ).first()
    assert (row["i"], row["l"]) == ("S", "Stripe · Remote")


def toggled(spark, golden, *ids_):
    rows = golden.withColumn("id_num", F.col("id").cast("bigint"))
    toggles = spark.createDataFrame([(1, int(i)) for i in ids_], "user_id bigint, id_num bigint")
    jobs = rows.withColumn("user_id", F.lit(1).cast("bigint"))
    return dashboard.user_stats(state.overlay_jobs(jobs, state.bookmark_flips(toggles))).first()


def test_bookmark_toggle(spark, golden):
    assert toggled(spark, golden, 3)["bookmarked"] == 0
    assert toggled(spark, golden, 99)["bookmarked"] == 1
    assert toggled(spark, golden, 3, 3)["bookmarked"] == 1
    assert toggled(spark, golden, 1, 2)["bookmarked"] == 3


def test_overlay_rows(spark, golden):
    rows = golden.select(F.col("id").cast("bigint").alias("id_num"), "bookmarked")
    toggles = spark.createDataFrame([(7, 3), (7, 1), (7, 1), (8, 99)], "user_id bigint, id_num bigint")
    seen = state.overlay(rows, state.bookmark_flips(toggles))
    assert seen.where("user_id is null").count() == 8
    assert [tuple(r) for r in seen.where("user_id is not null").select("user_id", "id_num", "bookmarked").collect()] == [
        (7, 3, False)
    ]


def test_sample_run_rollup(spark):
    counts = spark.createDataFrame(list(SAMPLE_RUN.items()), "source string, n int")
    rows = counts.select("source", F.explode(F.sequence(F.lit(1), "n")))
    rollup = {r["source"]: r["results"] for r in dashboard.per_source_with_total(rows).collect()}
    assert rollup == {**SAMPLE_RUN, "total": SAMPLE_RUN_TOTAL}


def test_listings_round_trip_prunes_by_source(spark, golden, tmp_path):
    path = str(tmp_path / "listings")
    boards.write_listings(golden, path)
    stored = boards.read_listings(spark, path)
    assert sorted(ids(stored)) == list("12345678")
    one = filters.from_source(stored, "LinkedIn")
    assert sorted(ids(one)) == ["1", "3", "7"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_union_of_boards(spark):
    a = spark.createDataFrame([(1, "$85k")], "id_num int, salary string")
    c = spark.createDataFrame([(2,)], "id_num int")
    rows = boards.union_boards({"LinkedIn": a, "Wuzzuf": c}).orderBy("id_num").collect()
    assert [(r["id_num"], r["salary"], r["source"]) for r in rows] == [(1, "$85k", "LinkedIn"), (2, None, "Wuzzuf")]


def test_refresh_prefers_the_new_pull_on_equal_dates(spark):
    schema = "id_num int, posted_on string, score int"
    old = spark.createDataFrame([(1, "2024-01-01", 1), (2, "2024-01-05", 2)], schema)
    new = spark.createDataFrame([(1, "2024-01-01", 9), (2, "2024-01-04", 9), (3, "2024-01-04", 9)], schema)
    rows = {r["id_num"]: r["score"] for r in boards.refresh(old, new).collect()}
    assert rows == {1: 9, 2: 2, 3: 9}


def test_page_extract(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://jobs.example.org/a/b?x=1#y", "<html><title>R&amp;D &lt;lead&gt; &amp;lt;</title>"),
            (2, "not a url at all", "no title"),
        ],
        "page_id int, url string, html string",
    )
    rows = boards.extract_pages(pages).orderBy("page_id").collect()
    assert tuple(rows[0]) == (1, "R&D <lead> &lt;", "jobs.example.org", "/a/b")
    assert rows[1]["host"] is None and rows[1]["title"] == ""
