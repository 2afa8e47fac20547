"""Lists of rows in top_matches: their order, and the short name that signatures go by."""

import datetime as dt

from pyspark.sql import functions as F

from joblattice.operators import matching
from tests.test_matching import LISTING, PROFILE, make


def test_lists_are_ordered_like_rows(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(day(2), 5), (None, 1), (day(3), 9), (day(2), None), (day(2), -4), (None, None)]
    df = spark.createDataFrame(rows, "posted_on date, id_num bigint")
    expected = df.orderBy(F.col("posted_on").desc_nulls_last(), F.col("id_num").asc()).collect()
    lists = df.agg(F.collect_list(F.struct("posted_on", "id_num")).alias("rows"))
    found = lists.select(matching._newest_first(F.col("rows")).alias("rows")).first().rows
    assert list(map(tuple, found)) == list(map(tuple, expected))


def test_signatures_are_ranked_by_a_short_name(spark):
    listings, profiles = make(5, 20, 10, 0.3)
    top = matching.top_matches(spark.createDataFrame(listings, LISTING), spark.createDataFrame(profiles, PROFILE), 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in plan if "Window [" in line]
    assert "signature" in windows[0] and "interest" not in windows[0]
