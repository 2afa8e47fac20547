"""Counts shown on the dashboard and on reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed
from joblattice.functions.listing import initial, score_tier

def _counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("score") >= fixed.SCORE_HIGH).alias("top_matches"),
        F.count_if(F.col("bookmarked")).alias("bookmarked"),
    ]


def stats(listings: DataFrame) -> DataFrame:
    """Totals over the unfiltered listings, in one pass.

    ``sources`` is the length of the fixed source list, as the dashboard shows
    it; ``sources_seen`` counts what is in the data.
    """
    return listings.agg(*_counts(), F.count_distinct("source").alias("sources_seen")).select(
        "total",
        "top_matches",
        "bookmarked",
        F.lit(len(fixed.SOURCES)).cast("bigint").alias("sources"),
        "sources_seen",
    )


def user_stats(jobs: DataFrame) -> DataFrame:
    """The same totals per user over the stored matches."""
    return jobs.groupBy("user_id").agg(*_counts())


def jobs_per_user(users: DataFrame, profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stored matches per user, with users lacking a profile or matches.

    Jobs are counted before the join, so it moves one row per user.
    """
    counts = jobs.groupBy("user_id").agg(F.count("*").alias("jobs"))
    known = profiles.select("user_id", F.lit(True).alias("has_profile"))
    return (
        users.select("user_id")
        .join(known, "user_id", "left")
        .join(counts, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("has_profile", F.lit(False)).alias("has_profile"),
            F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"),
        )
    )


def tier_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy(score_tier(F.col("score")).alias("tier")).agg(
        F.count("*").alias("listings")
    )


def initial_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy(initial(F.col("company")).alias("initial")).agg(
        F.count("*").alias("listings")
    )


def per_source_with_total(listings: DataFrame) -> DataFrame:
    """Results per source and the grand total.

    Counted per source first: a rollup straight over the listings would double
    every row before its map-side aggregate.
    """
    counts = listings.groupBy("source").agg(F.count("*").alias("n"))
    return (
        counts.rollup("source")
        .agg(F.sum("n").alias("results"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level") == 1, F.lit("total")).otherwise(F.col("source")).alias("source"),
            "results",
        )
    )


def per_day_and_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("posted_on", "source").agg(F.count("*").alias("listings"))


def matches_per_day(matches: DataFrame) -> DataFrame:
    return matches.groupBy("posted_on").agg(
        F.count("*").alias("matches"), F.count_distinct("user_id").alias("users")
    )


def average_scores(listings: DataFrame) -> DataFrame:
    """Average score per source and overall, from exact integer sums."""
    sums = listings.groupBy("source").agg(
        F.sum(F.col("score").cast("bigint")).alias("s"), F.count("score").alias("n")
    )
    return (
        sums.rollup("source")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level") == 1, F.lit("total")).otherwise(F.col("source")).alias("source"),
            (F.col("s").cast("double") / F.col("n")).alias("avg_score"),
        )
    )


def best_listings(listings: DataFrame, n: int) -> DataFrame:
    """Global report of the n best: each task keeps n rows, then they merge."""
    return listings.orderBy(F.col("score").desc(), F.col("id_num").asc()).limit(n)
