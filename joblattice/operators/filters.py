"""Dashboard search and filters; each is a plain predicate on the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed
from joblattice.functions.listing import salary_parts


def text_matches(term: Column | str) -> Column:
    """Case-insensitive substring of title or company.

    The term is taken as it is: not trimmed, no wildcards; "" matches all.
    """
    wanted = F.lower(term if isinstance(term, Column) else F.lit(term))
    return F.contains(F.lower("title"), wanted) | F.contains(F.lower("company"), wanted)


def search(listings: DataFrame, term: str) -> DataFrame:
    return listings if term == "" else listings.where(text_matches(term))


def from_source(listings: DataFrame, source: str) -> DataFrame:
    """Equality on source, which prunes partitions; "all" is no predicate."""
    if source == fixed.ALL_SOURCES:
        return listings
    return listings.where(F.col("source") == source)


def dashboard(listings: DataFrame, term: str = "", source: str = fixed.ALL_SOURCES) -> DataFrame:
    """Both dashboard controls; row order of the input is kept (no shuffle)."""
    return search(from_source(listings, source), term)


def facets(listings: DataFrame, wanted: Mapping[str, Iterable]) -> DataFrame:
    """Keep rows whose columns hold one of the wanted values; [] is no limit."""
    for column, values in wanted.items():
        values = list(values)
        if values:
            listings = listings.where(F.col(column).isin(values))
    return listings


def salary_between(
    listings: DataFrame,
    want_min: int,
    want_max: int,
    currency: str = fixed.DEFAULT_CURRENCY,
    period: str = "year",
) -> DataFrame:
    """Rows whose salary range overlaps the wanted one; want_max 0 is no limit."""
    # As a generator the parse is a step of its own, not copied into each condition.
    listings = listings.select("*", F.explode(F.array(salary_parts(F.col("salary")))).alias("pay")).where(
        (F.col("pay.currency") == currency)
        & (F.col("pay.period") == period)
        & (F.col("pay.hi") >= want_min)
    )
    if want_max:
        listings = listings.where(F.col("pay.lo") <= want_max)
    return listings


def score_at_least(listings: DataFrame, score: int) -> DataFrame:
    return listings.where(F.col("score") >= score)
