"""Text search over stored listings that opens only files which can hold the term.

Beside the listings lies an index: for each file the pieces of three characters its titles and
companies hold. A term is in a file only if all its pieces are. Listings are stored by
ranges of the title, so that files differ in their pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.operators import filters

PIECE = 3


def _pieces(text: Column) -> Column:
    starts = F.when(F.length(text) >= PIECE, F.sequence(F.lit(1), F.length(text) - (PIECE - 1)))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(PIECE)))


def write_searchable(listings: DataFrame, path: str, files: int | None = None) -> None:
    """Store listings and the index of their files."""
    order = ["title", "company"]
    dealt = listings.repartitionByRange(files, *order) if files else listings.repartitionByRange(*order)
    dealt.write.parquet(f"{path}/rows")
    stored = listings.sparkSession.read.schema(listings.schema).parquet(f"{path}/rows")
    # Titles repeat: a file's distinct texts are cut, not its rows.
    texts = stored.select(F.col("_metadata.file_name").alias("file"), F.explode(F.array(F.lower("title"), F.lower("company"))).alias("text"))
    pieces = texts.distinct().select("file", F.explode(_pieces(F.col("text"))).alias("piece")).distinct()
    # Sorted by piece, so that a lookup reads few row groups.
    pieces.repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{path}/pieces")


def files_with(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """Names of the files that may hold the term; None if its length allows all. A name per
    file at most comes to the driver, as for any listing of files."""
    wanted = spark.range(1).select(F.explode(F.array_distinct(_pieces(F.lower(F.lit(term))))).alias("piece"))
    wanted = [r.piece for r in wanted.collect()]
    if not wanted:
        return None
    index = spark.read.schema("file string, piece string").parquet(f"{path}/pieces")
    held = index.where(F.col("piece").isin(wanted)).groupBy("file").agg(F.count("*").alias("n"))
    return sorted(r.file for r in held.where(F.col("n") == len(wanted)).select("file").collect())


def search_stored(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Stored listings whose title or company holds the term."""
    every = spark.read.parquet(f"{path}/rows")
    files = files_with(spark, path, term)
    if files is None:
        return filters.search(every, term)
    if not files:
        return every.where(F.lit(False))
    some = spark.read.schema(every.schema).parquet(*[f"{path}/rows/{f}" for f in files])
    return filters.search(some, term)
