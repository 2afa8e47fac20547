"""Bands as data: an interval join for band tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed


def experience_bands(spark: SparkSession) -> DataFrame:
    """The printed bands of experience as a table: band, code, label, lo, hi."""
    edges = [row[4] for row in fixed.SENIORITY_BANDS]
    rows = [
        F.struct(
            F.lit(row[0]).alias("band"),
            F.lit(row[1]).alias("code"),
            F.lit(row[2]).alias("label"),
            F.lit(low).cast("bigint").alias("lo"),
            F.lit(high).cast("bigint").alias("hi"),
        )
        for row, low, high in zip(fixed.SENIORITY_BANDS, edges, [*edges[1:], None], strict=True)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def in_bands(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """``rows`` with the columns of the band their integer ``value`` lies in: lo <= value < hi.

    ``bands``: lo, hi (null: no upper end) and what else they carry, any number of them. They are
    put in buckets of one width, each band in all it touches: as many rows as bands and
    buckets together. A value looks in its own bucket, so the join is an equi-join.
    Values in no band have null columns; overlapping bands raise ValueError.
    """
    edges = bands.agg(F.min("lo"), F.max(F.coalesce("hi", "lo")), F.count("lo")).first()
    low, high, n = edges
    if not n:
        return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in bands.schema])
    width = max(1, -(-(high - low) // n))
    last = (high - low) // width  # everything behind the last edge shares a bucket
    bucket = lambda v: F.expr(f"least(({v} - {low}L) div {width}L, {last}L)")
    end = F.when(F.col("hi").isNull(), F.lit(last).cast("bigint")).otherwise(bucket("(hi - 1L)"))
    real = bands.where("lo IS NOT NULL AND (hi IS NULL OR hi > lo)")
    dealt = real.select("*", F.explode(F.sequence(bucket("lo"), end)).alias("_bucket"))
    before = Window.partitionBy("_bucket").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce("hi", F.lit(2**63 - 1))).over(before)
    if not dealt.withColumn("_reach", reach).where(F.col("_reach") > F.col("lo")).isEmpty():
        raise ValueError("bands overlap")
    given = rows.withColumn("_value", F.col(value).cast("bigint"))
    given = given.withColumn("_bucket", F.when(F.col("_value") >= low, bucket("_value")))
    right = dealt.select(*[F.col(c).alias(f"_band_{c}") for c in bands.columns], F.col("_bucket").alias("_right"))
    inside = (F.col("_value") >= F.col("_band_lo")) & (F.col("_band_hi").isNull() | (F.col("_value") < F.col("_band_hi")))
    joined = given.join(right, (F.col("_bucket") == F.col("_right")) & inside, "left")
    return joined.select(*rows.columns, *[F.col(f"_band_{c}").alias(c) for c in bands.columns])
