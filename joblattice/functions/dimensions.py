"""The fixed code lists as tiny tables.

Their size is that of the lists in ``fixed_values`` (at most five rows), so a
broadcast of them is bounded whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed


def _values(spark: SparkSession, names: list[str], rows) -> DataFrame:
    cells = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    )
    return spark.range(1).select(F.inline(cells))


def work_modes(spark: SparkSession) -> DataFrame:
    return _values(spark, ["code", "label"], fixed.WORK_MODES)


def job_types(spark: SparkSession) -> DataFrame:
    return _values(spark, ["code", "label"], fixed.JOB_TYPES)


def seniorities(spark: SparkSession) -> DataFrame:
    rows = [(band, code, label, years) for band, code, label, years, _, _ in fixed.SENIORITY_BANDS]
    return _values(spark, ["band", "code", "label", "years"], rows)


def currencies(spark: SparkSession) -> DataFrame:
    return _values(spark, ["code", "label"], fixed.CURRENCIES)


def with_label(df: DataFrame, code: str, dimension: DataFrame, label: str) -> DataFrame:
    """Add the printed label of a code; an unknown code gets null."""
    lookup = dimension.select(F.col("code").alias(code), F.col("label").alias(label))
    return df.join(F.broadcast(lookup), code, "left")


def experience_band(years: Column) -> Column:
    """Number of the band [lo, hi) the years fall into; null below zero.

    The printed bands share their edges; an edge belongs to the upper band.
    Four fixed ranges are a CASE, which needs no join at all.
    """
    band = F.lit(None).cast("int")
    for number, _, _, _, lowest, _ in fixed.SENIORITY_BANDS:
        band = F.when(years >= lowest, F.lit(number)).otherwise(band)
    return band


def band_text(band: Column, part: str) -> Column:
    """``code`` or ``label`` of a band number."""
    position = {"code": 1, "label": 2}[part]
    text = F.lit(None).cast("string")
    for row in fixed.SENIORITY_BANDS:
        text = F.when(band == row[0], F.lit(row[position])).otherwise(text)
    return text
