"""Webhook bodies as text, one request per line; batch or stream.

A line is a body, or its time of arrival (ISO-8601), a tab and the body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# No JSON value holds a raw tab before its first character that is not a blank.
_TIMED = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][^\t]*)\t(.*)$"


def _bodies(lines: DataFrame) -> DataFrame:
    """``body``, ``ts`` and ``own_time``.

    Without a time of its own a request takes that of its file, so a re-run agrees.
    """
    line = F.col("value")
    stamp = F.nullif(F.regexp_extract(line, _TIMED, 1), F.lit("")).try_cast("timestamp")
    return lines.select(
        F.when(stamp.isNotNull(), F.regexp_extract(line, _TIMED, 2)).otherwise(line).alias("body"),
        F.coalesce(stamp, F.col("_metadata.file_modification_time")).alias("ts"),
        stamp.isNotNull().alias("own_time"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return _bodies(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return _bodies(
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    )
