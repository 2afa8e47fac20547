"""The stored tables: users, profiles and per-user jobs, as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice import schemas
from joblattice.functions import secrets

USER_BUCKETS = 64  # directories of a small jobs table; choose them for about 1 GB each


def write_users(users: DataFrame, path: str) -> None:
    users.select(*schemas.USERS.names).write.mode("overwrite").parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USERS).parquet(path)


def write_profiles(profiles: DataFrame, path: str, key: Column) -> None:
    """Store profiles; the API key leaves the job encrypted only.

    ``profiles``: user_id, preferences (the profile struct), api_key in clear.
    The clear key is also blanked inside the preferences.
    """
    hidden = F.col("preferences").withField("apiKey", F.lit(None).cast("string"))
    profiles.select(
        "user_id",
        hidden.alias("preferences"),
        F.col("preferences.skills").alias("skills"),
        secrets.encrypt(F.col("api_key"), key).alias("api_key"),
    ).write.mode("overwrite").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILES).parquet(path)


def write_jobs(jobs: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """Store matches by a bucket of the user, so one user's dashboard reads one
    directory, and sorted by user within files, so that it skips most row groups.

    ``buckets`` fixes the number of directories and must be the same for every write and
    read of a table. A write replaces the buckets it has rows for and leaves the
    others, so a part of the users can be written anew with all of their bucket.
    """
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    (
        jobs.select(*schemas.JOBS.names, bucket.alias("user_bucket"))
        .hint("rebalance", "user_bucket")
        .sortWithinPartitions("user_bucket", "user_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("user_bucket")
        .parquet(path)
    )


def read_jobs(
    spark: SparkSession, path: str, user_id: int | None = None, buckets: int = USER_BUCKETS
) -> DataFrame:
    """Stored matches; with a user only that user's directory is listed."""
    schema = T.StructType([*schemas.JOBS.fields, T.StructField("user_bucket", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    if user_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(user_id).cast("bigint")), F.lit(buckets)).cast("int")
        stored = stored.where((F.col("user_bucket") == bucket) & (F.col("user_id") == user_id))
    return stored.drop("user_bucket")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select("document").write.mode("overwrite").text(path)
