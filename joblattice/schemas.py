"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("postedAt", T.StringType()),
        T.StructField("bookmarked", T.BooleanType()),
    ]
)

LOCATION = T.StructType(
    [T.StructField("country", T.StringType()), T.StructField("city", T.StringType())]
)

SALARY = T.StructType(
    [
        T.StructField("min", T.LongType()),
        T.StructField("max", T.LongType()),
        T.StructField("currency", T.StringType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("workPreference", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("field", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience", T.IntegerType()),
        T.StructField("jobType", T.ArrayType(T.StringType())),
        T.StructField("seniority", T.StringType()),
        T.StructField("salary", SALARY),
        T.StructField("apiKey", T.StringType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("email", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("preferences", PROFILE),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("api_key", T.BinaryType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("posted_on", T.DateType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("link", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
