"""Webhook intake: classify request bodies, fill defaults, build the payload.

Input of every function is a table with a text column ``body`` and an event
time ``ts`` (plus any key columns, which are kept). A column ``own_time``, if there, is
false where ``ts`` is not the request's own time but its file's: an id made
from such a time gets a hash of the body. All steps are narrow projections: no
shuffle, batch and stream alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed
from joblattice.functions import values as v
from joblattice.functions.skills import clean_skills

OK, BAD_REQUEST, FAILED = 200, 400, 500


# Members of a request body, by the column that holds them (as VARIANT).
_MEMBERS = {
    "_user": "$.userId",
    "_preference": "$.workPreference",
    "_country": "$.location.country",
    "_city": "$.location.city",
    "_field": "$.field",
    "_skills": "$.skills",
    "_experience": "$.experience",
    "_job_type": "$.jobType",
    "_seniority": "$.seniority",
    "_pay_min": "$.salary.min",
    "_pay_max": "$.salary.max",
    "_currency": "$.salary.currency",
    "_api_key": "$.apiKey",
}
_NUMBERS = ("_experience", "_pay_min", "_pay_max")
_INTERNAL = {"body", "request", "status", "ts", "own_time", "_made_id", *_MEMBERS}


def classify(raw: DataFrame) -> DataFrame:
    """Parse each body once; add ``status`` and the members of the request.

    Text that is not one JSON value, and the JSON value null, fail (500). Otherwise
    workPreference, field and skills must be truthy and skills not empty (400).
    Blank text passes, enum values are not checked, a text as skills passes.
    """
    # As generators the parse and the test of what follows it are steps of their own. As plain
    # columns they would be copied into every filter on the status, once per mention.
    parsed = raw.select("*", F.explode(F.array(v.strict_json(F.col("body")))).alias("_parsed"))
    value = v.strict_json_value(F.col("_parsed"), F.col("body"))
    parsed = parsed.select("*", F.explode(F.array(value)).alias("request")).drop("_parsed")
    shared = F.when(~F.col("own_time"), F.xxhash64("body")) if "own_time" in raw.columns else None
    parsed = parsed.withColumn("_made_id", v.generated_user_id(F.col("ts"), shared))
    request, skills = F.col("request"), F.col("_skills")
    taken = parsed.withColumns({c: v.member(request, path) for c, path in _MEMBERS.items()})
    # A truthy value has length 0 as an empty array, or as an object that
    # carries a number 0 under that name.
    length = F.to_json(v.member(skills, "$.length"))
    empty = (F.to_json(skills) == "[]") | length.rlike(r"^-?0(\.0*)?$")
    complete = (
        v.json_truthy(F.col("_preference"))
        & v.json_truthy(F.col("_field"))
        & v.json_truthy(skills)
        & F.coalesce(~empty, F.lit(True))
    )
    unreadable = request.isNull() | F.is_variant_null(request)
    status = F.when(unreadable, FAILED).when(complete, OK).otherwise(BAD_REQUEST)
    return taken.withColumn("status", status)


def responses(classified: DataFrame) -> DataFrame:
    """One answer per request: status with its error, details or message."""
    status = F.col("status")
    details = F.when(F.col("request").isNull(), F.lit("body is not valid JSON")).otherwise(
        F.lit("body is null")
    )
    return classified.select(
        *_keys(classified),
        "status",
        F.when(status == BAD_REQUEST, fixed.MISSING_FIELDS_ERROR)
        .when(status == FAILED, fixed.FAILED_ERROR)
        .alias("error"),
        F.when(status == FAILED, details).alias("details"),
        (status == OK).alias("success"),
        F.when(status == OK, fixed.SUCCESS_MESSAGE).alias("message"),
    )


def payloads(classified: DataFrame) -> DataFrame:
    """JSON text for the downstream consumer, valid requests only.

    Given values keep their JSON type; only falsy ones are replaced. Absent
    members are left out. The API key is not forwarded.
    """
    nothing = F.array().cast("array<string>")
    document = F.struct(
        v.json_or(F.col("_user"), F.col("_made_id")).alias("userId"),
        F.col("_preference").alias("workPreference"),
        F.struct(
            v.json_or(F.col("_country"), F.lit("")).alias("country"),
            v.json_or(F.col("_city"), F.lit("")).alias("city"),
        ).alias("location"),
        F.col("_field").alias("field"),
        F.col("_skills").alias("skills"),
        v.json_or(F.col("_experience"), F.lit(0)).alias("experience"),
        v.json_or(F.col("_job_type"), nothing).alias("jobType"),
        v.json_or(F.col("_seniority"), F.lit(fixed.DEFAULT_SENIORITY)).alias("seniority"),
        F.struct(
            v.json_or(F.col("_pay_min"), F.lit(0)).alias("min"),
            v.json_or(F.col("_pay_max"), F.lit(0)).alias("max"),
            v.json_or(F.col("_currency"), F.lit(fixed.DEFAULT_CURRENCY)).alias("currency"),
        ).alias("salary"),
        v.utc_stamp(F.col("ts")).alias("timestamp"),
    )
    valid = classified.where(F.col("status") == OK)
    return valid.select(*_keys(classified), F.to_json(document).alias("payload"))


def normalized(classified: DataFrame) -> DataFrame:
    """Typed, cleaned requests, valid ones only.

    Defaults as in the payload; enum codes trimmed and lower-case; a single
    job type or skill becomes a list; numbers are read leniently, and
    ``numbers_fit`` is false where one was too long for a BIGINT and became 0.
    ``request_hash`` orders requests of one user and time.
    """

    def code(text: Column) -> Column:
        return F.lower(v.js_trim(text))

    def number(column: str) -> Column:
        return v.lenient_int(v.json_text(F.col(column)))

    valid = classified.where(F.col("status") == OK)
    return valid.select(
        *_keys(classified),
        v.json_text_or(F.col("_user"), F.col("_made_id")).alias("user_id"),
        code(v.json_text(F.col("_preference"))).alias("work_preference"),
        F.struct(
            v.json_text_or(F.col("_country"), "").alias("country"),
            v.json_text_or(F.col("_city"), "").alias("city"),
        ).alias("location"),
        v.json_text(F.col("_field")).alias("field"),
        v.json_list(F.col("_skills")).alias("skills"),
        number("_experience").alias("experience"),
        F.transform(v.json_list(F.col("_job_type")), code).alias("job_type"),
        code(v.json_text_or(F.col("_seniority"), fixed.DEFAULT_SENIORITY)).alias("seniority"),
        F.struct(
            number("_pay_min").alias("min"),
            number("_pay_max").alias("max"),
            v.json_text_or(F.col("_currency"), fixed.DEFAULT_CURRENCY).alias("currency"),
        ).alias("salary"),
        v.json_text(F.col("_api_key")).alias("api_key"),
        v.utc_stamp(F.col("ts")).alias("stamp"),
        reduce(Column.__and__, [v.int_fits(v.json_text(F.col(c))) for c in _NUMBERS]).alias("numbers_fit"),
        F.xxhash64("body").alias("request_hash"),
    )


def latest_profiles(
    requests: DataFrame, order: Sequence[str] = ("stamp", "request_hash")
) -> DataFrame:
    """Profile of each user from their latest normalised request.

    ``order`` names the columns that put the requests of a user in time; the last
    must tell any two that differ apart, so that a re-run takes the same one. The
    literal bound of one row has Spark drop older requests map-side.
    """
    newest = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in order])
    latest = requests.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= 1)
    return latest.select(
        "user_id",
        "work_preference",
        "location.country",
        "location.city",
        "field",
        clean_skills(F.col("skills")).alias("skills"),
        "experience",
        "job_type",
        "seniority",
        F.col("salary.min").alias("want_min"),
        F.col("salary.max").alias("want_max"),
        "salary.currency",
    )


def _keys(df: DataFrame) -> list[str]:
    """Columns the caller brought along, apart from the body and its parse."""
    return [c for c in df.columns if c not in _INTERNAL]
