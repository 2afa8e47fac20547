"""Search strings sent to the job boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_strings(profiles: DataFrame) -> DataFrame:
    """One or two search strings per skill of a profile.

    remote: "{skill} {field} remote"; on-site: "{field} {place} {skill}" with
    the city, or the country when no city is given; hybrid: both.
    """
    skill, mode = F.col("skill"), F.col("work_preference")
    place = F.coalesce(F.nullif("city", F.lit("")), F.nullif("country", F.lit("")))
    remote = F.concat_ws(" ", skill, "field", F.lit("remote"))
    local = F.concat_ws(" ", "field", place, skill)
    strings = (
        F.when(mode == "remote", F.array(remote))
        .when(mode == "on-site", F.array(local))
        .when(mode == "hybrid", F.array(remote, local))
    )
    return profiles.withColumn("skill", F.explode("skills")).select(
        "user_id", F.explode(strings).alias("search")
    )
