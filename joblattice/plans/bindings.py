"""The test tables seen as listings, profiles, events, requests and toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the bindings -------------------------------------------

WORDS = (
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
)
KINDS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
THINGS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
FIELDS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(texts, position) -> F.Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), position.cast("int"))


def listings_of(orders: DataFrame, parts: DataFrame) -> DataFrame:
    """One listing per order; title and company come from one of all parts. The
    orders may be a stream."""
    k = F.col("o_orderkey")
    # Part keys run from 0 without a gap; their number is one row for the plan.
    orders = orders.withColumn("p_partkey", k % parts.agg(F.count("*")).scalar())
    parts = parts.select("p_partkey", "p_name", "p_type", "p_brand")
    k_text = k.cast("string")
    country = F.concat(F.lit("NATION_"), (k % 25).cast("string"))
    low = F.concat(F.lit("$"), (20 + k % 100).cast("string"), F.lit("k"))
    high = F.concat(F.lit("–$"), (40 + k % 100).cast("string"), F.lit("k"))
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    return orders.join(parts, "p_partkey").select(
        k.alias("id_num"),
        k_text.alias("id"),
        F.concat("p_name", F.when(k % 6 == 0, " / ").otherwise(" "), "p_type").alias("title"),
        F.col("p_brand").alias("company"),
        F.when(status == "O", "Remote").otherwise(country).alias("location"),
        country.alias("country"),
        F.when(status == "O", "remote").when(status == "F", "on-site").otherwise("hybrid").alias("work_mode"),
        _pick(("full-time", "part-time", "freelance", "contract"), k % 4).alias("type"),
        (F.floor(k / 4) % 4).alias("band"),
        _pick(FIELDS, F.floor(k / 7) % 5).alias("field"),
        F.when(k % 10 == 0, "$80–$100/hr")
        .when(k % 10 == 1, low)
        .when(k % 10 == 2, F.format_string("€%d–%dK", 20 + k % 100, 40 + k % 100))
        .when(k % 10 == 3, F.format_string("%d,500 GBP", 20 + k % 100))
        .when(k % 10 == 4, F.format_string("E£%d.5k - E£%dk", 20 + k % 100, 40 + k % 100))
        .when(k % 10 == 5, F.format_string("%d € / hour", 20 + k % 100))
        .when(k % 10 == 6, F.format_string("$%d.25M", 1 + k % 3))
        .when(k % 70 == 7, "Competitive")
        .otherwise(F.concat(low, high))
        .alias("salary"),
        ((k * 37) % 101).cast("int").alias("score"),
        F.when(priority == "1", "LinkedIn")
        .when(priority == "2", "Indeed")
        .when(priority == "3", "RemoteOK")
        .when(priority == "4", "Wuzzuf")
        .otherwise("Glassdoor")
        .alias("source"),
        F.concat(F.lit("https://example.org/jobs/"), k_text).alias("link"),
        F.to_date("o_orderdate").alias("posted_on"),
        (k % 9 == 0).alias("bookmarked"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings_of(table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per customer; one or two distinct skills, every fourth up to six, among them
    one of two words, in every eighth typed as "NEW-ROD"."""
    c = F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    skill1, skill2 = _pick(WORDS, c % 16), _pick(WORDS, F.floor(c / 16) % 16)
    kind, thing = _pick(KINDS, F.floor(c / 4) % 8), _pick(THINGS, F.floor(c / 32) % 8)
    third = F.when(c % 8 == 0, F.upper(F.concat_ws("-", kind, thing))).otherwise(F.concat_ws(" ", kind, thing))
    fourth = _pick(WORDS, (c * 7 + 3) % 16)
    fifth, sixth = _pick(WORDS, (F.floor(c / 64) + 11) % 16), _pick(WORDS, (F.floor(c / 1024) + 2) % 16)
    skills = (
        F.when(c % 8 == 0, F.array(skill1, skill2, third, fourth, fifth, sixth))
        .when(c % 4 == 0, F.array(skill1, skill2, third, fourth))
        .otherwise(F.array(skill1, skill2))
    )
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        c.alias("user_id"),
        _pick(("remote", "on-site", "hybrid"), c % 3).alias("work_preference"),
        "country",
        F.col("c_mktsegment").alias("field"),
        skill1.alias("skill1"),
        skill2.alias("skill2"),
        F.array_distinct(skills).alias("skills"),
        (c % 15).cast("int").alias("experience"),
        F.floor(F.greatest("c_acctbal", F.lit(0.0))).alias("want_min"),
        F.when(c % 50 == 0, "Teams").when(c % 10 == 0, "Pro").otherwise("Free").alias("plan"),
    )


def number_in_props(props) -> F.Column:
    return F.regexp_extract(props, "[0-9]+", 0).try_cast("bigint")


def events_of(raw: DataFrame) -> DataFrame:
    """Events with the number in ``props`` pulled out; batch or stream."""
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        number_in_props("props").alias("k"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """One raw webhook body per event, some of them broken or incomplete."""
    k, kind = F.col("k"), F.col("event_type")
    preference = (
        F.when(kind == "signup", "")
        .when(kind == "view", ',"workPreference":"remote"')
        .when(kind == "click", ',"workPreference":"on-site"')
        .otherwise(',"workPreference":"Hybrid"')
    )
    place = F.when(k % 3 == 0, F.format_string(',"location":{"country":"C%d","city":" Oslo "}', k % 5)).when(
        k % 3 == 1, ',"location":{"country":"C9"}'
    )
    pay = F.when(k % 9 == 0, F.format_string(',"salary":{"min":"%d,500","max":%d,"currency":"EUR"}', k, k * 1000)).when(
        k % 9 == 1, ',"salary":{"min":99999999999999999999}'
    )
    more = F.concat(
        F.coalesce(place, F.lit("")),
        F.coalesce(pay, F.lit("")),
        F.when(k % 8 == 0, ',"seniority":" Senior "').otherwise(""),
    )
    years = F.when(k == 7, F.lit(99_999_999_999)).otherwise(k % 6)
    skills = F.when(k % 10 == 0, "[]").when(k % 10 == 1, '"React"').otherwise('["a","b"]')
    job_type = (
        F.when(k % 7 == 0, ',"jobType":"Full-time"')
        .when(k % 7 == 1, ',"jobType":["contract"]')
        .otherwise("")
    )
    user = F.when(k % 4 == 0, '""').otherwise(F.format_string('"%d"', "user_id"))
    body = F.concat(
        F.lit('{"userId":'), user, preference,
        F.format_string(',"field":"F%d","skills":', k % 5), skills, job_type,
        more,
        F.format_string(',"experience":%d}', years),
    )
    behind = _pick((" trailing", "}", '{"a":1}', "] x"), k % 4)
    broken = F.when(k % 2 == 0, "{bad").otherwise(F.concat(body, behind))
    return events.select(
        "event_id",
        "ts",
        F.when(kind == "error", broken)
        .when(k == 50, "null")
        .when(k == 51, F.concat(F.lit("\ufeff"), body))
        .otherwise(body)
        .alias("body"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(events(spark, sf_dir))


def toggles_of(events: DataFrame) -> DataFrame:
    hot = F.col("event_id") % 2 == 0
    listing = F.when(hot, F.col("k") % 10).otherwise(F.col("event_id").cast("bigint"))
    return events.select("user_id", listing.alias("id_num"), "ts", "event_id")


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmark toggles: half name ten hot listings, half any id, known or not."""
    return toggles_of(events(spark, sf_dir))


def profile_updates_of(events: DataFrame) -> DataFrame:
    """Partial profile updates; every tenth k sets its field to null."""
    k = F.col("k")

    def update(kind: str, value) -> F.Column:
        given = F.when(k % 10 != 0, value)
        return F.when(F.col("event_type") == kind, F.struct(given.alias("value")))

    salary = F.struct(
        (k * 1000).alias("min"), (k * 2000).alias("max"), F.lit("EUR").alias("currency")
    )
    return events.where(F.col("event_type") != "error").select(
        "user_id",
        "ts",
        "event_id",
        update("view", _pick(("remote", "on-site", "hybrid"), k % 3)).alias("work_preference"),
        update("click", F.format_string("F%d", k % 5)).alias("field"),
        update("purchase", salary).alias("salary"),
        update("signup", (k % 15).cast("int")).alias("experience"),
    )


def profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_updates_of(events(spark, sf_dir))
