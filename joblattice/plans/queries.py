"""Registered queries: each takes (spark, directory of the tables)."""

from __future__ import annotations

import secrets as random_secrets
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice import schemas
from joblattice.config import SECRET_CONF
from joblattice.functions import dimensions, secrets, skills, values
from joblattice.functions import fixed_values as fixed
from joblattice.functions.listing import display_line, salary_parts
from joblattice.operators import alerts, bands, dashboard, filters, intake, matching, searches, state
from joblattice.plans import bindings as b
from joblattice.session import apply_settings, shared_folder
from joblattice.sources import listings as boards
from joblattice.sources import search_files, store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAVED_TERMS = ("ring", "RED", "brand#2", "widget economy", "%")
CARD = ["id_num", "title", "company", "location", "source", "score"]


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(apply_settings(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def profile_fields(updates: DataFrame) -> dict:
    """Seed of the fields the test updates carry."""
    return {f: v for f, v in state.profile_seed().items() if f in updates.columns}


def flat_profile(folded: DataFrame) -> DataFrame:
    return folded.select(
        "user_id", "work_preference", "field", "experience",
        F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max"),
        F.col("salary.currency").alias("currency"),
    )


# --- listings ----------------------------------------------------------------


@query
def listings_scan(spark, sf):
    return b.listings(spark, sf).select(
        "id", "title", "company", "location", "type", "salary", "score", "source", "link",
        "posted_on", "bookmarked", display_line(F.col("company"), F.col("location")).alias("line"),
    )


@query
def listings_union(spark, sf):
    rows = b.listings(spark, sf).select("id_num", "title", "salary", "source")
    parts = {s: rows.where(F.col("source") == s).drop("source") for s in fixed.SOURCES}
    parts["Wuzzuf"] = parts["Wuzzuf"].drop("salary")
    return boards.union_boards(parts)


def _pulls(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored listings and two pulls."""
    old = b.listings(spark, sf).select("id_num", "title", "posted_on", "score")
    # Pulls that are newer, of the same date and older; some listings come twice.
    days = (F.floor(F.col("id_num") / 3) % 3).cast("int") - 1
    first = old.where(F.col("id_num") % 3 == 0).withColumns(
        {"posted_on": F.date_add("posted_on", days), "score": 100 - F.col("score")}
    )
    second = first.where(F.col("id_num") % 5 == 0).withColumns(
        {"posted_on": F.date_add("posted_on", -1), "score": F.lit(7)}
    )
    return old, first, second


@query
def listings_refresh(spark, sf):
    old, first, second = _pulls(spark, sf)
    return boards.refresh(old, first.unionByName(second))


@query
def listings_store(spark, sf):
    """Listings stored in buckets of their id and refreshed by two pulls."""
    path = _shared_path(spark, "listing-store")
    old, first, second = _pulls(spark, sf)
    store.create(old, path, buckets=8)
    for pull in (first, second):
        store.refresh(spark, path, pull)
    return store.read(spark, path)


@query
def page_extract(spark, sf):
    return boards.extract_pages(b.table(spark, sf, "pages"))


@query
def salary_parsed(spark, sf):
    pay = salary_parts(F.col("salary")).alias("pay")
    return b.listings(spark, sf).select("id_num", "salary", pay).select("id_num", "salary", "pay.*")


@query
def option_labels(spark, sf):
    rows = b.listings(spark, sf).select(
        "id_num", "type", "work_mode", dimensions.band_text(F.col("band"), "label").alias("seniority_label")
    )
    rows = dimensions.with_label(rows, "type", dimensions.job_types(spark), "type_label")
    return dimensions.with_label(rows, "work_mode", dimensions.work_modes(spark), "work_label")


@query
def score_tier_counts(spark, sf):
    return dashboard.tier_counts(b.listings(spark, sf))


@query
def company_initial_counts(spark, sf):
    return dashboard.initial_counts(b.listings(spark, sf))


# --- requests ----------------------------------------------------------------


@query
def intake_status(spark, sf):
    return intake.responses(intake.classify(b.requests(spark, sf)))


@query
def request_payload(spark, sf):
    return intake.payloads(intake.classify(b.requests(spark, sf)))


@query
def request_normalized(spark, sf):
    return intake.normalized(intake.classify(b.requests(spark, sf))).select(
        "event_id", "user_id", "work_preference", "location.country", "location.city", "field",
        F.array_join("skills", "|").alias("skills"), "experience",
        F.array_join("job_type", "|").alias("job_type"), "seniority",
        F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max"),
        F.col("salary.currency").alias("currency"), "stamp", "numbers_fit",
    )


@query
def request_profiles(spark, sf):
    valid = intake.normalized(intake.classify(b.requests(spark, sf)))
    return intake.latest_profiles(valid, ["stamp", "event_id"]).select(
        "user_id", "work_preference", "country", "field", F.array_join("skills", "|").alias("skills"),
        "experience", F.array_join("job_type", "|").alias("job_type"), "seniority", "currency",
    )


@query
def lenient_int(spark, sf):
    props = b.table(spark, sf, "events").select(F.col("event_id").alias("id_num"), "props")
    salaries = b.listings(spark, sf).select("id_num", "salary")
    texts = [
        props.select(F.lit("props").alias("origin"), "id_num", F.col("props").alias("text")),
        props.select(
            F.lit("number").alias("origin"), "id_num", F.regexp_replace("props", "^[^0-9]+", "").alias("text")
        ),
        salaries.select(F.lit("salary").alias("origin"), "id_num", F.ltrim("salary", F.lit("$")).alias("text")),
    ]
    return texts[0].unionByName(texts[1]).unionByName(texts[2]).withColumn(
        "number", values.lenient_int(F.col("text"))
    )


# --- profiles ----------------------------------------------------------------


@query
def zero_as_blank(spark, sf):
    return b.profiles(spark, sf).select(
        "user_id",
        values.zero_as_blank(F.col("experience")).alias("experience_text"),
        values.zero_as_blank(F.col("want_min")).alias("want_min_text"),
    )


@query
def secret_roundtrip(spark, sf):
    # The session's key where it has one; else one for this query alone.
    given = spark.conf.get(SECRET_CONF, None)
    key = secrets.secret_key(spark) if given else F.lit(random_secrets.token_hex(16))
    clear = F.concat(F.lit("key-"), F.col("user_id").cast("string"))
    stored = b.profiles(spark, sf).select("user_id", clear.alias("clear")).withColumn(
        "stored", secrets.encrypt(F.col("clear"), key)
    )
    return stored.select(
        "user_id",
        secrets.masked(F.col("clear")).alias("shown"),
        (F.col("stored") != F.col("clear").cast("binary")).alias("hidden"),
        (secrets.decrypt(F.col("stored"), key) == F.col("clear")).alias("readable"),
    )


@query
def search_strings(spark, sf):
    return searches.search_strings(b.profiles(spark, sf).withColumn("city", F.lit("")))


@query
def experience_band(spark, sf):
    band = dimensions.experience_band(F.col("experience"))
    return b.profiles(spark, sf).select("user_id", "experience", band.alias("band")).select(
        "*",
        dimensions.band_text(F.col("band"), "code").alias("code"),
        dimensions.band_text(F.col("band"), "label").alias("label"),
    )


@query
def experience_band_table(spark, sf):
    """The band of ``experience_band`` by a join with the bands as a table."""
    people = b.profiles(spark, sf).select("user_id", "experience")
    return bands.in_bands(people, "experience", bands.experience_bands(spark)).drop("lo", "hi")


@query
def skills_clean(spark, sf):
    typed = F.array(
        F.concat(F.lit(" "), F.col("skill1")), F.col("skill1"), F.lit("  "), F.upper("skill2"), F.col("skill2")
    )
    return b.profiles(spark, sf).select("user_id", F.array_join(skills.clean_skills(typed), "|").alias("skills"))


@query
def skills_removed(spark, sf):
    left = skills.remove_skill(F.col("skills"), F.col("skill1"))
    return b.profiles(spark, sf).select(
        "user_id", F.array_join(left, "|").alias("skills"), F.size(left).alias("n")
    )


@query
def jobtype_toggle(spark, sf):
    start = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("full-time"))).otherwise(
        F.array().cast("array<string>")
    )
    one = skills.toggle(start, "full-time")
    two = skills.toggle(skills.toggle(start, "contract"), "full-time")
    return b.profiles(spark, sf).select(
        "user_id",
        F.array_join(one, "|").alias("one_toggle"),
        F.array_join(two, "|").alias("two_toggles"),
        F.array_contains(two, "full-time").alias("has_full_time"),
    )


# --- search and filters ------------------------------------------------------


@query
def search_listings(spark, sf):
    return filters.search(b.listings(spark, sf), "RING").select(*CARD)


@query
def filter_source(spark, sf):
    return filters.from_source(b.listings(spark, sf), "RemoteOK").select(*CARD)


@query
def dashboard_filter(spark, sf):
    return filters.dashboard(b.listings(spark, sf), "brand#2", "LinkedIn").select(*CARD)


@query
def filter_facets(spark, sf):
    rows = b.listings(spark, sf).withColumn("seniority", dimensions.band_text(F.col("band"), "code"))
    wanted = {
        "location": ["Remote", "NATION_3", "NATION_7"],
        "type": ["full-time", "contract"],
        "work_mode": ["remote", "hybrid"],
        "seniority": ["mid", "senior"],
    }
    return filters.facets(rows, wanted).select(*CARD, *[c for c in wanted if c != "location"])


@query
def filter_salary(spark, sf):
    return filters.salary_between(b.listings(spark, sf), 50_000, 90_000).select("id_num", "salary", "pay.lo", "pay.hi")


@query
def filter_score(spark, sf):
    return filters.score_at_least(b.listings(spark, sf), 80).select(*CARD)


# --- matching ----------------------------------------------------------------


@query
def match_candidates(spark, sf):
    return matching.candidate_counts(b.listings(spark, sf), b.profiles(spark, sf))


@query
def matches_scored(spark, sf):
    return matching.score_counts(b.listings(spark, sf), b.profiles(spark, sf))


@query
def rank_ranges(spark, sf):
    return matching.rank_ranges(matching.score_counts(b.listings(spark, sf), b.profiles(spark, sf)))


@query
def matches_ranked(spark, sf):
    deepest = max(k for _, k, _, _ in fixed.PLANS)
    return matching.top_matches(b.listings(spark, sf), b.profiles(spark, sf), deepest)


def _jobs(spark, sf, columns) -> DataFrame:
    rows = b.listings(spark, sf)
    top = matching.top_matches(rows, b.profiles(spark, sf), fixed.TOP_MATCHES)
    return matching.with_listing(top, rows, columns)


@query
def matches_topk(spark, sf):
    return _jobs(spark, sf, ["title", "company", "location", "source"]).select(
        "user_id", "rank", "id_num", "title", "company", "location", "source", "posted_on", "score"
    )


@query
def plan_topk(spark, sf):
    return matching.top_by_plan(b.listings(spark, sf), b.profiles(spark, sf)).select(
        "user_id", "plan", "rank", "id_num", "score"
    )


@query
def result_documents(spark, sf):
    rows = b.listings(spark, sf)
    owners, top = matching.top_signatures(rows, b.profiles(spark, sf), fixed.TOP_MATCHES)
    return matching.user_documents(owners, matching.with_listing(top, rows, ["title", "company", "location", "link"]))


@query
def alerts_new(spark, sf):
    # All listings are the new pull; what was toggled stands for what was sent.
    high = matching.class_matches_at_least(b.listings(spark, sf), b.profiles(spark, sf), fixed.SCORE_HIGH)
    return alerts.not_sent(high, b.toggles(spark, sf)).select("user_id", "id_num", "score")


@query
def saved_search_hits(spark, sf):
    terms = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in SAVED_TERMS])).alias("term"))
    return alerts.saved_search_hits(b.listings(spark, sf), terms)


@query
def alerts_by_class(spark, sf):
    """Alerts as in ``alerts_new``, on a third of the listings, from stored classes expanded for
    all buckets of users."""
    path = _shared_path(spark, "class-alerts")
    new = b.listings(spark, sf).where(F.col("id_num") % 3 == 0)
    found = matching.class_matches_at_least(new, b.profiles(spark, sf), fixed.SCORE_HIGH)
    alerts.write_class_alerts(*found, path)
    return alerts.class_alerts(spark, path, sent=b.toggles(spark, sf)).select("user_id", "id_num", "score")


@query
def matches_refreshed(spark, sf):
    """The best matches before a pull, stored, and brought up to date by it."""
    path = _shared_path(spark, "top")
    now, people = b.listings(spark, sf), b.profiles(spark, sf)
    i = F.col("id_num")
    # Before: a tenth of the listings not there yet, some with another title, some that go.
    old = now.where(i % 10 != 0).withColumn("title", F.when(i % 31 == 1, "red ring PROMO").otherwise(F.col("title")))
    gone = now.where(i % 97 == 5).withColumn("id_num", -i - 1)
    matching.top_matches(old.unionByName(gone), people, fixed.TOP_MATCHES).write.parquet(path)
    changed = now.where((i % 10 == 0) | (i % 31 == 1)).select("id_num").unionByName(gone.select("id_num"))
    top = spark.read.parquet(path)
    return matching.refreshed_top(top, now, changed, people, fixed.TOP_MATCHES)


@query
def search_stored(spark, sf):
    """Searches over stored listings that open only files which can hold the term."""
    path = _shared_path(spark, "searchable")
    search_files.write_searchable(b.listings(spark, sf).select(*CARD), path)
    terms = ("old RING", "brand#13", "#")
    found = [search_files.search_stored(spark, path, t).select(F.lit(t).alias("term"), "id_num") for t in terms]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- stored tables ---------------------------------------------------------


def _shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def jobs_roundtrip(spark, sf):
    """The best matches stored by user, a bucket's users written again, read back."""
    path = _shared_path(spark, "jobs")
    rows = b.listings(spark, sf)
    top = matching.top_matches(rows, b.profiles(spark, sf), fixed.TOP_MATCHES).drop("posted_on")
    stamp = F.lit("2024-01-01").cast("timestamp")
    columns = ["id", "title", "company", "location", "type", "salary", "source", "posted_on", "link"]
    jobs = matching.with_listing(top, rows, columns).withColumn("created_at", stamp)
    tables.write_jobs(jobs, path, buckets=8)
    # One bucket is written again; the others stay.
    again = jobs.where(F.pmod(F.xxhash64("user_id"), F.lit(8)) == 3)
    tables.write_jobs(again, path, buckets=8)
    return tables.read_jobs(spark, path, buckets=8).select(
        "id", "user_id", "title", "company", "location", "type", "salary", "source", "posted_on", "score", "link"
    )


@query
def listings_fixed_schema(spark, sf):
    """Listings written once and scanned with the given schema, no inference."""
    path = _shared_path(spark, "listings")
    rows = b.listings(spark, sf).withColumn("postedAt", F.date_format("posted_on", "yyyy-MM-dd"))
    boards.write_listings(rows.select(*schemas.LISTING.names), path)
    return boards.read_listings(spark, path).select("id", "title", "source", "score", "postedAt")


@query
def skills_added(spark, sf):
    """A skill that is there already, in other case and with blanks, and a new one."""
    people = b.profiles(spark, sf)
    known = skills.add_skill(F.col("skills"), F.concat(F.lit("  "), F.col("skill1"), F.lit(" ")))
    more = skills.add_skill(known, F.lit(" Spark "))
    return people.select("user_id", F.array_join(more, "|").alias("skills"), F.size(more).alias("n"))


@query
def search_is_empty(spark, sf):
    """Whether searches find nothing at all: the page shows a notice then."""
    rows = b.listings(spark, sf)
    terms = ("RING", "no such words")
    flags = [
        filters.search(rows, t).agg((F.count("*") == 0).alias("empty")).select(F.lit(t).alias("term"), "empty")
        for t in terms
    ]
    return flags[0].unionByName(flags[1])


# --- counts ------------------------------------------------------------------


@query
def dashboard_stats(spark, sf):
    return dashboard.stats(b.listings(spark, sf))


@query
def user_dashboard_stats(spark, sf):
    flips = state.bookmark_flips(b.toggles(spark, sf))
    return dashboard.user_stats(state.overlay_jobs(_jobs(spark, sf, ["bookmarked"]), flips))


@query
def user_job_counts(spark, sf):
    people = b.profiles(spark, sf)
    jobs = matching.top_matches(b.listings(spark, sf), people, fixed.TOP_MATCHES)
    users = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return dashboard.jobs_per_user(users, people, jobs)


@query
def source_rollup(spark, sf):
    return dashboard.per_source_with_total(b.listings(spark, sf))


@query
def daily_listings(spark, sf):
    return dashboard.per_day_and_source(b.listings(spark, sf))


@query
def daily_matches(spark, sf):
    top = matching.top_matches(b.listings(spark, sf), b.profiles(spark, sf), fixed.TOP_MATCHES)
    return dashboard.matches_per_day(top)


@query
def avg_score(spark, sf):
    return dashboard.average_scores(b.listings(spark, sf))


@query
def global_top(spark, sf):
    return dashboard.best_listings(b.listings(spark, sf), 100).select("id_num", "title", "score")


# --- state -------------------------------------------------------------------


@query
def bookmark_state(spark, sf):
    return state.bookmark_state(b.toggles(spark, sf), b.listings(spark, sf))


@query
def bookmark_overlay(spark, sf):
    rows = b.listings(spark, sf).select("id_num", "title", "bookmarked")
    return state.overlay(rows, state.bookmark_flips(b.toggles(spark, sf)))


@query
def profile_fold(spark, sf):
    updates = b.profile_updates(spark, sf)
    return flat_profile(state.fold_profile(updates, profile_fields(updates)))


@query
def rate_limited(spark, sf):
    return state.requests_per_window(b.events(spark, sf)).select(
        "user_id", F.to_date("window_start").alias("day"), "requests"
    )


@query
def search_quota(spark, sf):
    clicks = b.events(spark, sf).where(F.col("event_type") == "click")
    return state.within_quota(clicks, b.profiles(spark, sf))


@query
def time_to_first(spark, sf):
    rows = b.events(spark, sf)
    return state.time_to_first_result(
        rows.where(F.col("event_type") == "signup"), rows.where(F.col("event_type") == "view")
    )
