"""Score, ranking and thresholds against a plain loop over all pairs."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed
from joblattice.operators import matching

WORDS = ["react", "java", "go", "sql", "lead", "data", "web", "ops"]
LISTING = (
    "id_num bigint, title string, company string, location string, link string, field string, work_mode string, "
    "country string, band int, posted_on date, source string"
)
PROFILE = (
    "user_id bigint, field string, skills array<string>, work_preference string, country string, experience int, "
    "plan string"
)


def make(seed, n_listings, n_profiles, hot):
    """Random tables; ``hot`` is the share of rows that agree in all keys."""
    r = random.Random(seed)
    listings, profiles = [], []
    for i in range(n_listings):
        common = r.random() < hot
        words = ["react", "web"] if common else r.sample(WORDS, r.randint(0, 4))
        if not common and r.random() < 0.3:
            words.insert(r.randint(0, len(words)), r.choice(["Machine Learning", "learning-machine", "c++", "machine"]))
        title = r.choice([" ", " ", ", ", " / ", "-"]).join(w.upper() if r.random() < 0.2 else w for w in words)
        listings.append((
            i, title if r.random() > 0.03 else None, "c", "l", "#", "f1" if common else r.choice(["f1", "f2", None]),
            "remote" if common else r.choice(["remote", "on-site", "hybrid", None]),
            r.choice(["A", "B", None]), 1 if common else r.choice([0, 1, 2, 3, None]),
            None if r.random() < 0.05 else dt.date(2024, 1, r.randint(1, 5)), r.choice(fixed.SOURCES),
        ))
    for u in range(n_profiles):
        common = r.random() < hot
        skills = ["React", "web"] if common else [
            r.choice([str.upper, str.lower])(w) for w in r.choices(WORDS, k=r.randint(0, 4))
        ]
        if r.random() < 0.4:
            skills.append(r.choice(["machine learning", "Machine-LEARNING", "C++", "c", "learning", "web data", "  ", "java go sql"]))
        profiles.append((
            u, "f1" if common else r.choice(["f1", "f2"]), skills,
            "remote" if common else r.choice(["remote", "on-site", "hybrid", "other", None]),
            r.choice(["A", "B", None]), 3 if common else r.choice([-1, 0, 2, 5, 11, None]),
            r.choice(["Free", "Pro", "Teams"]),
        ))
    return listings, profiles


def band_of(years):
    if years is None or years < 0:
        return None
    return 0 if years < 2 else 1 if years < 5 else 2 if years < 10 else 3


def plain_words(text):
    return re.findall(r"\.?[^\W_]+(?:[.+#]+[^\W_]+)*[+#]*", text.lower())


def all_pairs(listings, profiles):
    """{user: [(id, date, skill, experience, location, score, source)]}"""
    out = {}
    for u, field, skills, mode, country, years, _ in profiles:
        skills = {" ".join(plain_words(s)) for s in skills}
        for i, title, _, _, _, l_field, l_mode, l_country, l_band, day, source in listings:
            if l_field != field or l_field is None or not skills or title is None:
                continue
            if l_mode == "remote":
                reach = mode in ("remote", "hybrid")
            else:
                reach = mode in ("on-site", "hybrid") and country is not None and l_country == country
            line = " " + " ".join(plain_words(title)) + " "
            hits = sum(s != "" and f" {s} " in line for s in skills)
            if not reach or not hits:
                continue
            own = band_of(years)
            gap = None if own is None or l_band is None else abs(own - l_band)
            parts = (60 * hits // len(skills), {0: 20, 1: 10}.get(gap, 0), (10 if l_mode == mode else 0) + 10)
            out.setdefault(u, []).append((i, day, *parts, sum(parts), source))
    return out


def ranked(rows, k):
    key = lambda r: (-r[5], -(r[1].toordinal() if r[1] else 0), r[0])
    return [(r[0], *r[2:6], n + 1) for n, r in enumerate(sorted(rows, key=key)[:k])]


@pytest.fixture(scope="module", params=[(1, 60, 40, 0.0), (2, 150, 40, 0.5)], ids=["even", "hot"])
def tables(spark, request):
    listings, profiles = make(*request.param)
    frames = spark.createDataFrame(listings, LISTING).cache(), spark.createDataFrame(profiles, PROFILE).cache()
    return frames, profiles, all_pairs(listings, profiles)


def by_user(df, columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["user_id"], []).append(tuple(r[c] for c in columns))
    return {u: sorted(rows, key=lambda r: r[-1]) for u, rows in out.items()}


@pytest.mark.parametrize("k", [1, 4, 20])
def test_top_matches(tables, k):
    (listings, profiles), _, pairs = tables
    got = by_user(matching.top_matches(listings, profiles, k), ["id_num", *matching.PARTS, "rank"])
    assert got == {u: ranked(rows, k) for u, rows in pairs.items()}


def test_score_counts_and_rank_ranges(tables):
    (listings, profiles), _, pairs = tables
    counts = matching.score_counts(listings, profiles)
    got = {(r["user_id"], *[r[p] for p in matching.PARTS]): r["listings"] for r in counts.collect()}
    expected = {}
    for u, rows in pairs.items():
        for r in rows:
            expected[(u, *r[2:6])] = expected.get((u, *r[2:6]), 0) + 1
    assert got == expected
    spans = {}
    for u, rows in pairs.items():
        for *_, score, rank in ranked(rows, len(rows)):
            low, high = spans.get((u, score), (rank, rank))
            spans[(u, score)] = (min(low, rank), max(high, rank))
    ranges = matching.rank_ranges(counts).collect()
    assert {(r["user_id"], r["score"]): (r["first_rank"], r["last_rank"]) for r in ranges} == spans


@pytest.mark.parametrize("score", [1, 40, 60, 75, 90, 100])
def test_matches_at_least(tables, score):
    (listings, profiles), _, pairs = tables
    got = {(r["user_id"], r["id_num"], r["score"]) for r in matching.matches_at_least(listings, profiles, score).collect()}
    assert got == {(u, r[0], r[5]) for u, rows in pairs.items() for r in rows if r[5] >= score}


def test_candidate_counts(spark, tables):
    (listings, profiles), people, _ = tables
    rows = listings.collect()
    expected = {}
    for u, field, _, mode, country, _, _ in people:
        n = sum(
            1 for r in rows if r["field"] == field and (
                mode in ("remote", "hybrid") if r["work_mode"] == "remote"
                else mode in ("on-site", "hybrid") and country is not None and r["country"] == country))
        if n:
            expected[u] = n
    got = {r["user_id"]: r["candidates"] for r in matching.candidate_counts(listings, profiles).collect()}
    assert got == expected


def test_plan_limits_and_sources(spark, tables):
    (listings, profiles), people, pairs = tables
    plan = {p[0]: p[6] for p in people}
    limits = {name: (k, sources) for name, k, _, sources in fixed.PLANS}
    got = by_user(matching.top_by_plan(listings, profiles), ["id_num", *matching.PARTS, "rank"])
    expected = {}
    for u, found in pairs.items():
        k, sources = limits[plan[u]]
        kept = ranked([r for r in found if r[6] in sources], k)
        if kept:
            expected[u] = kept
    assert got == expected


def test_no_pair_with_one_hit_is_formed(spark):
    """What two words are needed for meets on two words: the join's own rows have them."""
    held = lambda text: text.replace(" ", matching.BETWEEN)
    titles = [("f", held("a b c")), ("f", held("b d")), ("f", "c"), ("g", held("a b"))]
    titles = spark.createDataFrame(titles, "field string, title string")
    rows = [("f", ["a", "b", "x"]), ("f", ["d", "b", "c"]), ("f", ["x", "a"]), ("g", ["b", "a"])]
    interests = spark.createDataFrame(
        [(f, ",".join(s), s, len(s)) for f, s in rows], "field string, interest string, skills array<string>, n_skills int"
    )
    found = matching._meet(titles, interests, (), F.lit(2))
    got = sorted((r["field"], r["title"].replace(matching.BETWEEN, " "), r["interest"], r["hits"]) for r in found.collect())
    assert got == [("f", "a b c", "a,b,x", 2), ("f", "a b c", "d,b,c", 2), ("f", "b d", "d,b,c", 2), ("g", "a b", "b,a", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "w1" in plan.split("Join Inner")[1].split("\n")[0]


def test_only_phrases_of_the_dictionary_are_held(spark):
    titles = ["Machine Learning Engineer", "Learning Machine", "C++ / C# dev", "nothing here", "machine, learning"]
    texts = spark.createDataFrame([(t,) for t in titles], "text string")
    dictionary = spark.createDataFrame([(p,) for p in ("machine learning", "learning", "c++", "c", "deep machine learning")], "phrase string")
    got = {r.text: r.title.split(matching.BETWEEN) for r in matching.held_phrases(texts, dictionary).collect()}
    assert got == {
        "Machine Learning Engineer": ["learning", "machine learning"], "Learning Machine": ["learning"],
        "C++ / C# dev": ["c++"], "machine, learning": ["learning", "machine learning"],
    }
    assert matching.held_phrases(texts, dictionary.limit(0)).isEmpty()


def test_result_documents(tables):
    (listings, profiles), _, pairs = tables
    top = matching.top_matches(listings, profiles, 3)
    full = matching.with_listing(top, listings, ["title", "company", "location", "link"])
    docs = {r["user_id"]: json.loads(r["document"]) for r in matching.result_documents(full).collect()}
    assert {u: [j["score"] for j in d["jobs"]] for u, d in docs.items()} == {
        u: [r[4] for r in ranked(rows, 3)] for u, rows in pairs.items()
    }
    assert all(list(j) == ["title", "company", "location", "score", "link"] for d in docs.values() for j in d["jobs"])


def test_documents_are_made_once_for_users_alike(spark, tables):
    (listings, profiles), _, _ = tables
    columns = ["title", "company", "location", "link"]
    # Some users stand twice, with the same or another profile; some have no id.
    more = profiles.withColumn("user_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id") - F.col("user_id") % 3))
    people = profiles.unionByName(more)
    owners, top = matching.top_signatures(listings, people, 3)
    got = matching.user_documents(owners, matching.with_listing(top, listings, columns))
    plain = matching.result_documents(matching.with_listing(matching.top_matches(listings, people, 3), listings, columns))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert top.count() < matching.top_matches(listings, people, 3).count()


def test_groups_are_cut_before_the_first_shuffle(tables):
    (listings, profiles), _, _ = tables
    plan = matching.top_matches(listings, profiles, 20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("WindowGroupLimit") >= 6
