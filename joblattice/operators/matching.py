"""Profiles against listings: candidates, relevance score, ranking, top-k.

A naive join of profiles and listings on (field, place) grows with users times
listings, and one key (all remote listings of a field) may hold a third of all
rows. The jobs here never build that product. They use these facts:

* The score of a pair depends on few values of each side. Of a title only the skill
  phrases of the profiles that it holds count: each distinct title is scanned once for
  them. Listings that agree in field, place, work mode, band and held phrases form a
  *class* and score equal for every profile. A class is cut to its count, or to its k newest
  listings, before anything is joined; both are map-side reductions.
* The skills part of a score depends on the set of phrases held (called title below) and
  on the distinct skill list (the *interest*) only. Most pairs of them share a single phrase,
  and one-hit listings are found phrase by phrase, without forming such pairs. Pairs with
  two hits or more meet on two phrases at once, so every pair formed has them.
* Per interest, listings equal in place, mode, band and number of hits form a
  *cell* and again score equal, so k of them are enough.
* Profiles equal in all scored values share one *signature*: it is scored and
  ranked once and its result handed to each of its users.

A listing that is not among the k newest of its class, word or cell has k
listings above it in every ranking it could be in, so the cuts are exact.

Profiles: user_id, field, skills, work_preference, country, experience.
Listings: id_num, title, field, work_mode, country, band, posted_on.
``scope`` names further columns both sides must agree in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice.config import MATCH, MatchSettings
from joblattice.functions import fixed_values as fixed
from joblattice.functions.dimensions import experience_band
from joblattice.functions.listing import phrase, runs_of, words

ANYWHERE = "*"
NO_BAND = -9
NO_MODE = "?"
TWO = "two or more"
BETWEEN = "\n"  # parts the phrases of a title; no word holds it

PARTS = ["skill_points", "experience_points", "location_points", "score"]
LISTING = ["id_num", "title", "field", "work_mode", "country", "band", "posted_on"]
SETTINGS = [f.name for f in fields(MatchSettings)]


# --- both sides reduced to the columns that decide --------------------------


def listing_place(work_mode: Column, country: Column) -> Column:
    return F.when(work_mode == "remote", F.lit(ANYWHERE)).otherwise(country)


def profile_places(work_preference: Column, country: Column) -> Column:
    """Places a profile looks at; several never hold the same listing."""
    return (
        F.when(work_preference == "remote", F.array(F.lit(ANYWHERE)))
        .when(work_preference == "on-site", F.array(country))
        .when(work_preference == "hybrid", F.array(F.lit(ANYWHERE), country))
    )


def _listing_side(listings: DataFrame, scope: Sequence[str], interests: DataFrame) -> DataFrame:
    """``title`` becomes the sorted set of the skill phrases it holds, as one text.

    Rows that can match nothing are dropped here, in one place: filters the
    optimizer adds to single branches would keep them from sharing a shuffle.
    """
    rows = listings.select(
        "id_num",
        "posted_on",
        *scope,
        "field",
        listing_place(F.col("work_mode"), F.col("country")).alias("place"),
        # Classes are joined on it, so it is never null; no preference reads like this.
        F.coalesce("work_mode", F.lit(NO_MODE)).alias("work_mode"),
        F.coalesce(F.col("band").try_cast("int"), F.lit(NO_BAND)).alias("band"),
        F.col("title").alias("text"),
    ).where("text IS NOT NULL AND field IS NOT NULL AND place IS NOT NULL")
    held = held_phrases(rows.select("text").distinct(), skill_phrases(interests))
    return rows.join(held, "text").drop("text")


def skill_phrases(interests: DataFrame) -> DataFrame:
    """The dictionary: every ``phrase`` that some interest holds."""
    return interests.select(F.explode("skills").alias("phrase")).distinct().where("phrase <> ''")


def held_phrases(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text, title): the dictionary's phrases that stand in a text as consecutive words,
    sorted and joined; texts that hold none are left out.

    Every phrase counts, also one inside a longer one, so that what a profile matches does
    not depend on the skills of others. Runs of words are cut no longer than the longest
    phrase of the dictionary.
    """
    longest = dictionary.agg(F.max(F.size(F.split("phrase", " ")))).scalar()
    cut = texts.select("text", words(F.col("text")).alias("words"), F.sequence(F.lit(1), longest).alias("sizes"))
    sized = cut.select("text", "words", F.explode("sizes").alias("n"))
    runs = sized.select("text", F.explode(runs_of(F.col("words"), F.col("n"))).alias("phrase"))
    found = runs.join(dictionary, "phrase").groupBy("text").agg(F.collect_set("phrase").alias("held"))
    return found.select("text", F.array_join(F.sort_array("held"), BETWEEN).alias("title"))


def _held(title: str = "title") -> Column:
    return F.split(title, BETWEEN)


def _profile_side(
    profiles: DataFrame, scope: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``interest`` is the set of skill phrases as JSON text: one short key."""
    # As for listings, rows that match nothing are dropped in one place.
    skills = F.array_sort(F.array_distinct(F.transform("skills", phrase)))
    return profiles.where(F.size("skills") > 0).select(
        "user_id",
        *scope,
        *keep,
        "field",
        F.to_json(skills).alias("interest"),
        F.coalesce("work_preference", F.lit("")).alias("work_preference"),
        F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce(experience_band(F.col("experience")), F.lit(NO_BAND)).alias("own_band"),
    ).where("field IS NOT NULL AND interest IS NOT NULL")


def _signature(scope: Sequence[str]) -> list[str]:
    return [*scope, "field", "interest", "work_preference", "country", "own_band"]


def _signatures(side: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distinct signatures, one row per place they look at."""
    places = profile_places(F.col("work_preference"), F.col("country"))
    return side.select(*_signature(scope)).distinct().withColumn("place", F.explode(places))


def _class_keys(scope: Sequence[str]) -> list[str]:
    return [*scope, "field", "place", "work_mode", "band", "title"]


def _cell_keys(scope: Sequence[str]) -> list[str]:
    return [*scope, "field", "interest", "n_skills", "place", "work_mode", "band", "hits"]


def _best(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key, with their ``rank`` and the ``hash`` of the key.

    The literal bound cuts groups before the shuffle. The hash leads the sort,
    where one number settles most comparisons of long keys; the keys stay in
    the partitioning, so equal hashes do no harm.
    """
    window = Window.partitionBy("hash", *keys).orderBy(*order)
    hashed = df.withColumn("hash", F.xxhash64(*keys))
    return hashed.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


# --- skills: interests meet titles ------------------------------------------


def _interests(side: DataFrame, scope: Sequence[str]) -> DataFrame:
    skills = F.from_json("interest", "array<string>")
    return (
        side.select(*scope, "field", "interest")
        .distinct()
        .select(*scope, "field", "interest", skills.alias("skills"), F.size(skills).alias("n_skills"))
    )


def _rare_first(interests: DataFrame, titles: DataFrame) -> DataFrame:
    """Order the skills by how many titles hold them, rarest first."""
    seen = (
        titles.select(F.explode(_held()).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    keys = [c for c in interests.columns if c != "skills"]
    counted = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
    return (
        interests.select(*keys, F.explode("skills").alias("word"))
        .join(seen, "word", "left")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(counted)).getField("word").alias("skills"))
    )


def _meet(
    titles: DataFrame, interests: DataFrame, scope: Sequence[str], needed: Column
) -> DataFrame:
    """Pairs (title, interest) with at least ``needed`` hits, each once.

    Where two hits or more are needed, titles and interests meet on pairs of words: no
    pair of them with a single hit is formed. With h of m skills needed, a title that
    holds no two of the first m - h + 2 cannot qualify, in whatever order the skills
    stand; only pairs of those are looked up. What shares several pairs of words
    arrives once for each, and only the arrival on the first is kept, so no
    aggregate follows the join. Where one hit is enough single words do the same.
    """
    held = _held()
    hits = F.size(F.array_intersect("skills", held))
    columns = [*scope, "field", "title", "interest", "n_skills", hits.alias("hits")]

    def first(probe: Column, i: int) -> Column:
        return F.get(F.array_intersect(probe, held), F.lit(i))

    few = F.slice("skills", 1, F.greatest(F.col("n_skills") - needed + 2, F.lit(0)))
    probes = interests.where(needed > 1).select("*", F.explode(_word_pairs(few)).alias("two")).select("*", "two.*")
    found = titles.select("*", F.explode(_word_pairs(held)).alias("two")).select("*", "two.*")
    met = found.drop("two").join(probes.drop("two"), [*scope, "field", "w1", "w2"])
    on_first = (F.col("w1") == F.least(first(few, 0), first(few, 1))) & (
        F.col("w2") == F.greatest(first(few, 0), first(few, 1))
    )
    pairs = met.where(on_first & (hits >= needed)).select(*columns)

    all_words = interests.where(needed <= 1).select("*", F.explode("skills").alias("word"))
    single = titles.select("*", F.explode(held).alias("word")).join(all_words, [*scope, "field", "word"])
    single = single.where(F.col("word") == first(F.col("skills"), 0)).select(*columns)
    return pairs.unionByName(single)


def _word_pairs(words: Column) -> Column:
    """All pairs (w1 < w2) of an array of distinct words."""
    return F.flatten(
        F.transform(
            words,
            lambda x, i: F.transform(
                F.slice(words, i + 2, F.size(words)),
                lambda y: F.struct(F.least(x, y).alias("w1"), F.greatest(x, y).alias("w2")),
            ),
        )
    )


def _looks(
    rows: DataFrame,
    interests: DataFrame,
    signatures: DataFrame,
    scope: Sequence[str],
    needed: Column | str,
) -> DataFrame:
    """Rows with a title, joined to the interests that look at their place and
    hit the title at least ``needed`` times."""
    titles = rows.select(*scope, "field", "title").distinct()
    # Of two hits or more every pair of skills is looked up, in any order.
    ordered = interests if needed is TWO else _rare_first(interests, titles)
    pairs = _meet(titles, ordered, scope, F.lit(2) if needed is TWO else needed)
    places = signatures.select(*scope, "field", "interest", "place").distinct()
    wanted = pairs.join(places, [*scope, "field", "interest"])
    return rows.join(wanted, [*scope, "field", "title", "place"])


def _words(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(_held()).alias("word"))


def _word_looks(
    by_word: DataFrame, interests: DataFrame, signatures: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """Rows of a word, joined to the interests with it that look at their place;
    ``others`` are the further skills of the interest."""
    others = F.array_remove("skills", F.col("word"))
    probes = interests.select("*", F.explode("skills").alias("word"))
    places = signatures.select(*scope, "field", "interest", "place").distinct()
    wanted = probes.withColumn("others", others).join(places, [*scope, "field", "interest"])
    return by_word.join(wanted, [*scope, "field", "word", "place"])


# --- score -------------------------------------------------------------------


def _scored(df: DataFrame, settings: MatchSettings) -> DataFrame:
    """Add the three parts of the score and their sum (0-100, integers)."""
    apart = F.abs(F.col("own_band") - F.col("band"))
    known = (F.col("own_band") != NO_BAND) & (F.col("band") != NO_BAND)
    experience = (
        F.when(known & (apart == 0), settings.same_band_points)
        .when(known & (apart == 1), settings.near_band_points)
        .otherwise(0)
    )
    mode = F.when(F.col("work_mode") == F.col("work_preference"), settings.mode_points).otherwise(0)
    near = (F.col("place") == ANYWHERE) | (F.col("place") == F.col("country"))
    place = F.when(near, settings.place_points).otherwise(0)
    skill = F.floor(F.lit(settings.skill_points) * F.col("hits") / F.col("n_skills")).cast("int")
    return (
        df.withColumn("skill_points", skill)
        .withColumn("experience_points", experience)
        .withColumn("location_points", mode + place)
        .withColumn(
            "score", F.col("skill_points") + F.col("experience_points") + F.col("location_points")
        )
    )


def _score_signatures(
    signatures: DataFrame, cells: DataFrame, scope: Sequence[str], settings: MatchSettings
) -> DataFrame:
    return _scored(signatures.join(cells, [*scope, "field", "interest", "place"]), settings)


# --- queries -----------------------------------------------------------------


def candidate_counts(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listings in reach (field and place) per user, before any relevance test.

    Counts per (field, place) are joined, not the listings themselves.
    """
    place = listing_place(F.col("work_mode"), F.col("country"))
    counts = (
        listings.select("field", place.alias("place"))
        .groupBy("field", "place")
        .agg(F.count("*").alias("n"))
    )
    looks = profiles.select(
        "user_id",
        "field",
        F.explode(profile_places(F.col("work_preference"), F.col("country"))).alias("place"),
    )
    return (
        looks.join(counts, ["field", "place"])
        .groupBy("user_id")
        .agg(F.sum("n").alias("candidates"))
    )


def score_counts(
    listings: DataFrame, profiles: DataFrame, settings: MatchSettings = MATCH
) -> DataFrame:
    """Number of relevant listings per user and score, over all pairs.

    One-hit counts come from counts per word. There a listing with h hits is
    counted h times, so h times the count of each h > 1 is taken off again.
    """
    side = _profile_side(profiles, ())
    signatures, interests = _signatures(side, ()), _interests(side, ())
    classes = _listing_side(listings, (), interests).groupBy(*_class_keys(())).agg(F.count("*").alias("n"))
    # Always true; it has every branch below read the same shuffled counts.
    classes = classes.where("n > 0")

    word_keys = ["field", "place", "work_mode", "band", "word"]
    by_word = _words(classes).groupBy(*word_keys).agg(F.sum("n").alias("n"))
    once = _word_looks(by_word, interests, signatures, ()).withColumn("hits", F.lit(1))
    more = _looks(classes, interests, signatures, (), TWO)
    more = more.groupBy(*_cell_keys(())).agg(F.sum("n").alias("n"))
    entries = F.array(
        F.struct("hits", "n"), F.struct(F.lit(1).alias("hits"), (-F.col("hits") * F.col("n")).alias("n"))
    )
    more = more.withColumn("entry", F.explode(entries)).select(
        *[F.col("entry.hits") if c == "hits" else F.col(c) for c in _cell_keys(())], "entry.n"
    )
    cells = (
        once.select(*_cell_keys(()), "n")
        .unionByName(more)
        .groupBy(*_cell_keys(()))
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    per_signature = (
        _score_signatures(signatures, cells, (), settings)
        .groupBy(*_signature(()), *PARTS)
        .agg(F.sum("n").alias("listings"))
    )
    return side.join(per_signature, _signature(())).select("user_id", *PARTS, "listings")


def rank_ranges(counts: DataFrame) -> DataFrame:
    """Ranks each score of a user spans, over the user's whole ranking.

    Works on ``score_counts``, so a user has one row per score, not per listing.
    """
    levels = counts.groupBy("user_id", "score").agg(F.sum("listings").alias("listings"))
    above = Window.partitionBy("user_id").orderBy(F.col("score").desc())
    return levels.withColumn("last_rank", F.sum("listings").over(above)).select(
        "user_id",
        "score",
        "listings",
        (F.col("last_rank") - F.col("listings") + 1).alias("first_rank"),
        "last_rank",
    )


def top_matches(
    listings: DataFrame,
    profiles: DataFrame,
    k: int,
    scope: Sequence[str] = (),
    keep: Sequence[str] = (),
    settings: MatchSettings = MATCH,
) -> DataFrame:
    """The k best listings of every user with their rank.

    Order: score, then newest, then lowest id. ``keep`` names further profile
    columns to hand through.
    """
    owners, ranked = top_signatures(listings, profiles, k, scope, keep, settings)
    return owners.join(ranked, "signature").select(
        "user_id", *scope, *keep, "id_num", "posted_on", *PARTS, "rank"
    )


def top_signatures(
    listings: DataFrame,
    profiles: DataFrame,
    k: int,
    scope: Sequence[str] = (),
    keep: Sequence[str] = (),
    settings: MatchSettings = MATCH,
) -> tuple[DataFrame, DataFrame]:
    """``top_matches`` before users are put in: (owners, ranked).

    ``owners`` names the ``signature`` of each user, ``ranked`` the k best listings of each
    signature with their rank.

    Listings with one hit come from the k newest per (field, place, mode, band,
    word): what is not among them has k listings with that word, so with at
    least one hit, above it. Only titles with two hits or more are looked up
    title by title.
    """
    newest = [F.col("posted_on").desc_nulls_last(), F.col("id_num").asc()]
    side = _profile_side(profiles, scope, keep)
    signatures, interests = _signatures(side, scope), _interests(side, scope)
    classes = _best(_listing_side(listings, scope, interests), _class_keys(scope), newest, k)
    classes = classes.drop("hash", "rank")

    word_keys = [*scope, "field", "place", "work_mode", "band", "word"]
    by_word = _best(_words(classes), word_keys, newest, k)
    # The k rows of a word go to its interests, and the k of a cell to its signatures, as lists.
    by_word = by_word.groupBy("hash", *word_keys).agg(F.collect_list(F.struct("title", "posted_on", "id_num")).alias("rows"))
    alone = F.filter("rows", lambda r: ~F.arrays_overlap("others", F.split(r["title"], BETWEEN)))
    alone = F.transform(alone, lambda r: F.struct(r["posted_on"].alias("posted_on"), r["id_num"].alias("id_num")))
    one_hit = _word_looks(by_word.drop("hash"), interests, signatures, scope).withColumn("hits", F.lit(1))
    one_hit = one_hit.select(*_cell_keys(scope), alone.alias("rows")).where(F.size("rows") > 0)
    one_hit = one_hit.groupBy(*_cell_keys(scope)).agg(F.flatten(F.collect_list("rows")).alias("rows"))
    one_hit = one_hit.withColumn("rows", F.slice(_newest_first(F.col("rows")), 1, k))

    more = _looks(classes, interests, signatures, scope, TWO)
    more = _best(more.select(*_cell_keys(scope), "id_num", "posted_on"), _cell_keys(scope), newest, k)
    more = more.groupBy("hash", *_cell_keys(scope)).agg(F.collect_list(F.struct("posted_on", "id_num")).alias("rows"))
    # Cells of the two differ in their hits. Two lists of plain values are a third of one of pairs.
    cells = one_hit.unionByName(more.drop("hash")).select(
        *_cell_keys(scope), F.col("rows.id_num").alias("id_num"), F.col("rows.posted_on").alias("posted_on")
    )

    # One short name per signature: its rows are shuffled and sorted several times.
    name = F.unhex(F.md5(F.to_json(F.struct(*_signature(scope))))).alias("signature")
    # A score level is needed only while the levels above it hold fewer than k.
    levels = Window.partitionBy("signature").orderBy(F.col("score").desc())
    above = F.coalesce(
        F.sum(F.size("id_num")).over(levels.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    scored = _score_signatures(signatures, cells, scope, settings).select(name, *PARTS, "id_num", "posted_on")
    needed = scored.withColumn("above", above).where(F.col("above") < k)
    rows = needed.select("signature", *PARTS, F.inline(F.arrays_zip("id_num", "posted_on")))
    ranked = _best(rows, ["signature"], [F.col("score").desc(), *newest], k)
    return side.select("user_id", *scope, *keep, name), ranked.select("signature", "id_num", "posted_on", *PARTS, "rank")


def _newest_first(rows: Column) -> Column:
    """A list of (posted_on, id_num) in the order of ``top_matches``: newest first, no date
    last, then the lowest id, none first."""
    def turned(row: Column) -> Column:
        posted, number = row["posted_on"], row["id_num"]
        return F.struct(posted.alias("posted_on"), number.isNull().alias("none"), F.bitwise_not(number).alias("back"))

    def back(row: Column) -> Column:
        return F.struct(row["posted_on"].alias("posted_on"), F.bitwise_not(row["back"]).alias("id_num"))

    return F.transform(F.sort_array(F.transform(rows, turned), asc=False), back)


def matches_at_least(
    listings: DataFrame, profiles: DataFrame, score: int, settings: MatchSettings = MATCH
) -> DataFrame:
    """Every (user, listing) pair scoring at least ``score``."""
    return expanded(*class_matches_at_least(listings, profiles, score, settings))


def class_matches_at_least(
    listings: DataFrame, profiles: DataFrame, score: int, settings: MatchSettings = MATCH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs scoring at least ``score``, by class: (pairs, members, owners).

    ``pairs`` has one row per class of listings and signature of profiles with the parts of
    the score, however many listings and users they hold; ``members`` names the listings of
    each class, ``owners`` the users of each signature.

    Skills carry most points, so a high bound needs most skills in the title;
    pairs short of that are not formed. Skills are looked up rarest first. Ids and users
    are put in at the end (``expanded``), for what has reached the score.
    """
    side = _profile_side(profiles, ())
    signatures = _signatures(side, ())
    interests = _interests(side, ())
    rows = _listing_side(listings, (), interests)
    classes = rows.select(*_class_keys(())).distinct()
    met = _looks(classes, interests, signatures, (), _needed(score, settings))
    wanted = _score_signatures(signatures, met, (), settings).where(F.col("score") >= score)
    keys = list(dict.fromkeys([*_class_keys(()), *_signature(())]))
    return wanted.select(*keys, *PARTS), rows, side


def _needed(score: int, settings: MatchSettings) -> Column:
    """Skills that have to be held for a score, whatever else a pair has."""
    least = max(score - settings.points_beside_skills, 1)
    return F.ceil(F.lit(least) * F.col("n_skills") / settings.skill_points).cast("int")


def skill_matches_at_least(
    listings: DataFrame, profiles: DataFrame, score: int, settings: MatchSettings = MATCH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``expanded_skills`` makes the pairs scoring at least ``score`` of: (pairs, members, owners).

    ``pairs`` has one row per title and interest of a field that hold enough skills in common,
    whatever places, modes and bands there are: far fewer than pairs of classes and signatures.
    ``members`` names the listings of each title, ``owners`` the users of each interest.
    """
    side = _profile_side(profiles, ())
    interests = _interests(side, ())
    rows = _listing_side(listings, (), interests)
    titles = rows.select("field", "title").distinct()
    return _meet(titles, _rare_first(interests, titles), (), _needed(score, settings)), rows, side


def named_skills(
    pairs: DataFrame, members: DataFrame, owners: DataFrame, score: int, settings: MatchSettings = MATCH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``skill_matches_at_least`` with one short name per title and interest of a field. The bound and
    the weights go with the pairs, so that they score the same when these have changed."""
    listing = F.md5(F.to_json(F.struct("field", "title"))).alias("listing_class")
    user = F.md5(F.to_json(F.struct("field", "interest"))).alias("user_class")
    weights = [F.lit(v).alias(c) for c, v in {**asdict(settings), "least": score}.items()]
    return (
        pairs.select(listing, user, "n_skills", "hits", *weights),
        members.select(listing, "place", "work_mode", "band", "id_num"),
        owners.select(user, "user_id", "work_preference", "country", "own_band"),
    )


def expanded_skills(pairs: DataFrame, members: DataFrame, owners: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """(user_id, id_num, score, batch) for each pair of ``named_skills`` that reaches its bound, but those
    of ``sent``. All three carry their ``batch``, and only what is of one batch belongs together.

    Users with their interest's titles are shuffled once for all their batches, and once for all modes and
    bands; they meet the ids of a title and place as lists, one per mode, band and batch. So a score
    is taken per list, and the result, by far the largest table, is never shuffled.
    """
    pairs = _over_batches(pairs).withColumnRenamed("batches", "scored")
    both = F.filter("batches", lambda b: F.array_contains("scored", b))
    found = _over_batches(owners).join(pairs, "user_class").withColumn("batches", both).where(F.size("batches") > 0)
    found = found.withColumn("place", F.explode(profile_places(F.col("work_preference"), F.col("country"))))
    found = found.drop("user_class", "scored", "country")

    # One list per task that reads them, so that none outgrows a task; a list of values leaves out nulls.
    nulls = F.array_repeat(F.lit(None).cast("bigint"), F.count_if(F.isnull("id_num")).cast("int"))
    keys = ["listing_class", "place", "work_mode", "band", "batch"]
    lists = members.groupBy(*keys, F.spark_partition_id().alias("task")).agg(
        F.concat(F.collect_list("id_num"), nulls).alias("ids")
    )
    ids = F.col("ids")
    if sent is not None:
        told = sent.select("user_id", "id_num").join(members.select("id_num", "listing_class"), "id_num")
        told = told.groupBy("user_id", "listing_class").agg(F.collect_set("id_num").alias("told"))
        found = found.join(told, ["user_id", "listing_class"], "left")
        ids = F.when(F.col("told").isNull(), ids).otherwise(F.array_except(ids, "told"))
    rows = found.join(lists.drop("task"), ["listing_class", "place"])
    # Every place a profile looks at is near.
    rows = _scored(rows.withColumn("country", F.col("place")), MatchSettings(*map(F.col, SETTINGS)))
    rows = rows.where(F.col("score") >= F.col("least"))
    # Two equal profiles of a user name the batch twice.
    rows = rows.select("user_id", "score", ids.alias("ids"), F.explode(F.filter("batches", lambda b: b == F.col("batch"))).alias("batch"))
    return rows.select("user_id", F.explode("ids").alias("id_num"), "score", "batch")


def _over_batches(rows: DataFrame) -> DataFrame:
    """Equal rows of several batches as one, with a list of their ``batches``."""
    return rows.groupBy(*[c for c in rows.columns if c != "batch"]).agg(F.collect_list("batch").alias("batches"))


def expanded(pairs: DataFrame, members: DataFrame, owners: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """One row for each (user, listing) of matched classes, but those of ``sent``."""
    rows = expanded_names(*named_classes(pairs, members, owners), sent)
    return rows.select("user_id", "id_num", "posted_on", *PARTS)


def expanded_names(pairs: DataFrame, members: DataFrame, owners: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """``expanded`` for ``named_classes``, with whatever columns they have besides.

    A class holds far more listings than a signature users, so users are put in first and
    listings by the last join: its result, by far the largest table, is never shuffled. What
    was sent is therefore found by class before it, and left out as the listings are put in.
    """
    found = owners.join(pairs, "user_class").drop("user_class")
    if sent is None:
        return found.join(members, "listing_class").drop("listing_class")
    told = sent.select("user_id", "id_num").join(members.select("id_num", "listing_class"), "id_num")
    told = told.groupBy("user_id", "listing_class").agg(F.collect_set("id_num").alias("told"))
    rows = found.join(told, ["user_id", "listing_class"], "left").join(members, "listing_class")
    again = F.coalesce(F.array_contains("told", F.col("id_num")), F.lit(False))
    return rows.where(~again).drop("listing_class", "told")


def named_classes(pairs: DataFrame, members: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with one short name per class in place of its values: (listing_class, user_class
    and PARTS), (listing_class, id_num, posted_on), (user_class, user_id)."""
    listing = F.md5(F.to_json(F.struct(*_class_keys(())))).alias("listing_class")
    user = F.md5(F.to_json(F.struct(*_signature(())))).alias("user_class")
    return pairs.select(listing, user, *PARTS), members.select(listing, "id_num", "posted_on"), owners.select(user, "user_id")


def refreshed_top(
    top: DataFrame, listings: DataFrame, changed: DataFrame, profiles: DataFrame, k: int, settings: MatchSettings = MATCH
) -> DataFrame:
    """``top_matches`` of ``listings`` from the ``top`` of before some of them changed.

    ``changed``: id_num of every listing that is new, has changed or is gone. A user none of
    whose k best has changed keeps them: they are united with the k best of the changed
    listings, and the k best of both are the result. Users who lost one are ranked anew, as
    anything may follow. ``top`` has the columns of ``top_matches`` without further ones.
    """
    ids = changed.select("id_num").distinct()
    lost = top.join(ids, "id_num", "left_semi").select("user_id").distinct()
    anew = top_matches(listings, profiles.join(lost, "user_id", "left_semi"), k, settings=settings)
    others = profiles.join(lost, "user_id", "left_anti")
    fresh = top_matches(listings.join(ids, "id_num", "left_semi"), others, k, settings=settings)
    kept = top.join(lost, "user_id", "left_anti").join(others.select("user_id"), "user_id", "left_semi")
    both = kept.unionByName(fresh).drop("rank")
    order = [F.col("score").desc(), F.col("posted_on").desc_nulls_last(), F.col("id_num").asc()]
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return both.withColumn("rank", nth).where(F.col("rank") <= k).unionByName(anew)


def with_listing(matches: DataFrame, listings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach listing columns to finished (few, narrow) matches by id."""
    return matches.join(listings.select("id_num", *columns), "id_num")


def top_by_plan(listings: DataFrame, profiles: DataFrame, settings: MatchSettings = MATCH) -> DataFrame:
    """The best listings of every user, as many and of the sources their plan shows.

    Plans that show the same are ranked together, each group over its own sources and
    to its own depth; a plan of all sources reads the listings as they are.
    """
    groups: dict[tuple, list[str]] = {}
    for plan, k, _, sources in fixed.PLANS:
        groups.setdefault((k, sources), []).append(plan)
    parts = []
    for (k, sources), plans in groups.items():
        seen = listings if set(sources) == set(fixed.SOURCES) else listings.where(F.col("source").isin(*sources))
        people = profiles.where(F.col("plan").isin(*plans))
        parts.append(top_matches(seen, people, k, keep=["plan"], settings=settings))
    return reduce(DataFrame.unionByName, parts)


def result_documents(matches: DataFrame, by: str = "user_id") -> DataFrame:
    """One JSON document per user, or other value of ``by``, jobs in rank order."""
    job = F.struct("title", "company", "location", "score", "link").alias("job")
    jobs = F.sort_array(F.collect_list(F.struct("rank", job))).getField("job")
    return matches.groupBy(by).agg(F.to_json(F.struct(jobs.alias("jobs"))).alias("document"))


def user_documents(owners: DataFrame, matches: DataFrame) -> DataFrame:
    """``result_documents`` of users from the ``owners`` and the matches of ``top_signatures``.

    Users of one signature have one document, so it is made once and handed to each of them.
    A user with several profiles has the matches of all in one document.
    """
    users = owners.groupBy("user_id").agg(F.sort_array(F.collect_list("signature")).alias("signatures"))
    wanted = users.select("signatures").distinct().select("signatures", F.explode("signatures").alias("signature"))
    documents = result_documents(wanted.join(matches, "signature"), "signatures")
    return users.join(documents, "signatures").select("user_id", "document")
