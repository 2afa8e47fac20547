"""Line dedup within an edit distance (operator 3).

Lines are normalised (ASCII letters in lower case, runs of blanks as one space, trimmed).
Lines of ``MIN_CHARS`` characters or more are compared; two are linked if at most ``EDITS``
(two) insertions, deletions or changes turn one to the other, and linked lines form
classes. The earliest occurrence of a class stays, ranked by document (id, then the hash
of its text) and place; all others are removed.

Links are found on distinct lines by segments. A line is cut in EDITS + 1 segments,
kept in an index by length, number and content. Of two linked lines the longer holds
a whole segment of the shorter, at a place that is off by no more than the edits before
and after allow; it probes the index with just those substrings, for each length it
may meet: twelve probes a line. Candidates are verified by a banded bit-parallel
distance: a column of the band is a few bits of a number, and a fold over one line moves
it down the diagonal and then along the last row.

An index key with more than ``CROWD`` lines is not probed like that: its lines must also
match in what lies beside the segment, within the edits that are left, and meet on
segments of that rest. So a segment that many lines share costs rows, not pairs.
Texts of distinct lines cross the network once and are stored; all else is hashes. What two candidates share at both ends is cut off
before their distance is taken. No Python runs on the executors.

Defined results: a null or empty text has no line; shorter lines always stay; a null id
ranks after all ids; rows equal in id and text are one document and keep the same
lines; an empty table gives no row; all columns of the input stay as they are. Lines are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import BLANKS, ascii_lower, broadcast_if_small, discard, documents, stored
from joblattice.llm.simhash import components

MIN_CHARS = 32
EDITS = 2
PARTS = 12  # of a line; a pair with more than EDITS of them missing is not verified
CROWD = 32  # lines of an index key that are compared with every line that probes it


def normalised(line: Column) -> Column:
    # Most lines are ASCII and have single spaces only: neither mapped nor matched char by char.
    plain = F.octet_length(line) == F.length(line)
    low = F.when(plain, F.lower(line)).otherwise(ascii_lower(line))
    odd = reduce(Column.__or__, [F.contains(line, F.lit(b)) for b in ("  ", *BLANKS[1:])])
    return F.trim(F.when(odd, F.regexp_replace(low, "[\\x20\\x09-\\x0D]+", " ")).otherwise(low))


def lines(docs: DataFrame) -> DataFrame:
    """(id, h, place, lh, line) of every line that is long enough."""
    # Normalised within the generator, thus once; no line gets longer by it.
    whole = F.split(F.col("text").cast("string"), "\n")
    cut = docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64("text").alias("h"),
        F.posexplode(F.transform(whole, lambda t: F.when(F.length(t) >= MIN_CHARS, normalised(t)))).alias("place", "line"),
    )
    return cut.where(F.length("line") >= MIN_CHARS).withColumn("lh", F.xxhash64("line"))


# Segments and probes


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift) a longer line has to look at."""
    return [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]


def segments(edits: int) -> list[tuple[int, int, int]]:
    """The same for the segments of a line itself, as the index holds them."""
    return [(0, i, 0) for i in range(edits + 1)]


def keyed(rows: DataFrame, text: str, wanted: list[tuple[int, int, int]], edits: int, beside: Column) -> DataFrame:
    """``rows`` with ``key``, ``i``, ``at``, ``size``, ``less`` and ``own`` of each wanted piece of ``text``.

    ``own`` pieces are segments of the text itself, as the index holds them.

    The wanted pieces are rows and the key is one short expression over them: one for each piece
    makes code too long for the JVM to compile.
    """
    list_ = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("less", "i", "shift"), w)]) for w in wanted])
    n, i = F.length(text), F.col("w.i")
    cut = rows.select("*", n.alias("n_"), F.explode(list_).alias("w")).withColumn("length_", F.col("n_") - F.col("w.less"))
    start = F.floor(F.col("length_") * i / (edits + 1)).cast("int")
    end = F.floor(F.col("length_") * (i + 1) / (edits + 1)).cast("int")
    cut = cut.withColumns({"at": start + F.col("w.shift"), "size": end - start})
    cut = cut.where("length_ >= 0 AND at >= 0 AND at + size <= n_")
    key = F.xxhash64(beside, "length_", i, F.substring(text, F.col("at") + 1, F.col("size")))
    own = (F.col("w.less") == 0) & (F.col("w.shift") == 0)
    return cut.select(*rows.columns, key.alias("key"), i.alias("i"), "at", "size", F.col("w.less").alias("less"), own.alias("own"))


def _meet(index: DataFrame, probing: DataFrame, both_ways: bool = False) -> DataFrame:
    """Pairs (a, b), a > b, that share a key; lines of one length meet once or both ways."""
    once = F.lit(both_ways) | (F.col("p.less") > 0) | (F.col("p.lh") > F.col("x.lh"))
    return (
        probing.alias("p")
        .join(index.alias("x"), (F.col("p.key") == F.col("x.key")) & once & (F.col("p.lh") != F.col("x.lh")))
        .select(F.greatest("p.lh", "x.lh").alias("a"), F.least("p.lh", "x.lh").alias("b"))
    )


def _rest(text: Column, edits: int) -> list[tuple[Column, int]]:
    """What lies beside segment i, and the edits it may hold, for each i."""
    right = F.substring(text, F.col("at") + F.col("size") + 1, F.length(text))
    left = F.substring(text, F.lit(1), F.col("at"))
    # Before segment i lie at most i edits, behind it edits - i.
    return [(right, edits - i) if edits - i >= i else (left, i) for i in range(edits + 1)]


def candidates(distinct: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a > b, of line hashes that may be linked; every linked pair is among them."""
    top = F.lit(0).cast("bigint")
    index = keyed(distinct, "line", segments(edits), edits, top).select("key")
    crowded = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
    crowded = stored(crowded, "crowded-keys")
    named = broadcast_if_small(crowded).withColumn("crowded", F.lit(True))
    # A line's own segments are among its probes. Most keys belong to one line alone: a
    # window leaves them out, so that the rows meet and go further as a small table.
    probing = keyed(distinct, "line", probes(edits), edits, top).select("lh", "key", "less", "own")
    probing = probing.join(named, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    # Crowded keys are only passed on: dealt over many groups.
    group = Window.partitionBy("key", F.when(F.col("crowded"), F.pmod("lh", F.lit(4096))).otherwise(-1))
    facts = {
        "n_own": F.count(F.when(F.col("own"), 1)).over(group),
        "low": F.min("lh").over(group),
        "high": F.max("lh").over(group),
    }
    shared = probing.withColumns(facts).where("crowded OR (n_own > 0 AND low < high)")
    shared = stored(shared.select("lh", "key", "less", "own", "crowded"), "shared-keys")
    few = shared.where("NOT crowded")
    pairs = _meet(few.where("own"), few)
    if crowded.isEmpty():
        return pairs.distinct()
    # Only lines of crowded keys are taken further with their texts.
    members = broadcast_if_small(stored(shared.where("crowded").select("lh").distinct(), "crowded-hashes"))
    members = stored(distinct.join(members, "lh", "left_semi"), "crowded-lines")

    def below(wanted, *more: str) -> DataFrame:
        rows = keyed(members, "line", wanted(edits), edits, top).join(crowded, "key").withColumnRenamed("key", "beside")
        out = []
        for i, (rest, left) in enumerate(_rest(F.col("line"), edits)):
            part = rows.where(F.col("i") == i).select("lh", "beside", rest.alias("rest"))
            # What the first level says of a line's length is part of its key.
            made = keyed(part, "rest", wanted(left), left, F.col("beside"))
            out.append(made.select("lh", *more, "key"))
        return reduce(DataFrame.unionByName, out)

    index2, probing2 = below(segments), below(probes, "less")
    # Of two lines of one length either may have the longer rest: both probe.
    return pairs.union(_meet(index2, probing2, both_ways=True)).distinct()


def banded_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """Edit distance of two texts if it is at most ``most``, else most + 1.

    Bit 2 * most of a number is the lowest row of the band, bit 0 its highest. The text's
    characters are folded over one by one; vp and vn are the rows where the distance
    grows or falls by one from the row above. Needs lengths above ``most``.

    Down the diagonal the distance never falls, and each of the most + m - n steps along the
    last row lowers it by one at best: beyond that the other characters are passed over.
    """
    band = 2 * most + 1
    full = (1 << band) - 1
    low = 1 << (band - 1)
    p, t = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)

    def step(s: Column, c: Column) -> Column:
        match = F.lit(0).cast("bigint")
        for d in range(band):
            same = F.coalesce(F.get(s["p"], s["j"] + (most - d)) == c, F.lit(False)) & (s["j"] + (most - d) >= 0)
            match = match.bitwiseOR(F.when(same, F.lit(low >> d).cast("bigint")).otherwise(F.lit(0).cast("bigint")))

        def with_match(pm: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return F.transform(F.array(d0), lambda x: moved(s, x))[0]

        def moved(s: Column, d0: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # Down the diagonal until the band's lowest row is the last one, then along it.
            diagonal = s["j"] < n - most
            row = F.greatest(F.lit(band - 2) - (s["j"] - (n - most)), F.lit(0)).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), row)
            change = F.when(diagonal, F.when(d0.bitwiseAND(F.lit(low)) == 0, 1).otherwise(0)).otherwise(
                F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            )
            return F.struct(
                s["p"].alias("p"),
                (s["j"] + 1).alias("j"),
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["d"] + change).alias("d"),
            )

        return F.transform(F.array(match), with_match)[0]

    start = F.struct(
        p.alias("p"),
        F.lit(0).alias("j"),
        F.lit(full ^ ((1 << most) - 1)).cast("bigint").alias("vp"),
        F.lit(0).cast("bigint").alias("vn"),
        F.lit(most).alias("d"),
    )
    known = lambda s: s["d"] > m - n + 2 * most
    distance = F.aggregate(t, start, lambda s, c: F.when(known(s), s).otherwise(step(s, c)), lambda s: s["d"])
    return F.when(F.abs(n - m) > most, F.lit(most + 1)).otherwise(F.least(distance, F.lit(most + 1)))


def _common_start(a: Column, b: Column, most: Column) -> Column:
    """Characters that two texts share from their start, at most ``most``; by bisection."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(
            F.when(same, middle).otherwise(s["lo"]).alias("lo"),
            F.when(same, s["hi"]).otherwise(F.greatest(middle - 1, s["lo"])).alias("hi"),
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda s: s["lo"])


def trimmed(a: Column, b: Column, keep: int = 4) -> Column:
    """struct<a, b> of two texts less what they share at both ends, but ``keep`` of it.

    The edit distance stays the same; it is then taken over what differs alone.
    """
    n = F.least(F.length(a), F.length(b))

    def ends(start: Column) -> Column:
        end = _common_start(F.reverse(a), F.reverse(b), n - start)
        return F.transform(F.array(F.greatest(end - keep, F.lit(0))), lambda e: cut(F.greatest(start - keep, F.lit(0)), e))[0]

    def cut(start: Column, end: Column) -> Column:
        return F.struct(
            F.substring(a, start + 1, F.length(a) - start - end).alias("a"),
            F.substring(b, start + 1, F.length(b) - start - end).alias("b"),
        )

    return F.transform(F.array(_common_start(a, b, n)), ends)[0]


def _found_parts(a: Column, b: Column, first: int, parts: int, most: int) -> Column:
    """Whether at most ``most`` of the parts of ``a``, less ``first`` characters at both ends, are missing in ``b``."""
    n = F.greatest(F.length(a) - 2 * first, F.lit(0))
    cuts = [F.floor(n * k / parts).cast("int") for k in range(parts + 1)]
    found = [F.contains(b, F.substring(a, lo + (first + 1), hi - lo)) for lo, hi in zip(cuts, cuts[1:])]
    return reduce(Column.__add__, [F.when(f, 0).otherwise(1) for f in found]) <= most


def whole_parts(a: Column, b: Column, edits: int) -> Column:
    """True for all texts within the edits: an edit breaks one part of a text, others stand in the other."""
    return _found_parts(a, b, 0, PARTS, edits)


def whole_middle(a: Column, b: Column, edits: int, keep: int) -> Column:
    """The same for ``trimmed`` texts. They differ at both ends (but for what is kept), which
    takes two edits; the others cannot break all of ``edits`` - 1 parts of what lies between."""
    parts = max(edits - 1, 1)
    return _found_parts(a, b, keep + 1, parts, parts - 1)


def links(found: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """Linked pairs (a, b), a > b, of distinct lines given as (lh, line); stored."""
    # Read several times below: the distinct lines are cut, shuffled and stored once.
    distinct = stored(found.groupBy("lh").agg(F.any_value("line").alias("line")), "distinct-lines")
    pairs = stored(candidates(distinct, edits, crowd), "line-candidates")
    wanted = stored(pairs.select(F.col("a").alias("lh")).union(pairs.select("b")).distinct(), "wanted-lines")
    texts = stored(distinct.join(broadcast_if_small(wanted), "lh", "left_semi"), "line-texts")
    left = texts.select(F.col("lh").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("lh").alias("b"), F.col("line").alias("line_b"))
    met = pairs.join(left, "a").join(right, "b")
    # As a generator the trimming is a step of its own, not copied into the distance.
    # Of lines of one template most pairs have more edits: cheap conditions go first.
    met = met.where(whole_parts(F.col("line_a"), F.col("line_b"), edits))
    met = met.select("a", "b", F.explode(F.array(trimmed(F.col("line_a"), F.col("line_b"), edits + 2))).alias("t"))
    met = met.where(whole_middle(F.col("t.a"), F.col("t.b"), edits, edits + 2))
    # Pairs are few bytes and much work: dealt out evenly, as merging partitions goes by bytes.
    # As a generator the distance stays behind that; a plain condition is moved before it.
    met = met.repartition(4 * distinct.sparkSession.sparkContext.defaultParallelism)
    met = met.select("a", "b", F.explode(F.array(banded_distance(F.col("t.a"), F.col("t.b"), edits))).alias("d"))
    linked = stored(met.where(F.col("d") <= edits).select("a", "b"), "line-links")
    discard(distinct, pairs, wanted, texts)
    return linked


def _rank() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "h", "place")


def classed(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, h, place, lh, n_links, first) of every line that is compared.

    ``n_links`` counts the distinct lines within the edits; ``first`` is the earliest
    occurrence of the line's class and names it.
    """
    found = lines(docs)
    # Hashes and places only: the texts of all lines are not stored.
    places = stored(found.select("lh", "id", "h", "place"), "line-places")
    edges = links(found.select("lh", "line"), edits)
    roots = components(edges)
    degree = (
        edges.select(F.explode(F.array("a", "b")).alias("lh")).groupBy("lh").agg(F.count("*").alias("n_links"))
    )
    rooted = places.join(roots, places["lh"] == roots["node"], "left").join(degree, "lh", "left").select(
        *places.columns, "n_links", F.coalesce("root", "lh").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min(_rank()).alias("first"))
    return rooted.join(firsts, "root").select(
        "id", "h", "place", "lh", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first"
    )


def removals(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per document (id, h): n_lines, n_links, and ``removed`` places, sorted."""
    return classed(docs, edits).groupBy("id", "h").agg(
        F.size(F.collect_set("place")).cast("bigint").alias("n_lines"),
        F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_set(F.when(_rank() != F.col("first"), F.col("place")))).alias("removed"),
    )


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``row`` (all columns of the input), ``kept`` text, ``n_lines``, ``n_links``, ``removed``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    cuts = removals(docs, edits).withColumnsRenamed({"id": "_id", "h": "_h"})
    joined = given.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    text = F.col("row.text").cast("string")
    pieces = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), "removed")
    kept = F.when(
        F.size("removed") > 0,
        F.transform(F.array(pieces), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n"))[0],
    ).otherwise(text)
    none = F.array().cast("array<int>")
    return joined.select(
        "row",
        kept.alias("kept"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("removed", none).alias("removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


def op3_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per compared line: its place, its class by document and place of the earliest
    occurrence, and the number of distinct lines it is linked to."""
    return classed(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("id").alias("doc_id"),
        F.col("place").cast("bigint").alias("place"),
        F.col("first.id").alias("class_doc"),
        F.col("first.place").cast("bigint").alias("class_place"),
        "n_links",
    )


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
  FROM documents),
normal AS (
  SELECT doc_id, place, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM cut),
lines AS (SELECT * FROM normal WHERE length(line) >= 32),
nodes AS (SELECT line, row_number() OVER (ORDER BY line) AS node FROM (SELECT DISTINCT line FROM lines)),
sized AS (SELECT node, line, length(line) AS size, length(line) + unnest([0, 1, 2]) AS reach FROM nodes),
edges AS (
  SELECT a.node AS a, b.node AS b FROM sized a JOIN nodes b ON length(b.line) = a.reach
  WHERE a.node <> b.node AND levenshtein(a.line, b.line) <= 2),
two_way AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, root) AS (
  SELECT node, node FROM nodes UNION SELECT two_way.b, reach.root FROM reach JOIN two_way ON two_way.a = reach.node),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY root ORDER BY doc_id, place) > 1 AS again
  FROM lines JOIN nodes USING (line) JOIN classes USING (node))
SELECT doc_id, count(place) AS n_lines, count(*) FILTER (WHERE again) AS n_removed,
  coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE again), '') AS removed_lines
FROM documents LEFT JOIN ranked USING (doc_id) GROUP BY doc_id
"""

# The first tables are those of SQL.
CLASSES_SQL = (
    SQL[: SQL.index("ranked AS (")]
    + r"""degrees AS (SELECT a AS node, count(*) AS n_links FROM two_way GROUP BY a)
SELECT doc_id, place, first_value(doc_id) OVER class AS class_doc, first_value(place) OVER class AS class_place,
  coalesce(n_links, 0) AS n_links
FROM lines JOIN nodes USING (line) JOIN classes USING (node) LEFT JOIN degrees USING (node)
WINDOW class AS (PARTITION BY root ORDER BY doc_id, place)
"""
)
