"""Edit joins of lines against all pairs."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from joblattice.llm import line_dedup


def changed(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abé ") + text[i:], text[:i] + "x" + text[i + 1 :]])
    return text


def made(seed, n=25):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(32, 50))) for _ in range(n)]
    return base + [changed(rng, b, rng.randint(1, 4)) for b in base for _ in range(4)]


def test_banded_distance_is_the_edit_distance(spark):
    rng = random.Random(1)
    texts = made(7)
    pairs = [(a, changed(rng, a, rng.randint(0, 4))) for a in texts] + list(zip(texts, texts[1:]))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        rows = df.withColumn("t", line_dedup.trimmed(F.col("a"), F.col("b"))).select(
            line_dedup.banded_distance(F.col("t.a"), F.col("t.b"), most).alias("d"),
            line_dedup.banded_distance(F.col("a"), F.col("b"), most).alias("whole"),
            F.least(F.levenshtein("a", "b"), F.lit(most + 1)).alias("e"),
            "a",
            "b",
        ).where("d <> e OR whole <> e")
        assert rows.collect() == []


@pytest.mark.parametrize(("seed", "crowd"), [(1, 32), (2, 1), (3, 2)])
def test_no_link_is_missed(spark, seed, crowd):
    rng = random.Random(seed)
    texts = made(seed)
    stem = texts[0][:20]
    texts += [stem + "".join(rng.choice("ab") for _ in range(rng.randint(14, 16))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in set(texts)], "line string").withColumn("lh", F.xxhash64("line")).cache()
    found = {(r.a, r.b) for r in line_dedup.links(df, crowd=crowd).collect()}
    a, b = df.alias("a"), df.alias("b")
    plain = a.join(b, F.col("a.lh") > F.col("b.lh")).where(F.levenshtein("a.line", "b.line") <= 2)
    assert found == {(r[0], r[1]) for r in plain.select("a.lh", "b.lh").collect()}
    assert len(found) > 20


LINE = "a line that is long enough to be compared with others"


def test_earliest_of_a_class_stays(spark):
    rows = [
        (3, f"{LINE} one\nshort\nshort"),
        (1, f"first\n{LINE.upper()}"),
        (2, f"{LINE}s\n{LINE[1:]} "),
        (None, f"{LINE} one"),
        (None, None),
        (5, ""),
        (6, "x" * 30_000 + "\n" + "x" * 30_001),
        (7, f"{LINE} two"),
        (7, f"{LINE} two"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, removed int")
    got = {(r.row.doc_id, r.row.text): (r.kept, r.removed) for r in line_dedup.dedup(docs).collect()}
    assert got[1, rows[1][1]] == (rows[1][1], [])
    assert got[2, rows[2][1]] == ("", [0, 1])
    assert got[3, rows[0][1]] == (rows[0][1], [])
    assert got[None, rows[3][1]] == ("", [0])
    assert got[None, None] == (None, []) and got[5, ""] == ("", [])
    assert got[6, rows[6][1]] == ("x" * 30_000, [1])
    assert got[7, rows[7][1]] == (rows[7][1], [])
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_classes_and_links_of_lines(spark):
    rows = [(3, f"{LINE} one\nshort"), (1, f"first\n{LINE.upper()}"), (2, f"{LINE}s\n{LINE[1:]} "), (4, f"{LINE}s"), (5, "y" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, r.place): ((r.first.id, r.first.place), r.n_links) for r in line_dedup.classed(docs).collect()}
    # The first line is within two edits of two others, which are three apart; 2 and 4 share one.
    one = (1, 1)
    assert got == {(1, 1): (one, 2), (2, 0): (one, 1), (2, 1): (one, 1), (4, 0): (one, 1), (3, 0): ((3, 0), 0), (5, 0): ((5, 0), 0)}
    assert line_dedup.classed(docs.limit(0)).count() == 0


def test_classes_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(line_dedup.CLASSES_SQL)
    found = line_dedup.op3_line_classes(spark, sf)
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_keys_are_one_expression_and_cut_the_pieces(spark):
    df = spark.createDataFrame([("abcdefghij",), ("é" * 7 + "xyz",), ("ab",)], "line string")
    found = line_dedup.keyed(df, "line", line_dedup.probes(2), 2, F.lit(0))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    expected = set()
    for (line,) in map(tuple, df.collect()):
        for less, i, shift in line_dedup.probes(2):
            n = len(line) - less
            start, end = n * i // 3, n * (i + 1) // 3
            if n >= 0 and start + shift >= 0 and end + shift <= len(line):
                expected.add((line, less, i, start + shift, end - start))
    assert {(r.line, r.less, r.i, r.at, r["size"]) for r in found.collect()} == expected


def test_lines_are_normalised_alike_by_both_ways(spark):
    texts = ["A b C", " A  b\tc ", "É A  İ b", "İA b", "\x0b\x0cA\r", "", "\xa0A\x1fb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.normalised(F.col("t")).alias("n"))
    for r in rows.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.t)
        assert r.n == re.sub("[ \t-\r]+", " ", low).strip(" ")


def test_cheap_conditions_hold_for_all_texts_within_the_edits(spark):
    rng = random.Random(11)
    texts = made(5, 60) + ["x" * 40, "ab" * 20, "x" * 33]
    pairs = [(t, changed(rng, t, k)) for t in texts for k in (0, 1, 2, 3)] + [(t, "y" * 50) for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        t = line_dedup.trimmed(F.col("a"), F.col("b"), most + 2)
        rows = df.withColumn("t", t).select(
            (F.levenshtein("a", "b") <= most).alias("near"),
            line_dedup.whole_parts(F.col("a"), F.col("b"), most).alias("parts"),
            line_dedup.whole_middle(F.col("t.a"), F.col("t.b"), most, most + 2).alias("middle"),
        ).collect()
        assert all(r.parts and r.middle for r in rows if r.near)
        assert not any(r.parts and r.middle for r in rows[-len(texts) :])


def test_distance_passes_over_what_cannot_change_it(spark):
    # Far texts: the fold's steps end where the band is left, so long ones take no longer.
    df = spark.createDataFrame([("ab" * 5000, "cd" * 5000), ("ab" * 20, "ab" * 19 + "cc")], "a string, b string")
    found = df.select(line_dedup.banded_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()
    assert [r.d for r in found] == [3, 2]


def test_keys_of_one_line_alone_do_not_meet_and_crowded_ones_do(spark):
    rng = random.Random(12)
    texts = {"".join(rng.choice("abcdefgh") for _ in range(48)) for _ in range(40)}
    stem = "the same beginning of many lines "
    texts |= {stem + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)}
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("lh", F.xxhash64("line")).cache()
    a, b = df.alias("a"), df.alias("b")
    plain = a.join(b, F.col("a.lh") > F.col("b.lh")).where(F.levenshtein("a.line", "b.line") <= 2)
    expected = {(r[0], r[1]) for r in plain.select("a.lh", "b.lh").collect()}
    for crowd in (1, 4, 1000):
        found = line_dedup.candidates(df, crowd=crowd).collect()
        assert len(found) == len(set(found)) and expected <= {(r.a, r.b) for r in found}
        # Random lines share no segment with any other.
        alone = {r.lh for r in df.where(~F.col("line").startswith(stem)).collect()}
        assert not alone & {x for r in found for x in (r.a, r.b)}
