"""Quality rules: measures of odd texts, exact tails, certified cutoffs and their guarantee."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from joblattice.llm import quality_rules as rules

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    lines, seen, dup = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(twice), failed)


def test_measures_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "# $", "a b\n\na b\n a b", "ünï\u00a0x 日本 " * 30, "one two three four five six seven eight " * 5]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 120))) for _ in range(12)] + ["x\n" * 300, "w " * 40_000]
    rows = [(i if i else None, t, "en", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words string")
    found = {r.doc_id: tuple(r[c] for c in COLUMNS[1:]) for r in rules.measured(docs).collect()}
    assert found == {i if i else None: plain(t) for i, t in enumerate(texts)}
    assert rules.measured(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.004, 0.05])
def test_tails_are_exact(spark, rate):
    cases = [(n, k) for n in (1, 7, 60, 900, 5000) for k in (0, 1, 2, 5, 40) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint")
    for r in df.withColumn("p", F.exp(rules._tail_log(F.col("n"), F.col("k"), rate))).collect():
        exact = sum(math.comb(r.n, j) * rate**j * (1 - rate) ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9, abs=1e-300)


def documents(rng, n, odd):
    """Good documents of plain words; a share ``odd`` holds many symbols."""
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(30)]
        if rng.random() < odd:
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words), "en"))
    return rows


def test_cutoffs_are_certified_and_equal_the_sql(spark):
    """2,000 labelled good texts certify cutoffs; copies of one text count once."""
    rng = random.Random(5)
    rows = documents(rng, 2000, 0.0)
    rows += [(5000 + i, " ".join(["sym#bols$"] * 3 + [f"w{i}x{j}" for j in range(27)]), "en") for i in range(40)]  # junk, not labelled
    rows += [(9000 + i, rows[0][1], "xx") for i in range(2000)]  # one text, 2,000 labels: no cutoff
    labels = [(d, 1, 0) for d, _, _ in rows if d < 5000 or d >= 9000]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    measures = rules.measured(docs)
    cutoffs = {r.lang: r.asDict() for r in rules.chosen_cutoffs(measures, labelled).collect()}
    assert any(v is not None for k, v in cutoffs["en"].items() if k != "lang")
    assert all(v is None for k, v in cutoffs["xx"].items() if k != "lang")
    found = rules.judged(measures, rules.chosen_cutoffs(measures, labelled))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert sum(kept[i] for i in range(2000)) >= 1990 and all(kept[9000 + i] for i in range(2000))
    assert not any(kept[5000 + i] for i in range(40))
    duck = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labelled)):
        duck.register(name, df.toArrow())
    expected = duck.execute(rules.SQL).fetchall()
    place = [d[0] for d in duck.execute(rules.SQL).description]
    assert {r[place.index("doc_id")]: r[place.index("kept")] for r in expected} == kept


def test_the_guarantee_holds_in_simulation(spark):
    """Cutoffs chosen from draws of a population whose false rejections are known."""
    rng = random.Random(8)
    limit, wrong, draws = rules.MAX_FALSE_REJECTION, 0, 12
    measured = None
    for draw in range(draws):
        rows = [(draw * 10_000 + i, text, f"d{draw}") for i, text, _ in documents(rng, 700, 0.004)]
        part = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        measured = part if measured is None else measured.unionByName(part)
    measures = rules.measured(measured)
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    cutoffs = rules.chosen_cutoffs(measures, labels).collect()
    # Fresh documents of the same kind show what a cutoff really rejects.
    fresh = rules.measured(spark.createDataFrame(documents(random.Random(99), 3000, 0.004), "doc_id bigint, text string, lang string")).collect()
    for r in cutoffs:
        chosen = {m: r[f"{m}_cutoff"] for m in rules.METRICS if r[f"{m}_cutoff"] is not None}
        rejected = sum(any(x[m] > c for m, c in chosen.items()) for x in fresh)
        wrong += rejected > 1.3 * limit * len(fresh)
    assert wrong <= max(1, 0.05 * draws)


def test_no_labels_and_null_languages(spark):
    docs = spark.createDataFrame([(1, "a " * 30, None), (2, "b c d " * 10 + "x", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    measures = rules.measured(docs)
    for given in (labels, labels.limit(0)):
        found = rules.judged(measures, rules.chosen_cutoffs(measures, given)).collect()
        assert len(found) == 2 and all(r.kept == (not r.base_failed) for r in found)
