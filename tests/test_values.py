"""Small functions with JavaScript's quirks."""

import pytest
from pyspark.sql import functions as F

from joblattice.functions import dimensions, secrets, skills, values
from joblattice.functions.listing import phrase, runs_of, words
from joblattice.operators.searches import search_strings


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "text, number",
    [
        ("12abc", 12), ("abc", 0), ("", 0), ("3.9", 3), ("50,000", 50), ("-5", -5), (" 7", 7), ("1e5", 1),
        (None, 0), ("+4", 4), (" 9", 9), ("0x1F", 0), ("99999999999999999999", 0), ("--1", 0),
    ],
)
def test_lenient_int(spark, text, number):
    assert one(spark, values.lenient_int(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize("number, text", [(0, ""), (5, "5"), (-1, "-1"), (None, "")])
def test_zero_as_blank(spark, number, text):
    assert one(spark, values.zero_as_blank(F.lit(number).cast("int"))) == text


def test_trim_takes_all_unicode_space(spark):
    assert one(spark, values.js_trim(F.lit("﻿ \t a b  \n　"))) == "a b"


def test_add_and_remove_skills(spark):
    start = F.array(F.lit("Go"))
    add = lambda entry: one(spark, skills.add_skill(start, F.lit(entry).cast("string")))
    assert add(" React") == ["Go", "React"]
    assert add("Go ") == ["Go"]
    assert add("go") == ["Go", "go"]
    assert add("  ") == ["Go"]
    assert add(" ") == ["Go"]
    assert one(spark, skills.remove_skill(F.array(F.lit("Go"), F.lit("React"), F.lit("Go")), "Go")) == ["React"]


def test_clean_skills_keeps_first_seen_order(spark):
    typed = F.array(*[F.lit(s) for s in (" b", "a", "b", "", "B", "a ")])
    assert one(spark, skills.clean_skills(typed)) == ["b", "a", "B"]


def test_toggle(spark):
    c = F.array().cast("array<string>")
    expected = [["a"], ["a", "b"], ["b"]]
    for choice, result in zip("aba", expected):
        c = skills.toggle(c, choice)
        assert one(spark, c) == result


@pytest.mark.parametrize(
    "years, band", [(-1, None), (0, 0), (1, 0), (2, 1), (4, 1), (5, 2), (9, 2), (10, 3), (40, 3), (None, None)]
)
def test_experience_band(spark, years, band):
    assert one(spark, dimensions.experience_band(F.lit(years).cast("int"))) == band


def test_labels(spark):
    codes = spark.createDataFrame([("full-time",), ("odd",)], "type string")
    rows = dimensions.with_label(codes, "type", dimensions.job_types(spark), "label").collect()
    assert {r["type"]: r["label"] for r in rows} == {"full-time": "Full-time", "odd": None}
    assert dimensions.currencies(spark).count() == 4
    assert dimensions.seniorities(spark).where("code = 'lead'").first()["years"] == "10+ years"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Senior  React Developer react", ["senior", "react", "developer", "react"]),
        ("C++/C# (.NET) dev.", ["c++", "c#", ".net", "dev"]),
        ("Node.js, Machine-Learning & CI/CD", ["node.js", "machine", "learning", "ci", "cd"]),
        ("Ingénieur·e C++11\tüber", ["ingénieur", "e", "c++11", "über"]),
        (" -- ", []),
        ("", []),
    ],
)
def test_words(spark, text, expected):
    assert one(spark, words(F.lit(text))) == expected
    assert one(spark, phrase(F.lit(text))) == " ".join(expected)


def test_runs_of_words(spark):
    runs = lambda text, n: one(spark, runs_of(words(F.lit(text)), F.lit(n)))
    assert runs("a b, a b", 2) == ["a b", "b a"]
    assert runs("a", 1) == ["a"]
    assert runs("a", 2) == runs("...", 1) == []


def test_secrets(spark):
    key = F.lit("0123456789abcdef")
    stored = secrets.encrypt(F.lit("my key"), key)
    assert one(spark, secrets.decrypt(stored, key)) == "my key"
    assert b"my key" not in bytes(one(spark, stored))
    assert one(spark, secrets.masked(F.lit("aB1-é"))) == "*****"


def test_secret_key_has_to_be_set(spark):
    from joblattice.config import SECRET_CONF

    before = spark.conf.get(SECRET_CONF, None)
    spark.conf.unset(SECRET_CONF)
    with pytest.raises(ValueError):
        secrets.secret_key(spark)
    if before:
        spark.conf.set(SECRET_CONF, before)


def test_secret_is_redacted_in_plans(spark, capsys):
    df = spark.range(1).select(secrets.encrypt(F.col("id").cast("string"), F.lit("0123456789abcdef")).alias("c"))
    df.explain("formatted")
    assert "0123456789abcdef" not in capsys.readouterr().out


def test_search_strings(spark):
    rows = [
        (1, "remote", "Developer", "Egypt", "Cairo", ["React"]),
        (2, "on-site", "Software Engineer", "Egypt", "Cairo", [".NET"]),
        (3, "hybrid", "QA", "Egypt", "", ["Go"]),
    ]
    people = spark.createDataFrame(
        rows, "user_id int, work_preference string, field string, country string, city string, skills array<string>"
    )
    found = {}
    for r in search_strings(people).collect():
        found.setdefault(r["user_id"], []).append(r["search"])
    assert found[1] == ["React Developer remote"]
    assert found[2] == ["Software Engineer Cairo .NET"]
    assert sorted(found[3]) == ["Go QA remote", "QA Egypt Go"]
