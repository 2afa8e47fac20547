"""License scans by diagonal voting (operator 7).

Words are cut from the text, every rolling run of three words is joined with the positions
of the same run in the license templates, and each hit votes for its diagonal: place in
the text less place in the template. An undisturbed copy of a template lies on one
diagonal; inserted or dropped words move the rest to a neighbouring one, so diagonals at
most ``GAP`` apart are merged to one span. A span is verified by the share of the
template's runs it holds: ``MIN_COVERAGE`` or more. Runs are joined on their hash and
compared word by word in the join, so a hash collision adds no vote.

The templates are the fixed list below (some hundred runs): their broadcast does not grow
with the data. All runs of all texts are joined, but only hits are shuffled, in groups by
document and template that are bounded by the text itself. No Python runs.

Defined results: a null or empty text has no word, no label and score 0; a phrase counts
at each place it stands; rows equal in id and text get equal results; a null id is an
id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import UPPER, ascii_lower, documents

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of well-known license texts and notices, as words.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the "
        "gnu lesser general public license as published by the free software foundation",
    ),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

RUN = 3
GAP = 3
MIN_COVERAGE = 0.6


def scan_words(text: Column) -> Column:
    """Lower-case words: ASCII letters and digits, and all that is not ASCII."""
    parts = F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _documents(docs: DataFrame) -> DataFrame:
    """(id, h, words): h tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), scan_words(text).alias("words")
    )


def template_runs(spark: SparkSession) -> DataFrame:
    """(run, template, label, t, total): place t of each run in each template."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, label string, words string")
    words = F.split("words", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, RUN)))
    return rows.select("template", "label", runs.alias("runs")).select(
        "template", "label", F.size("runs").alias("total"), F.posexplode("runs").alias("t", "t_run")
    )


def spans(docs: DataFrame) -> DataFrame:
    """Verified copies: (id, h, label, template, first, last, coverage), places in words."""
    words = F.col("words")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, RUN)))
    cut = _documents(docs).where(F.size("words") >= RUN).select("id", "h", F.posexplode(runs).alias("at", "run"))
    templates = template_runs(docs.sparkSession).withColumn("t_hash", F.xxhash64("t_run"))
    same = (F.xxhash64("run") == F.col("t_hash")) & (F.col("run") == F.col("t_run"))
    votes = (
        cut.join(F.broadcast(templates), same)
        .groupBy("id", "h", "template", "label", "total", (F.col("at") - F.col("t")).alias("diagonal"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("t").alias("seen"))
    )
    by = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > GAP, F.lit(False))
    merged = votes.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(by))
    return (
        merged.groupBy("id", "h", "template", "label", "total", "span")
        .agg(
            F.min("first").alias("first"),
            (F.max("last") + (RUN - 1)).alias("last"),
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"),
        )
        .withColumn("coverage", F.col("votes") / F.col("total"))
        .where(F.col("coverage") >= MIN_COVERAGE)
        .drop("total", "span", "votes")
    )


def base_scan(docs: DataFrame) -> DataFrame:
    """(id, h, n_words, places): place and label of every base phrase."""
    words = F.col("words")

    def label_at(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            parts = phrase.split()
            hit = F.lit(True)
            for j, part in enumerate(parts):
                hit = hit & F.coalesce(F.get(words, i + j) == part, F.lit(False))
            found = F.when(hit, F.lit(label)).otherwise(found)
        return found

    places = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("at"), label_at(i).alias("label"))),
        lambda p: p["label"].isNotNull(),
    )
    # No phrase stands where none of its first words does.
    starts = F.array(*[F.lit(p.split()[0]) for p in PHRASES])
    none = F.array().cast("array<struct<at:int,label:string>>")
    possible = F.when(F.arrays_overlap(words, starts), places).otherwise(none)
    return _documents(docs).select("id", "h", F.size(words).cast("bigint").alias("n_words"), possible.alias("places"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = (
        spans(docs)
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("score"))
    )
    base = base_scan(docs)
    joined = base.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    at = F.transform("places", lambda p: p["at"].cast("bigint"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, more)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


_VALUES = ", ".join(f"({i}, '{label}', string_split('{words}', ' '))" for i, (label, words) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())

SQL = rf"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda w: w <> '') AS words
  FROM documents),
templates(template, label, words) AS (VALUES {_VALUES}),
template_runs AS (
  SELECT template, label, len(words) - 2 AS total, t - 1 AS t, array_to_string(words[t : t + 2], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS t FROM templates)),
runs AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(words[i : i + 2], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM cut)),
hits AS (SELECT doc_id, template, label, total, pos, t, pos - t AS diagonal FROM runs JOIN template_runs USING (run)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
marked AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} AS far
  FROM diagonals),
numbered AS (
  SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM marked),
spans AS (
  SELECT doc_id, label, count(DISTINCT t) / any_value(total) AS coverage
  FROM hits JOIN numbered USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, span),
method AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS score
  FROM spans WHERE coverage >= {MIN_COVERAGE} GROUP BY doc_id),
phrases(phrase, label, n) AS (VALUES {_PHRASES}),
places AS (
  SELECT doc_id, i - 1 AS pos, label
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM cut) JOIN phrases
    ON array_to_string(words[i : i + n - 1], ' ') = phrase),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels,
  coalesce(score, 0.0) AS score
FROM cut LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""
