"""Substring dedup by line or paragraph hashing (operator 8).

A text is cut into units: its lines, cut further behind sentence ends (. ! ? and a blank), so
that a passage inside a long line has units of its own, or its paragraphs (runs of lines that
are not blank). A unit is normalised: ASCII letters in lower case, runs of blanks as one
space, none at the ends. Units with a word are grouped over the whole table by a 128-bit
digest of the normalised text. The earliest occurrence stays, ranked by document (id, then
the hash of its text) and place. All others are removed, with the blanks or line end behind
them, where they stand in a stretch: repeated units next to each other with ``STRETCH`` words
or more in all. A short line that many texts share by chance or by custom stays.
Every document keeps the offsets of what it lost.

Only digests and places are shuffled for the grouping, partly grouped in each task
first, so a unit in a third of all documents costs one row per task. A digest that
occurs once needs no answer; the others go back to their units by an inner join, which
Spark splits where one digest is hot. The spans to cut then meet the texts once, on
the document's own key. Spans of one document go to one task, as its text does.

Defined results: a null text stays null and has no unit, an empty one stays empty;
a null id ranks after all ids; rows equal in id and text are one document: they keep and
lose the same units; a unit repeated within a document keeps its first place; an empty
table gives no row; all columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import documents, ship

STRETCH = 25  # words of neighbouring repeated units that are a passage
_END = re.compile(r"[.!?][\x20\x09\x0B-\x0D]+|\n")


def spans(text: str, unit: str = "line") -> Iterator[tuple[int, int]]:
    """(start, end) of every unit in characters, with what ends it; some may have no word."""
    at, begun = 0, None
    if unit == "line":
        for end in _END.finditer(text):
            yield at, end.end()
            at = end.end()
        if at < len(text):
            yield at, len(text)
        return
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        blank = not line.strip()
        if blank:
            if begun is not None:
                yield begun, at
            begun = None
        elif begun is None:
            begun = at
        at = end
    if begun is not None:
        yield begun, len(text)


def passages(again: list[tuple[int, int, int, int]], stretch: int = STRETCH) -> list[tuple[int, int]]:
    """Spans of the repeated units (place, start, end, words) that stand in long stretches."""
    out, run, words = [], [], 0
    for place, start, end, n in [*sorted(again), (-1, 0, 0, 0)]:
        if run and place != run[-1][0] + 1:
            out += [u[1:] for u in run] if words >= stretch else []
            run, words = [], 0
        run.append((place, start, end))
        words += n
    return out


def units(docs: DataFrame, unit: str = "line") -> DataFrame:
    """(digest, id, h, place, start, end, words) of every unit with a word; ``place`` counts them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, hashes, texts = (c.to_pylist() for c in part.columns)
                out = []
                for doc, h, text in zip(ids, hashes, texts, strict=True):
                    place = 0
                    for start, end in spans(text or "", unit):
                        words = text[start:end].encode().lower().split()
                        if words:
                            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                            out.append((digest, doc, h, place, start, end, len(words)))
                            place += 1
                if out:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4)
                    names = ["digest", "id", "h", "place", "start", "end", "words"]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "digest binary, id bigint, h bigint, place int, start int, end int, words int")


def dedup(docs: DataFrame, unit: str = "line", stretch: int = STRETCH) -> DataFrame:
    """``row`` (all columns of the input), ``kept`` text, ``n_units`` and ``removed`` spans."""
    # Cut twice rather than stored: units are many, and cutting is cheap beside their disk.
    found = units(docs, unit)
    rank = F.struct(F.col("id").isNull(), "id", "h", "place")
    firsts = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(firsts, "digest").where(rank != F.col("first"))
    cuts = (
        later.select("id", "h", "place", "start", "end", "words")
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("place", "start", "end", "words")).alias("again"), F.sum("words").alias("words"))
        .where(F.col("words") >= stretch)
        .select(F.col("id").alias("_id"), F.col("h").alias("_h"), "again")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    joined = given.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept, n_units, removed = [], [], []
                for text, again in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    n_units.append(sum(bool(text[a:b].encode().split()) for a, b in spans(text or "", unit)))
                    gone = passages([(u["place"], u["start"], u["end"], u["words"]) for u in again or ()], stretch)
                    if gone:
                        edges = [0, *(x for s in gone for x in s), len(text)]
                        text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    kept.append(text)
                    removed.append([{"start": a, "end": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(removed, kind), pa.array(kept, pa.string()), pa.array(n_units, pa.int64())],
                    names=["row", "removed", "kept", "n_units"],
                )

    ready = joined.select("row", F.col("row.text").cast("string").alias("text"), "again")
    schema = ready.select(
        "row",
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("removed"),
        F.lit(None).cast("string").alias("kept"),
        F.lit(0).cast("bigint").alias("n_units"),
    ).schema
    return ready.mapInArrow(cut, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_units",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(
            F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " "
        ).alias("removed_spans"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH pieces AS (
  SELECT doc_id, t, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nth
  FROM (
    SELECT doc_id, coalesce(text, '') AS t,
      string_split(regexp_replace(coalesce(text, ''), '([.!?][\x20\x09\x0B-\x0D]+|\n)', '\1' || chr(1), 'g'), chr(1)) AS pieces
    FROM documents)),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
  FROM pieces),
ranked AS (
  SELECT *, normal <> '' AS is_unit, len(string_split(normal, ' ')) AS words,
    row_number() OVER (PARTITION BY doc_id, normal <> '' ORDER BY nth) AS place,
    normal <> '' AND row_number() OVER (PARTITION BY normal ORDER BY doc_id, nth) > 1 AS again
  FROM placed),
runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, is_unit, again ORDER BY place) AS run FROM ranked),
judged AS (
  SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, is_unit, again, run) >= {STRETCH} AS gone FROM runs)
SELECT doc_id, count(*) FILTER (WHERE is_unit) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(start_at || '-' || (start_at + length(piece)), ' ' ORDER BY nth) FILTER (WHERE gone), '') AS removed_spans,
  sha256(coalesce(string_agg(piece, '' ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ship(__name__)
