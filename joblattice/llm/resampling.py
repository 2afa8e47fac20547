"""Target-distribution importance resampling (operator 12).

Documents are drawn in proportion to how much more likely their words are in a target
text collection than in the documents themselves. Words fall into hash buckets; a bucket's
gain is the rounded logarithm of its share of the target over its share of the documents,
a document's weight the sum of its words' gains, and Gumbel noise from a hash of the id
turns the highest weights into a draw without replacement.

1. Bucket counts of both sides: each task adds up arrays, one row per bucket it has met
   leaves it, and sums by bucket follow.
2. Weights are array lookups: the gains, ``BUCKETS`` numbers, go to the tasks as one array.
3. The n-th highest score is found by distributed quickselect. A round draws ``PIVOTS``
   rows of the open interval by a random hash, counts rows below, at and between
   these keys, and goes on between the two that enclose the n-th. No row moves; a round
   reads the narrow stored scores and brings home as many numbers as there are pivots.
4. Only the winners are sorted, by ranges, and ranked from their places in the sorted
   parts and the parts' sizes.

The composite key is (score descending, doc_id, hash of the text, number of the row in the
stored scores): no two rows have the same, so every three-way count is exact.

Defined results: a null or empty text has no word, weight 0, and is drawn never; a null id
counts as no digits in the hash and comes after all ids in ties; rows of one id tie
by the hashes of their texts, and of equal rows any is drawn; an empty table gives no row;
with an empty target every bucket has 0 target words; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import documents, ship, stored

BUCKETS = 10_000
RUN = 1  # longest run of words that is a feature
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
PIVOTS = 16

# Bytes that part words, in UTF-8: all of ASCII but digits and letters.
_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def buckets_of(words: list[bytes], run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``run`` words."""
    found = [crc32(w) for w in words]
    for n in range(2, run + 1):
        found += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(found, dtype=np.int64) % buckets


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all ``text`` fall in a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                sums += np.bincount(buckets_of(words_of(text.as_py()), run, buckets), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    narrow = texts.select(F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(given: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket. Both tables of counts have ``buckets`` rows at most."""
    sides = []
    for texts in (given, target):
        counts = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(texts, run, buckets).toArrow().to_pylist():
            counts[r["bucket"]] = r["n"]
        sides.append(counts.tolist())
    s, t = sides
    all_s, all_t = sum(s), sum(t)
    return [
        math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets))))
        for a, b in zip(s, t, strict=True)
    ]


def weights(docs: DataFrame, gain: list[int], run: int = RUN) -> DataFrame:
    """(doc_id, h, n_words, n_features, weight); ``h`` is a hash of the text."""
    raw = np.array(gain, dtype=np.int64).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.frombuffer(raw, dtype=np.int64)
        for batch in batches:
            words = (words_of(t.as_py()) for t in batch.column(2))
            found = [(len(w), buckets_of(w, run, len(each))) for w in words]
            columns = ([n for n, _ in found], [len(b) for _, b in found], [int(each[b].sum()) for _, b in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "h", "n_words", "n_features", "weight"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "doc_id bigint, h bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED) -> Column:
    """1000 times a Gumbel variable from the hash of seed and id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def key() -> Column:
    """The composite key, ascending from the best row."""
    return F.struct(
        (-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), "doc_id", "h", "number"
    )


def _literal(k) -> Column:
    parts = [F.lit(v).cast(t).alias(n) for n, v, t in zip(("s", "none", "doc_id", "h", "number"), k, _KINDS, strict=True)]
    return F.struct(*parts)


_KINDS = ("bigint", "boolean", "bigint", "bigint", "bigint")


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th least ``key()`` of stored ``rows``, 1 <= k <= number of rows.

    In each round the open interval between two known keys holds the answer. Its random
    pivots part it in pieces, whose sizes say in which one to go on; a piece no larger than
    the number of pivots ends the search, as all its rows are pivots then.
    """
    low = high = None
    seed = 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.where((F.col("score") <= -low[0]) & (key() > _literal(low)))
        if high is not None:
            inside = inside.where((F.col("score") >= -high[0]) & (key() < _literal(high)))
        drawn = inside.orderBy(F.xxhash64("number", F.lit(seed)), "number").limit(pivots)
        at = sorted((tuple(r.k) for r in drawn.select(key().alias("k")).collect()), key=_order)
        # Even places: rows below the pivot and above the one before; odd places: the pivot.
        place = F.lit(0)
        for p in at:
            place = place + F.when(key() > _literal(p), 2).when(key() == _literal(p), 1).otherwise(0)
        sizes = dict(inside.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())
        for i in range(2 * len(at) + 1):
            if k <= sizes.get(i, 0):
                break
            k -= sizes.get(i, 0)
        if i % 2:
            return at[i // 2]
        low, high = (at[i // 2 - 1] if i else low), (at[i // 2] if i // 2 < len(at) else high)
        seed += 1


def _order(k: tuple) -> tuple:
    return tuple((v is not None, v or 0) for v in k)


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their ``rank`` in the order of ``key()``, without one task for all."""
    names = winners.columns
    parts = winners.repartitionByRange(key()).sortWithinPartitions(key())
    # The number holds the part above 33 bits and the place in the sorted part below them.
    held = stored(parts.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for p, n in sorted(held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    first = winners.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    place = F.col("at") - F.shiftleft(part, 33) + 1
    return held.join(F.broadcast(first), part == F.col("_part")).select(*names, (F.col("_before") + place).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    run: int = RUN,
    seed: int = SEED,
    buckets: int = BUCKETS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """doc_id, h, n_words, n_features, weight, score and rank of every row of ``docs``.

    Of the rows with ``least_words`` words ``percent`` in a hundred are drawn and
    ranked; the others have no rank. ``target`` has a column ``text``.
    """
    weighed = weights(docs, gains(docs, target, run, buckets), run).withColumn("score", F.col("weight") + noise(seed))
    scored = stored(weighed.withColumn("number", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    draw = percent * scored.where(able).count() // 100
    if draw == 0:
        return scored.drop("number").withColumn("rank", F.lit(None).cast("bigint"))
    last = kth_key(scored.where(able), draw, pivots)
    won = able & (F.col("score") >= -last[0]) & (key() <= _literal(last))
    rest = scored.where(~won).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(scored.where(won)).unionByName(rest).drop("number")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resample(documents(spark, sf_dir).select("doc_id", "text"), target)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of the UTF-8 bytes of ``text``, bit by bit."""
    step = "xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)"
    bits = f"list_reduce(range(8), lambda r, i: {step}, xor(c, b))"
    hexed = f"hex(encode({text}))"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

SQL = f"""
WITH given AS (SELECT doc_id, {_SPLIT} AS words FROM documents),
target AS (SELECT {_SPLIT} AS words FROM benchmark),
source_words AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM given) GROUP BY w),
target_words AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM target) GROUP BY w),
known AS (
  SELECT w, {_crc32_sql("w")} % {BUCKETS} AS bucket
  FROM (SELECT w FROM source_words UNION SELECT w FROM target_words)),
s AS (SELECT bucket, sum(n) AS s FROM source_words JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM target_words JOIN known USING (w) GROUP BY bucket),
totals AS (
  SELECT coalesce((SELECT sum(n) FROM source_words), 0) AS all_s, coalesce((SELECT sum(n) FROM target_words), 0) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * (all_t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), totals),
word_gains AS (SELECT w, gain FROM known JOIN gains USING (bucket)),
weighed AS (
  SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(words) AS w FROM given) JOIN word_gains USING (w)
  GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000.0 * ln(-ln(
      (CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM given LEFT JOIN weighed USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""

ship(__name__)
