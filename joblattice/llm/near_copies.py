"""Near-duplicates by word shingles: Jaccard similarity of 0.8 or more (pipeline).

A document is its set of five-word shingles, as 64-bit hashes; two are linked if their sets
have a Jaccard similarity of ``SIMILAR`` or more, and linked documents form components.

Candidates come from SimHash first: a set's fingerprint has the bits that more than half of its
hashes have, and sets whose fingerprints are linked as in ``simhash`` (equal blocks, pivot
distances, midpoints) are pairs to verify. Fingerprints alone do not decide: on the given
documents pairs at 0.8 differ by up to 17 of 64 bits, and no choice of equal blocks reaches so far.

Pairs further apart come from ``BANDS`` bands of ``ROWS`` minimum hashes: a pair of similarity s misses
all of them with probability (1 - s ** ROWS) ** BANDS, 5e-8 at 0.8. Pairs that meet are
discarded where their sizes show that they cannot share enough, then verified on their whole
sets. A document costs ``BANDS`` short rows, however long it is.

A key with more than ``CROWD`` sets first links each to its least set. Sets that are one
component by then need no more links; only sets of different components are compared
further. A group of near copies is one component at once and costs rows, not pairs;
sets of many components that share a crowded key still cost their product.

Defined results: words are those of ``simhash``; a text of fewer than five words is one
shingle, a null text or one without words the shingle of no word; texts of equal sets are
one node; rows without id, repeated rows and empty tables are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm import simhash
from joblattice.llm.common import discard, ship, stored
from joblattice.llm.simhash import SEED, components, keep_first

SHINGLE = 5
SIMILAR = (4, 5)  # the least similarity, as a fraction
CROWD = 64  # sets of a key that are compared pair by pair
BANDS, ROWS = 32, 4

_MIX = np.frombuffer(
    b"".join(xxhash.xxh64_digest(bytes([i]), SEED) for i in range(2 * BANDS * ROWS)), dtype=">u8"
).astype(np.uint64)
_TIMES, _FLIP = _MIX[: BANDS * ROWS] | np.uint64(1), _MIX[BANDS * ROWS :]


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64).astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    raw = b"".join([digest(joined[a:b], SEED) for a, b in spans])
    return np.unique(np.frombuffer(raw, dtype=">u8").astype(np.int64))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string")
    )


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def band_keys(found: np.ndarray) -> list[int]:
    """A hash for each band of minimum hashes of a set of shingles."""
    values, least = found.view(np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        mixed = (values[at : at + 2048, None] ^ _FLIP) * _TIMES
        least = np.minimum(least, mixed.min(axis=0))
    raw = least.tobytes()
    size = 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[size * b : size * (b + 1)], b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).astype(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """``id``, ``h``, ``s`` (a hash of the set), its size ``n``, ``fp`` (its fingerprint) and
    ``keys``, those of its bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                names, sizes, fps, keys = [], [], [], []
                for text in piece.column(2):
                    found = shingles(text.as_py())
                    names.append(xxhash.xxh64_digest(found.tobytes(), SEED))
                    sizes.append(len(found))
                    fps.append(simhash.majority(found.astype(">i8").tobytes()))
                    keys.append(band_keys(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[:2],
                        pa.array(np.frombuffer(b"".join(names), dtype=">i8").astype(np.int64)),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.frombuffer(b"".join(fps), dtype=">i8").astype(np.int64)),
                        _lists(keys),
                    ],
                    names=["id", "h", "s", "n", "fp", "keys"],
                )

    return _narrow(docs).mapInArrow(rows, "id bigint, h bigint, s bigint, n bigint, fp bigint, keys array<bigint>")


def fingerprint_pairs(known: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a > b, of sets ``s`` that join them as all pairs of linked or equal
    fingerprints would: a fingerprint's least set stands for its others."""
    found = known.select("fp", "s").distinct()
    least = stored(found.groupBy("fp").agg(F.min("s").alias("least")), "set-fingerprints")
    equal = found.join(least, "fp").where("s > least").select(F.col("s").alias("a"), F.col("least").alias("b"))
    linked = simhash.links(least.select("fp"), least.count(), crowd)
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"s_{side}"))
    linked = linked.join(of("a"), "a").join(of("b"), "b")
    return equal.union(linked.select(F.greatest("s_a", "s_b"), F.least("s_a", "s_b")))


def _enough(shared: Column, n_a: Column, n_b: Column, similar: tuple[int, int]) -> Column:
    part, whole = similar
    return shared * (part + whole) >= (n_a + n_b) * part


def _may_link(a: str, b: str, similar: tuple[int, int]) -> Column:
    """The smaller set is large enough."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _enough(F.least(n, m), n, m, similar)


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, stored."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    chosen = known.join(wanted, "s", "left_semi").groupBy("s").agg(F.min(rank).alias("r"))
    chosen = chosen.select("s", F.col("r.id").alias("_id"), F.col("r.h").alias("_h"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [shingles(t.as_py()) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(found)], names=["s", "all"])

    texts = _narrow(docs).join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    # Rows equal in id and text are repeated here; one of them is enough.
    whole = texts.select("s", "text").mapInArrow(rows, "s bigint, all array<bigint>").dropDuplicates(["s"])
    whole = stored(whole, "shingle-sets")
    left = whole.select(F.col("s").alias("a"), F.col("all").alias("all_a"))
    right = whole.select(F.col("s").alias("b"), F.col("all").alias("all_b"))
    shared = F.size(F.array_intersect("all_a", "all_b"))
    linked = _enough(shared, F.size("all_a"), F.size("all_b"), similar)
    found = stored(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"), "shingle-links")
    discard(whole)
    return found


def links(docs: DataFrame, known: DataFrame, crowd: int = CROWD, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links (a, b), a > b, that join the sets ``s`` of ``known`` as all linked pairs would."""
    distinct = stored(known.groupBy("s").agg(F.any_value(F.struct("n", "keys")).alias("v")), "distinct-sets")
    keys = distinct.select("s", "v.n", F.explode("v.keys").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("s").alias("least")).where("members > 1")
    met = stored(keys.join(counts, "key"), "band-keys")
    discard(distinct)

    def meet(rows: DataFrame, *more: Column) -> DataFrame:
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.s") > F.col("y.s")) & _may_link("x", "y", similar)
        for condition in more:
            on = on & condition
        return rows.alias("x").join(rows.alias("y"), on).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))

    many = met.where(F.col("members") > crowd)
    to_least = many.where("s > least").select(F.col("s").alias("a"), F.col("least").alias("b"))
    pairs = meet(met.where(F.col("members") <= crowd)).union(to_least)
    pairs = pairs.union(fingerprint_pairs(known, crowd)).distinct()
    pairs = stored(pairs, "shingle-pairs")
    found = _verified(pairs, docs, known, similar)
    discard(pairs)
    if many.isEmpty():
        discard(met)
        return found
    roots = components(found)
    rooted = many.join(roots, many["s"] == roots["node"], "left")
    rooted = stored(rooted.select("key", "s", "n", F.coalesce("root", "s").alias("root")), "shingle-crowds")
    discard(met)
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = rooted.join(apart.select("key"), "key", "left_semi")
    rest = stored(meet(rest, F.col("x.root") != F.col("y.root")).distinct(), "shingle-pairs")
    discard(rooted)
    more = _verified(rest, docs, known, similar)
    discard(rest)
    return found.union(more)


def grouped(docs: DataFrame, crowd: int = CROWD, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Every row's ``doc_id``, ``h``, set ``s`` and the ``root`` that names its component."""
    known = stored(sets(docs), "shingle-bands")
    roots = components(links(docs, known, crowd, similar))
    return known.join(roots, known["s"] == roots["node"], "left").select(
        F.col("id").alias("doc_id"), "h", "s", F.coalesce("root", "s").alias("root")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the first of each component stays."""
    return keep_first(docs, grouped(docs))


ship(__name__)
