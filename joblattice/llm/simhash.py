"""SimHash near-duplicates (operator 5).

A fingerprint has a bit set where more than half of the shingle hashes of a document have
it. Documents whose fingerprints differ in four bits or fewer are linked, and linked
documents form components.

Work is done on distinct fingerprints, so copies cost one row. Each carries its
distances to sixteen reference fingerprints (pivots), packed in two numbers. Distances to
one pivot of a linked pair differ by at most four, so a pair whose largest coordinate
difference is greater is discarded before its own distance is taken.

Pivots alone cannot say which of N random fingerprints should meet, as nearly all lie
about 32 bits from any pivot. Pairs therefore meet on exact keys: cut 64 bits in m blocks;
of a linked pair at least m - 4 blocks are equal, so every choice of m - 4 blocks is a
key. m grows with the number of fingerprints so that chance meetings stay rare;
any m finds every link.

A key with more than ``CROWD`` fingerprints does not form pairs. Its members are joined
through midpoints: two fingerprints are within four bits exactly if some value is
within two bits of both. Each member names its 2,081 neighbours within two bits,
and links to the least member that names the same one. That is linear in the members and
gives the same components.

Defined results: no word, null or empty text: fingerprint zero, linked like any other;
repeated rows and equal fingerprints are one component; a component of rows without
id has a null component_id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import discard, documents, ship, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
PIVOTS = 16
CROWD = 64  # fingerprints of a key that are compared pair by pair
# (number of blocks, distinct fingerprints up to which chance meetings stay rare)
SCHEMES = ((6, 1 << 20), (7, 1 << 26), (8, 1 << 63))

# Bits set in each of the eight bit places of a byte, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> bytes:
    """The eight bytes of a text's fingerprint, most significant first."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())])
    return majority(hashes)


def majority(hashes: bytes) -> bytes:
    """The bits set in more than half of the given eight-byte hashes."""
    seen = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    counts = np.bincount((seen + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return np.packbits((2 * counts > len(seen)).ravel()).tobytes()


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text) and ``fp``, the fingerprint as a signed number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(t.as_py(), width, seed) for t in batch.column(2)])
            fps = pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fps], names=["doc_id", "h", "fp"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "doc_id bigint, h bigint, fp bigint")


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of the numbers 0 to n - 1, as signed numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(bytes([i]), SEED)).astype(np.int64)) for i in range(n)]


def _pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` with the distances to the pivots, eight in each of p0 and p1."""
    pivots = pivot_values()

    def packed(eight: list[int]) -> Column:
        parts = [
            F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i)
            for i, p in enumerate(eight)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return fps.withColumns({"p0": packed(pivots[:8]), "p1": packed(pivots[8:])})


def _close(a: str, b: str) -> Column:
    """Pivot coordinates within the bound, then the distance itself."""
    near = [
        F.abs(
            F.shiftright(F.col(f"{a}.{p}"), 8 * i).bitwiseAND(F.lit(127))
            - F.shiftright(F.col(f"{b}.{p}"), 8 * i).bitwiseAND(F.lit(127))
        )
        <= MAX_BITS
        for p in ("p0", "p1")
        for i in range(8)
    ]
    exact = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= MAX_BITS
    return reduce(Column.__and__, near) & exact


def _masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, total: int, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), a > b, that join the fingerprints ``fp`` as all linked pairs would."""
    blocks = next(m for m, most in SCHEMES if total <= most)
    keys = _pivot_table(distinct.select("fp")).select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks)])).alias("k", "key"),
        "fp",
        "p0",
        "p1",
    )
    counts = keys.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(counts.hint("merge"), ["k", "key"]), "simhash-keys")
    few = met.where(F.col("n") <= crowd).drop("n")
    a, b = few.alias("a"), few.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b.hint("merge"), on & (F.col("a.fp") > F.col("b.fp")) & _close("a", "b")).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )
    found = stored(pairs.distinct(), "simhash-links")
    many = stored(met.where(F.col("n") > crowd).select("fp").distinct(), "simhash-crowd")
    if many.isEmpty():
        return found
    # All values of at most two set bits: one bit shifted to place i, another to place j <= i
    # (the same place counts once), and none.
    place = F.sequence(F.lit(0), F.lit(63))
    named = many.select("fp", F.explode(place).alias("i")).select("fp", "i", F.explode(F.sequence(F.lit(-1), F.col("i"))).alias("j"))
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    two = F.when(F.col("j") == F.col("i"), bit("i")).otherwise(bit("i").bitwiseOR(bit("j")))
    flip = F.when(F.col("j") >= 0, two).when(F.col("i") == 0, F.lit(0).cast("bigint"))
    named = named.select("fp", F.col("fp").bitwiseXOR(flip).alias("z")).where("z IS NOT NULL")
    least = named.groupBy("z").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    through = named.join(least.hint("merge"), "z").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return found.union(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached, for every node of an edge.

    Alternating large-star and small-star rounds; each halves the paths. A round's
    edges are cut off from their lineage by a checkpoint in the shared folder.
    """
    spark = edges.sparkSession

    def star(sym: DataFrame, large: bool) -> DataFrame:
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Dealt out in any case: a hash table on the driver would grow with the edges.
        near = sym.join(least.hint("merge"), "a")
        if large:
            return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.where("a > b"), "edges")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stored(star(both, True), "edges")
        small = stored(star(large, False), "edges")
        discard(now, large)
        now = small
        last, seen = seen, state(now)
        if seen == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def grouped(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Every row's ``doc_id``, ``h``, fingerprint number ``fp`` and ``component_id``.

    ``root`` names the component; no two have the same, with or without ids.
    """
    fps = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(distinct, distinct.count()))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return fps.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "h", "fp", "component_id", "root")


def representatives(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one of each component stays."""
    return keep_first(docs, grouped(docs, width, seed))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``groups`` (doc_id, h, root).

    It is the one of the least id (rows without id last, then by the hash of the text);
    of rows equal in id and text one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = groups.groupBy("root").agg(F.min(rank).alias("r"))
    first = first.select(F.col("r.doc_id").alias("_id"), F.col("r.h").alias("_h"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    stay = given.join(first, same, "left_semi")
    number = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0)))
    return stay.withColumn("number", number).where("number = 1").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


ship(__name__)
