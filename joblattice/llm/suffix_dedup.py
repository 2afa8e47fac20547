"""Suffix-array dedup: bytes of repeated 100-byte strings go (operator 6).

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier: in a
document of smaller rank (id, then a 64-bit hash of its text) or earlier in its own.

All suffixes of a large table cannot be sorted in one place, so strings first choose who
meets. Each 100-byte string has an anchor: the first least hash of its ``GRAM``-byte
pieces. Equal strings have equal anchors at equal places, so they meet on the
anchor's hash; neighbouring strings with one anchor form a run. A run is a row of hashes and
places; its text stays where it is.

1. Anchors that occur once are dropped (counts by hash, partly summed in each task).
2. Runs equal in anchor and text are grouped: all but the first are removed whole. A
   passage that thousands of documents share ends here.
3. What is left are first occurrences of different runs with one anchor, mostly at the
   edges of passages. Their texts are read and, group by group, sorted by a suffix
   array in two stages: only suffixes smaller than their successors are sorted directly,
   the rest are induced by a scan of the buckets. Neighbours that share 100 bytes
   are one string; all but its first start are removed.
4. An anchor with more than ``CROWD`` different runs is not sorted in one task: its
   strings are dealt out by their own hashes and grouped as in step 2.

A lost task repeats its part; what is used twice is stored in the shared folder. A document
with its spans goes to one task, as its text does; longer texts are cut in overlapping
parts for the anchors.

Defined results: a null or empty text has no byte; texts under 100 bytes lose nothing; a
null id ranks after all ids; rows equal in id and text are one document and lose the
same bytes; an empty table gives no row; all columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import documents, kept_by_worker, ship, stored

LENGTH = 100
GRAM = 24
PART = 1 << 18  # bytes whose anchors are taken at once
CROWD = 512  # different runs of an anchor that are sorted together
SORTED_BYTES = 1 << 18  # texts of whole groups that share a suffix array

_ODD = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


class Hasher:
    """Hashes of all pieces of a text from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, size: int):
        inverse = pow(_ODD, -1, 1 << 64)
        self.up = self.powers(_ODD, size)
        self.down = self.powers(inverse, size)
        seeds = [xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)]
        self.values = np.array(seeds, dtype=np.uint64)

    @staticmethod
    def powers(base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        done, power = 1, base
        while done < size:
            n = min(done, size - done)
            out[done : done + n] = out[:n] * np.uint64(power)
            done, power = 2 * done, power * power % (1 << 64)
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def pieces(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD)
    return x ^ (x >> np.uint64(31))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of every window of ``width`` values."""
    least, place, done = values, np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        take = least[step:] < least[: len(least) - step]
        place = np.where(take, place[step:], place[: len(place) - step])
        least = np.where(take, least[step:], least[: len(least) - step])
        done += step
    return place


def runs_of(data: np.ndarray, hasher: Hasher, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor in texts laid end to end.

    ``ends`` gives, for each byte, the end of its text. Returns (anchor hash, run hash,
    first start, number of starts).
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = hasher.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hasher.pieces(sums, at, at + GRAM)
    anchor = first_least(grams, LENGTH - GRAM + 1)
    starts = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[: len(anchor)])
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    own = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(starts) != 1)]))
    first, count = starts[new], np.diff(np.append(new, len(starts)))
    place = own[new]
    text = hasher.pieces(sums, first, first + count + LENGTH - 1)
    shape = ((place - first) * 256 + count).astype(np.uint64)
    return grams[place], mixed(text + mixed(shape)), first, count


def suffix_array(data: bytes, depth: int = LENGTH) -> list[int]:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(data)
    if n == 0:
        return []
    c = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    # A suffix is smaller than its successor if the next different byte is greater.
    change = np.flatnonzero(np.diff(c))
    after = np.searchsorted(change, np.arange(n))
    known = after < len(change)
    at = change[np.minimum(after, max(len(change) - 1, 0))] if len(change) else np.zeros(n, dtype=np.int64)
    smaller = known & (c[at] < c[np.minimum(at + 1, n - 1)])
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i : i + depth])
    sizes = np.bincount(c, minlength=256)
    tops = np.cumsum(sizes)
    front = (tops - sizes).tolist()
    order = [-1] * n
    # Within a bucket the larger ones come first, the directly sorted ones last.
    back = (tops - np.bincount(c[smaller], minlength=256)).tolist()
    for i in direct:
        b = data[i]
        order[back[b]] = i
        back[b] += 1
    induced = (~smaller).tolist()

    def place(i: int) -> None:
        b = data[i]
        order[front[b]] = i
        front[b] += 1

    place(n - 1)  # the last suffix is larger than the empty one
    for j in range(n):
        i = order[j] - 1
        if i >= 0 and induced[i]:
            b = data[i]
            order[front[b]] = i
            front[b] += 1
    return order


def common_prefixes(data: bytes, order: list[int], most: int = LENGTH) -> list[int]:
    """Bytes that each suffix shares with the one before it in ``order``, up to ``most``."""
    out = [0] * len(order)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] : order[k - 1] + most], data[order[k] : order[k] + most]
        if a == b:
            out[k] = len(a)
        else:
            n = min(len(a), len(b))
            out[k] = next((i for i in range(n) if a[i] != b[i]), n)
    return out


def repeated_starts(texts: list[bytes], ranks: list[tuple]) -> list[tuple[int, int]]:
    """(text, start) of every 100-byte string that occurs again with a smaller rank.

    ``ranks[i]`` is the rank of the first byte of text i, a tuple whose last part is
    the byte's place.
    """
    texts, ranks, whose, offset = _stretches(texts, ranks)
    data = b"\xff".join(texts)  # no UTF-8 text holds this byte
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    order = np.asarray(suffix_array(data))
    text = np.searchsorted(firsts, order, side="right") - 1
    inside = order - firsts[text]
    whole = inside + LENGTH <= np.asarray([len(t) for t in texts])[text]
    order, text, inside = order[whole].tolist(), text[whole].tolist(), inside[whole].tolist()
    shared = common_prefixes(data, order)
    out, k = [], 0
    while k < len(order):
        e = k + 1
        while e < len(order) and shared[e] >= LENGTH:
            e += 1
        if e - k > 1:
            group = [((*ranks[text[j]][:-1], ranks[text[j]][-1] + inside[j]), text[j], inside[j]) for j in range(k, e)]
            least = min(group)[0]
            out += [(whose[t], offset[t] + i) for r, t, i in group if r != least]
        k = e
    return out


def _stretches(texts: list[bytes], ranks: list[tuple]) -> tuple[list[bytes], list[tuple], list[int], list[int]]:
    """The parts of the texts that hold strings which may be repeated: (parts, ranks of their
    first bytes, their texts, their places there).

    A string whose hash no other has is not repeated and need not be sorted.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hasher = kept_by_worker("suffix_hasher", lambda: Hasher(4 * PART))
    if len(data) > len(hasher.up):
        hasher = Hasher(len(data))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(max(len(data) - LENGTH + 1, 0))
    at = at[at + LENGTH <= ends[: len(at)]]
    hashes = hasher.pieces(hasher.sums(data), at, at + LENGTH)
    _, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
    at = at[count[place] > 1]
    if not len(at):
        return [], [], [], []
    text = np.searchsorted(np.cumsum(sizes), at, side="right")
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0)]))
    firsts = np.cumsum(sizes) - sizes
    out: tuple[list, list, list, list] = ([], [], [], [])
    for first, last in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
        t = int(np.searchsorted(firsts, first, side="right")) - 1
        start = first - int(firsts[t])
        out[0].append(texts[t][start : start + last - first + LENGTH])
        out[1].append((*ranks[t][:-1], ranks[t][-1] + start))
        out[2].append(t)
        out[3].append(start)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, did, h, text): did and h name a document; a null id ranks last."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"))
    return given.select(
        "row",
        F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("did"),
        F.xxhash64(F.col("row.doc_id").isNull(), "row.text", F.octet_length("row.text")).alias("h"),
        F.col("row.text").cast("string").alias("text"),
    )


def runs(keyed: DataFrame) -> DataFrame:
    """(ah, th, did, h, start, n) of every run of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PART + LENGTH)
        names = ["ah", "th", "did", "h", "start", "n"]

        def out(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            """parts: (did, h, place of the part in its text, bytes)."""
            data = np.frombuffer(b"".join([p[3] for p in parts]), dtype=np.uint8)
            firsts = np.cumsum([0] + [len(p[3]) for p in parts])
            ends = np.repeat(firsts[1:], np.diff(firsts))
            ah, th, first, count = runs_of(data, hasher, ends)
            part = np.searchsorted(firsts, first, side="right") - 1
            column = lambda i, kind: np.asarray([p[i] for p in parts], dtype=kind)[part]
            start = first - firsts[part] + column(2, np.int64)
            arrays = [ah.view(np.int64), th.view(np.int64), column(0, np.int64), column(1, np.int64)]
            arrays += [start.astype(np.int32), count.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

        parts, size = [], 0
        for batch in batches:
            for did, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                for at in range(0, max(len(raw) - LENGTH + 1, 0), PART):
                    piece = raw[at : at + PART + LENGTH - 1]
                    if parts and size + len(piece) > PART + LENGTH:
                        yield out(parts)
                        parts, size = [], 0
                    parts.append((did, h, at, piece))
                    size += len(piece)
        if parts:
            yield out(parts)

    return keyed.select("did", "h", "text").mapInArrow(
        rows, "ah bigint, th bigint, did bigint, h bigint, start int, n int"
    )


def _texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of ``wanted`` runs (ah, crowd, did, h, start, n); a crowd's start by start."""
    per_doc = wanted.groupBy("did", "h").agg(
        F.collect_list(F.struct("ah", "crowd", "start", "n")).alias("runs")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ah", "crowd", "sub", "did", "h", "start", "run"]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = []
        for batch in batches:
            for at in range(batch.num_rows):
                _, did, h, text, wanted_runs = (c[at].as_py() for c in batch.columns)
                raw = text.encode()
                for r in wanted_runs:
                    ah, start, n = r["ah"], r["start"], r["n"]
                    if not r["crowd"]:
                        found.append((ah, False, 0, did, h, start, raw[start : start + n + LENGTH - 1]))
                    else:
                        for s in range(start, start + n):
                            digest = xxhash.xxh64_intdigest(raw[s : s + LENGTH], 11)
                            sub = digest - (1 << 64) if digest >> 63 else digest
                            found.append((ah, True, sub, did, h, s, None))
                    if len(found) >= 2048:
                        yield out(found)
                        found = []
        if found:
            yield out(found)

    # All columns pass, so that this reads the exchange that the last join reads too.
    joined = keyed.join(per_doc, ["did", "h"]).select("row", "did", "h", "text", "runs")
    return joined.mapInArrow(
        rows, "ah bigint, crowd boolean, sub bigint, did bigint, h bigint, start int, run binary"
    )


def _sorted_repeats(texts: DataFrame) -> DataFrame:
    """Spans (did, h, start, end) that suffix arrays of whole anchor groups find."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            # Equal strings have equal anchors, so whole groups can share one array.
            ranks = [(did, h, start) for _, did, h, start, _ in group]
            found = [(*ranks[t][:2], ranks[t][2] + i) for t, i in repeated_starts([g[4] for g in group], ranks)]
            if found:
                did, h, start = zip(*found, strict=True)
                arrays = [pa.array(did, pa.int64()), pa.array(h, pa.int64()), pa.array(start, pa.int32())]
                arrays.append(pa.array([s + LENGTH for s in start], pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, names=["did", "h", "start", "end"])

        group, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED_BYTES and row[0] != group[-1][0]:
                    yield from out(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[4])
        if group:
            yield from out(group)

    dealt = texts.where(~F.col("crowd")).select("ah", "did", "h", "start", "run")
    dealt = dealt.repartition("ah").sortWithinPartitions("ah")
    return dealt.mapInArrow(rows, "did bigint, h bigint, start int, end int")


def repeats(keyed: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Spans (did, h, start, end) whose bytes go; they may overlap."""
    rank = F.struct("did", "h", "start")
    found = runs(keyed)
    again = found.groupBy("ah").agg(F.count("*").alias("c")).where("c > 1").select("ah")
    shared = stored(found.join(again, "ah"), "shared-runs")
    firsts = shared.groupBy("ah", "th").agg(F.min(rank).alias("first"), F.min("n").alias("n"), F.count("*").alias("c"))
    copies = firsts.where("c > 1").select("ah", "th", "first")
    later = shared.join(copies, ["ah", "th"]).where(rank != F.col("first"))
    later = later.select("did", "h", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    many = firsts.groupBy("ah").agg(F.count("*").alias("k")).where("k > 1")
    wanted = firsts.join(many, "ah").select(
        "ah", (F.col("k") > crowd).alias("crowd"), "first.did", "first.h", "first.start", "n"
    )
    texts = stored(_texts(keyed, wanted), "run-texts")
    single = texts.where("crowd").select("ah", "sub", "did", "h", "start")
    # Sorted by rank within a string all but its first start go; nothing is joined or kept in memory.
    nth = F.rank().over(Window.partitionBy("ah", "sub").orderBy("did", "h", "start"))
    dealt = single.withColumn("nth", nth).where("nth > 1")
    dealt = dealt.select("did", "h", "start", (F.col("start") + LENGTH).alias("end"))
    return later.unionByName(dealt).unionByName(_sorted_repeats(texts))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes that stay, maximal removed spans)."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    edges = [0, *(x for s in merged for x in s), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]), [tuple(s) for s in merged]


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``row`` (all columns of the input), ``kept`` bytes, ``n_bytes`` and ``removed`` spans."""
    keyed = _keyed(docs)
    spans = repeats(keyed, crowd).groupBy("did", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, sizes, removed = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    rest, gone = cut(raw, [(s["start"], s["end"]) for s in found or ()])
                    kept.append(rest)
                    sizes.append(len(raw))
                    removed.append([{"start": a, "end": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, kind)],
                    names=["row", "kept", "n_bytes", "removed"],
                )

    joined = keyed.join(spans, ["did", "h"], "left").select("row", "text", "spans")
    schema = joined.select(
        "row",
        F.lit(None).cast("binary").alias("kept"),
        F.lit(None).cast("bigint").alias("n_bytes"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("removed"),
    ).schema
    return joined.mapInArrow(rows, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ship(__name__)
