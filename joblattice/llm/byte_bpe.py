"""Byte-level BPE encoding and decoding (operator 4).

Each task cuts its texts by the tokenizer's pattern and hands Spark the distinct words of a
block of texts that it has not handed over before. Spark's higher-order functions fold the
ranked merges over the bytes of each word: the pair with the least rank is merged, the
leftmost first, until no pair has a rank. The ranks are one literal, an array of small
maps that the ids of a pair pick from, as a map of Spark is searched from end to end. The
ids then take the places of the words of the block's texts, in the same task.

Nothing is shuffled or broadcast beside the fixed vocabulary. A task holds one block (about
``BLOCK_BYTES`` or one longer text) and the words since the last reset. A lost task repeats
its blocks.

The fold is quadratic in a word's length. Words of more than ``LONG`` bytes (no blank or
change of kind in them) are merged in the task with a heap: the same merges in the same order
in n log n steps. A text may be one such word of any length.

Decoding takes the piece of every id from a literal array and joins them; bytes are held as
Latin-1 text there, one character per byte.

Letters and digits are those of the ``regex`` library's Unicode version. Code points it counts
as letters and the tiktoken library's older version does not (none assigned up to
Unicode 15) may be cut otherwise than there; they decode to the same bytes.

Defined results: a null or empty text has no id and decodes to no bytes; repeated rows
are encoded alike; special tokens are ordinary text; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import documents, ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 4 << 20
KNOWN_WORDS = 1_000_000  # words of a task between two resets
LONG = 256
BUCKETS = 8192
NO_RANK = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<bigint,int>>: the rank of every two tokens that make a third, by bucket.

    A pair (a, b) of ids has the key a * 2**20 + b.
    """
    buckets: list[list[list[int]]] = [[] for _ in range(BUCKETS)]
    for raw, rank in ranks.items():
        for cut in range(1, len(raw)):
            a, b = ranks.get(raw[:cut]), ranks.get(raw[cut:])
            if a is not None and b is not None:
                buckets[(a * 31 + b) % BUCKETS].append([a << 20 | b, rank])
    # JSON has no maps with numbers as keys; a row (one block) makes the maps once.
    entries = F.from_json(F.lit(json.dumps(buckets)), "array<array<array<bigint>>>")
    entry = lambda e: F.struct(F.get(e, F.lit(0)), F.get(e, F.lit(1)).cast("int"))
    return F.transform(entries, lambda b: F.map_from_entries(F.transform(b, entry)))


def byte_literal(ranks: dict[bytes, int]) -> Column:
    return F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<int>")


def merged(word: Column, merges: Column, singles: Column) -> Column:
    """Ids of a word given as its bytes: a fold over ids and the ranks of their pairs."""

    def rank(a: Column, b: Column) -> Column:
        bucket = F.get(merges, F.pmod(a * 31 + b, F.lit(BUCKETS)))
        return F.coalesce(bucket[a.cast("bigint") * (1 << 20) + b], F.lit(NO_RANK))

    def put(array: Column, i: Column, drop: int, new: Column) -> Column:
        # ``new`` in place of the elements from i on, ``drop`` of them.
        return F.concat(F.slice(array, F.lit(1), i), new, F.slice(array, i + (drop + 1), F.size(array)))

    def step(state: Column, _: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]

        def merge(m: Column) -> Column:
            i, least = m["i"], m["least"]
            left = F.when(i > 0, F.array(rank(F.get(ids, i - 1), least))).otherwise(none)
            right = F.when(i + 2 < F.size(ids), F.array(rank(least, F.get(ids, i + 2)))).otherwise(none)
            # The pairs left of, at and right of the merged one give way to two new ones.
            begin = F.greatest(i - 1, F.lit(0))
            kept = F.concat(
                F.slice(ranks, F.lit(1), begin), left, right, F.slice(ranks, i + 3, F.size(ranks))
            )
            return F.struct(put(ids, i, 2, F.array(least)).alias("ids"), kept.alias("ranks"))

        least = F.array_min(ranks)
        found = F.struct((F.array_position(ranks, least) - 1).cast("int").alias("i"), least.alias("least"))
        return F.when(
            F.size(ranks) > 0,
            F.transform(F.array(found), lambda m: F.when(m["least"] == NO_RANK, state).otherwise(merge(m)))[0],
        ).otherwise(state)

    none = F.array().cast("array<int>")
    first = F.transform(word, lambda b: F.get(singles, b))

    def fold(ids: Column) -> Column:
        pairs = F.transform(
            F.slice(ids, F.lit(2), F.size(ids)), lambda b, i: rank(F.get(ids, i), b)
        )
        start = F.struct(ids.alias("ids"), pairs.alias("ranks"))
        return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), start, step, lambda s: s["ids"])

    return F.transform(F.array(first), fold)[0]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and linked pieces."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, n + 1))  # end of the piece that starts here; 0 where none does
    before = list(range(-1, n - 1))

    def rank_at(i: int) -> int | None:
        j = end[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, until = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != until:
            continue  # one of the two pieces has grown or gone meanwhile
        end[i], end[j] = until, 0
        if until < n:
            before[until] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank_at(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    """Numbers of words in the order they are first asked for; ``new`` lists those."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


_BLOCK = (
    "ids array<bigint>, counts array<int>, tokens array<int>, words array<array<int>>, "
    "given array<array<int>>, fresh boolean"
)


def _ragged(parts: list[bytes], dtype: str) -> pa.ListArray:
    flat = np.frombuffer(b"".join(parts), dtype=dtype).astype(np.int32)
    size = np.dtype(dtype).itemsize
    ends = np.cumsum([0, *(len(p) // size for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _blocks(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Blocks of texts as numbers of words, with the words that are new in the task.

    ``counts`` are the words of each text, ``tokens`` their numbers. Of a new word either
    ``words`` has the bytes, to be merged, or ``given`` the ids: those of a word that
    is a token itself, or too long for the fold. ``fresh`` starts the numbers anew.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(public_tokenizers.PATTERN).findall
        numbers = _Numbers()

        def block(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal numbers
            fresh = len(numbers) > KNOWN_WORDS
            if fresh:
                numbers = _Numbers()
            numbers.new = []
            found = [list(map(numbers.__getitem__, cut(t or ""))) for t in texts]
            words, given = [], []
            for word in map(str.encode, numbers.new):
                whole = ranks.get(word)
                direct = [whole] if whole is not None else merged_long(word, ranks) if len(word) > LONG else []
                given.append(np.asarray(direct, dtype="<i4").tobytes())
                words.append(b"" if direct else word)
            tokens = np.fromiter((n for f in found for n in f), dtype=np.int32)
            whole_block = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(f) for f in found], pa.int32()),
                pa.array(tokens),
                _ragged(words, "u1"),
                _ragged(given, "<i4"),
            ]
            names = ["ids", "counts", "tokens", "words", "given", "fresh"]
            return pa.RecordBatch.from_arrays([*map(whole_block, columns), pa.array([fresh])], names=names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, _BLOCK)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` and ``ids_le``, the ids as little-endian 32-bit numbers."""
    ranks = load_ranks(public_tokenizers.path(vocabulary))
    tables = F.struct(merge_literal(ranks).alias("merges"), byte_literal(ranks).alias("singles"))
    folded = F.transform(
        F.array(tables), lambda t: F.transform("words", lambda w: merged(w, t["merges"], t["singles"]))
    )[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        flat, starts, lengths = none, none, none  # ids of the words by their numbers

        def numbers(array: pa.Array) -> np.ndarray:
            return array.to_numpy(zero_copy_only=False).astype(np.int64)

        for batch in batches:
            for at in range(batch.num_rows):
                docs, counts, tokens, given, encoded, fresh = (c[at] for c in batch.columns)
                if fresh.as_py():
                    flat, starts, lengths = none, none, none
                # One of the two lists of a word is empty.
                sizes = [numbers(x.values.value_lengths()) for x in (encoded, given)]
                ids = [numbers(x.values.flatten()) for x in (encoded, given)]
                places = [np.cumsum(n) - n for n in sizes]
                begin = np.where(sizes[0] > 0, places[0], len(ids[0]) + places[1]) + len(flat)
                flat = np.concatenate([flat, *ids])
                starts = np.concatenate([starts, begin])
                lengths = np.concatenate([lengths, sizes[0] + sizes[1]])

                words, words_of = numbers(tokens.values), numbers(counts.values)
                doc_ids, first = docs.values, np.concatenate([[0], np.cumsum(words_of)])
                for i in range(0, len(words_of), 256):
                    last = min(i + 256, len(words_of))
                    part = words[first[i] : first[last]]
                    n = lengths[part]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    out = flat[np.repeat(starts[part] - ends[:-1], n) + np.arange(ends[-1])].astype("<i4")
                    bounds = ends[first[i : last + 1] - first[i]].astype(np.int32)
                    raw = out.tobytes()
                    le = [raw[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                    arrays = [
                        doc_ids.slice(i, last - i),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(out)),
                        pa.array(le, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "ids_le"])

    blocks = _blocks(docs, ranks).select("ids", "counts", "tokens", "given", folded.alias("encoded"), "fresh")
    return blocks.mapInArrow(rows, "doc_id bigint, ids array<int>, ids_le binary")


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes of an array of ids."""
    ranks = load_ranks(public_tokenizers.path(vocabulary))
    pieces = [""] * (max(ranks.values()) + 1)
    for raw, rank in ranks.items():
        pieces[rank] = raw.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.transform(F.array(table), lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))[0]
    return F.encode(joined, "ISO-8859-1")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )


ship(__name__)
