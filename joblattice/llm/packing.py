"""Packing of tokenised documents into windows of fixed size (operator 1).

Documents are cut into full windows first; what is left of each is placed by best
fit decreasing: the longest piece first, into the open window with the least room
that still holds it. The open windows of each remaining room sit in the leaf of
that room in a segment tree, so the tightest one is found in log(window) steps.

Every task packs the rows it reads, in blocks of a fixed number of leftovers, so
nothing is shuffled and no task holds more than a block. A block leaves about one
window part empty; a block holds thousands of leftovers.

A lost task reads and packs its rows again. Windows then have the same ids if the
rows come in the same order, as those of stored files do; store the result of a
shuffle before packing it.

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; equal lengths keep their order; an empty table gives no row; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import documents, kept_by_worker, ship

WINDOW = 4096
END_TOKEN = 2
VOCABULARY = "word_bpe_49k.json"
BLOCK = 8192  # leftovers that are packed together
CACHED_BYTES = 144 << 20  # words of each Python worker; an executor holds several beside its heap
ENTRY_BYTES = 180  # of a word without its characters and ids: two objects, a place in the dictionary
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


class RoomTree:
    """Open windows by the room they have left; a maximum tree over the rooms in use."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node and not self.used[node]:
            self.used[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of ``need`` or more, as (room, window)."""
        node, used = need + self.size, self.used
        if not used[node]:
            # Up until a right sibling has a room in use, then down its left edge.
            while node > 1 and (node & 1 or not used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if used[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            used[node] = 0
            node >>= 1
            while node and not (used[2 * node] or used[2 * node + 1]):
                used[node] = 0
                node >>= 1
        return room, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window of each piece, its offset there, number of windows)."""
    tree, opened = RoomTree(window), 0
    place, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        found = tree.take(lengths[i])
        room, at = found if found else (window, opened)
        opened += found is None
        place[i], offset[i] = at, window - room
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return place, offset, opened


class WordCache:
    """Token ids of texts, looked up by the runs between blanks.

    The pre-tokeniser never joins what a space, tab or line end separates, so a text's
    ids are those of its runs one after another. A new run of ASCII and Latin letters,
    digits and signs is cut into the pre-tokeniser's pieces here, and new pieces go
    through the vocabulary's merges alone; any other run goes through the tokenizer whole.
    A piece is a run as well, and kept once. What is kept is forgotten when it would take
    more than ``most`` bytes, checked between texts given together.
    """

    def __init__(self, path: str, most: int = CACHED_BYTES):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces_of = regex.compile(split).findall
        self.plain = regex.compile(r"(?!.*<\|)[\x21-\x7e\u00c0-\u017f]+").fullmatch
        signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in signs]
        self.letters = {b: 256 + i for i, b in enumerate(others)}
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.odd_pieces: dict[str, bytes] = {}  # those that are no plain run
        self.bytes = 0

    def put(self, table: dict[str, bytes], text: str, ids: bytes) -> None:
        table[text] = ids
        self.bytes += ENTRY_BYTES + (1 if text.isascii() else 4) * len(text) + len(ids)

    def learn_pieces(self, pieces: list[str]) -> None:
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        encoded = self.merges.encode(" ".join(shown), add_special_tokens=False)
        ends = np.cumsum(np.bincount(encoded.word_ids, minlength=len(pieces))).tolist()
        raw, at = np.asarray(encoded.ids, dtype="<u4").tobytes(), 0
        for piece, end in zip(pieces, ends, strict=True):
            plain = (piece.isascii() and piece.isalpha()) or self.plain(piece)
            self.put(self.known if plain else self.odd_pieces, piece, raw[4 * at : 4 * end])
            at = end

    def learn(self, runs: list[str]) -> None:
        plain, known, odd = self.plain, self.known, self.odd_pieces
        cut = {}
        for run in runs:
            if run.isascii() and run.isalpha():
                cut[run] = [run.lower()]
            elif plain(run):
                cut[run] = self.pieces_of(run.lower())
            else:
                ids = self.tokenizer.encode(run, add_special_tokens=False).ids
                self.put(known, run, np.asarray(ids, dtype="<u4").tobytes())
        new = list({p for pieces in cut.values() for p in pieces if p not in known and p not in odd})
        for i in range(0, len(new), 4096):
            self.learn_pieces(new[i : i + 4096])
        for run, pieces in cut.items():
            if run not in known:
                self.put(known, run, b"".join([known[p] if p in known else odd[p] for p in pieces]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if self.bytes > self.most:
            self.forget()
        known = self.known
        missing = {w for runs in split for w in runs if w not in known}
        if missing:
            self.learn(list(missing))
        look = known.__getitem__
        return [b"".join(map(look, runs)) for runs in split]


def pack(docs: DataFrame, window: int = WINDOW, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece of a document, with its ids (little-endian, 32 bits each)."""
    path = public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gc.disable()  # the caches are millions of plain strings, nothing cyclic
        words = kept_by_worker(f"words of {path}", lambda: WordCache(path))
        end = np.asarray([end_token], dtype="<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        left: list[tuple] = []

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(columns[6], pa.binary())], names=[*names, "ids"]
            )

        def placed(block: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            place, offset, opened = best_fit([len(p[3]) // 4 for p in block], window)
            pieces = [
                (doc, start, len(ids) // 4, total, next_id + place[i], offset[i], ids)
                for i, (doc, start, total, ids) in enumerate(block)
            ]
            next_id += opened
            for i in range(0, len(pieces), 1024):
                yield out(pieces[i : i + 1024])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                full = []
                texts = part.column(1).to_pylist()
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    cut = total - total % window
                    for start in range(0, cut, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        full.append((doc, start, window, total, next_id, 0, piece))
                        next_id += 1
                        if len(full) == 512:
                            yield out(full)
                            full = []
                    if cut < total:
                        left.append((doc, cut, total, ids[4 * cut :]))
                if full:
                    yield out(full)
                if len(left) >= BLOCK:
                    yield from placed(left[:BLOCK])
                    left = left[BLOCK:]
        if left:
            yield from placed(left)

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


ship(__name__)
