"""Packing: ids equal to the tokenizer's, pieces whole, windows tight."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from joblattice.llm import packing


def checked(pieces, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    for doc, text in texts.items():
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        expected = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == expected
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert {p.doc_tokens for p in parts} == {len(expected)}
    for parts in by_window.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert sum(p.length for p in parts) <= packing.WINDOW
    return by_window


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    windows = checked(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    tokens = sum(p.length for w in windows.values() for p in w)
    assert len(windows) <= tokens / packing.WINDOW * 1.01 + 2


def test_odd_texts(spark):
    texts = {
        0: None,
        1: "",
        2: "don't <|endoftext|> stop",
        3: "Café café İstanbul ΣΣ ’s x\u0085y \x1c z",
        4: "word, " * 30_000,
        5: "x" * 20_000,
        6: "\t\n \r\x0b",
        7: "ÄÖ 12,5%...!? 'll I'll",
    }
    docs = spark.createDataFrame([(*i, 0) for i in texts.items()], "doc_id bigint, text string, ids int")
    checked(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.where("doc_id = 7").union(docs.where("doc_id = 7"))).collect()
    assert len(twice) == 2 and len({(p.sequence_id, p.offset) for p in twice}) == 2


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_is_the_tightest(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
    place, offset, opened = packing.best_fit(lengths, 64)
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        fitting = [r for r in rooms if r >= lengths[i]]
        assert 64 - offset[i] == (min(fitting) if fitting else 64)
        if fitting:
            rooms.remove(min(fitting))
        rooms.append(64 - offset[i] - lengths[i])
    assert opened == len(rooms) and len(set(place)) == opened


def test_words_are_forgotten_beyond_their_bytes():
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, most = Tokenizer.from_file(path), 200_000
    words = packing.WordCache(path, most)
    rng = random.Random(4)
    letters = "abcdefghij" * 3 + "\u00c9\u00e9\u0130\u00df.,'<|1"
    for _ in range(40):
        texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(30)) for _ in range(8)]
        found = words.encode([*texts, "Word word WORD word, 'll", None])
        expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "Word word WORD word, 'll", ""]]
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == expected
        kept = [*words.known.items(), *words.odd_pieces.items()]
        assert sum(len(t) + len(i) + packing.ENTRY_BYTES for t, i in kept) < 2 * most
    # A word that is one piece is kept once.
    assert not words.known.keys() & words.odd_pieces.keys()
