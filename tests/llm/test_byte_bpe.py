"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import struct
import unicodedata

import public_tokenizers
import pytest
import tiktoken

from joblattice.llm import byte_bpe

# Letters newer than the library's Unicode version are cut otherwise; see the docstring.
ASSIGNED = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x1FFFF)]) if unicodedata.category(c) != "Cn"]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_given_documents(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.op4_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts(spark, library):
    rng = random.Random(3)
    texts = {
        0: None,
        1: "",
        2: " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0  x  \n\n y ",
        3: "don't DON'T it's 3½ ²³ ٣٤ x_y a1b2",
        4: "日本語テキスト 한국어 Ελληνικά кириллица 🙂🙃👩‍👩‍👧 é",
        5: "<|endoftext|> \x00\x01\x7f",
        6: "x" * 3000,
        7: "".join(rng.choice("abcdeéß") for _ in range(5000)),
        8: "word " * 50_000,
        9: "".join(rng.choice(ASSIGNED) for _ in range(3000)),
        10: " " * 1000,
    }
    docs = spark.createDataFrame([(*t, "n") for t in texts.items()], "doc_id bigint, text string, ids string")
    found = byte_bpe.encode(docs).withColumn("back", byte_bpe.decoded("ids")).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text), r.doc_id
        assert bytes(r.back) == text.encode()
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_long_words_merge_alike(library):
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = random.Random(5)
    for n in (1, 2, 3, 30, 500):
        for letters in ("ab", "etaoinshr", "aé日"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert byte_bpe.merged_long(word.encode(), ranks) == library.encode_ordinary(word)
