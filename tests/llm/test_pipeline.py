"""The pipeline's stages against plain recomputations, each on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from joblattice.llm import quality_classifier
from tests.llm.test_simhash import plain_components, plain_fingerprint

SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def normal(line):
    return SPACE.sub(" ", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)).strip(" ")


def distance(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
        if min(row[lo - 1 : hi + 1]) > most:
            return most + 1
    return row[-1]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf).cache()
        out.append((name, docs, found))
        if name != "packing":
            assert found.columns == docs.columns
        docs = found
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_dedup", "substring_dedup", "packing",
    ]


def test_classifier_stage(spark, sf, stages):
    _, docs, found = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in quality_classifier.classify(docs, labels).where("NOT kept").select("row.doc_id").collect()}
    assert set(texts(docs)) - set(texts(found)) == rejected != set()
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & rejected) <= 0.02 * len(clean)


def test_line_stage(stages):
    _, docs, found = stages[1]
    given = texts(docs)
    long = {normal(x) for t in given.values() for x in t.split("\n")}
    long = sorted(x for x in long if len(x) >= 32)
    root = {x: x for x in long}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = {}
    for x in long:
        by_size.setdefault(len(x), []).append(x)
    for x in long:
        for n in (len(x), len(x) + 1, len(x) + 2):
            for y in by_size.get(n, ()):
                if x != y and sum(map(str.__eq__, x, y)) + sum(map(str.__eq__, x[::-1], y[::-1])) >= len(x) // 3 - 6 and distance(x, y) <= 2:
                    root[find(x)] = find(y)
    seen = {}

    def drop(line, doc, place):
        line = normal(line)
        return len(line) >= 32 and seen.setdefault(find(line), (doc, place)) != (doc, place)

    expected = {}
    for doc in sorted(given):
        pieces = given[doc].split("\n")
        kept = [p for i, p in enumerate(pieces) if not drop(p, doc, i)]
        if len(kept) == len(pieces) or "".join(kept).split():
            expected[doc] = "\n".join(kept)
    assert texts(found) == expected
    assert all(r.n_chars == len(r.text) for r in found.collect())


def test_near_duplicate_stage(stages):
    _, docs, found = stages[2]
    given = texts(docs)
    classes = plain_components([(d, plain_fingerprint(t)) for d, t in given.items()])
    assert texts(found) == {d: given[d] for d in set(classes.values())}


def test_substring_stage(stages):
    _, docs, found = stages[3]
    given, seen, expected = texts(docs), {}, {}
    for doc in sorted(given):
        pieces = [p for p in re.findall(r"(?s).*?(?:[.!?][ \t\v\f\r]+|\n)|.+$", given[doc]) if p]
        assert "".join(pieces) == given[doc]
        again = [bool(normal(p)) and seen.setdefault(normal(p), (doc, i)) != (doc, i) for i, p in enumerate(pieces)]
        gone, run = set(), []
        for i, p in enumerate([*pieces, "end"]):
            if i < len(pieces) and not normal(p):
                continue
            if i < len(pieces) and again[i]:
                run.append(i)
                continue
            if sum(len(normal(pieces[j]).split(" ")) for j in run) >= 25:
                gone |= set(run)
            run = []
        kept = "".join(p for i, p in enumerate(pieces) if i not in gone)
        if not gone or kept.split():
            expected[doc] = kept
    assert texts(found) == expected


def test_packing_stage(stages):
    _, docs, found = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = {}
    for p in found.orderBy("doc_id", "start").collect():
        parts.setdefault(p.doc_id, []).append(bytes(p.ids))
    given = texts(docs)
    assert set(parts) == set(given)
    for doc, text in given.items():
        expected = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(parts[doc]), "<u4").tolist() == expected


def test_run_and_empty_table(spark, sf, stages):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    rows = sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*columns).collect()))
    assert rows == sorted(map(tuple, stages[4][2].select(*columns).collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
