"""Suffix-array dedup against a plain scan of all 100-byte strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from joblattice.llm import suffix_dedup as suffix


def plain(docs):
    """docs: {id: bytes}; {id: (removed bytes, spans, kept)}."""
    seen, out = set(), {}
    for doc in sorted(docs):
        raw, gone = docs[doc], bytearray(len(docs[doc]))
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def test_given_documents(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = plain(docs)
    assert any(e[0] for e in expected.values())
    for r in suffix.op6_suffix_dedup(spark, sf).collect():
        removed, spans, kept = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(docs[r.doc_id]), removed, spans), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [512, 2])
def test_planted_passages(spark, crowd):
    rng = random.Random(crowd)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [text(n) for n in (95, 100, 101, 140, 400, 900)]
    docs = {}
    for i in range(40):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, rng.randint(0, 60)])
            parts += [p[cut:], text(rng.randint(0, 90))]
        docs[i] = "".join(parts)
    docs |= {50: "x" * 3000, 51: "xy" * 800, 52: "x" * 150, 53: text(300) * 3, 54: "", 55: "short"}
    docs[56] = text(270_000) + docs[53]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id bigint, text string, removed int")
    expected = plain({d: t.encode() for d, t in docs.items()})
    for r in suffix.dedup(df, crowd).collect():
        removed, spans, kept = expected[r.row.doc_id]
        assert (sum(s.end - s.start for s in r.removed), len(r.removed)) == (removed, spans), r.row.doc_id
        assert bytes(r.kept) == kept


def test_odd_rows(spark):
    long = "abc " * 10 + "def " * 10 + "ghi " * 10
    rows = [(None, long), (3, long), (3, long), (2, None), (2, ""), (3, long + "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.row.doc_id, r.row.text, bytes(r.kept).decode()) for r in suffix.dedup(docs).collect()]
    assert got.count((3, long, long)) == 2 or got.count((3, long, "")) == 2
    assert (None, long, "") in got and (2, None, "") in got and (2, "", "") in got
    assert suffix.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh\xff") for _ in range(rng.randint(0, 400)))
    depth = 1000
    order = suffix.suffix_array(data, depth)
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    shared = suffix.common_prefixes(data, order, depth)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        n = shared[k]
        assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


def test_rows_without_id_and_repeated_ids_are_told_apart(spark):
    """Two texts whose 32-bit hashes agree: one loses all to a copy, the other nothing."""
    rng = random.Random(4)
    texts = spark.range(300_000).selectExpr("id", "repeat(sha2(cast(id as string), 256), 3) text")
    pairs = texts.selectExpr("hash(true, text) a", "hash(false, text) b", "text")
    for name, given in (("a", None), ("b", 7)):
        one, other = pairs.groupBy(name).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first()["texts"][:2]
        rows = [(1, one), (given, one), (given, other), (given, "".join(rng.choice("abc") for _ in range(500)))]
        found = suffix.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
        lost = {(r.row.doc_id, r.row.text): r.n_bytes - len(r.kept) for r in found.collect()}
        # 64 hex digits three times over: the second and third copy of the unit repeat it
        assert lost[(given, one)] == len(one)
        assert lost[(given, other)] == lost[(1, one)] < len(other)


def test_strings_of_a_crowd_are_not_joined(spark):
    docs = spark.createDataFrame([(i, "same passage " * 9 + str(i)) for i in range(6)], "doc_id bigint, text string")
    plan = suffix.repeats(suffix._keyed(docs), crowd=1)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "sub#" in line]
