"""SimHash links of the pipeline's near-duplicate stage against all pairs of fingerprints."""

import xxhash

from joblattice.llm import near_copies, simhash
from tests.llm.test_near_copies import made, plain_set
from tests.llm.test_simhash import plain_components


def plain_fingerprint(text):
    hashes = {xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in plain_set(text)}
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_sets_are_linked_by_fingerprint(spark):
    texts = {**made(1), 900: "a b c d e f g", 901: "A b c d e f g", 902: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    known = near_copies.sets(docs).cache()
    rows = known.collect()
    assert {r.id: r.fp % (1 << 64) for r in rows} == {d: plain_fingerprint(t) for d, t in texts.items()}
    expected = plain_components([(r.s, r.fp % (1 << 64)) for r in sorted(rows, key=lambda r: r.s)])
    for crowd in (64, 2):
        pairs = near_copies.fingerprint_pairs(known, crowd)
        assert pairs.where("a <= b").isEmpty()
        found = {r.node: r.root for r in simhash.components(pairs).collect()}
        assert {s: found.get(s, s) for s in expected} == expected
        assert 0 < len(set(expected.values())) < len(expected)


def test_the_stage_verifies_what_simhash_links(spark, monkeypatch):
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(a) or links(*a))
    docs = spark.createDataFrame(list(made(2).items()), "doc_id bigint, text string")
    assert near_copies.representatives(docs).count() > 0 and len(asked) == 1
