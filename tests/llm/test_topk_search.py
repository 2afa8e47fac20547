"""Exact top-k search against all products."""

import math
import random

import numpy as np
import pytest

from joblattice.llm import topk_search as topk


def usable(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    c = [math.floor(256 * x) for x in v]
    return c if sum(x * x for x in c) < 2**62 else None


def plain(rows, k=5, every=50):
    """rows: (id, vector); sorted (query_id, rank, vec_id, score)."""
    taken = [(i, c) for i, v in rows if (c := usable(v)) is not None]
    out = []
    for n, (q, a) in enumerate(taken):
        if q is None or q % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), c is None, c or 0) for m, (c, b) in enumerate(taken) if m != n and len(a) == len(b)]
        for rank, (score, none, c) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if none else c, -score))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in df.collect())


def test_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = plain(rows)
    assert len(expected) == 50
    assert found(topk.op13_topk_search(spark, sf)) == expected


def near(rng, v, by):
    return [x + rng.gauss(0, by) for x in v]


@pytest.mark.parametrize("settings", [{}, {"steep": 0.2}, {"steep": 2.0, "bucket": 7}, {"group_bytes": 600, "probe": 3, "bucket": 5}])
def test_lengths_copies_and_clusters(spark, settings):
    """Lengths of several orders, clusters of near copies, and a vector many rows hold."""
    rng = random.Random(1)
    rows = []
    for c in range(8):
        centre = [rng.gauss(0, 1) * 10 ** rng.uniform(-1, 1) for _ in range(6)]
        rows += [near(rng, centre, 0.01) for _ in range(20)] + [[rng.gauss(0, 1) for _ in range(6)] for _ in range(15)]
    common = rows[3]
    rows = [(i, v) for i, v in enumerate(rows)] + [(i, common) for i in range(400, 460)]
    rows += [(500 + i, [0.0] * 6) for i in range(4)] + [(600, [-x for x in common])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(topk.top_k(df, every=5, **settings)) == plain(rows, every=5)


def test_odd_rows(spark):
    big = float(2**22)
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (None, [1.0, 2.0]), (None, [3.0, 3.0]), (50, None), (50, []),
        (50, [None, 1.0]), (50, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (-50, [-1.0, -2.0]), (150, [1.0, 2.0, 3.0]),
        (151, [0.001, -0.001, 1e-9]), (200, [1.5]), (250, [big, big]), (251, [big, -big]), (300, [1e30, 1.0]), (3, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, 7, 9) for r in rows], "vec_id bigint, embedding array<double>, score int, v int")
    assert found(topk.top_k(df)) == plain(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert topk.top_k(none).count() == 0


def test_long_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (50, 1 << 20, 1 << 29):
        a, b = rng.integers(-most, most, (9, 6)), rng.integers(-most, most, (11, 6))
        bound = float(np.sqrt((a.astype(float) ** 2).sum(1)).max() * np.sqrt((b.astype(float) ** 2).sum(1)).max()) + 1
        expected = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert topk.products(a, b, bound).astype(np.int64).tolist() == expected


def test_coordinates_keep_every_vector_within_the_angle():
    rng = np.random.default_rng(3)
    m = rng.integers(-300, 300, (400, 5))
    m[:200] = m[0] + rng.integers(-20, 20, (200, 5))
    len2 = (m * m).sum(1)
    bucket = topk.Bucket(m, len2, 0)
    unit = m / np.sqrt(len2)[:, None]
    for q in unit[:250]:
        for t in (0.3, 0.9, 0.999, 1.0):
            kept = bucket.near(q, t)
            assert set(np.flatnonzero(unit @ q >= t)) <= set(kept.tolist())
    assert len(bucket.near(unit[0], 0.99)) < 250
