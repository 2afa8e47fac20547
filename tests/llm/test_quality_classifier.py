"""Quality classifier: held-out accuracy, site posteriors, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblattice.llm import quality_classifier as classifier


def test_held_out_labels(spark):
    # The smaller tables have too few junk documents to fit on some and test on others.
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit_on = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2000)
    found = classifier.classify(docs, fit_on).select("row.doc_id", "kept")
    rest = labels.join(fit_on, "doc_id", "left_anti").join(found, "doc_id").collect()
    clean = [r.kept for r in rest if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in rest if r.quality == 0]
    assert len(clean) > 1000 and np.mean(clean) > 0.99
    assert len(junk) > 200 and np.mean(junk) < 0.1


def test_sparse_sites_stay_near_their_parents(spark):
    rows = [("a", "x", 1.0)] * 900 + [("a", "y", 0.9)] * 5 + [("b", "x", 0.0)] * 900 + [("c", "x", 0.0)] + [(None, None, 1.0)]
    df = spark.createDataFrame(rows, "host string, path string, good double")
    sites, overall = classifier.site_posteriors(df)
    got = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in sites.collect()}
    assert overall == pytest.approx(sum(r[2] for r in rows) / len(rows))
    assert got["a", "x"][1] > 0.95 and got["b", "x"][1] < 0.05
    assert 0.1 < got["c", "x"][1] < overall
    assert len(got) == 5 and got[None, None][1] > overall


def test_newton_fit_is_stationary():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] - 0.5)))).astype(int)
    w = classifier.fitted(x, y, ridge=0.5)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-4
    assert abs((p - y).sum()) < 1e-4


def test_odd_rows(spark):
    rows = [(1, "fine words here", "s", "en"), (None, None, None, None), (2, "", "s", None), (2, "", "s", None), (3, "w " * 60_000, "t", "en")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id bigint, text string, source string, lang string, p_good int, kept int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = classifier.classify(docs, labels).collect()
    assert len(found) == 5 and {r.row.p_good for r in found} == {7}
    assert all(0 <= r.p_good <= 1 for r in found)
    assert classifier.classify(docs.limit(0), labels).count() == 0
    assert classifier.classify(docs, labels.limit(0)).count() == 5
