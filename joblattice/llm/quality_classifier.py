"""Quality classifier with hierarchical empirical Bayes (operator 10).

Evidence of a document: two logistic models, of junk (quality 0) and of toxic text, on
shares of odd characters, upper-case words, repeats and the like, and on the presence of
the words that tell the classes apart best. They are fitted on at most ``SAMPLE``
labelled documents, those with the least id hashes; the words are counted by Spark,
and the driver gets at most ``SAMPLE`` short vectors.

A document's host is its ``source``, its path the ``lang`` below it. One grouped
aggregation over all documents sums the evidence by path, and sums those by host. A
host's posterior is its mean shrunk toward the global mean, a path's posterior is its
mean shrunk toward its host's; the strengths come from the spread of the means between
groups (method of moments), so sparse sites stay near their parents. The posterior
shifts the log-odds of each of its documents, by at most ``MOST_SHIFT``, so that no
site condemns a clean document by itself.

Texts are read twice, once for the sums and once to judge; neither pass keeps more than
a batch in a task, and only sums by path are shuffled. Sites are joined on their own
keys, which Spark may split where one site holds much of the table.

Defined results: a null or empty text has neither words nor evidence against it beyond
the models' constants; null source or lang is a site of its own; repeated rows are
judged alike; without labels of both kinds a model gives its base rate; an empty
table gives no row; all columns of the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import broadcast_if_small, documents, ship, stored

SAMPLE = 12_000  # labelled documents the models are fitted on
WORDS = 128  # telling words for each of the two models
MIN_WORD_DOCS = 5
RIDGE = 0.1
MOST_SHIFT = 1.0
THRESHOLD = 0.5  # a document stays if it is good with this probability or more
HEADS = ("junk", "toxic")

_SIGNS = "*$%&#|!<>{}=_~^"
_EDGES = ".,;:!?\"'()[]*$%&#|<>{}=_~^"


def measured(text: str | None) -> tuple[list[float], set[str]]:
    """(shares of a text, its distinct words without signs at the edges)."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(len(text), 1)
    shares = [
        *(min(1.0, text.count(c) / n) for c in _SIGNS),
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(str.isdigit, text)) / chars if any(map(str.isdigit, set(text))) else 0.0,
        min(1.0, chars / n / 20),
        1.0 if len(words) < 5 else 0.0,
    ]
    return shares, {w.strip(_EDGES).lower() for w in set(words)}


N_SHARES = len(measured("")[0])


def vector(text: str | None, columns: dict[str, int]) -> np.ndarray:
    shares, words = measured(text)
    out = np.zeros(N_SHARES + len(columns), dtype=np.float32)
    out[:N_SHARES] = shares
    for w in words & columns.keys():
        out[N_SHARES + columns[w]] = 1.0
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge logistic weights, the constant last, by Newton steps."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return weights
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        curve = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def telling_words(sample: DataFrame, most: int = WORDS) -> list[str]:
    """Words whose presence is tied most to junk or to toxic text (likelihood ratio)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, junk, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = sorted(measured(text)[1] - {""})
                m = len(words)
                arrays = [pa.array(words, pa.string()), pa.array([junk] * m, pa.int32()), pa.array([toxic] * m, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", *HEADS])

    seen = sample.select("text", *HEADS).mapInArrow(rows, "word string, junk int, toxic int")
    docs, *totals = sample.agg(F.count("*"), *[F.coalesce(F.sum(h), F.lit(0)) for h in HEADS]).first()
    counts = (
        seen.groupBy("word")
        .agg(F.count("*").cast("double").alias("n"), *[F.sum(h).cast("double").alias(h) for h in HEADS])
        .where(F.col("n") >= MIN_WORD_DOCS)
    )

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    best = []
    for head, total in zip(HEADS, totals, strict=True):
        if not 0 < total < docs:
            continue
        rate, hit, n = total / docs, F.col(head), F.col("n")
        ratio = part(hit, n * rate) + part(n - hit, n * (1 - rate))
        best += counts.orderBy(ratio.desc(), "word").limit(most).select("word").collect()
    return sorted({r.word for r in best})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(telling words, weights of the two models as rows)."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .select(
            F.col("doc_id").alias("_id"),
            (F.col("quality") == 0).cast("int").alias("junk"),
            F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"),
        )
        .groupBy("_id")
        .agg(*[F.max(h).alias(h) for h in HEADS])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # At most ``sample`` short rows: small enough to broadcast at any size of the input. Of
    # rows with one id the text of the least hash counts, chosen within each task first.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", *HEADS).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", *HEADS)
    rows = stored(rows, "labelled-sample")
    words = telling_words(rows)
    columns = {w: i for i, w in enumerate(words)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t.as_py(), columns).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], names=["x", *HEADS])

    table = rows.mapInArrow(vectors, "x binary, junk int, toxic int").toArrow()
    width = N_SHARES + len(words)
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float32).reshape(-1, width)
    return words, np.stack([fitted(x, table.column(h).to_numpy()) for h in HEADS])


def evidence(docs: DataFrame, words: list[str], weights: np.ndarray) -> DataFrame:
    """``row`` (all columns of the input), ``p_junk`` and ``p_toxic``."""
    columns = {w: i for i, w in enumerate(words)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.stack([vector(t.as_py(), columns) for t in part.column(1)])
                odds = np.clip(x @ weights[:, :-1].T + weights[:, -1], -30, 30)
                p = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(p[:, i], pa.float64()) for i in range(2))],
                    names=["row", "p_junk", "p_toxic"],
                )

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"), F.col("text").cast("string").alias("_text"))
    schema = given.select("row", F.lit(0.0).alias("p_junk"), F.lit(0.0).alias("p_toxic")).schema
    return given.mapInArrow(rows, schema)


def _strength(groups: DataFrame, mean: str, parent: str) -> float:
    """Pseudo-documents of the prior: p(1 - p) over the spread of group means, less one."""
    n, m, p = F.col("n"), F.col(mean), F.col(parent)
    row = groups.agg(
        F.sum(n * p * (1 - p)) / F.sum(n),
        F.sum(n * (m - p) * (m - p)) / F.sum(n),
        F.sum(p * (1 - p)) / F.sum(n),
    ).first()
    if row[0] is None or row[0] <= 0:
        return 1.0
    between = max(row[1] - row[2], 1e-6)
    return float(min(max(row[0] / between - 1, 1.0), 1e6))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(posterior by path, with ``host`` and ``path``; the global mean)."""
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("s"))
    paths = stored(paths, "site-evidence")
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    overall = 0.5 if total is None else float(total)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = hosts.select("host", "n", (F.col("s") / F.col("n")).alias("mean"), F.lit(overall).alias("parent"))
    k = _strength(hosts, "mean", "parent")
    shrunk = hosts.select(
        F.col("host").alias("_host"),
        ((F.col("n") * F.col("mean") + k * overall) / (F.col("n") + k)).alias("host_posterior"),
    )
    below = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    below = below.withColumn("mean", F.col("s") / F.col("n"))
    k = _strength(below, "mean", "host_posterior")
    posterior = (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)
    return below.select("host", "path", "host_posterior", posterior.alias("path_posterior")), overall


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row``, ``p_junk``, ``p_toxic``, site posteriors, ``p_good`` and ``kept``."""
    words, weights = fit(docs, labels, sample)
    good = (1 - F.col("p_junk")) * (1 - F.col("p_toxic"))
    site = [F.col("row.source").cast("string").alias("host"), F.col("row.lang").cast("string").alias("path")]
    lean = evidence(docs.select("source", "lang", "text"), words, weights)
    sites, overall = site_posteriors(lean.select(*site, good.alias("good")))
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_posterior", "path_posterior")
    # A row per path: broadcast where they are few, so that no text is shuffled.
    sites = broadcast_if_small(stored(sites, "site-posteriors"), 100_000)
    rows = evidence(docs, words, weights).select("*", *site)
    shift = _logit(F.col("path_posterior")) - F.lit(float(np.log(max(overall, 1e-9) / max(1 - overall, 1e-9))))
    shift = F.greatest(F.least(shift, F.lit(MOST_SHIFT)), F.lit(-MOST_SHIFT))
    both = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    p_good = 1 / (1 + F.exp(-(_logit(good) + shift)))
    return (
        rows.join(sites, both)
        .select("row", "p_junk", "p_toxic", "host_posterior", "path_posterior", p_good.alias("p_good"))
        .withColumn("kept", F.col("p_good") >= THRESHOLD)
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "p_junk", "p_toxic", "host_posterior", "path_posterior", "p_good", "kept"
    )


ship(__name__)
