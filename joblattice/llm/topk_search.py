"""Exact top-k search by inner product in buckets of equal length (operator 13).

Vectors are grouped by length (norm). No product with a vector exceeds the product of both
lengths, so a bucket whose longest vector cannot reach a query's k-th best score is passed
over, and a bucket that can gives the query a *local cosine threshold*: the cosine a member
needs at least to matter.

1. Components become integers. Equal vectors are one row with their ``K + 1`` least ids
   (a query leaves out its own row), cut map-side, so copies cost one row.
2. The distinct vectors are sorted by length over the cluster and stored in *groups*, ranges
   of length, each small enough for a task.
3. Each distinct query vector takes the k-th best score among the ``PROBE`` longest vectors
   as its first threshold, and goes to the groups it can still reach.
4. A task holds one group, in buckets of descending length, and lets queries pass in
   batches. Per bucket and query the local threshold t decides: from ``STEEP`` on,
   *coordinate pruning*: of a unit vector with cosine t or more to the query, each coordinate
   lies within q t +- sqrt((1 - q^2)(1 - t^2)); members outside of this range in one of the
   query's largest coordinates are left out, found in sorted columns. Below, *length
   pruning*: members long enough for the threshold form a front part of the bucket.
   What is left is verified by exact products, and raises the threshold.
5. The k + 1 best of each group meet per query vector, cut map-side.

All products are exact: in single precision while no sum can pass 2**24, in double
precision up to 2**53, in 64-bit integers beyond. Pruning is strict, with a margin
for rounding, so equal scores are never lost and ties go to the smaller id.

Defined results: a null vector, one without components, with null or non-finite components or
with a squared integer length of 2**62 or more takes no part; vectors meet those with
as many components only; a row of zeros takes part; rows with a null id are candidates,
behind all ids in ties, and never queries; of repeated rows each has its result and
counts as a candidate of the others; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblattice.llm.common import ship, stored

K = 5
EVERY = 50  # rows whose id is divisible by it are the queries
SCALE = 256
PROBE = 4096  # longest vectors that give the first thresholds
GROUP_BYTES = 1 << 25  # vectors of a group, held by one task
BUCKET = 4096  # vectors of a bucket
BATCH = 256  # queries that pass at a time
STEEP = 0.9  # local cosine threshold from which coordinates prune
FOCUS = 3  # coordinates looked at
_SHORT = np.iinfo(np.int16)
_LAST, _LEAST = np.iinfo(np.int64).max, -(1 << 62)  # behind every id; below every score

DISTINCT = "dim int, len2 bigint, v binary"


def packed(components: np.ndarray) -> bytes:
    """Integer components as 16-bit numbers, or as 64-bit ones if one does not fit; the
    first byte says which, so that equal vectors have equal bytes."""
    small = components.size == 0 or (components.min() >= _SHORT.min and components.max() <= _SHORT.max)
    return b"\2" + components.astype("<i2").tobytes() if small else b"\x08" + components.astype("<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i2" if raw[0] == 2 else "<i8", offset=1)


def matrix(raws: list[bytes]) -> np.ndarray:
    """Packed vectors of one size as rows, 16-bit if all are."""
    if all(r[0] == 2 for r in raws):
        return np.frombuffer(b"".join([r[1:] for r in raws]), dtype="<i2").reshape(len(raws), -1)
    return np.stack([unpacked(r).astype(np.int64) for r in raws])


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, len2, v) of every vector that takes part; ``v`` holds floor(scale * x)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, lengths, raws = [], [], [], []
            for i, vector in enumerate(batch.column(1)):
                values = None if not vector.is_valid else vector.values
                if values is None or len(values) == 0 or values.null_count:
                    continue
                x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(x).all() or float(x @ x) >= 2.0**62:
                    continue
                c = x.astype(np.int64)
                keep.append(i)
                dims.append(len(c))
                lengths.append(int(c @ c))
                raws.append(packed(c))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(lengths, pa.int64()), pa.array(raws, pa.binary())],
                names=["vec_id", "dim", "len2", "v"],
            )

    narrow = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>"))
    return narrow.mapInArrow(rows, f"vec_id bigint, {DISTINCT}")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(dim, len2, v, ids): each vector once with its ``keep`` least ids, null ids last."""
    order = F.col("vec_id").asc_nulls_last()
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "len2", "v").orderBy(order)))
    entry = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    ids = F.sort_array(F.collect_list(entry)).getField("vec_id")
    return first.where(F.col("nth") <= keep).groupBy("dim", "len2", "v").agg(ids.alias("ids"))


def by_length(distinct: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``distinct`` in groups of neighbouring lengths, stored; ``part`` numbers them.

    A group holds about ``group_bytes`` of vectors; there are at least two for each core,
    so that small tables are dealt out too.
    """
    context = distinct.sparkSession.sparkContext
    size = distinct.agg(F.sum(F.octet_length("v") + 64)).first()[0] or 0
    groups = max(-(-size // group_bytes), 2 * context.defaultParallelism)
    # The hash parts vectors of one length, of which there may be any number.
    order = [F.col("dim"), F.col("len2").desc(), F.xxhash64("v")]
    dealt = distinct.repartitionByRange(int(groups), *order)
    return stored(dealt.withColumn("part", F.spark_partition_id()), "vectors-by-length")


class Bucket:
    """Vectors of similar length, longest first, with sorted coordinates of their unit vectors."""

    def __init__(self, m: np.ndarray, len2: np.ndarray, offset: int):
        self.m, self.offset = m, offset  # place of the first member in its group
        self.length = np.sqrt(len2.astype(np.float64))
        self._unit, self._sorted = None, {}

    def near(self, q: np.ndarray, t: float) -> np.ndarray:
        """Members that may have cosine ``t`` or more to the unit vector ``q``.

        Both lie within the angle arccos t of each other, so their angles to an axis
        differ by no more.
        """
        if self._unit is None:
            self._unit = (self.m / np.maximum(self.length, 1e-300)[:, None]).astype(np.float32)
        found = None
        for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS].tolist():
            spread = np.sqrt(max(1 - q[f] * q[f], 0.0) * max(1 - t * t, 0.0))
            high = (1.0 if q[f] >= t else q[f] * t + spread) + 1e-6
            low = (-1.0 if q[f] <= -t else q[f] * t - spread) - 1e-6
            if found is None:
                if f not in self._sorted:
                    at = np.argsort(self._unit[:, f], kind="stable")
                    self._sorted[f] = (at, self._unit[at, f])
                at, values = self._sorted[f]
                found = at[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
            else:
                x = self._unit[found, f]
                found = found[(x >= low) & (x <= high)]
        return found


class Ids:
    """The ids of a group's members, end to end; ``starts`` has one place more than members."""

    def __init__(self, lists: list[pa.Array]):
        whole = pa.concat_arrays(lists)
        flat = whole.flatten()
        self.none = flat.is_null().to_numpy(zero_copy_only=False)
        self.flat = flat.fill_null(_LAST).to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy())]).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each query of a batch, and the score to beat."""

    def __init__(self, bar: np.ndarray, k: int, ids: Ids):
        self.k, self.bar, self.ids = k, bar, ids
        self.query = self.score = self.at = self.member = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, member: np.ndarray) -> None:
        """Scores of members; each counts once for each of its ids."""
        if not len(query):
            return
        first = self.ids.starts[member]
        sizes = self.ids.starts[member + 1] - first
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        query = np.concatenate([self.query, np.repeat(query, sizes)])
        score = np.concatenate([self.score, np.repeat(score.astype(np.int64), sizes)])
        at = np.concatenate([self.at, np.repeat(first, sizes) + nth])
        member = np.concatenate([self.member, np.repeat(member, sizes)])
        order = np.lexsort((at, self.ids.none[at], self.ids.flat[at], -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        full = place == self.k - 1
        self.bar[query[full]] = np.maximum(self.bar[query[full]], score[order[full]])
        self.query, self.score, self.at, self.member = query[place < self.k], score[keep], at[keep], member[keep]


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; ``bound`` limits all of them."""
    if bound < 2.0**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(best: Best, q: np.ndarray, length: np.ndarray, bucket: Bucket, steep: float = STEEP) -> bool:
    """Raise ``best`` by the members of ``bucket``; false if no query can reach it, nor any
    shorter one."""
    top = bucket.length[0]
    reach = length * top * (1 + 1e-9) + 1e-9
    live = np.flatnonzero(reach >= best.bar)
    if not len(live):
        return False
    bound = float(length.max() * top) + 1
    local = best.bar[live] / reach[live]  # the cosine a member needs at least
    found = []
    for i, t in zip(live[local >= steep].tolist(), local[local >= steep].tolist(), strict=True):
        near = bucket.near(q[i] / length[i], t)
        score = products(q[i : i + 1], bucket.m[near], bound)[0]
        won = score >= best.bar[i]
        found.append((np.full(won.sum(), i), score[won], near[won]))
    flat = live[local < steep]
    if len(flat):
        # Members too short for every query of the batch stand at the end of the bucket.
        least = np.min(best.bar[flat] / np.maximum(length[flat], 1e-300))
        front = int(np.searchsorted(-bucket.length * (1 + 1e-9) - 1e-9, -least, "right"))
        score = products(q[flat], bucket.m[:front], bound)
        bar = best.bar[flat]
        if front > best.k:  # this bucket alone has k members of the k-th score or better
            bar = np.maximum(bar, np.partition(score, front - best.k, axis=1)[:, front - best.k])
        at, member = np.nonzero(score >= bar[:, None])
        found.append((flat[at], score[at, member], member))
    query, score, member = (np.concatenate(c) for c in zip(*found, strict=True))
    best.add(query, score, member + bucket.offset)
    return True


def thresholds(queries: DataFrame, longest: list[bytes], k: int) -> DataFrame:
    """``queries`` (dim, len2, v) with ``bar``: the k-th best product with ``longest``.

    ``longest`` are distinct vectors of one size, so the k-th best over all rows is no less;
    null where there are fewer than k of them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrix(longest)
        far = max(float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max()), 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                q = matrix(piece.column(2).to_pylist())
                score = products(q, m, far * float(np.sqrt(max(piece.column(1).to_pylist()))) + 1)
                bar = np.partition(score, len(m) - k, axis=1)[:, len(m) - k].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(bar)], names=["dim", "len2", "v", "bar"])

    if len(longest) < k:
        return queries.withColumn("bar", F.lit(None).cast("bigint"))
    return queries.select("dim", "len2", "v").mapInArrow(rows, f"{DISTINCT}, bar bigint")


def in_groups(members: DataFrame, sent: DataFrame, k: int, bucket: int = BUCKET, steep: float = STEEP) -> DataFrame:
    """(query, score, vec_id, same): the ``k`` best of every group for the queries ``sent`` to it.

    ``members``: part, len2, v, ids; ``sent``: part, len2, v, bar. Both meet by
    ``part``; a task reads a group's members first, longest first, then its queries. ``same`` marks the
    query's own vector.
    """
    none = F.lit(None)
    both = members.select("part", F.lit(0).alias("side"), "len2", "v", "ids", none.cast("bigint").alias("bar")).unionByName(
        sent.select("part", F.lit(1).alias("side"), "len2", "v", none.cast("array<bigint>").alias("ids"), "bar")
    )
    dealt = both.repartition(members.sparkSession.sparkContext.defaultParallelism * 4, "part")
    dealt = dealt.sortWithinPartitions("part", "side", F.col("len2").desc())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, buckets, ids = None, [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                kind = np.stack([piece.column(0).to_numpy(), piece.column(1).to_numpy()])
                cuts = np.flatnonzero((np.diff(kind) != 0).any(axis=0)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), piece.num_rows], strict=True):
                    run = piece.slice(a, z - a)
                    part, side = kind[:, a].tolist()
                    if part != now:
                        now, held, buckets, ids = part, [], [], None
                    if side == 0:
                        held.append(run)
                        continue
                    if held:
                        m = matrix([v for r in held for v in r.column(3).to_pylist()])
                        len2 = np.concatenate([r.column(2).to_numpy() for r in held])
                        ids = Ids([r.column(4) for r in held])
                        buckets = [Bucket(m[c : c + bucket], len2[c : c + bucket], c) for c in range(0, len(m), bucket)]
                        held = []
                    if buckets:
                        yield from answers(run, buckets, ids)

    def answers(run: pa.RecordBatch, buckets: list[Bucket], ids: Ids) -> Iterator[pa.RecordBatch]:
        raws = run.column(3).to_pylist()
        q = matrix(raws)
        length = np.sqrt(run.column(2).to_numpy().astype(np.float64))
        best = Best(run.column(5).fill_null(_LEAST).to_numpy().copy(), k, ids)
        for b in buckets:
            if not search(best, q, length, b, steep):
                break
        if len(best.query):
            same = [
                np.array_equal(q[i], buckets[c // bucket].m[c % bucket])
                for i, c in zip(best.query.tolist(), best.member.tolist(), strict=True)
            ]
            columns = [
                pa.array([raws[i] for i in best.query.tolist()], pa.binary()),
                pa.array(best.score),
                pa.array(ids.flat[best.at], mask=ids.none[best.at]),
                pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "vec_id", "same"])

    return dealt.mapInArrow(rows, "query binary, score bigint, vec_id bigint, same boolean")


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    group_bytes: int = GROUP_BYTES,
    probe: int = PROBE,
    bucket: int = BUCKET,
    steep: float = STEEP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every query row.

    ``vectors``: vec_id, embedding. The list of a query vector holds ``k + 1`` rows, as its
    own row may be one of them.
    """
    spark = vectors.sparkSession
    rows = stored(integers(vectors, scale), "integer-vectors")
    members = by_length(distinct_vectors(rows, k + 1), group_bytes)
    asked = rows.where(F.col("vec_id") % every == 0)
    distinct = stored(asked.select("dim", "len2", "v").distinct(), "query-vectors")

    # One row per group and size of vectors.
    limits = members.groupBy("dim", "part").agg(F.max("len2").alias("longest")).collect()
    found = []
    for dim in sorted({r.dim for r in limits}):
        longest = members.where(F.col("dim") == dim).orderBy(F.col("len2").desc(), "v").limit(probe)
        first = [r.v for r in longest.select("v").collect()]
        known = stored(thresholds(distinct.where(F.col("dim") == dim), first, k + 1), "query-thresholds")
        groups = spark.createDataFrame([(r.part, r.longest) for r in limits if r.dim == dim], "part int, longest bigint")
        # Groups are in descending length: a query is sent to the first ones, up to the
        # last whose longest member can reach its threshold.
        mine = sorted((r.part, r.longest) for r in limits if r.dim == dim)
        parts, longest2 = F.lit([p for p, _ in mine]), F.lit([n for _, n in mine])
        length = F.sqrt(F.col("len2").cast("double"))
        reached = F.filter(longest2, lambda n: F.sqrt(n.cast("double")) * length * (1 + 1e-9) + 1e-9 >= F.coalesce("bar", F.lit(_LEAST)))
        sent = known.select(F.explode(F.slice(parts, 1, F.size(reached))).alias("part"), "len2", "v", "bar")
        found.append(in_groups(members.where(F.col("dim") == dim), sent, k + 1, bucket, steep))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    every_group = found[0]
    for more in found[1:]:
        every_group = every_group.unionByName(more)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("same")]
    nth = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best = every_group.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id", "same"))).alias("best"))
    mine = F.transform("best", lambda b: b["same"] & b["vec_id"].eqNullSafe(F.col("vec_id")))
    own = F.coalesce(F.array_position(mine, True), F.lit(0))
    others = F.filter("best", lambda b, i: i + 1 != own)
    return (
        asked.join(lists, F.col("query") == F.col("v"))
        .select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    )


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH taken AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM taken q JOIN taken c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS nth FROM scored)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM best WHERE nth <= {K}
"""

ship(__name__)
