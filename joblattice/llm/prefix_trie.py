"""Prefix trie of conversations in balanced parentheses (operator 11).

A trie over turn sequences shows what a model would read again and again: a node is a
distinct sequence of first turns, and its text is saved once for every conversation that
shares it beyond the first.

1. A turn becomes a digest and a text length before anything is grouped; a conversation
   is one row of its turns' digests (16 bytes a turn; no text travels on).
2. Conversations of one sequence become one row with their number, least id and the hash of
   their ids. Ids are joined in ranges of 2**8, then 2**16, and the last step runs over
   these pieces in order, so that no task holds a hot sequence's ids.
3. Sequences are sorted over the cluster. Neighbours share prefixes, and a *shard* of up
   to ``SHARD`` turns writes its part of the trie as balanced parentheses. Over their
   excess (opened less closed) blocks keep the least value, in a tree over the blocks:
   ``find_close`` delimits a node's subtree. The rank of "()" pairs before both ends counts
   its leaves, and cumulative arrays over the nodes in order of opening give its
   conversations and savings.
4. A node whose subtree spans shards lies on the last path of one and on the first path of
   the next. These *spines* are merged: numbers are added up by node, and what the common
   part of two neighbouring spines has counted twice is taken off: the child that is shared, a
   leaf that goes on in the next shard, and one occurrence of every shared text.

Memory is bounded by a shard and by the longest conversation (16 bytes a turn).

Defined results: turns without conv_id belong to no conversation; a null turn comes first, turns of
one number stand in the order of their digests; null role or text is empty; texts and roles of any
length are read whole; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import broadcast_if_small, ship, stored

SHARE = 5  # conversations c - c % SHARE lend their first turns
HEADS = 9  # up to HEADS - 1 of them
DIGEST = 16  # bytes
SHARD = 1 << 17  # turns of a shard
BLOCK = 256  # parentheses of an excess block
ROOT = bytes(DIGEST)
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "key binary, parent binary, depth bigint, bytes bigint, n bigint, first bigint, children bigint, leaves bigint, saved bigint, ends string"


class Parentheses:
    """A balanced sequence with excess blocks and the range minimum tree over them."""

    def __init__(self, opens: np.ndarray, block: int = BLOCK):
        self.opens, self.block = opens, block
        self.excess = np.cumsum(np.where(opens, 1, -1))
        n = -(-len(opens) // block)
        padded = np.full(n * block, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(n, block)
        # Level 0 holds the least excess of each block, the next ones that of pairs below.
        self.least = [self.blocks.min(axis=1)]
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int64).max)
                self.least[-1] = below
            self.least.append(np.minimum(below[::2], below[1::2]))
        self.rank_open = np.cumsum(opens)
        leaf = np.append(opens[:-1] & ~opens[1:], False)
        self.rank_leaf = np.concatenate([[0], np.cumsum(leaf)])

    def _in_block(self, block: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place of a block, behind ``after``, whose excess is under ``below``; -1 if none."""
        out = np.full(len(block), -1)
        for at in range(0, len(block), 4096):
            part = slice(at, at + 4096)
            hit = (self.blocks[block[part]] < below[part, None]) & (np.arange(self.block) > after[part, None])
            out[part] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        return out

    def find_close(self, i: np.ndarray) -> np.ndarray:
        """The place that closes each opening place: the first behind it with a smaller excess."""
        below = self.excess[i]
        block = i // self.block
        place = self._in_block(block, i % self.block, below)
        out = block * self.block + place
        left = np.flatnonzero(place < 0)
        # Up the tree while neither the right brother nor anything under it is small enough ...
        node, want = block[left].copy(), below[left]
        level = np.zeros(len(left), dtype=np.int64)
        climbing = np.ones(len(left), dtype=bool)
        for height, least in enumerate(self.least):
            at = np.flatnonzero(climbing)
            brother = node[at] + 1
            right = (node[at] % 2 == 0) & (brother < len(least))
            found = right & (least[np.minimum(brother, len(least) - 1)] < want[at])
            node[at[found]] += 1
            level[at[found]] = height
            climbing[at[found]] = False
            node[at[~found]] //= 2
        # ... then down to the first block that is.
        for height in range(len(self.least) - 1, 0, -1):
            at = np.flatnonzero(level == height)
            child = node[at] * 2
            node[at] = np.where(self.least[height - 1][child] < want[at], child, child + 1)
            level[at] -= 1
        out[left] = node * self.block + self._in_block(node, np.full(len(left), -1), want)
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node, in order of opening: nodes and leaves of its subtree."""
        at = np.flatnonzero(self.opens)
        end = self.find_close(at)
        return (end - at + 1) // 2, self.rank_leaf[end] - self.rank_leaf[at]


class Shard:
    """The trie of sorted sequences, filled path by path."""

    def __init__(self):
        self.opens: list[bool] = []
        self.key, self.parent, self.depth, self.bytes = [], [], [], []
        self.members, self.first, self.ends = [], [], []
        self.path: list[int] = []  # open nodes from the root
        self.last = b""
        self._open(-1, ROOT, 0)
        self.first_path: list[int] = []

    def _open(self, parent: int, key: bytes, size: int) -> None:
        self.path.append(len(self.key))
        self.opens.append(True)
        self.key.append(key)
        self.parent.append(parent)
        self.depth.append(len(self.path) - 1)
        self.bytes.append(size)
        self.members.append(0)
        self.first.append(_LAST)
        self.ends.append(None)

    def add(self, path: bytes, sizes: list[int], n: int, first: int, ends: str) -> None:
        """A sequence greater than all before, as its turns' digests end to end."""
        shared, most = 0, min(len(path), len(self.last)) // DIGEST
        while shared < most and path[shared * DIGEST : (shared + 1) * DIGEST] == self.last[shared * DIGEST : (shared + 1) * DIGEST]:
            shared += 1
        self.opens += [False] * (len(self.path) - 1 - shared)
        del self.path[shared + 1 :]
        for d in range(shared, len(sizes)):
            above = self.path[-1]
            turn = path[d * DIGEST : (d + 1) * DIGEST]
            self._open(above, hashlib.blake2b(self.key[above] + turn, digest_size=DIGEST).digest(), sizes[d])
        node = self.path[-1]
        self.members[node], self.first[node], self.ends[node] = n, first, ends
        self.last = path
        if not self.first_path:
            self.first_path = list(self.path)

    def rows(self, part: int, number: int) -> Iterator[pa.RecordBatch]:
        """A row per node. ``spine``: 1 on the first path, 2 on the last, 3 on both; ``above``:
        the parent's least member, null if the parent is on a spine."""
        count = len(self.key)
        tree = Parentheses(np.array(self.opens + [False] * len(self.path), dtype=bool))
        nodes, leaves = tree.subtrees()
        begin = np.arange(count)
        end = begin + nodes
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        members = total(np.array(self.members))
        n = members[end] - members[begin]
        sizes = np.array(self.bytes)
        saved = total((n - 1) * sizes)
        parent = np.array(self.parent)
        least = list(self.first)
        for i in range(count - 1, 0, -1):  # children open behind their parents
            p = self.parent[i]
            if least[i] < least[p]:
                least[p] = least[i]
        spine = np.zeros(count, dtype=np.int32)
        spine[self.first_path] |= 1
        spine[self.path] |= 2
        least = np.array(least)
        above = np.where(parent >= 0, spine[parent] > 0, True)
        keys = self.key
        columns = {
            "part": pa.array(np.full(count, part, np.int32)),
            "shard": pa.array(np.full(count, number, np.int32)),
            "spine": pa.array(spine),
            "above": pa.array(least[parent], mask=above),
            "key": pa.array(keys, pa.binary()),
            "parent": pa.array([keys[p] if p >= 0 else None for p in self.parent], pa.binary()),
            "depth": pa.array(self.depth, pa.int64()),
            "bytes": pa.array(sizes),
            "n": pa.array(n),
            "first": pa.array(least),
            "children": pa.array(np.bincount(parent[1:], minlength=count)),
            "leaves": pa.array(leaves),
            "saved": pa.array(saved[end] - saved[begin]),
            "ends": pa.array(self.ends, pa.string()),
        }
        whole = pa.RecordBatch.from_pydict(columns)
        for at in range(0, count, 8192):
            yield whole.slice(at, 8192)


_LAST = np.iinfo(np.int64).max


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it shares with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the original turns in order, each a struct of digest ``dg`` and text
    bytes ``nb``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.substring(F.unhex(F.sha2(marked, 256)), 1, DIGEST).alias("dg"),
            F.octet_length(text).cast("bigint").alias("nb"),
        ).alias("t"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["dg"].alias("dg"), t["nb"].alias("nb")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(originals: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation with the lent turns in front."""
    own = originals.withColumns({"h": heads(F.col("conv_id")), "lender": F.col("conv_id") - F.col("conv_id") % SHARE})
    lent = originals.where(F.col("conv_id") % SHARE == 0).select(
        F.col("conv_id").alias("lender"), F.slice("turns", 1, HEADS - 1).alias("lent")
    )
    none = F.array().cast(originals.schema["turns"].dataType)
    turns = F.concat(
        F.slice(F.coalesce("lent", none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
    )
    joined = own.join(lent, "lender", "left").select("conv_id", turns.alias("turns"))
    # Digests have one size, so joined digests sort as the sequences do.
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["dg"])), ""))
    return joined.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["nb"]).alias("sizes"))


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(path, sizes, n, first, ends): each sequence with its members' number, least id and the
    hash of their ids in ascending order."""
    name = F.sha2("path", 256)
    digits = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    payload = [F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes")]
    small = (
        rows.groupBy(name.alias("s"), F.shiftright("conv_id", 8).alias("r"))
        .agg(F.array_join(digits, ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"), *payload)
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("r", "ids"))), lambda p: p["ids"])
    pieces = small.groupBy("s", F.shiftright("r", 8).alias("range")).agg(
        F.array_join(pieces, ",").alias("ids"), F.sum("n").alias("n"), F.min("first").alias("first"), *payload
    )
    sorted_ = pieces.select("s", "range", "ids", "n", "first", "path", "sizes").repartition("s").sortWithinPartitions("s", "range")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sizes", "n", "first", "ends"]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        now, digest, held, done = None, None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["s"] != now:
                    if held:
                        done.append((*held, digest.hexdigest()))
                    if len(done) >= 4096:
                        yield out()
                        done = []
                    now, digest, held = row["s"], hashlib.sha256(row["ids"].encode()), [row["path"], row["sizes"], row["n"], row["first"]]
                else:
                    digest.update(b"," + row["ids"].encode())
                    held[2] += row["n"]
                    held[3] = min(held[3], row["first"])
        if held:
            done.append((*held, digest.hexdigest()))
            yield out()

    return sorted_.mapInArrow(whole, "path binary, sizes array<bigint>, n bigint, first bigint, ends string")


def shards(distinct: DataFrame, most: int = SHARD) -> DataFrame:
    """The nodes of every shard of the sorted sequences, numbered by ``part`` and ``shard``."""
    dealt = distinct.repartitionByRange("path").sortWithinPartitions("path")
    numbered = dealt.select("*", F.spark_partition_id().alias("part"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, part = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for path, sizes, n, first, ends, part in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if shard is not None and len(shard.key) + len(sizes) > most:
                        yield from shard.rows(part, number)
                        shard, number = None, number + 1
                    if shard is None:
                        shard = Shard()
                    shard.add(path, sizes, n, first, ends)
        if shard is not None:
            yield from shard.rows(part, number)

    return numbered.mapInArrow(rows, f"part int, shard int, spine int, above bigint, {_NODE}")


def _corrections(spines: DataFrame) -> DataFrame:
    """What the common part of neighbouring spines has counted twice, by node."""
    spark = spines.sparkSession
    # One row per part with the shards it has; shards follow each other over the parts.
    before, offsets = 0, []
    counted = spines.where(F.col("depth") == 0).groupBy("part").agg(F.count("*").alias("n"))
    for p, n in sorted(counted.collect()):
        offsets.append((p, before))
        before += n
    first = spark.createDataFrame(offsets, "part int, before bigint")
    at = spines.join(F.broadcast(first), "part").withColumn("edge", F.col("before") + F.col("shard"))
    left = at.where(F.col("spine").bitwiseAND(2) > 0).select("edge", "depth", "key", "bytes", (F.col("children") == 0).alias("tip"))
    right = at.where(F.col("spine").bitwiseAND(1) > 0).select((F.col("edge") - 1).alias("edge"), "depth", "key")
    shared = left.join(right, ["edge", "depth", "key"])
    # A spine is as long as a conversation: the shared part of an edge is one row.
    edges = shared.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "bytes", "tip"))).alias("path"))
    edges = edges.withColumn("goes_on", F.element_at("path", -1)["tip"].cast("bigint"))
    total = F.aggregate("path", F.lit(0).cast("bigint"), lambda s, p: s + p["bytes"])
    # Texts from a node on: the total less those before it.
    running = F.aggregate(
        "path",
        F.struct(F.array().cast("array<bigint>").alias("sums"), total.alias("rest")),
        lambda s, p: F.struct(F.array_append(s["sums"], s["rest"]).alias("sums"), (s["rest"] - p["bytes"]).alias("rest")),
    )["sums"]
    each = edges.select("goes_on", F.size("path").alias("size"), F.posexplode(F.arrays_zip("path", running.alias("sums"))).alias("i", "x"))
    zero, null = F.lit(0).cast("bigint"), F.lit(None)
    return each.select(
        F.col("x.path.key").alias("key"),
        null.cast("binary").alias("parent"),
        F.col("x.path.depth").alias("depth"),
        F.col("x.path.bytes").alias("bytes"),
        zero.alias("n"),
        null.cast("bigint").alias("first"),
        (-(F.col("i") < F.col("size") - 1).cast("bigint")).alias("children"),
        (-F.col("goes_on")).alias("leaves"),
        F.col("x.sums").alias("saved"),
        null.cast("string").alias("ends"),
    )


def merged(spines: DataFrame) -> DataFrame:
    """The nodes on spines, each once, with the numbers of the whole trie."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    every = spines.select(*names).unionByName(_corrections(spines))
    return every.groupBy("key").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.max("bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.min("first").alias("first"),
        F.max("ends").alias("ends"),
    )


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, the node's ``key`` and its
    ``parent``'s."""
    # Both the lenders and the borrowers read it.
    originals = stored(sequences(conversations), "turn-sequences")
    distinct = stored(distinct_sequences(rebuilt(originals)), "distinct-sequences")
    nodes = stored(shards(distinct, shard), "trie-shards")
    joint = stored(merged(nodes.where("spine > 0")), "trie-spines")
    first = broadcast_if_small(joint.select(F.col("key").alias("_key"), F.col("first").alias("_first")))
    names = joint.columns
    inner = nodes.where("spine = 0")
    alone = inner.where("above IS NOT NULL").select(*names, "above")
    hung = inner.where("above IS NULL").select(*names).unionByName(joint)
    hung = hung.join(first, F.col("parent") == F.col("_key"), "left").select(*names, F.col("_first").alias("above"))
    return alone.unionByName(hung).select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        "key",
        "parent",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key", "parent")


def _crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)"
    bits = f"list_reduce(range(8), lambda r, i: {step}, xor(c, b))"
    codes = f"list_transform(range(length({text})), lambda i: CAST(ascii(substr({text}, i + 1, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
marked AS (
  SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS d, octet_length(encode(text)) AS b FROM turns),
convs AS (
  SELECT conv_id, list(d || ' ' || b ORDER BY turn NULLS FIRST, d) AS turns,
    {_crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h
  FROM marked GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(l.turns[1 : c.h], []), c.turns[c.h + 1 :]) AS turns
  FROM convs c LEFT JOIN convs l ON l.conv_id = c.conv_id - c.conv_id % {SHARE}),
prefixes AS (
  SELECT conv_id, d, len(turns) AS size, sha256(array_to_string(turns[1 : d], ',')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(turns[1 : d - 1], ',')) END AS parent,
    CASE WHEN d > 0 THEN CAST(string_split(turns[d], ' ')[2] AS BIGINT) ELSE 0 END AS b
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(b) AS b, count(*) AS n, min(conv_id) AS first,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends
  FROM prefixes GROUP BY node),
children AS (SELECT parent AS node, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT DISTINCT a.node AS top, p.node FROM prefixes p JOIN prefixes a ON a.conv_id = p.conv_id AND a.d <= p.d),
sums AS (
  SELECT top AS node, sum((n - 1) * b) AS saved, count(*) FILTER (WHERE children IS NULL) AS leaves
  FROM below JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top)
SELECT x.first AS conv_id, CAST(x.d AS BIGINT) AS depth, p.first AS parent_conv_id, x.n AS n_convs,
  coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = x.parent
"""

ship(__name__)
