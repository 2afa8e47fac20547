"""Prefix trie of conversations against a plain trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from joblattice.llm import prefix_trie


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    """rows: (conv_id, turn, role, text); the eight columns of every node, sorted."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, turn_digest(role, text), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(turns.get(lender, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            top = node[:d]
            leaves[top] = leaves.get(top, 0) + (node not in children)
            saved[top] = saved.get(top, 0) + (len(cs) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(cs), len(node), parent, len(cs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def found(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(prefix_trie.op11_prefix_trie(spark, sf)) == plain(rows)


def some(rng, n, words):
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("shard", [1, 3, 10, 1 << 17])
def test_spines_over_many_shards(spark, shard):
    """Few words make deep shared prefixes; small shards cut them everywhere."""
    rng = random.Random(shard)
    rows = some(rng, 150, ["a", "bé", ""])
    rows += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie.trie(df, shard)) == plain(rows)


def test_spines_over_many_parts(spark):
    """Every sequence in a part of its own, and empty parts between."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = some(random.Random(5), 12, ["x", "y"])
        assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), 4)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", "x" * 300_000), (0, 1, "user", "x" * 300_000),
        (0, 1, "assistant", "tie"), (1, 5, "", "a"), (1, 5, "a", ""), (2, -3, "user", "ü" * 50), (-7, 0, "user", "n"),
        (-5, 0, "user", "n"), (-5, 1, None, "m"), (77, 0, "user", "alone"), (3, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, 5, b"k") for r in rows], f"{SCHEMA}, depth int, key binary")
    assert found(prefix_trie.trie(df)) == plain(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.trie(only_null).count() == 0


def test_ids_far_apart_are_hashed_in_order(spark):
    rng = random.Random(9)
    ids = [-(2**40), -300, -256, -1, 3, 255, 256, 65_535, 65_536, 2**33, 2**62]
    rows = [(c, t, "user", "t") for c in ids + rng.sample(range(10**6), 200) for t in range(12)]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)


@pytest.mark.parametrize("block", [4, 8, 256])
def test_find_close(block):
    rng = random.Random(block)
    for n in (1, 2, 7, 60, 700):
        opens, stack, expected, depth = [], [], {}, 0
        left = n
        while left or depth:
            if left and (not depth or rng.random() < rng.choice([0.5, 0.8])):
                stack.append(len(opens))
                opens.append(True)
                depth, left = depth + 1, left - 1
            else:
                expected[stack.pop()] = len(opens)
                opens.append(False)
                depth -= 1
        tree = prefix_trie.Parentheses(np.array(opens), block)
        at = np.array(sorted(expected))
        assert tree.find_close(at).tolist() == [expected[i] for i in at.tolist()]
        nodes, leaves = tree.subtrees()
        for i, a, b in zip(at.tolist(), nodes.tolist(), leaves.tolist()):
            inside = opens[i : expected[i] + 1]
            assert a == sum(inside)
            assert b == sum(x and not y for x, y in zip(inside, inside[1:]))


def test_a_chain_deeper_than_blocks():
    opens = np.array([True] * 3000 + [False] * 3000)
    tree = prefix_trie.Parentheses(opens)
    assert tree.find_close(np.arange(3000)).tolist() == [5999 - i for i in range(3000)]
