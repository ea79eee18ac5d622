"""The prefix trie: parentheses against a stack, figures against brute force, shards of any size, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string"


def test_findclose_matches_a_stack():
    rng = np.random.default_rng(7)
    for size in (1, 5, 64, 65, 3000):
        bits, open_nodes, left = [1], 1, size - 1
        while left or open_nodes:
            deep = left and (open_nodes == 1 or rng.random() < 0.5)
            bits.append(1 if deep else 0)
            open_nodes += 1 if deep else -1
            left -= 1 if deep else 0
        stack, want = [], {}
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                want[stack.pop()] = at
        opens = np.array(sorted(want))
        tree = trie.Parentheses(np.array(bits, np.uint8))
        assert tree.findclose(opens).tolist() == [want[i] for i in opens.tolist()]
        assert np.flatnonzero(tree.leaf_pairs()).tolist() == [i for i in opens.tolist() if want[i] == i + 1]


def brute(rows):
    """Nodes by dictionaries, as the contract says."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    below, children = defaultdict(list), defaultdict(int)
    for p in nodes:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
        if p:
            children[p[:-1]] += 1
    cost = {p: (len(m) - 1) * (len(p[-1][1].split()) if p else 0) for p, m in nodes.items()}
    return sorted(
        (
            m[0], len(p), nodes[p[:-1]][0] if p else -1, len(m), children[p], sum(not children[q] for q in below[p]),
            sum(cost[q] for q in below[p]),
            hashlib.sha256(",".join(str(c) for c in m if rebuilt[c] == p).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def found(frame):
    assert frame.columns == list(trie.RESULT)
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def conversations():
    rng = np.random.default_rng(5)
    rows = []
    for conv in [*range(0, 130), 1000, 1001, 1019, 2019]:
        for turn in range(int(rng.integers(1, 7))):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], f"turn {turn} " + "word " * int(rng.integers(0, 3))))
    rows += [(conv, turn, "user", f"same {turn}") for conv in range(200, 400) for turn in range(3)]  # a hot conversation
    rows += [(500, turn, "user", f"deep {turn}") for turn in range(90)]
    return rows


@pytest.mark.parametrize("limit,parts", [(trie.SHARD_TURNS, 8), (5, 8), (40, 200), (1, 1)])
def test_figures_match_brute_force(spark, limit, parts):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(trie.prefix_trie(frame, shard_turns=limit)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_conversations(spark):
    rows = [
        (1, None, "user", "first as its turn is null"), (1, 0, None, None), (1, 1, "", ""), (1, 2, "user", "a  b\tc"),
        (20, 0, "user", "hello there"), (21, 5, "user", "own"), (39, 0, "user", "x"), (39, 0, "user", "x"), (-3, 0, "user", "minus"),
        (None, 0, "user", "no conversation"), (61, 0, "user", "nothing to borrow"), (62, 0, "user", "w " * 5000), (63, 1, "u", "é ü"),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    rows = [r for r in rows if r[0] != -3]
    own = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(20))
    assert found(trie.prefix_trie(frame.where("conv_id <> -3 OR conv_id IS NULL"))) == brute(rows)
    assert trie.prefix_trie(frame, own, F.lit(0)).where("depth = 0").first()["n_convs"] == 8
    assert trie.prefix_trie(frame.where("conv_id IS NULL")).count() == 0
    assert trie.prefix_trie(frame.limit(0)).columns == list(trie.RESULT)


def test_lone_turnless_conversation(spark):
    """A conversation that borrows more than there is keeps no turn: the root is its only node, and a leaf."""
    conv = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    frame = spark.createDataFrame([(conv, 0, "user", "gone", 1, "x")], SCHEMA)
    digest = hashlib.sha256(str(conv).encode()).hexdigest()
    assert found(trie.prefix_trie(frame)) == [(conv, 0, -1, 1, 0, 1, 0, digest)]
