"""Prefix trie of conversations, encoded as balanced parentheses.

A conversation becomes a path of 128-bit turn hashes. Paths are sorted in ranges across all tasks, so every task holds
a stretch of the trie in depth-first order and writes it as parentheses, '(' for entering a node and ')' for leaving
it, in shards of bounded size. `Parentheses` keeps minima and maxima of the excess (open nodes) per block and a tree
over the blocks: `findclose` delimits a node's subtree, ranks of '()' pairs count its leaves, and running sums over
nodes in the order of their '(' give what its subtree saves.

Neighbouring shards share the nodes of the common prefix at their boundary, their spine. Every node is owned by the
first shard that holds it and every leaf is counted where its last conversation lies, so figures of shared nodes are
sums over shards, and everything else is final where it is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.operators.positions import sorted_ranges
from grainmill.session import cut_lineage

BLOCK = 64
SHARD_TURNS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()

PARTS = (
    "shared boolean, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, parent_shared boolean, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, "
    "first_end bigint"
)
RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with block-wise excess minima and maxima."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        low = padded.reshape(blocks, BLOCK).min(1)
        padded[len(bits) :] = np.iinfo(np.int32).min
        self.levels = [(low, padded.reshape(blocks, BLOCK).max(1))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            if len(low) % 2:
                low, high = np.append(low, np.iinfo(np.int32).max), np.append(high, np.iinfo(np.int32).min)
                self.levels[-1] = (low, high)
            self.levels.append((low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)))

    def _scan(self, out: np.ndarray, which: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Look for the target excess from `start` to the end of its block; returns those not found."""
        end = np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        at = start.copy()
        while len(which):
            live = at < end
            hit = live.copy()
            hit[live] = self.excess[at[live]] == target[which[live]]
            out[which[hit]] = at[hit]
            go = live & ~hit
            if not go.any():
                break
            which, at, end = which[go], at[go] + 1, end[go]
        return np.flatnonzero(out < 0)

    def _holds(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        low, high = self.levels[level]
        inside = node < len(low)
        inside[inside] = (low[node[inside]] <= target[inside]) & (target[inside] <= high[node[inside]])
        return inside

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Position of the ')' of each '(': the first one after it where the excess falls below it."""
        opens = np.asarray(opens, np.int64)
        target, out = self.excess[opens] - 1, np.full(len(opens), -1, np.int64)
        first = opens + 1
        same = np.flatnonzero(first // BLOCK == opens // BLOCK)
        self._scan(out, same, first[same], target)
        rest = np.flatnonzero(out < 0)
        node, found = opens[rest] // BLOCK, np.full(len(rest), -1, np.int64)
        level = 0
        while (found < 0).any():  # up: the nearest block, pair of blocks, ... to the right that holds the target
            up = np.flatnonzero(found < 0)
            right = (node[up] % 2 == 0) & self._holds(level, node[up] + 1, target[rest[up]])
            found[up[right]] = level
            node[up[right]] += 1
            node[up[~right]] //= 2
            level += 1
        for at in range(level - 1, 0, -1):  # down: its first block that holds the target
            down = np.flatnonzero(found == at)
            left = node[down] * 2
            node[down] = np.where(self._holds(at - 1, left, target[rest[down]]), left, left + 1)
            found[down] = at - 1
        self._scan(out, rest, node * BLOCK, target)
        return out

    def leaf_pairs(self) -> np.ndarray:
        """True at each '(' that its ')' follows at once."""
        pairs = self.bits.astype(bool)
        pairs[:-1] &= self.bits[1:] == 0
        return pairs


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Common leading turns of two paths of two hashes a turn."""
    n = min(len(a), len(b)) // 2
    same = (a[: 2 * n] == b[: 2 * n]).reshape(n, 2).all(1)
    return n if same.all() else int(np.argmin(same))


def _prefixes(first: np.ndarray, second: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Common turns of each row with the row before it; 0 for the first row."""
    shorter = np.minimum(lens[1:], lens[:-1])
    off = np.concatenate([[0], np.cumsum(shorter)])
    j = np.arange(off[-1]) - np.repeat(off[:-1], shorter)
    here, before = np.repeat(start[1:-1], shorter) + j, np.repeat(start[:-2], shorter) + j
    differ = np.where((first[here] == first[before]) & (second[here] == second[before]), np.iinfo(np.int64).max, j)
    out = np.concatenate([[0], shorter]).astype(np.int64)
    some = np.flatnonzero(shorter)
    if len(some):
        out[some + 1] = np.minimum(shorter[some], np.minimum.reduceat(differ, off[:-1][some]))
    return out


def _chain(values: np.ndarray, start: np.ndarray, salt: int) -> np.ndarray:
    """Hash of every prefix of every row: row r's prefix of d turns at `start[r] + r + d`."""
    lens = np.diff(start)
    depth = np.arange(len(values)) - np.repeat(start[:-1], lens)
    with np.errstate(over="ignore"):
        h = values.view(np.uint64) ^ ((depth.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        at = np.repeat(np.arange(len(lens)), lens + 1)
        place = np.arange(len(values) + len(lens)) - at
        return (running[place] - running[start[at]]).view(np.int64)


def shard(ids: np.ndarray, path: np.ndarray, start: np.ndarray, words: np.ndarray, before: int, after: int) -> dict:
    """Node figures of sorted rows; `before` and `after` are the common turns of the first row with the row ahead of
    the shard and of the last row with the row behind it, -1 where there is none."""
    first, second, rows, lens = path[0::2], path[1::2], len(ids), np.diff(start)
    lcp = _prefixes(first, second, start, lens)
    lcp[0] = -1  # the shard opens its whole first path, and the root
    new = lens - lcp
    closes = np.concatenate([[0], lens[:-1] - lcp[1:]])
    node_row = np.repeat(np.arange(rows), new)
    nodes = len(node_row)
    ends_at = np.cumsum(new)
    depth = np.arange(nodes) - np.repeat(ends_at - new, new) + lcp[node_row] + 1
    opens = np.arange(nodes) + np.cumsum(closes)[node_row]
    bits = np.zeros(2 * nodes, np.uint8)
    bits[opens] = 1
    tree = Parentheses(bits)
    close = tree.findclose(opens)
    size = (close - opens + 1) // 2
    row_at = np.concatenate([[0], np.cumsum(closes + new)])  # where each row's closes begin
    last_row = np.searchsorted(row_at, close, "right") - 2
    last_row[close >= row_at[-1]] = rows - 1

    pairs = tree.leaf_pairs()
    pairs[opens[-1]] = after < lens[-1]  # otherwise the next shard goes on with this path
    leaf_rank = np.concatenate([[0], np.cumsum(pairs)])
    members = last_row - node_row + 1
    owned = (node_row > 0) | (depth > before)
    weight = np.zeros(nodes, np.int64)
    inner = depth > 0
    weight[inner] = words[start[node_row[inner]] + depth[inner] - 1]
    saved = np.concatenate([[0], np.cumsum(weight * (members - owned))])
    shared = ((node_row == 0) & (depth <= before)) | ((last_row == rows - 1) & (depth <= after))

    at = np.arange(nodes)
    by_depth = np.sort(depth * nodes + at)
    parent = by_depth[np.maximum(np.searchsorted(by_depth, (depth - 1) * nodes + at) - 1, 0)] % nodes
    children = np.bincount(parent[inner & owned], minlength=nodes)
    bounds = np.column_stack([node_row, last_row + 1]).ravel()
    smallest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), bounds)[::2]
    place = start[node_row] + node_row + depth
    k1, k2 = _chain(first, start, 1)[place], _chain(second, start, 0x5851F42D)[place]

    texts, first_end = [NOTHING] * nodes, np.zeros(nodes, np.int64)
    for node in np.flatnonzero(shared).tolist():
        texts[node] = ""
    groups = np.flatnonzero(new)
    for s, e in zip(groups.tolist(), [*groups[1:].tolist(), rows]):
        node = int(ends_at[s]) - 1
        ends = ",".join(map(str, ids[s:e].tolist()))
        texts[node] = ends if shared[node] else hashlib.sha256(ends.encode()).hexdigest()
        first_end[node] = ids[s]
    return {
        "shared": shared,
        "depth": depth,
        "k1": k1,
        "k2": k2,
        "p1": k1[parent],
        "p2": k2[parent],
        "parent_shared": shared[parent] & inner,
        "conv_id": smallest,
        "parent_conv_id": pa.array(smallest[parent], mask=~inner),
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaf_rank[close + 1] - leaf_rank[opens],
        "saved_tokens": saved[at + size] - saved[at],
        "ends": pa.array(texts, pa.string()),
        "first_end": first_end,
    }


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column."""
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last path of a range."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [first.column("_range"), first.column("path"), last.column("path")], names=["_range", "head", "tail"]
        )


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common turns of each range's first row with the last row of the range before it; -1 for the first range."""
    tail = None
    for batch in batches:
        for i in range(batch.num_rows):
            head = _lists(batch.column("head").slice(i, 1))[0]
            common = -1 if tail is None else common_prefix(tail, head)
            tail = _lists(batch.column("tail").slice(i, 1))[0]
            yield pa.RecordBatch.from_arrays([batch.column("_range").slice(i, 1), pa.array([common])], names=["_range", "common"])


def _shards(seams: dict[int, tuple[int, int]], limit: int):
    names = [field.split()[0] for field in PARTS.split(", ")]

    def made(held: pa.Table, before: int, after: int) -> pa.RecordBatch:
        whole = held.combine_chunks()
        path, off = _lists(whole.column("path").combine_chunks())
        words, _ = _lists(whole.column("words").combine_chunks())
        parts = shard(whole.column("conv_id").to_numpy(), path, off // 2, words, before, after)
        return pa.RecordBatch.from_arrays([pa.array(parts[name]) for name in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turns, before, after = 0, -1, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if not held:
                before, after = seams[batch.column("_range")[0].as_py()]
            ends = np.cumsum(np.diff(batch.column("words").offsets.to_numpy(zero_copy_only=False)))
            at, base = 0, 0
            while at < batch.num_rows:  # cut the stream where a shard is full; its next row stays for the seam
                upto = int(np.searchsorted(ends, base + limit - turns, "right")) + 1
                upto = min(max(upto, at + 1), batch.num_rows)
                held.append(batch.slice(at, upto - at))
                turns += int(ends[upto - 1]) - base
                at, base = upto, int(ends[upto - 1])
                full = pa.Table.from_batches(held)
                if turns > limit and full.num_rows > 1:
                    ready, kept = full.slice(0, full.num_rows - 1), full.slice(full.num_rows - 1)
                    tail = _lists(ready.column("path").slice(ready.num_rows - 1).combine_chunks())[0]
                    head = _lists(kept.column("path").combine_chunks())[0]
                    common = common_prefix(tail, head)
                    yield made(ready, before, common)
                    held, turns, before = kept.to_batches(), len(head) // 2, common
        if held:
            yield made(pa.Table.from_batches(held), before, after)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come sorted; only the running digest is held."""
    key, digest = None, None
    kind = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def done():
        return pa.RecordBatch.from_pylist([dict(zip(kind.names, (*key, digest.hexdigest())))], kind)

    for batch in batches:
        for row in batch.to_pylist():
            mine = (row["depth"], row["k1"], row["k2"])
            if mine != key:
                if key is not None:
                    yield done()
                key, digest = mine, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["ends"].encode())
    if key is not None:
        yield done()


def paths(
    df: DataFrame, base: Column, lead: Column, id_col: str, turn_col: str, role_col: str, text_col: str
) -> DataFrame:
    """Rebuilt conversations: conv_id, path (two hashes a turn), words (of each turn's text).

    `base` and `lead` are expressions on the column `conv_id`: the conversation that the first turns come from, and how
    many (at most 3).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).alias("w"),
    )
    turns = df.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    own = (
        turns.withColumn("base", base)
        .repartition("base")  # a conversation and the one it borrows from meet in one task; at most 39 share a base
        .groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
    )
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("t", 1, 3))
    own = own.withColumn("head", F.first(head, ignorenulls=True).over(Window.partitionBy("base"))).withColumn("lead", lead)
    borrowed = F.coalesce(F.slice("head", F.lit(1), F.col("lead")), F.slice("t", F.lit(1), F.lit(0)))
    rebuilt = own.select("conv_id", F.concat(borrowed, F.slice("t", F.col("lead") + 1, F.size("t"))).alias("t"))
    return rebuilt.select(
        "conv_id",
        F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"]))).alias("path"),
        F.transform("t", lambda x: x["w"].cast("long")).alias("words"),
    )


def borrowed_lead() -> tuple[Column, Column]:
    """The first crc32(id) % 4 turns come from the conversation numbered by the id's multiple of 20."""
    conv = F.col("conv_id")
    return conv - conv % 20, (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def prefix_trie(
    df: DataFrame,
    base: Column | None = None,
    lead: Column | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """Every node of the trie of conversations with its figures, columns `RESULT`.

    Conversations are ordered by turn, null first; rows of one turn by the hash of role and text, a repeated row is a
    turn of its own. Null roles and texts are empty. Rows without an id take no part. By default the first turns are
    borrowed as `borrowed_lead` says; `base` and `lead` are expressions on `conv_id`. A node is a distinct sequence of
    (role, text), told apart by 128 bits of hash a turn. Other columns are ignored. Without a conversation there is no
    node. A conversation's path of hashes (24 bytes a turn) is held by one task. Jobs run at once: the sort of the
    paths, the seams between its ranges, and the shards; both frames are checkpointed.
    """
    if base is None or lead is None:
        base, lead = borrowed_lead()
    ranged = sorted_ranges(paths(df, base, lead, id_col, turn_col, role_col, text_col), ["path", "conv_id"])
    ranged = ranged.select("_range", "conv_id", "path", "words")
    edges = ranged.select("_range", "path").mapInArrow(_edges, "_range bigint, head array<bigint>, tail array<bigint>")
    joints = edges.repartition(1).sortWithinPartitions("_range").mapInArrow(_seams, "_range bigint, common bigint")
    found = sorted((r["_range"], r["common"]) for r in joints.collect())  # two numbers a range
    after = [common for _, common in found[1:]] + [-1]
    seams = {r: (common, nxt) for (r, common), nxt in zip(found, after)}
    parts = cut_lineage(ranged.mapInArrow(_shards(seams, shard_turns), PARTS))

    key = ["depth", "k1", "k2"]
    whole = parts.where("NOT shared").withColumnRenamed("ends", "ends_sha256")
    spine = parts.where("shared")
    digests = (
        spine.where("ends <> ''")
        .select(*key, "ends", "first_end")
        .repartition(*key)
        .sortWithinPartitions(*key, "first_end")
        .mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    )
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = spine.groupBy(*key, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    merged = merged.join(digests, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    merged = merged.join(parents, ["depth", "p1", "p2"], "left")
    hanging = whole.where("parent_shared").drop("parent_conv_id").join(parents, ["depth", "p1", "p2"], "left")
    inner = whole.where("NOT parent_shared")
    return inner.select(*RESULT).unionByName(hanging.select(*RESULT)).unionByName(merged.select(*RESULT))


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([
        [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

ORACLE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    turns AS (SELECT v.c, t.k, t.role, t.text FROM convs v JOIN t ON t.c = v.base AND t.k <= v.h
        UNION ALL SELECT v.c, t.k, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.k > v.h),
    paths AS (SELECT c, list(sha256(role || chr(1) || text) ORDER BY k) AS p,
        list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY k) AS w FROM turns GROUP BY c
        UNION ALL SELECT c, [], [] FROM convs WHERE c NOT IN (SELECT c FROM turns)),
    steps AS (SELECT c, d, sha256(array_to_string(p[1:d], '/')) AS node,
        CASE WHEN d > 0 THEN sha256(array_to_string(p[1:d - 1], '/')) END AS parent,
        CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(p) AS ends
        FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
    nodes AS (SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
        FROM steps GROUP BY node, d),
    kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
    whole AS (SELECT n.*, coalesce(k.k, 0) AS children FROM nodes n LEFT JOIN kids k USING (node)),
    below AS (SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.c = b.c AND a.d <= b.d),
    sums AS (SELECT b.top AS node, count(*) FILTER (WHERE w.children = 0) AS leaves, sum((w.n - 1) * w.words) AS saved
        FROM below b JOIN whole w USING (node) GROUP BY 1)
    SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.children AS n_children,
        s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
    FROM whole w JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = w.parent"""
