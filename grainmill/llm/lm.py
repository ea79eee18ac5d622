"""Language-model scores by deleted interpolation of word n-grams.

p(w | v) mixes the maximum-likelihood estimates of the pair, of the word and of one word in all; the mixture weights
depend on how often the context v was seen (a bucket per power of two) and are learned by expectation-maximisation on
held-out counts: pairs of a twentieth of the training documents against the counts of the others. The scores use the
counts of all training documents.

Documents are dealt into blocks. A block sends its distinct words and pairs, as sorted lists of hash differences with
counts, to the parts of the hash space; a part adds up the lists of all blocks and answers each list in its order. So
no n-gram is a row, every list is bounded by its block, and a word as frequent as a third of all tokens is one number
per block. Only the mixture's histogram, of bounded size, comes to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import bytesops
from grainmill.session import cut_lineage

BLOCK_BYTES = 16_000_000
LEAST_BLOCKS = 20
FOLD = 20  # one block in so many is held out
PAIR_BITS = 48  # of a pair's hash; a false match has a chance of (different pairs) / 2**PAIR_BITS
BUCKETS = 24
GRAIN = 8  # cells per factor of two in the histogram of estimates
ROUNDS = 40
_END = np.uint64(0x51ED270B9F3A4C15)
_PAIR = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Mixture:
    """Weights (pair, word, one word in all) of each bucket of context frequency."""

    weights: np.ndarray


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1)), BUCKETS - 1).astype(int)


def narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers, each in as few bytes as the largest needs."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


@dataclass
class Tokens:
    """Tokens of a block in order: hashes, pair hashes, and the offsets of each document's tokens."""

    words: np.ndarray
    pairs: np.ndarray
    at: np.ndarray


_PACK = pa.schema(
    [("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))]
    + [("texts", pa.binary())]
)
_PACK_SQL = "block int, ids array<bigint>, learn array<boolean>, sizes array<bigint>, texts binary"


def _pack(batches):
    """Rows of a task as one compressed pack per block and chunk: texts are shuffled twice, so they travel small."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in bytesops.chunked(batches, "text"):
        data, off = bytesops.buffers(bytesops.column(batch, "text"))
        block = bytesops.column(batch, "block").to_numpy()
        order = np.argsort(block, kind="stable")
        ids, learn = (bytesops.column(batch, c).take(pa.array(order)) for c in ("id", "learn"))
        sizes = np.diff(off)[order]
        bounds = np.flatnonzero(np.diff(block[order], prepend=-1))
        rows = []
        for s, e in zip(bounds, [*bounds[1:], len(order)]):
            text = b"".join(data[off[i] : off[i + 1]] for i in order[s:e])
            rows.append((block[order[s]], ids[s:e].to_pylist(), learn[s:e].to_pylist(), sizes[s:e].tolist(), squeeze(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACK)], schema=_PACK)


def _texts(packs: pa.Table):
    """Bytes and offsets of the packs' texts, about a chunk at a time, in the packs' order."""
    data, sizes, held = [], [], 0
    for text, own in zip(packs.column("texts"), packs.column("sizes")):
        data.append(zstandard.ZstdDecompressor().decompress(text.as_py(), max_output_size=max(1, sum(own.as_py()))))
        sizes += own.as_py()
        held += len(data[-1])
        if held >= bytesops.CHUNK_BYTES:
            yield np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data, sizes, held = [], [], 0
    if sizes:
        yield np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _flat(packs: pa.Table, name: str) -> pa.Array:
    return packs.column(name).combine_chunks().flatten()


def tokens(packs: pa.Table) -> Tokens:
    """Words and one end for every text of a block. The context of a first word is the end."""
    words, counts = [], []
    for data, off in _texts(packs):
        hashes, at = bytesops.word_hashes(data, off)
        ends = at[1:] + np.arange(len(at) - 1)
        own = np.full(len(hashes) + len(ends), _END, np.uint64)
        inside = np.ones(len(own), bool)
        inside[ends] = False
        own[inside] = hashes
        words.append(own)
        counts.append(np.diff(at) + 1)
    word = np.concatenate(words) if words else np.zeros(0, np.uint64)
    before = np.concatenate([np.full(1, _END, np.uint64), word[:-1]])[: len(word)]
    with np.errstate(over="ignore"):
        pairs = bytesops.mix(before * _PAIR + word) >> np.uint64(64 - PAIR_BITS)
    return Tokens(word, pairs, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, int))


def _bounds(distinct: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part of the hash space begins in a sorted list."""
    edges = [-(-(p << bits) // parts) for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(distinct, np.array(edges, np.uint64)), [len(distinct)]]).astype(int)


_REQUEST = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]
)
_ANSWER = pa.schema(
    [("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("all", pa.binary()), ("kept", pa.binary())]
    + [(name, pa.int64()) for name in ("tokens", "types", "kept_tokens", "kept_types")]
)
_REQUEST_SQL = "part int, block int, kind int, n bigint, hashes binary, counts binary"
_ANSWER_SQL = (
    "block int, part int, kind int, n bigint, `all` binary, kept binary, tokens bigint, types bigint, "
    "kept_tokens bigint, kept_types bigint"
)


def _lists(found: Tokens) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Sorted distinct values, the place of each token among them, and bits, of words and of pairs."""
    return [(*np.unique(v, return_inverse=True), bits) for v, bits in ((found.words, 64), (found.pairs, PAIR_BITS))]


def _ask(block: int, table: pa.Table, parts: int) -> pa.Table:
    found = tokens(table)
    learn = np.repeat(_flat(table, "learn").to_numpy(zero_copy_only=False), np.diff(found.at)).astype(bool)
    rows = []
    for kind, (distinct, inverse, bits) in enumerate(_lists(found)):
        counts = np.bincount(inverse[learn], minlength=len(distinct))
        bounds = _bounds(distinct, bits, parts)
        for part, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
            steps = np.diff(distinct[s:e], prepend=np.uint64(-(-(part << bits) // parts)))
            rows.append((part, block, kind, int(e - s), narrow(steps), zlib.compress(narrow(counts[s:e]), 1)))
    return pa.Table.from_pylist([dict(zip(_REQUEST.names, r)) for r in rows], _REQUEST)


def _answer(part: int, table: pa.Table, parts: int) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
    out = []
    for kind, bits in ((0, 64), (1, PAIR_BITS)):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        base = np.uint64(-(-(part << bits) // parts))
        with np.errstate(over="ignore"):
            hashes = np.concatenate([np.cumsum(widen(r["hashes"], r["n"])) + base for r in own])
        counts = np.concatenate([widen(zlib.decompress(r["counts"]), r["n"]) for r in own])
        held = np.repeat([r["block"] % FOLD == 2 for r in own], [r["n"] for r in own])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        kept = total - np.bincount(inverse[held], counts[held], len(distinct)).astype(np.int64)
        sums = [0] * 4 if kind else [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
        at = 0
        for r in own:
            place = inverse[at : at + r["n"]]
            at += r["n"]
            rest = zlib.compress(narrow(kept[place]), 1) if r["block"] % FOLD == 2 else None
            out.append((r["block"], part, kind, r["n"], zlib.compress(narrow(total[place]), 1), rest, *sums))
    return pa.Table.from_pylist([dict(zip(_ANSWER.names, r)) for r in out], _ANSWER)


@dataclass
class Counts:
    """Counts of each token's word, context and pair, all tokens and all types."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    tokens: int
    types: int


def _counts(found: Tokens, answers: pa.Table, name: str) -> Counts:
    rows = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    per_token = []
    for kind, (distinct, inverse, _) in enumerate(_lists(found)):
        lists = [widen(zlib.decompress(r[name]), r["n"]) for r in rows if r["kind"] == kind]
        counts = np.concatenate(lists).astype(np.int64)
        if len(counts) != len(distinct):
            raise ValueError("a block's texts changed between two passes")
        per_token.append(counts[inverse])
    word, pair = per_token
    end = word[found.at[1] - 1]
    prefix = "" if name == "all" else "kept_"
    total, types = (sum(r[prefix + f] for r in rows if r["kind"] == 0) for f in ("tokens", "types"))
    return Counts(word, np.concatenate([[end], word[:-1]]), pair, total, types)


def _cells(estimate: np.ndarray) -> np.ndarray:
    return np.where(estimate > 0, np.round(GRAIN * np.log2(np.maximum(estimate, 1e-300))), -9999).astype(int)


def _held_out(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Histogram of a held-out block's training tokens: bucket, cells of the pair and word estimates, number of types."""
    found = tokens(table)
    c = _counts(found, answers, "kept")
    learn = np.repeat(_flat(table, "learn").to_numpy(zero_copy_only=False), np.diff(found.at)).astype(bool)
    pair, word = c.pair / np.maximum(c.context, 1), c.word / max(c.tokens, 1)
    frame = pd.DataFrame({"bucket": bucket(c.context)[learn], "pair": _cells(pair)[learn], "word": _cells(word)[learn]})
    frame = frame.value_counts().rename("n").reset_index()
    return pa.Table.from_pandas(frame.assign(types=c.types).astype("int64"), preserve_index=False)


def learn_mixture(histogram: pd.DataFrame) -> Mixture:
    """Expectation-maximisation in every bucket, from the weights learned on all buckets together."""
    start = np.array([0.4, 0.4, 0.2])
    if not len(histogram):
        return Mixture(np.tile(start, (BUCKETS, 1)))
    uniform = 1 / (float(histogram["types"].max()) + 1)
    value = lambda cell: np.where(cell > -9999, 2.0 ** (cell / GRAIN), 0.0)
    p = np.column_stack([value(histogram["pair"]), value(histogram["word"]), np.full(len(histogram), uniform)])
    n, at = histogram["n"].to_numpy(float), histogram["bucket"].to_numpy()

    def rounds(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(ROUNDS):
            share = p[rows] * w
            share *= (n[rows] / share.sum(1))[:, None]
            w = share.sum(0) / share.sum()
        return np.maximum(w, 1e-9)

    pooled = rounds(np.ones(len(n), bool), start)
    return Mixture(np.array([rounds(at == b, pooled) if (at == b).any() else pooled for b in range(BUCKETS)]))


def _scores(table: pa.Table, answers: pa.Table, mixture: Mixture) -> pa.Table:
    found = tokens(table)
    c = _counts(found, answers, "all")
    w = mixture.weights[bucket(c.context)] * np.column_stack(
        [c.context > 0, np.full(len(c.word), c.tokens > 0), np.ones(len(c.word), bool)]
    )
    w /= w.sum(1, keepdims=True)  # an estimate that does not exist leaves its weight to the others
    p = w[:, 0] * c.pair / np.maximum(c.context, 1) + w[:, 1] * c.word / max(c.tokens, 1) + w[:, 2] / (c.types + 1)
    starts = found.at[:-1]
    base = np.log10((c.word + 0.5) / (c.tokens + 0.5 * (c.types + 1)))
    return pa.table(
        {
            "id": _flat(table, "ids"),
            "n_tokens": np.diff(found.at),
            "n_known": np.add.reduceat((c.word > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(starts), c.tokens, np.int64),
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10(p), starts),
        }
    )


def score(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of `df`: the id, n_tokens, n_known, train_tokens, base_score and score, all log10.

    Words are runs of bytes other than ASCII white space, lower-cased in A-Z; every text ends with one end token. The
    model learns from rows with `learn`; null counts as false. `base_score` is the sum over the tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))). Null texts are empty: one end. Repeated rows are scored and, where `learn`
    holds, counted as often as they occur; a null id stays null. Without a training row every token has the probability
    of one word in one. Other columns are ignored. An empty table gives no rows.

    The size of the texts is summed, the answers to all blocks are written to the checkpoint folder, and the mixture is
    learned before this returns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // block_bytes))
    rows = df.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("id"),
        text.alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )

    def ask(key, table):
        return _ask(key[0].as_py(), table, blocks)

    def answer(key, table):
        return _answer(key[0].as_py(), table, blocks)

    rows = rows.mapInArrow(_pack, _PACK_SQL)
    asked = rows.groupBy("block").applyInArrow(ask, _REQUEST_SQL)
    answers = cut_lineage(asked.groupBy("part").applyInArrow(answer, _ANSWER_SQL))

    def held_out(key, table, right):
        return _held_out(table, right)

    fold = F.col("block") % FOLD == 2
    cells = (
        rows.where(fold)
        .groupBy("block")
        .cogroup(answers.where(fold).groupBy("block"))
        .applyInArrow(held_out, "bucket bigint, pair bigint, word bigint, n bigint, types bigint")
        .groupBy("bucket", "pair", "word")
        .agg(F.sum("n").alias("n"), F.max("types").alias("types"))
        .toPandas()
    )
    mixture = learn_mixture(cells.sort_values(["bucket", "pair", "word"], ignore_index=True))

    def scored(key, table, right):
        return _scores(table, right, mixture)

    return (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            scored,
            "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        )
        .withColumnRenamed("id", id_col)
    )
