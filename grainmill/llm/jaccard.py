"""Similarity join on word n-grams: MinHash bands, then exact verification.

Texts with the same set of n-grams are one set, which goes on once. Band and row counts are chosen from the target
recall at the threshold. Sets that agree in a band meet by the band's hash; only their ids are shuffled, as a star to
the smallest of each bucket, and the components of these stars are the groups of candidates. Every set of a group is
then sent once per pair of blocks of its group, and all pairs of two blocks are compared in one task on full n-gram
sets: a task puts out its members' numbers of links and a spanning forest, never pairs. A group holding a third of all
rows is thus many tasks of bounded memory.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm import bytesops
from grainmill.llm.components import components
from grainmill.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 320
BLOCK = 1000  # sets of a group in one block
FILTER = 2**20  # buckets of the filter that keeps texts without a candidate out of the second shuffle
_SEED = 41


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows per band, and so the fewest false candidates, whose bands reach the recall with `most` hashes."""
    best = (1, 1)
    for rows in range(1, min(most, 64) + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-chance))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, off: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashed n-grams of lower-cased words in order, and the rows' offsets.

    A row with fewer than `size` words has one n-gram of all of them, a row without a word has none.
    """
    words, at = bytesops.word_hashes(data, off)
    counts = np.diff(at)
    found = np.where(counts >= size, counts - size + 1, (counts > 0).astype(int))
    row = np.repeat(np.arange(len(counts)), found)
    first = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
    last = at[1:][row]
    factors = np.random.default_rng(_SEED).integers(1, 2**62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = first + k < last
            word = words[np.minimum(first + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
            h += np.where(inside, word, np.uint64(k + 1)) * factors[k]
    h = bytesops.mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(counts)))])


def band_hashes(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows of text, bands) hashes of the bands' minima; rows without an n-gram get zeros."""
    some = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, bands), np.uint64)
    if not len(some):
        return out
    rng = np.random.default_rng(_SEED + 1)
    short = (h >> np.uint64(32)).astype(np.uint32)
    value = np.empty_like(short)
    starts = at[:-1][some]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(some), band + 1, np.uint64)
            for _ in range(rows):
                a, b = rng.integers(0, 2**31, 2).astype(np.uint32)
                np.multiply(short, a * np.uint32(2) + np.uint32(1), out=value)
                value ^= value >> np.uint32(15)
                value *= b * np.uint32(2) + np.uint32(1)
                key = bytesops.mix(key ^ np.minimum.reduceat(value, starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
            out[some, band] = key
    return out


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _fingerprints(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each row's n-gram set."""
    count, prints = np.diff(at).astype(np.uint64), []
    with np.errstate(over="ignore"):
        for factor in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytesops.mix(h * np.uint64(factor)))])
            prints.append(bytesops.mix(running[at[1:]] - running[at[:-1]] + count).view(np.int64))
    return prints


def _sets(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, seal, f1, f2, bands): a hash of the text, fingerprints of the n-gram set and band hashes."""
    schema = pa.schema([("id", pa.int64()), ("seal", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in bytesops.chunked(batches, "text", bytesops.SMALL_BYTES):
            h, at = shingles(*bytesops.buffers(bytesops.column(batch, "text")), size)
            keys = band_hashes(h, at, bands, rows).view(np.int64)
            places = (np.arange(len(at)) * bands).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(keys.ravel()), mask=pa.array(np.diff(at) == 0))
            prints = map(pa.array, _fingerprints(h, at))
            own = [bytesops.column(batch, c) for c in ("id", "seal")]
            yield pa.RecordBatch.from_arrays([*own, *prints, lists], schema=schema)

    sealed = df.select("id", F.xxhash64("text").alias("seal"), "text")
    return sealed.mapInArrow(run, "id bigint, seal bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _full_sets(df: DataFrame, size: int) -> DataFrame:
    """(id, f1, f2, grams): the fingerprints and the sorted n-gram hashes as bytes."""
    schema = pa.schema([("id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for batch in bytesops.chunked(batches, "text", bytesops.SMALL_BYTES):
            h, at = shingles(*bytesops.buffers(bytesops.column(batch, "text")), size)
            grams = [h[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
            prints = map(pa.array, _fingerprints(h, at))
            yield pa.RecordBatch.from_arrays([bytesops.column(batch, "id"), *prints, pa.array(grams, pa.binary())], schema=schema)

    return df.mapInArrow(run, "id bigint, f1 bigint, f2 bigint, grams binary")


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
    """For each set of `left`, the positions of sets in `right` (or later ones in `left`) that are similar enough."""
    sets = left if right is None else right
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(universe) + 1, bool)
    for i, own in enumerate(left):
        at = np.minimum(np.searchsorted(universe, own), len(universe) - 1)
        at = at[universe[at] == own]
        marked[at] = True
        common = np.add.reduceat(marked[ids], starts, dtype=np.int64)
        marked[at] = False
        similar = common >= threshold * (len(own) + sizes - common) - 1e-9
        if right is None:
            similar[: i + 1] = False
        yield i, np.flatnonzero(similar)


def _block(key, frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows (a, b, links): numbers of links of a set (b null), and edges of a spanning forest (links 0)."""
    frame = frame.drop_duplicates(["node", "block"]).sort_values(["block", "node"], ignore_index=True)
    reps, copies, blocks = (frame[c].to_numpy() for c in ("node", "n", "block"))
    grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
    cut = len(frame) if key[1] == key[2] else int((blocks == key[1]).sum())
    links, parent = np.zeros(len(frame), np.int64), list(range(len(frame)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if 0 < cut and (cut < len(frame) or key[1] == key[2]):
        right = None if key[1] == key[2] else grams[cut:]
        for i, found in compare(grams[:cut], right, threshold):
            found = found if right is None else found + cut
            links[i] += copies[found].sum()
            links[found] += copies[i]
            for j in found.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    smallest: dict[int, int] = {}
    for i in range(len(frame)):
        r = root(i)
        smallest[r] = min(smallest.get(r, reps[i]), reps[i])
    rows = [(reps[i], None, links[i]) for i in np.flatnonzero(links)]
    rows += [(reps[i], smallest[root(i)], 0) for i in range(len(frame)) if reps[i] != smallest[root(i)]]
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype("Int64")


def _labelled(
    df: DataFrame, threshold: float, size: int, recall: float, id_col: str, text_col: str, block: int
) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and per distinct set its smallest row, class, whether it heads the class, and links."""
    bands, rows = bands_and_rows(threshold, recall)
    texts = _texts(df, id_col, text_col)
    hashed = cut_lineage(_sets(texts, size, bands, rows))
    sets = hashed.where("id IS NOT NULL").groupBy("f1", "f2").agg(
        F.min(F.struct("id", "seal")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")
    )
    # a number of its own for every set, as one id may head several
    sets = sets.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", F.col("first.id").alias("rep"), F.col("first.seal").alias("seal"), "n", "bands")
    sets = cut_lineage(sets)
    keyed = sets.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = keyed.join(buckets, "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    groups = components(stars)
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = (
        groups.join(blocks, "root")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(sets.select("node", "rep", "f1", "f2", "n"), "node")
    )
    members = cut_lineage(members.select("node", "rep", "f1", "f2", "root", "blocks", "block", "n"))
    kept = members.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER)).alias("bucket")).distinct()
    near = (
        texts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(FILTER)))
        .join(F.broadcast(kept), "bucket", "left_semi")
        .select("id", "text")
    )
    sent = (
        _full_sets(near, size)
        .join(members.withColumnRenamed("rep", "id"), ["id", "f1", "f2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "block", "grams")
    )

    def run(key, frame):
        return _block(key, frame, threshold)

    verified = sent.groupBy("root", "i", "j").applyInPandas(run, "a bigint, b bigint, links bigint")
    verified = cut_lineage(verified)
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(verified.where("b IS NOT NULL").select("a", "b"))
    roots = sets.select("node", "f1", "f2", "rep", "seal", "n").join(links, "node", "left").join(classes, "node", "left")
    heads = roots.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("rep", "f1", "f2")).alias("head"))
    head = F.coalesce("head", F.struct("rep", "f1", "f2"))
    labelled = roots.join(heads, "root", "left").select(
        "f1", "f2", F.col("rep").alias("copy_of"), "seal", head.getField("rep").alias("class_id"),
        ((head.getField("f1") == F.col("f1")) & (head.getField("f2") == F.col("f2"))).alias("heads"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    return hashed, labelled


def join(
    df: DataFrame,
    threshold: float = THRESHOLD,
    size: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `df`: the id, copy_of, class_id and n_links.

    `copy_of` is the smallest id with the same set of n-grams, `class_id` the smallest id that the row is connected to
    by links, and `n_links` counts the other rows whose set has a Jaccard similarity of at least `threshold`, copies
    among them. Words are runs of bytes other than ASCII white space, lower-cased in A-Z; a text of fewer than `size`
    words has one n-gram of all its words.

    Null, empty and blank texts have no n-gram: they are copies of each other and link to nothing else. Rows with a
    null id take no part, and have a null class and no link. Repeated rows count as copies; an id with several texts has
    a row for each, with that text's copies and links. Other columns are ignored. An empty table gives no rows. Narrow tables are written to the
    checkpoint folder, and jobs run at once for the components.
    """
    hashed, labelled = _labelled(df, threshold, size, recall, id_col, text_col, block)
    own = hashed.select("id", "f1", "f2").where("id IS NOT NULL").join(labelled, ["f1", "f2"])
    none = F.lit(None).cast("long")
    lost = hashed.where("id IS NULL").select("id", none.alias("copy_of"), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return own.select("id", "copy_of", "class_id", "n_links").unionByName(lost).withColumnRenamed("id", id_col)


def representatives(
    df: DataFrame,
    threshold: float = THRESHOLD,
    size: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per class: the id of its smallest row, and `seal`, the xxhash64 of that row's text (as a string).

    An id with several texts heads as many classes as its texts head. Nulls and repeated rows as in `join`.
    """
    _, labelled = _labelled(df, threshold, size, recall, id_col, text_col, block)
    return labelled.where("heads").select(F.col("copy_of").alias(id_col), "seal")
