"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Inner product becomes a distance by one more component, sqrt(M^2 - |x|^2), with M the largest norm: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors are rotated at random, so that the distance over the first few components is
an estimate of the whole. Centroids of the inverted lists are fitted on a bounded sample, and every row is indexed. A
list is scanned in column blocks: after each block a hypothesis test compares the partial distance with the k-th best
so far, and candidates whose whole distance is unlikely to be less are dropped. Survivors are scored exactly.

Lists larger than `part_rows` are dealt into parts by a hash of the row, so a list holding a third of all rows is
scanned by many tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from grainmill.llm.topk import usable

SAMPLE_ROWS = 20_000
PART_ROWS = 8192
FIRST_ROWS = 256
QUERY_ROWS = 64  # queries whose first column block is multiplied at once
COLUMNS = 32
EPSILON = 1.2  # of the hypothesis test; larger drops fewer candidates
SEED = 17


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's rounds from a random start; an empty list takes the vector farthest from its centroid."""
    centroids = sample[np.random.default_rng(seed).permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        to = (sample * sample).sum(1)[:, None] - 2 * sample @ centroids.T + (centroids * centroids).sum(1)
        own = to.argmin(1)
        for c in range(len(centroids)):
            members = sample[own == c]
            centroids[c] = members.mean(0) if len(members) else sample[int(to.min(1).argmax())]
    return centroids


def augmented(x: np.ndarray, largest: float, turn: np.ndarray) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest * largest - (x * x).sum(1), 0))
    return np.column_stack([x, rest]) @ turn


def first_block(rows: np.ndarray, queries: np.ndarray, columns: int) -> np.ndarray:
    """Partial distances over the first columns, of every query (row) to every row."""
    x, q = rows[:, :columns], queries[:, :columns]
    return (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)


def scan_list(
    rows: np.ndarray, query: np.ndarray, k: int, columns: int, epsilon: float, first: np.ndarray
) -> tuple[np.ndarray, int]:
    """Positions of rows that may be among the k nearest to the query, and how many components were looked at.

    The rows nearest over the `first` columns are measured whole and give the bar; the others are dropped block by
    block of columns.
    """
    n, dim = rows.shape
    head = min(n, max(FIRST_ROWS, k))
    order = np.argpartition(first, head - 1) if head < n else np.arange(n)
    near = ((rows[order[:head]] - query) ** 2).sum(1)
    bar = np.partition(near, k - 1)[k - 1] if head >= k else np.inf
    kept, looked = [order[:head][near <= bar]], head * dim
    if head < n:
        alive = order[head:]
        partial, looked = first[alive], looked + len(alive) * columns
        for at in range(0, dim, columns):
            to = min(at + columns, dim)
            if at:
                block = rows[alive, at:to] - query[at:to]
                partial = partial + (block * block).sum(1)
                looked += block.size
            slack = 1 + 1e-9  # for rounding in `first`
            limit = bar * slack if to == dim else bar * slack * (to / dim) * (1 + epsilon / np.sqrt(to)) ** 2
            keep = partial <= limit
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        kept.append(alive)
    return np.concatenate(kept), looked


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    probe_share: float = 0.75,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Each query's k nearest rows found: query_id, rank from 1, the id column, score (inner product in doubles).

    A query's own id is no candidate; ties go to the smaller id; where fewer than k rows are found in the nearest
    `probe_share` of the lists, further lists are probed until k others are covered or all rows are. Rows with a null
    id, or a null, empty, zero, partly null or non-finite vector take no part. Only vectors of equal length meet: every
    length has an index of its own, and jobs of its own. A repeated row is a candidate as often as it occurs; a repeated query id is one query (its smallest
    vector). Other columns are ignored; an empty table gives no rows. Jobs run at once: lengths and norms, a sample of
    at most `SAMPLE_ROWS` vectors for the centroids, and the sizes of the lists.
    """
    spark = df.sparkSession
    out = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def plain(table: DataFrame) -> DataFrame:
        double = F.col(vector_col).cast("array<double>")
        return table.where(usable(double) & F.exists(double, lambda x: x != 0) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), double.alias("v")
        )

    rows = plain(df)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("sq"))
    asked = plain(queries).groupBy(F.size("v").alias("dim"), "id").agg(F.min("v").alias("v"))
    found = [
        _nearest(
            rows.where(F.size("v") == r["dim"]), asked.where(F.col("dim") == r["dim"]).drop("dim"),
            r["dim"], r["n"], float(np.sqrt(r["sq"])), k, lists, probe_share, part_rows,
        )
        for r in lengths.orderBy("dim").collect()
    ]
    if not found:
        return spark.createDataFrame([], out)
    order = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "id")
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _nearest(
    rows: DataFrame,
    asked: DataFrame,
    dim: int,
    n: int,
    largest: float,
    k: int,
    lists: int | None,
    probe_share: float,
    part_rows: int,
) -> DataFrame:
    """Candidates (query_id, id, score, dim) among vectors of one length: `n` rows (id, v), norms up to `largest`."""
    spark = rows.sparkSession
    turn = rotation(dim + 1)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    turned = augmented(np.array(sample.tolist(), np.float64), largest, turn)
    centroids = fit_centroids(turned, min(lists or min(max(1, round(n**0.5 / 4)), 1024), len(turned)))
    sizes_of = (centroids * centroids).sum(1)

    def to_lists(x: np.ndarray) -> np.ndarray:
        return sizes_of - 2 * x @ centroids.T

    indexed_schema = "list int, id bigint, v array<double>, t array<double>"

    def index(batches):
        for frame in batches:
            x = np.array(frame["v"].tolist(), np.float64).reshape(-1, dim)
            t = augmented(x, largest, turn)
            yield pd.DataFrame({"list": to_lists(t).argmin(1).astype("int32"), "id": frame["id"], "v": frame["v"], "t": list(t)})

    indexed = rows.mapInPandas(index, indexed_schema)
    sizes = np.zeros(len(centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    parts = np.maximum(1, -(-sizes // part_rows))
    probes = max(1, int(np.ceil(probe_share * len(centroids))))
    offset = np.concatenate([[0], np.cumsum(parts)])

    def probe(batches):
        for frame in batches:
            x = np.array(frame["v"].tolist(), np.float64).reshape(-1, dim)
            t = np.column_stack([x, np.zeros(len(x))]) @ turn
            order = np.argsort(to_lists(t), axis=1, kind="stable")
            covered = np.cumsum(sizes[order], axis=1)
            count = np.minimum(np.maximum(probes, 1 + (covered < k + 1).sum(1)), len(centroids))
            chosen = [[p for c in o[:m] for p in range(offset[c], offset[c + 1])] for o, m in zip(order, count)]
            yield pd.DataFrame({"part": chosen, "id": frame["id"], "v": frame["v"], "t": list(t)})

    asked = asked.mapInPandas(probe, "part array<int>, id bigint, v array<double>, t array<double>")
    asked = asked.withColumn("part", F.explode("part"))
    places = spark.createDataFrame(
        [(c, int(offset[c]), int(parts[c])) for c in range(len(centroids))], "list int, first int, parts int"
    )
    dealt = indexed.join(F.broadcast(places), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"), "id", "v", "t"
    )

    def scan(key, left, right):
        asking, found, scored = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            ids, x = left["id"].to_numpy(), np.array(left["v"].tolist(), np.float64)
            t, turned = np.array(left["t"].tolist(), np.float64), np.array(right["t"].tolist(), np.float64)
            for at, (query_id, v) in enumerate(zip(right["id"].tolist(), right["v"])):
                if at % QUERY_ROWS == 0:
                    firsts = first_block(t, turned[at : at + QUERY_ROWS], COLUMNS)
                own = ids == query_id
                near, _ = scan_list(t, turned[at], k + int(own.sum()), COLUMNS, EPSILON, firsts[at % QUERY_ROWS])
                near = near[~own[near]]
                scores = x[near] @ v
                best = np.lexsort((ids[near], -scores))[:k]
                asking.append(np.full(len(best), query_id))
                found.append(ids[near][best])
                scored.append(scores[best])
        return pd.DataFrame({"query_id": np.concatenate(asking), "id": np.concatenate(found), "score": np.concatenate(scored)})

    best = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(
        scan, "query_id bigint, id bigint, score double"
    )
    return best.withColumn("dim", F.lit(dim))
