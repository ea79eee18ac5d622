"""Exact top-k by inner product with pivot tables.

Vectors become whole numbers, floor(scale * x). Distances of every vector to a few pivots are computed once per block
of candidates. For a query q and a candidate x the triangle inequality gives d(q, x) >= max over pivots of
|d(q, p) - d(x, p)|, and so an upper bound of their inner product, (|q|^2 + |x|^2 - bound^2) / 2. Candidates are
evaluated in the order of that bound until the k-th score exceeds what is left: the result is exact.

Candidates and queries are dealt into blocks of bounded size; each block of queries meets each block of candidates once, and only
k rows per query and block are shuffled on.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SCALE = 1024
PIVOTS = 32
PIVOT_SAMPLE = 512
BLOCK_ROWS = 8192
QUERY_ROWS = 4096


def usable(vector: Column) -> Column:
    """The vector holds at least one component and no null, NaN or infinite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, v, dim) of the usable vectors, components floor(scale * x)."""
    double = F.col(vector_col).cast("array<double>")
    return df.where(usable(double) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(double, lambda x: F.floor(x * scale).cast("double")).alias("v"),
        F.size(double).alias("dim"),
    )


def choose_pivots(sample: list[list[float]], count: int) -> np.ndarray:
    """Far-apart rows of a sample: each next pivot is the row farthest from those chosen."""
    x = np.array(sample, np.float64)
    chosen = [0]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots])


def _exact(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; in doubles while every partial sum fits 53 bits."""
    if len(a) and np.abs(a).max() * max(np.abs(q).max(), 1) * len(q) < 2**53:
        return (a @ q).astype(np.int64)
    return a.astype(np.int64) @ q.astype(np.int64)


def search_block(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int
) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of each query's k best in the block, and how many inner products were evaluated."""
    table = _distances(x, pivots)
    of_queries = _distances(queries, pivots)
    norms, found, evaluated = (x * x).sum(1), [], 0
    for query_id, q, to_pivots in zip(query_ids.tolist(), queries, of_queries):
        lower = np.zeros(len(x))
        for p in range(len(pivots)):
            np.maximum(lower, np.abs(table[:, p] - to_pivots[p]), out=lower)
        size = float(q @ q)
        slack = 1e-9 * (size + norms.max(initial=0.0)) + 1e-6
        upper = (size + norms - lower * lower) / 2 + slack
        order = np.argsort(-upper, kind="stable")
        best: np.ndarray = np.zeros((0, 2), np.int64)
        step, at = max(64, 4 * k), 0
        while at < len(order):
            if len(best) == k and upper[order[at]] < best[-1, 0]:
                break
            part = order[at : at + step]
            at += step
            part = part[ids[part] != query_id]
            evaluated += len(part)
            best = np.vstack([best, np.column_stack([_exact(x[part], q), ids[part]])])
            best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
        found += [(query_id, i, s) for s, i in best.tolist()]
    return found, evaluated


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's k rows of largest inner product: query_id, rank from 1, the id column, score.

    The query's own id is no candidate; ties go to the smaller id; fewer than k candidates are all returned. Rows with
    a null id, or a null, empty, partly null or non-finite vector take no part. Only vectors of equal length meet. A
    repeated row is a candidate as often as it occurs, and a repeated query id is one query (its smallest vector).
    Other columns are ignored. An empty table gives no rows. Jobs run at once: two counts and the pivots of each length,
    taken from at most `PIVOT_SAMPLE` vectors, smallest hash first.
    """
    spark = df.sparkSession
    rows = whole_numbers(df, id_col, vector_col, scale)
    asked = whole_numbers(queries, id_col, vector_col, scale).groupBy("id", "dim").agg(F.min("v").alias("v"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {}
    for dim in sorted(counts):
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE)
        table[dim] = choose_pivots([r["v"] for r in sample.select("v").collect()], pivots)
    of_queries = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(d, -(-n // block_rows), max(1, -(-of_queries.get(d, 0) // query_rows))) for d, n in counts.items()],
        "dim int, blocks int, parts int",
    )
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda count: F.pmod(F.xxhash64("id", "v"), F.col(count)).cast("int")
    keys = ["dim", "block", "part"]
    dealt = rows.join(F.broadcast(blocks), "dim").withColumn("block", own("blocks")).withColumn("part", every("parts"))
    asked = asked.join(F.broadcast(blocks), "dim").withColumn("part", own("parts")).withColumn("block", every("blocks"))

    def search(key, left, right):
        found: list = []
        if len(left) and len(right):
            x = np.array(left["v"].tolist(), np.float64)
            q = np.array(right["v"].tolist(), np.float64)
            found, _ = search_block(left["id"].to_numpy(), x, right["id"].to_numpy(), q, table[int(key[0])], k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype("int64")

    parts = (
        dealt.select(*keys, "id", "v")
        .groupBy(*keys)
        .cogroup(asked.select(*keys, "id", "v").groupBy(*keys))
        .applyInPandas(search, "query_id bigint, id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        parts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
