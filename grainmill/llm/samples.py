"""Bounded labelled samples for classifiers, and a small logistic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import bytesops

SAMPLE_ROWS = 3000
SKETCH = 6


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def held_out(id_col: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(id_col, modulus) == value, F.lit(False))


@dataclass(frozen=True)
class Sample:
    """Texts with labels 0 or 1, and how many labelled rows of either kind there are in all."""

    texts: list[bytes]
    labels: np.ndarray
    counts: tuple[int, int]

    @property
    def rate(self) -> float:
        """Share of label 1 among all labelled rows; 0 without any."""
        return self.counts[1] / sum(self.counts) if sum(self.counts) else 0.0

    def shift(self, labels: np.ndarray) -> float:
        """What brings log odds fitted on `labels` to the rate of all labelled rows."""
        part = (labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)
        return float(np.log((self.counts[1] + 0.5) / (self.counts[0] + 0.5)) - np.log(part))


def without_near_copies(texts: list[bytes]) -> list[int]:
    """Positions of the texts that are no near copy of an earlier one: fewer than half of `SKETCH` minima over hashed
    word pairs agree."""
    seen: dict[tuple[int, int], int] = {}
    kept = []
    factors = np.random.default_rng(11).integers(1, 2**62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for at, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        words, _ = bytesops.word_hashes(data, np.array([0, len(data)]))
        with np.errstate(over="ignore"):
            pairs = bytesops.mix(words[:-1] * np.uint64(31) + words[1:]) if len(words) > 1 else words
            keys = [(i, int((pairs * f).min())) for i, f in enumerate(factors)] if len(pairs) else []
        agreeing = Counter(seen[k] for k in keys if k in seen)
        if not agreeing or max(agreeing.values()) * 2 < SKETCH:
            kept.append(at)
            for k in keys:
                seen.setdefault(k, at)
    return kept


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    keep: Column,
    limit: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Sample:
    """At most `limit` documents of each label 0 and 1 with `keep` (on the column `id`), smallest hash of the id first.

    The rows are chosen on the ids alone, and only their texts are read to the driver. Other labels, null ids and null
    texts are left out, and so are near copies of a text that the sample has.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(keep & F.col("label").isin(0, 1) & F.col("id").isNotNull())
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(limit) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(parts[0].union(parts[1])), "id").select("id", "text", "label").collect()
    distinct = {(r["text"], r["label"]): r for r in sorted(rows, key=lambda r: (r["id"], r["label"], r["text"]))}
    rows = list(distinct.values())
    rows = [rows[i] for i in without_near_copies([r["text"].encode() for r in rows])]
    # Ids follow the order of ingestion; a fixed shuffle lets callers split the sample.
    rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    return Sample(
        [r["text"].encode() for r in rows],
        np.array([r["label"] for r in rows], int),
        (counts.get(0, 0), counts.get(1, 0)),
    )


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the last one for the constant, of a ridge logistic regression (Newton's rounds)."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * len(a) * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - ridge * len(a) * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
