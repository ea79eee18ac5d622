"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned figures of its bytes and words and those of the lines before and
after it; transitions tie neighbouring lines together. Training takes a document's label for each of its lines (weak
labels), by full-batch gradient steps on the regularised likelihood. A document's quality is the mean of its lines'
forward-backward marginals weighted by their lengths, put on the labels' scale by a logistic calibration on documents
that trained no field.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, types as T

from grainmill.llm import bytesops, samples

#: Upper bin bounds of each figure of a line.
BINS = {
    "bytes": (20, 60, 150, 400, 1200),
    "words": (3, 8, 20, 60, 200),
    "word_bytes": (3.0, 4.2, 5.5, 7.0, 9.0),
    "upper": (0.01, 0.05, 0.2, 0.6),
    "digits": (0.005, 0.03, 0.1),
    "stops": (0.005, 0.02, 0.05, 0.1),
    "symbols": (0.002, 0.02, 0.06, 0.15),
    "distinct": (0.15, 0.4, 0.6, 0.8, 0.95),
    "repeated": (0.01, 0.05, 0.2),
    "wide": (0.001, 0.05, 0.15),
}
WIDTH = 6  # more than the bins of any figure
COUNT = 3 * len(BINS) * WIDTH
STEPS, RATE, RIDGE = 120, 0.1, 1e-4

_KIND = np.full(256, 4, np.uint8)  # 0 upper, 1 lower or part of a wide character, 2 digit, 3 stop, 4 symbol, 5 space
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "\"',-.:;?"]] = 3
_KIND[bytesops.SPACE] = 5


def line_figures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures of every line that is not blank, its length in bytes, and the offsets of each row's lines."""
    start, end = bytesops.spans(data != 10, off)
    lengths = end - start
    kinds = _KIND[data]

    def total(flags: np.ndarray) -> np.ndarray:
        running = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return running[end] - running[start]

    share = lambda kind: total(kinds == kind) / np.maximum(lengths, 1)
    letters = np.maximum(total(kinds <= 1), 1)
    w_start, w_end = bytesops.word_spans(data, off)
    hashes = bytesops.span_hashes(bytesops.LOWER[data], w_start, w_end)
    line = np.searchsorted(start, w_start, "right") - 1
    words = np.bincount(line, minlength=len(start))
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = (line[order][1:] != line[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(start))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeated = np.bincount(line[again], minlength=len(start))
    some = np.maximum(words, 1)
    figures = np.column_stack(
        [
            lengths,
            words,
            np.bincount(line, weights=w_end - w_start, minlength=len(start)) / some,
            total(kinds == 0) / letters,
            share(2),
            share(3),
            share(4),
            distinct / some,
            repeated / some,
            total(data >= 128) / np.maximum(lengths, 1),
        ]
    )
    keep = words > 0
    return figures[keep], lengths[keep], np.searchsorted(start[keep], off)


def features(figures: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Feature numbers of each line, three times as many as figures; `COUNT` stands for a missing neighbour."""
    own = np.column_stack([np.searchsorted(b, figures[:, i]) + i * WIDTH for i, b in enumerate(BINS.values())])
    own = own.reshape(-1, len(BINS))
    step = len(BINS) * WIDTH
    before, after = np.full_like(own, COUNT), np.full_like(own, COUNT)
    before[1:] = own[:-1] + step
    after[:-1] = own[1:] + 2 * step
    used = rows[:-1][np.diff(rows) > 0]
    last = rows[1:][np.diff(rows) > 0] - 1
    before[used] = COUNT
    after[last] = COUNT
    return np.column_stack([own, before, after])


@dataclass(frozen=True)
class Field:
    """Emission weights of label 1 (good), transitions [from, to], and the calibration of a document's mean."""

    emission: np.ndarray
    transition: np.ndarray
    calibration: np.ndarray


def _steps(rows: np.ndarray):
    """Lines in the order of their place in a document, as positions of the documents that reach it."""
    lengths = np.diff(rows)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = rows[:-1][order], lengths[order]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        yield starts[: np.searchsorted(-lengths, -t, "left")] + t


def marginals(scores: np.ndarray, transition: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition."""
    n = len(scores)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.column_stack([np.zeros(n), scores])
    steps = list(_steps(rows))
    for t, at in enumerate(steps):
        if t == 0:
            forward[at] = emit[at]
        else:
            before = forward[at - 1]
            for y in (0, 1):
                forward[at, y] = np.logaddexp(before[:, 0] + transition[0, y], before[:, 1] + transition[1, y]) + emit[at, y]
    for at in steps[:0:-1]:
        after = backward[at] + emit[at]
        for y in (0, 1):
            backward[at - 1, y] = np.logaddexp(transition[y, 0] + after[:, 0], transition[y, 1] + after[:, 1])
    joint = forward + backward
    log_z = np.logaddexp(joint[:, 0], joint[:, 1])
    good = np.exp(joint[:, 1] - log_z)
    expected = np.zeros((2, 2))
    if len(steps) > 1:
        at = np.concatenate(steps[1:])
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.exp(
                    forward[at - 1, a] + transition[a, b] + emit[at, b] + backward[at, b] - log_z[at]
                ).sum()
    return good, expected


def _emit(feature: np.ndarray, emission: np.ndarray) -> np.ndarray:
    return emission[feature].sum(1)


def fit_field(feature: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam steps on the mean log likelihood per line."""
    y = np.repeat(labels, np.diff(rows)).astype(float)
    inner = np.ones(len(y), bool)
    inner[rows[:-1][np.diff(rows) > 0]] = False
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (inner & (y == label)).sum()
    size = COUNT + 1
    w = np.zeros(size + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        good, expected = marginals(_emit(feature, w[:size]), w[size:].reshape(2, 2), rows)
        gradient = np.empty_like(w)
        gradient[:size] = np.bincount(feature.ravel(), np.repeat(y - good, feature.shape[1]), size)
        gradient[size:] = (seen - expected).ravel()
        gradient = gradient / len(y) - RIDGE * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        w += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:size], w[size:].reshape(2, 2)


def document_means(field: Field, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log odds of each row's length-weighted mean marginal; 0 for a row without a line."""
    figures, lengths, rows = line_figures(data, off)
    if not len(figures):
        return np.zeros(len(off) - 1)
    good, _ = marginals(_emit(features(figures, rows), field.emission), field.transition, rows)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(rows))
    weight = np.bincount(owner, lengths, len(off) - 1)
    mean = np.bincount(owner, good * lengths, len(off) - 1) / np.maximum(weight, 1)
    mean = np.clip(np.where(weight > 0, mean, 0.5), 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def train(sample: samples.Sample) -> Field:
    """A field from three quarters of the sample, calibrated on the rest. With one label only, scores are constant."""
    flat = Field(np.zeros(COUNT + 1), np.zeros((2, 2)), np.array([0.0, np.log((sample.rate + 1e-3) / (1 - sample.rate + 1e-3))]))
    cut = len(sample.texts) * 3 // 4
    known = [set(sample.labels[:cut]), set(sample.labels[cut:])]
    if known != [{0, 1}, {0, 1}]:
        return flat
    parts, counts = [], [np.zeros(1, int)]
    for _, data, off in bytesops.joined(sample.texts[:cut]):
        figures, _, rows = line_figures(data, off)
        parts.append(features(figures, rows).astype(np.int16))
        counts.append(np.diff(rows))
    field = fit_field(np.concatenate(parts), np.cumsum(np.concatenate(counts)), sample.labels[:cut])
    field = Field(*field, flat.calibration)
    means = np.concatenate([document_means(field, data, off) for _, data, off in bytesops.joined(sample.texts[cut:])])
    weights = samples.logistic(means[:, None], sample.labels[cut:].astype(float))
    weights[-1] += sample.shift(sample.labels[cut:])
    return Field(field.emission, field.transition, weights)


def scores(field: Field, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return samples.probability(document_means(field, data, off)[:, None], field.calibration)


def score(df: DataFrame, field: Field, text_col: str = "text", name: str = "score") -> DataFrame:
    """`df` with a column of scores from 0 to 1, higher for good text.

    Null, empty and blank texts have no line and get the score of even odds after calibration. A column called `name`
    is replaced; other columns are kept whatever their names.
    """
    return bytesops.with_values(df, text_col, name, T.DoubleType(), lambda data, off: scores(field, data, off))
