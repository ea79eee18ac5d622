"""Quality rules: counted figures of a text against fixed thresholds, and a logistic regression on hashed n-grams.

The counted rules are exact. The verdict on what passes them is a logistic regression over hashed word n-grams (one and
two words, A-Z folded) and hashed byte n-grams (three to five bytes), trained on labelled quality rows and calibrated
to a probability on rows that trained no weight. A text's features are its n-grams' shares, so long and short texts
are alike to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm import bytesops, samples

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
KEEP = 0.3

SAMPLE_ROWS = 1000  # labelled documents of either label that are learned from, whole texts
BUCKETS = 1 << 16  # per family
CHARS = (3, 4, 5)
FAMILIES = ("word", "pair", *(f"char{n}" for n in CHARS))
STEPS, RATE, RIDGE = 60, 1.0, 1e-5
PIECE = 1 << 20  # bytes of one text handled at a time

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

RESULT = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64()),
)
KINDS = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


# ---------------------------------------------------------------- pieces of texts


def pieces(data: np.ndarray, off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows, and cuts of rows longer than `limit`: bytes, offsets, and the row of each offset.

    A long row is cut behind white space where its next `limit` bytes have any, else in the middle of a word.
    """
    start = 0
    while start < len(off) - 1:
        stop = max(int(np.searchsorted(off, off[start] + limit, "right")) - 1, start + 1)
        if off[stop] - off[start] <= limit:
            yield data[off[start] : off[stop]], off[start : stop + 1] - off[start], np.arange(start, stop)
        else:
            at, end = int(off[start]), int(off[stop])
            while at < end:
                cut = min(at + limit, end)
                if cut < end:
                    space = np.flatnonzero(bytesops.SPACE[data[at:cut]])
                    cut = at + int(space[-1]) + 1 if len(space) else cut
                yield data[at:cut], np.array([0, cut - at]), np.array([start])
                at = cut
        start = stop


def line_hashes(data: np.ndarray, off: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every line that holds a word, exact in its bytes. A line longer than `limit` is hashed in parts
    cut at multiples of `limit` from its start."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    start, end = bytesops.spans(data != 10, off)
    owner = bytesops.owners(start, off)
    first = 0
    while first < len(start):
        stop = max(int(np.searchsorted(end, start[first] + limit, "right")), first + 1)
        base, upto = int(start[first]), int(end[stop - 1])
        if upto - base <= limit:
            part, s, e = data[base:upto], start[first:stop] - base, end[first:stop] - base
            running = np.concatenate([[0], np.cumsum(~bytesops.SPACE[part])])
            h, wordy = bytesops.span_hashes(part, s, e), running[e] > running[s]
        else:
            value, some = np.uint64(0), False
            for at in range(base, upto, limit):
                part = data[at : min(at + limit, upto)]
                own = bytesops.span_hashes(part, np.zeros(1, np.int64), np.array([len(part)]))
                with np.errstate(over="ignore"):
                    value = bytesops.mix(own ^ (value * np.uint64(31) + np.uint64(1)))[0]
                some = some or not bytesops.SPACE[part].all()
            h, wordy = np.array([value]), np.array([some])
        hashes.append(h[wordy])
        rows.append(owner[first:stop][wordy])
        first = stop
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class Words:
    """Words of some texts: exact hashes (for the rules) and folded hashes (for the features), with their rows."""

    exact: np.ndarray
    folded: np.ndarray
    row: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray


def words(data: np.ndarray, off: np.ndarray, limit: int = PIECE) -> Words:
    """All words, piece by piece. A word longer than a piece is joined from its parts, cut at multiples from its start."""
    rows = len(off) - 1
    exact, folded, owner = [], [], []
    chars, symbols = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    open_row = -1  # the row whose last word goes on in the next piece
    for part, part_off, part_rows in pieces(data, off, limit):
        start, end = bytesops.word_spans(part, part_off)
        own = part_rows[bytesops.owners(start, part_off)]
        inside = ~bytesops.SPACE[part]
        letters = np.concatenate([[0], np.cumsum(inside & ((part & 0xC0) != 0x80))])
        marks = np.concatenate([[0], np.cumsum(SYMBOLS[part])])
        chars[part_rows] += np.diff(letters[part_off])
        symbols[part_rows] += np.diff(marks[part_off])
        a, b = bytesops.span_hashes(part, start, end), bytesops.span_hashes(bytesops.LOWER[part], start, end)
        if open_row >= 0 and len(start) and start[0] == 0 and own[0] == open_row:
            with np.errstate(over="ignore"):
                for whole, new in ((exact, a), (folded, b)):
                    whole[-1][-1:] = bytesops.mix(new[:1] ^ (whole[-1][-1:] * np.uint64(31) + np.uint64(1)))
            a, b, own = a[1:], b[1:], own[1:]
        if len(a):
            exact.append(a)
            folded.append(b)
            owner.append(own)
        cut = len(part_rows) == 1 and len(part) and inside[-1]
        open_row = int(part_rows[0]) if cut else -1
    none = np.zeros(0, np.uint64)
    return Words(
        np.concatenate([none, *exact]),
        np.concatenate([none, *folded]),
        np.concatenate([np.zeros(0, np.int64), *owner]).astype(np.int64),
        chars,
        symbols,
    )


# ---------------------------------------------------------------- rules


def _again(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash occurs elsewhere in its row, and whether it is not the first of its kind there."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    h, r = hashes[order], rows[order]
    later = np.zeros(len(h), bool)
    later[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    either = later.copy()
    either[:-1] |= later[1:]
    some, second = np.zeros(len(h), bool), np.zeros(len(h), bool)
    some[order], second[order] = either, later
    return some, second


def repeated_words(hashes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Words of each row that lie in a window of three words found twice or more in the row."""
    inside = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        starts = np.flatnonzero(rows[2:] == rows[:-2])
        with np.errstate(over="ignore"):
            first, second = hashes[starts] * np.uint64(0x9E3779B97F4A7C15), hashes[starts + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
            windows = bytesops.mix(bytesops.mix(first) + bytesops.mix(second ^ np.uint64(0x165667B1)) * np.uint64(3) + hashes[starts + 2])
        found = starts[_again(windows, rows[starts])[0]]
        for shift in range(3):
            inside[found + shift] = True
    return np.bincount(rows[inside], minlength=count)


def figures(data: np.ndarray, off: np.ndarray, limit: int = PIECE) -> tuple[dict[str, np.ndarray], Words]:
    rows, found = len(off) - 1, words(data, off, limit)
    hashes, owner = line_hashes(data, off, limit)
    return {
        "n_words": np.bincount(found.row, minlength=rows),
        "word_chars": found.chars,
        "n_symbols": found.symbols,
        "n_dup_lines": np.bincount(owner[_again(hashes, owner)[1]], minlength=rows),
        "n_repeat_words": repeated_words(found.exact, found.row, rows),
    }, found


# ---------------------------------------------------------------- features


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray, found: Words, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Family number, bucket and row of every n-gram; byte n-grams do not cross rows or the cuts of long rows."""
    yield 0, _buckets(found.folded), found.row
    if len(found.folded) > 1:
        same = found.row[1:] == found.row[:-1]
        with np.errstate(over="ignore"):
            pairs = bytesops.mix(found.folded[:-1] * np.uint64(31) + found.folded[1:])
        yield 1, _buckets(pairs)[same], found.row[1:][same]
    for part, part_off, part_rows in pieces(data, off, limit):
        codes = bytesops.LOWER[part].astype(np.uint64)
        codes[bytesops.SPACE[part]] = 32
        row = np.repeat(part_rows, np.diff(part_off))
        grams = codes
        for n in range(2, max(CHARS) + 1):
            if len(codes) < n:
                break
            grams = (grams[:-1] << np.uint64(8)) | codes[n - 1 :]
            if n in CHARS:
                same = row[n - 1 :] == row[: len(row) - n + 1]
                with np.errstate(over="ignore"):
                    spread = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                yield 2 + CHARS.index(n), _buckets(spread)[same], row[n - 1 :][same]


@dataclass(frozen=True)
class Model:
    """Weights [family, bucket], a constant, and the calibration of the log odds."""

    weights: np.ndarray
    bias: float
    calibration: np.ndarray


def log_odds(model: Model, data: np.ndarray, off: np.ndarray, found: Words, limit: int = PIECE) -> np.ndarray:
    """Constant plus, per family, the mean weight of a row's n-grams."""
    rows = len(off) - 1
    sums, counts = np.zeros((len(FAMILIES), rows)), np.zeros((len(FAMILIES), rows))
    for family, bucket, row in features(data, off, found, limit):
        sums[family] += np.bincount(row, model.weights[family][bucket], rows)
        counts[family] += np.bincount(row, minlength=rows)
    return model.bias + (sums / np.maximum(counts, 1)).sum(0)


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text in order: text, feature number, square root of its share (unit length each family)."""
    row_parts, code_parts, value_parts = [], [], []
    for first, data, off in bytesops.joined(texts):
        found, rows = words(data, off), len(off) - 1
        keys = [family * BUCKETS + bucket + row * (BUCKETS * len(FAMILIES)) for family, bucket, row in features(data, off, found)]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row, code = np.divmod(key, BUCKETS * len(FAMILIES))
        group = row * len(FAMILIES) + code // BUCKETS
        total = np.bincount(group, count, rows * len(FAMILIES))
        row_parts.append((row + first).astype(np.int32))
        code_parts.append(code.astype(np.int32))
        value_parts.append((count / total[group]).astype(np.float32))
    return np.concatenate(row_parts), np.concatenate(code_parts), np.concatenate(value_parts)


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant by full-batch AdaGrad steps on the mean log loss. Features are scaled by their spread, so
    that rare n-grams move as readily as frequent ones."""
    row, code, share = _shares(texts)
    size = BUCKETS * len(FAMILIES)
    spread = np.sqrt(np.bincount(code, share.astype(np.float64) ** 2, size) / len(texts))
    scale = np.where(spread > 0, 1 / (spread + 1e-4), 0)
    value = (share * scale[code]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(texts)).mean())
    value /= max(norm, 1e-9)
    # a text counts by the other label's number, so both labels weigh the same; the calibration restores the rate
    ones = labels.sum()
    weight = np.where(labels == 1, len(labels) - ones, ones) / (2 * ones * (len(labels) - ones))
    w, bias, squares, bias_square = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):
        odds = bias + np.bincount(row, value * w[code], len(texts))
        error = (labels - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))) * weight
        gradient = np.bincount(code, value * error[row], size) - RIDGE * w
        squares += gradient**2
        w += RATE * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias += RATE * error.sum() / np.sqrt(bias_square)
    return (w * scale / max(norm, 1e-9)).reshape(len(FAMILIES), BUCKETS).astype(np.float32), bias


def odds_of(model: Model, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([log_odds(model, data, off, words(data, off)) for _, data, off in bytesops.joined(texts)])


def train(sample: samples.Sample) -> Model:
    """Weights from three quarters of the sample, calibrated on the rest. With one label only, scores are constant."""
    rate = np.log((sample.rate + 1e-3) / (1 - sample.rate + 1e-3))
    flat = Model(np.zeros((len(FAMILIES), BUCKETS), np.float32), 0.0, np.array([0.0, rate]))
    cut = len(sample.texts) * 3 // 4
    if [set(sample.labels[:cut]), set(sample.labels[cut:])] != [{0, 1}, {0, 1}]:
        return flat
    weights, bias = fit(sample.texts[:cut], sample.labels[:cut].astype(float))
    model = Model(weights, bias, flat.calibration)
    calibration = samples.logistic(odds_of(model, sample.texts[cut:])[:, None], sample.labels[cut:].astype(float), ridge=1e-2)
    calibration[-1] += sample.shift(sample.labels[cut:])
    return Model(weights, bias, calibration)


# ---------------------------------------------------------------- the operator


def judge(model: Model, data: np.ndarray, off: np.ndarray, keep: float = KEEP, limit: int = PIECE) -> dict[str, np.ndarray]:
    out, found = figures(data, off, limit)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
    out["score"] = samples.probability(log_odds(model, data, off, found, limit)[:, None], model.calibration)
    out["kept"] = ~out["base_failed"] & (out["score"] >= keep)
    return out


def apply_rules(df: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """`df` with the figures, `base_failed`, `kept` and `score` of every whole text.

    Null and empty texts have no word and fail. Rows that repeat are judged each. Columns of `df` that bear the name of
    a new one, in any case, are replaced; all others are kept as they are. An empty table gives no rows. Texts are read
    in chunks of 2 MB; a longer one in pieces of 1 MB, of which only its words' hashes (24 bytes a word) are held.
    """
    new = {name for name, _ in RESULT}
    columns = [f for f in df.schema.fields if f.name.lower() not in new or f.name == text_col]
    text = df[text_col].cast("string")
    names = [f"_c{i}" for i in range(len(columns))]  # positions, so that no name clashes
    inner = df.select(*[df[f"`{f.name}`"].alias(n) for f, n in zip(columns, names)], text.alias("_text"))

    def run(batches):
        for batch in bytesops.chunked(batches, "_text"):
            found = judge(model, *bytesops.buffers(bytesops.column(batch, "_text")), keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(found[name], kind) for name, kind in RESULT],
                names=names + [f"_n{i}" for i in range(len(RESULT))],
            )

    schema = inner.select(*names).schema
    for i, (_, kind) in enumerate(RESULT):
        schema = schema.add(f"_n{i}", KINDS[kind])
    out = inner.mapInArrow(run, schema)
    return out.toDF(*[f.name for f in columns], *[name for name, _ in RESULT])
