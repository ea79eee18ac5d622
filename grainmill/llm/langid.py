"""Language identification by a small convolutional network over bytes.

Text is cut into windows of fixed length. Each byte has a learned vector; filters of several widths run over them,
the largest response of a filter in a window is kept, and a softmax layer reads off the language. The network is
trained in numpy on labelled windows and applied to all windows of a text, batch by batch; a document's probabilities
are the mean of its windows' log probabilities, weighted by their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.llm import bytesops

WINDOW = 256
VECTOR = 8
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
SAMPLE_ROWS = 1500  # documents of each language
SAMPLE_WINDOWS = 4  # of each sampled document
EPOCHS, BATCH, RATE = 6, 64, 0.01
BATCH_WINDOWS = 512
UNKNOWN = "und"
SEED = 23

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Network:
    """Byte vectors, filters as (longest width * vector, filters), their constants, the output layer, and its names."""

    vectors: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    names: tuple[str, ...]


def _mask() -> np.ndarray:
    """1 where a filter has a weight: narrow filters look at the first bytes only."""
    longest = max(WIDTHS)
    return np.column_stack(
        [np.repeat((np.arange(longest) < w).astype(np.float32), VECTOR) for w in WIDTHS for _ in range(FILTERS)]
    )


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as rows of WINDOW + longest - 1 bytes (zero beyond the text), their row, and their bytes of text."""
    lengths = np.diff(off)
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = off[:-1][owner] + place * WINDOW
    ends = off[1:][owner]
    wide = WINDOW + max(WIDTHS) - 1
    index = starts[:, None] + np.arange(wide)
    inside = index < ends[:, None]
    padded = np.where(inside, data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return padded, owner, np.minimum(ends - starts, WINDOW)


def _columns(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(windows, places, longest * VECTOR) of the byte vectors under a filter at each place."""
    longest = max(WIDTHS)
    e = vectors[x]
    flat = e.reshape(len(x), -1)
    strides = (flat.strides[0], VECTOR * flat.itemsize, flat.itemsize)
    return np.lib.stride_tricks.as_strided(flat, (len(x), WINDOW, longest * VECTOR), strides)


def forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities, pooled responses, the places of the largest responses, and the columns."""
    columns = np.ascontiguousarray(_columns(x, net.vectors))
    response = (columns.reshape(-1, columns.shape[2]) @ net.filters).reshape(len(x), WINDOW, -1)
    best = response.max(1)
    pooled = np.maximum(best + net.shift, 0)
    logits = pooled @ net.out + net.bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True)), pooled, response, columns


def train(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy of single windows, a fixed order for each epoch."""
    rng = np.random.default_rng(SEED)
    mask = _mask()
    count = mask.shape[1]
    net = {
        "vectors": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        "filters": (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32),
        "shift": np.zeros(count, np.float32),
        "out": rng.normal(0, 0.1, (count, len(names))).astype(np.float32),
        "bias": np.zeros(len(names), np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step, longest = 0, max(WIDTHS)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            xb, yb = x[rows], y[rows]
            model = Network(**net, names=names)
            log_p, pooled, response, columns = forward(model, xb)
            d_logit = np.exp(log_p)
            d_logit[np.arange(len(yb)), yb] -= 1
            d_logit /= len(yb)
            d_pool = (d_logit @ net["out"].T) * (pooled > 0)
            place = response.argmax(1)
            at = np.arange(len(xb))[:, None]
            picked = columns[at, place]  # windows, filters, longest * VECTOR
            gradients = {
                "out": pooled.T @ d_logit,
                "bias": d_logit.sum(0),
                "shift": d_pool.sum(0),
                "filters": np.einsum("nf,nfc->cf", d_pool, picked) * mask,
            }
            d_columns = (d_pool[:, :, None] * net["filters"].T[None]).reshape(len(xb), count, longest, VECTOR)
            under = xb[at[:, :, None], place[:, :, None] + np.arange(longest)]
            d_vectors = np.zeros((256, VECTOR))
            for v in range(VECTOR):
                d_vectors[:, v] = np.bincount(under.ravel(), d_columns[..., v].ravel(), 256)
            gradients["vectors"] = d_vectors
            step += 1
            for k, g in gradients.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                net[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(**net, names=names)


def sample(
    docs: DataFrame,
    keep: Column,
    limit: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """Windows, their language numbers and the languages' names, for training.

    About `limit` documents of each language with `keep` are taken, those with the smallest hashes of their ids (all,
    where there are fewer), and up to `SAMPLE_WINDOWS` windows spread over each of them are cut out by Spark: no whole
    text comes to the driver. Null texts, languages and ids are left out.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & keep)
    known = known.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    number = {n: i for i, n in enumerate(names)}
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(int(min(1.0, limit / n) * 2**30))).otherwise(share)
    size = F.length("text")
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)),
        lambda i: F.floor(F.greatest(size - WINDOW, F.lit(0)) * i / SAMPLE_WINDOWS),
    )
    cut = F.array_distinct(F.transform(starts, lambda s: F.substring("text", s.cast("int") + 1, F.lit(WINDOW))))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).select("id", "lang", cut.alias("parts"))
    rows = sorted(chosen.collect(), key=lambda r: (r["id"], r["lang"], r["parts"]))
    found = [(p.encode()[:WINDOW], number[r["lang"]]) for r in rows for p in r["parts"] if p]
    x, _, _ = windows(*bytesops.buffers(pa.array([p for p, _ in found], pa.binary())))
    return x, np.array([n for _, n in found], int), tuple(names)


def predict(net: Network, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number of each row and its probability; -1 and 0 for a row without a letter."""
    lengths = np.diff(off)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    some = letters[off[1:]] > letters[off[:-1]]
    for row in np.flatnonzero(~some & (lengths > 0)):
        some[row] = any(c.isalpha() for c in data[off[row] : off[row + 1]].tobytes().decode("utf-8", "replace"))
    total = np.zeros((len(lengths), len(net.names)))
    x, owner, sizes = windows(data, off)
    for start in range(0, len(x), BATCH_WINDOWS):
        rows = slice(start, start + BATCH_WINDOWS)
        log_p = forward(net, x[rows])[0] * sizes[rows, None]
        np.add.at(total, owner[rows], log_p)
    total /= np.maximum(lengths, 1)[:, None]
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return np.where(some, best, -1), np.where(some, p[np.arange(len(p)), best], 0.0)


def identify(df: DataFrame, net: Network, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """`df` with the predicted language and its probability.

    Null texts and texts without a letter get "und" and 0, and so does every text where no language was learned. Ties
    go to the language first in order. Columns of those names are replaced; other columns are kept.
    """
    names = np.array([*net.names, UNKNOWN], object)

    def values(data, off):
        if not net.names:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * (len(off) - 1), pa.string()), pa.array(np.zeros(len(off) - 1))], ["lang", "score"])
        best, p = predict(net, data, off)
        return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(p)], ["lang", "score"])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    kept, name = bytesops.others(df, (lang_name, score_name)), bytesops.free_name(df, "_langid")
    found = bytesops.with_values(df, text_col, name, kind, values)
    fields = [F.col(f"`{name}`.lang").alias(lang_name), F.col(f"`{name}`.score").alias(score_name)]
    return found.select(*[F.col(f"`{c}`") for c in kept], *fields)
