"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text: the passages of toxic documents whose byte n-grams set
them apart from ordinary ones. Both hold the ordinary dictionary as background, in the ordinary one with a neutral
filler in place of the toxic content, so the same settings compress with both and only toxic content can make a
difference. A window is a word between spaces, three times over, which is long enough to be compressed at all. A
window's gap is its length under the ordinary dictionary minus that under the toxic one. A document's three largest
gaps of different words, and how many and how large a share of its windows have a gap, are turned into a score by a
logistic calibration on labelled documents that trained no dictionary.

Every word of a text is a window; equal words of a chunk of texts are compressed once. A run of more than `PIECE`
bytes without spaces is cut into overlapping windows that cover the whole run.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, types as T

from grainmill.llm import bytesops, samples

NGRAMS = (5, 6, 8)
LEAST_DOCUMENTS = 5  # toxic documents that must hold an n-gram
LEAST_EVIDENCE = 30.0  # nats of n * log(toxic rate / ordinary rate)
LEAST_RATIO = 10.0
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
PIECE, STEP = 200, 136  # bytes of a window of a long run, and from one to the next
CELLS = 1 << 25  # counters for n-grams of long runs, of which only frequent ones are kept
REPEAT = 3
LEAST_GAP = 2
GAPS = 3
SEED = 3
TASK_BYTES = 1_000_000  # of text scored at once; a smaller chunk compresses the same words more often


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _words(text: bytes) -> list[bytes]:
    return bytesops.LOWER[np.frombuffer(text, np.uint8)].tobytes().split()


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of at most `PIECE` bytes that cover the given ones, and the place of each one's given span."""
    count = 1 + np.maximum(-(-(end - start - PIECE) // STEP), 0)
    of = np.repeat(np.arange(len(start)), count)
    first = start[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + PIECE, end[of]), of


def _cut(words: list[bytes]) -> list[bytes]:
    start, end, of = pieces(np.zeros(len(words), np.int64), np.array([len(w) for w in words], np.int64))
    return [words[i][s:e] for i, s, e in zip(of.tolist(), start.tolist(), end.tolist())]


def _grams(padded: bytes):
    return ((k, n) for n in NGRAMS for k in range(len(padded) - n + 1))


def _cells(padded: bytes) -> np.ndarray:
    data = np.frombuffer(padded, np.uint8)
    at = np.concatenate([np.arange(len(data) - m + 1) for m in NGRAMS])
    size = np.repeat(NGRAMS, [len(data) - m + 1 for m in NGRAMS])
    return (bytesops.span_hashes(data, at, at + size) % np.uint64(CELLS)).astype(np.int64)


def frequent_grams(toxic: Counter) -> Counter:
    """N-grams of words with the numbers of documents that hold these words, `LEAST_DOCUMENTS` or more.

    An n-gram of long runs only is counted by its text once its counter has enough, so memory does not hold all.
    """
    found: Counter = Counter()
    long = {w: n for w, n in toxic.items() if len(w) > PIECE}
    for word, n in toxic.items():
        if word not in long:
            padded = b" " + word + b" "
            for gram in {padded[k : k + m] for k, m in _grams(padded)}:
                found[gram] += n
    if long:
        counters = np.zeros(CELLS, np.int32)
        for word, n in long.items():
            counters[np.unique(_cells(b" " + word + b" "))] += n
        for word, n in long.items():
            padded = b" " + word + b" "
            enough = (counters[_cells(padded)] >= LEAST_DOCUMENTS).tolist()
            for gram in {g for (k, m), many in zip(_grams(padded), enough) if (g := padded[k : k + m]) in found or many}:
                found[gram] += n
    return Counter({g: n for g, n in found.items() if n >= LEAST_DOCUMENTS})


def distinctive(toxic: Counter, ordinary: Counter, n_toxic: int, n_ordinary: int) -> Counter:
    """Stretches of toxic documents' words covered by n-grams that set these documents apart, with their counts."""
    of_toxic = frequent_grams(toxic)
    of_ordinary: Counter = Counter()
    for word, n in ordinary.items():
        padded = b" " + word + b" "
        for gram in {g for k, m in _grams(padded) if (g := padded[k : k + m]) in of_toxic}:
            of_ordinary[gram] += n
    marks = set()
    for gram, n in of_toxic.items():
        ratio = (n / n_toxic) / ((of_ordinary[gram] + 0.5) / n_ordinary)
        if ratio > LEAST_RATIO and n * np.log(ratio) > LEAST_EVIDENCE:
            marks.add(gram)
    found: Counter = Counter()
    for word, n in toxic.items():
        padded = b" " + word + b" "
        covered = np.zeros(len(padded) + 2, np.int8)
        for k, m in _grams(padded):
            if padded[k : k + m] in marks:
                covered[k + 1 : k + m + 1] = 1
        edges = np.flatnonzero(np.diff(covered))
        for start, end in zip(edges[::2], edges[1::2]):
            found[padded[start:end]] += n
    return found


def _dictionary(parts: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes, or the joined parts where there is too little text to train on."""
    try:
        return zstandard.train_dictionary(size, parts, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def train(sample: samples.Sample) -> Model:
    """Dictionaries from three quarters of the sample, calibration on the rest."""
    rate = sample.rate
    constant = Model(b"", b"", (0.0,) * (GAPS + 2) + (float(np.log((rate + 1e-3) / (1 - rate + 1e-3))),))
    cut = len(sample.texts) * 3 // 4
    toxic, ordinary, drawn = Counter(), Counter(), []
    rng, counts = np.random.default_rng(SEED), [0, 0]
    for text, label in zip(sample.texts[:cut], sample.labels[:cut]):
        words = _words(text)
        counts[label] += 1
        (toxic if label else ordinary).update(set(words))
        words = _cut(words)
        if words and not label:
            picked = rng.integers(0, len(words), min(len(words), 40))
            drawn.append(b" " + b" ".join(words[i] for i in picked) + b" ")
    if not all(counts):
        return constant
    found = distinctive(toxic, ordinary, *counts[::-1])
    if not found:
        return constant
    stretches = [s for s, n in sorted(found.items()) for _ in range(min(n, 12))]
    stretches = [stretches[i] for i in rng.permutation(len(stretches))]
    content = _dictionary([b"".join(stretches[i : i + 8]) for i in range(0, len(stretches), 8)], TOXIC_BYTES)
    background = _dictionary(drawn, ORDINARY_BYTES)
    filler = rng.integers(128, 192, len(content), dtype=np.uint8).tobytes()
    model = Model(filler + background, content + background, constant.weights)
    gaps = np.concatenate([document_gaps(model, data, off) for _, data, off in bytesops.joined(sample.texts[cut:])])
    weights = samples.logistic(gaps, sample.labels[cut:].astype(float))
    weights[-1] += sample.shift(sample.labels[cut:])
    return Model(model.ordinary, model.toxic, tuple(weights.tolist()))


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if content not in _COMPRESSORS:
        settings = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=13, chain_log=13, search_log=3, min_match=5, target_length=16,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        _COMPRESSORS[content] = zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)
    return _COMPRESSORS[content]


def document_gaps(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's `GAPS` largest gaps of different words, in descending order, and the logarithms of how many of its
    words, and how many in 1,000 of its windows, have one. Gaps under `LEAST_GAP` count as none."""
    out = np.zeros((len(off) - 1, GAPS + 2))
    if not model.toxic or not len(data):
        return out
    low = bytesops.LOWER[data]
    whole_start, whole_end = bytesops.word_spans(low, off)
    start, end, of = pieces(whole_start, whole_end)
    left, right = start == whole_start[of], end == whole_end[of]
    with np.errstate(over="ignore"):
        hashes = bytesops.span_hashes(low, start, end) + np.uint64(0x9E3779B97F4A7C15) * (2 * left + right).astype(np.uint64)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw, plain, tainted = low.tobytes(), compressor(model.ordinary).compress, compressor(model.toxic).compress
    gaps = np.empty(len(first), np.int64)
    for i, (s, e, x, y) in enumerate(zip(start[first].tolist(), end[first].tolist(), left[first].tolist(), right[first].tolist())):
        window = (b" " * x + raw[s:e] + b" " * y) * REPEAT
        gaps[i] = len(plain(window)) - len(tainted(window))
    hits = np.flatnonzero(gaps[inverse] >= LEAST_GAP)
    pairs = np.unique(np.column_stack([bytesops.owners(start, off)[hits], -gaps[inverse[hits]], inverse[hits]]), axis=0)
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    found = np.bincount(pairs[:, 0], minlength=len(out))
    windows = np.bincount(bytesops.owners(start, off), minlength=len(out))
    out[:, GAPS] = np.log1p(found)
    out[:, GAPS + 1] = np.log1p(1000 * found / np.maximum(windows, 1))
    pairs, place = pairs[place < GAPS], place[place < GAPS]
    out[pairs[:, 0], place] = -pairs[:, 1]
    return out


def scores(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return samples.probability(document_gaps(model, data, off), np.array(model.weights))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`df` with a column of scores from 0 to 1; null and empty texts get the score of no toxic window.

    Without both labels, or without anything that sets toxic text apart, every score is the rate of toxic labels. A
    column called `name` is replaced; other columns are kept whatever their names.
    """
    return bytesops.with_values(df, text_col, name, T.DoubleType(), lambda data, off: scores(model, data, off), TASK_BYTES)
