"""Closest known spelling of a value, by an index of the known names (pandas UDF, used on distinct unmatched values).

The similarity is difflib's: twice the matched characters over both lengths. Matched characters lie in order, so a
common subsequence is never shorter, and neither are the characters that two texts share in any order. `SpellingIndex`
counts shared characters with all names at once from lists per character, takes the names from the highest bound down,
bounds them again by the longest common subsequence, and compares only what may still win.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD_BITS = 64
FIRST, MORE = 16, 256  # names bounded again in the first and in later rounds
LEVELS = (0.95, 0.85, 0.75, 0.65)


class SpellingIndex:
    def __init__(self, names: Sequence[str]):
        self.names = sorted(set(names), key=len)
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        places: dict[str, tuple[list[int], list[int]]] = {}
        for at, name in enumerate(self.names):
            for sign, count in Counter(name).items():
                where, counts = places.setdefault(sign, ([], []))
                where.append(at)
                counts.append(count)
        self.places = {sign: (np.array(w), np.array(c)) for sign, (w, c) in places.items()}
        # a sign that many names have is counted in a row over all names instead
        self.rows = {}
        if len(self.names) and self.lengths[-1] < 1 << 15:
            for sign, (where, counts) in self.places.items():
                if len(where) * 16 > len(self.names):
                    self.rows[sign] = np.zeros(len(self.names), np.uint16)
                    self.rows[sign][where] = counts

    def shared(self, value: str, low: int, high: int) -> np.ndarray:
        """Characters that the value and each of the names `low` to `high` have in common, in any order."""
        out, dense = np.zeros(high - low, np.int64), np.zeros(high - low, np.uint16)
        for sign, count in Counter(value).items():
            if sign in self.rows:
                dense += np.minimum(self.rows[sign][low:high], np.uint16(min(count, 1 << 15)))
            elif sign in self.places:
                where, counts = self.places[sign]
                a, b = np.searchsorted(where, [low, high])
                out[where[a:b] - low] += np.minimum(counts[a:b], count)
        return out + dense

    def subsequences(self, value: str, which: np.ndarray) -> np.ndarray:
        """Longest common subsequence of the value and each of the names; the value's length beyond 64 characters."""
        if len(value) > WORD_BITS:
            return np.full(len(which), len(value))
        masks: dict[str, int] = {}
        for i, sign in enumerate(value):
            masks[sign] = masks.get(sign, 0) | 1 << i
        width = int(self.lengths[which].max(initial=0))
        matches = np.zeros((len(which), width), np.uint64)
        for r, at in enumerate(which.tolist()):
            name = self.names[at]
            matches[r, : len(name)] = [masks.get(sign, 0) for sign in name]
        state = np.full(len(which), np.uint64(2**64 - 1))  # a zero bit per matched character of the value
        with np.errstate(over="ignore"):
            for i in range(width):
                both = state & matches[:, i]
                state = (state + both) | (state - both)
        keep = np.uint64(2 ** len(value) - 1)
        return np.bitwise_count(~state & keep).astype(np.int64)

    def closest(self, value: str, cutoff: float = 0.6) -> tuple[str | None, int]:
        """The name of highest similarity, at least `cutoff` (ties: the larger name), and how many were compared."""
        if not self.names or not 0 < cutoff <= 1:
            raise ValueError("names and a cutoff over 0 are needed")
        size = len(value)
        # 2 min / (sum) >= cutoff bounds the lengths that come into question
        low = int(np.searchsorted(self.lengths, np.ceil(size * cutoff / (2 - cutoff) - 1e-9), "left"))
        high = int(np.searchsorted(self.lengths, np.floor(size * (2 - cutoff) / cutoff + 1e-9), "right"))
        total = self.lengths[low:high] + size
        bound = np.where(total > 0, 2.0 * self.shared(value, low, high) / np.maximum(total, 1), 1.0)
        best: tuple[float, str] | None = None
        matcher, compared = SequenceMatcher(), 0
        matcher.set_seq2(value)
        above = np.inf
        for level in [t for t in LEVELS if t > cutoff] + [cutoff]:  # the few names of high bounds first
            if best and best[0] > above:
                break
            left = np.flatnonzero((bound >= level) & (bound < above))
            left, above, step = left[np.argsort(-bound[left], kind="stable")], level, FIRST
            while len(left):
                part, left = left[:step], left[step:]
                step = MORE
                tighter = np.minimum(bound[part], 2.0 * self.subsequences(value, part + low) / np.maximum(total[part], 1))
                tighter[total[part] == 0] = 1.0
                for at in np.argsort(-tighter, kind="stable").tolist():
                    if tighter[at] < (best[0] if best else cutoff):
                        break
                    name = self.names[low + int(part[at])]
                    matcher.set_seq1(name)
                    compared += 1
                    ratio = matcher.ratio()
                    if ratio >= cutoff and (best is None or (ratio, name) > best):
                        best = (ratio, name)
                if best:
                    left = left[bound[left] >= best[0]]
        return (best[1] if best else None), compared


def closest(c: Column, known: Sequence[str], cutoff: float = 0.6) -> Column:
    """Best match of the stripped, lower-cased text among `known` with a similarity of at least `cutoff`, else null.

    The index of the names goes to every task; its size is that of the names. Without names there is no match.
    """
    if not known:
        return F.lit(None).cast("string")
    index = SpellingIndex(known)

    @F.pandas_udf(T.StringType())
    def match(values: pd.Series) -> pd.Series:
        found = [index.closest(value.strip().lower(), cutoff)[0] if value is not None else None for value in values]
        return pd.Series(found, dtype=object)

    return match(c)
