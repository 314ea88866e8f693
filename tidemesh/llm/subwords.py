"""Distinct words of a block of texts and their character n-grams, as hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemesh.llm import kernel as K

_LETTERED = np.zeros(256, dtype=bool)
_LETTERED[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Marks of n-grams that begin or end their word.
_BEGINS, _ENDS = np.uint64(0x632BE59BD9B4E019), np.uint64(0xC2B2AE3D27D4EB4F)


class Distinct:
    """The distinct words of a block: ``codes`` numbers each word's in order, ``start`` and ``end`` are one place of each, ``hashes`` its hash."""

    def __init__(self, text: pa.Array, parts: bool) -> None:
        self.words = w = K.Words(text, parts=parts)
        self.rolling = K.Rolling(K.byte_codes(w.data), K.BASES[0])
        self.codes, self.hashes = pd.factorize(self.rolling.ranges(w.start, w.end))
        at = np.zeros(len(self.hashes), dtype=np.int64)
        at[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        self.start, self.end = w.start[at], w.end[at]
        self._heads = np.append(np.flatnonzero((w.data & 0xC0) != 0x80), len(w.data))

    def lettered(self) -> np.ndarray:
        """Which hold an ASCII letter or a character beyond ASCII."""
        count = np.zeros(len(self.words.data) + 1, dtype=np.int64)
        np.cumsum(_LETTERED[self.words.data], out=count[1:])
        return count[self.end] > count[self.start]

    def grams(self, k: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, which distinct word each belongs to) of the runs of k characters, marked if they begin or end the word."""
        which = np.arange(len(self.start)) if which is None else which
        first = np.searchsorted(self._heads, self.start[which])
        last = np.searchsorted(self._heads, self.end[which])
        n = np.maximum(last - first - k + 1, 0)
        owner = np.repeat(np.arange(len(which)), n)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        h = self.rolling.ranges(self._heads[at], self._heads[at + k])
        h = np.where(at == first[owner], h ^ _BEGINS, h)
        return K.mix(np.where(at + k == last[owner], h ^ _ENDS, h)), which[owner]


    def beginnings(self, k: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, which distinct word each belongs to) of the first k characters of the words that have more."""
        first = np.searchsorted(self._heads, self.start[which])
        longer = np.searchsorted(self._heads, self.end[which]) - first > k
        first = first[longer]
        return K.mix(self.rolling.ranges(self._heads[first], self._heads[first + k]) ^ _BEGINS), which[longer]


class Table:
    """Values by 64-bit hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)
