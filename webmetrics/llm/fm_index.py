"""A bidirectional FM-index over word numbers, for phrases of bounded length.

The Burrows-Wheeler transform holds, for every suffix of the sequence in order, the word before it. All suffixes that
begin with a phrase lie in one interval, and the words before that interval are the phrase's left extensions; the
interval of an extended phrase follows from the number of equal words further up. A second transform of the reversed
sequence gives right extensions. Both intervals of a phrase are kept together: extending one narrows the other.

Suffixes are sorted by their first `DEPTH` words only, which is all that phrases of up to that length need.
Everything works on arrays of intervals at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of the longest phrase that intervals are right for.
DEPTH = 4
#: The number that no phrase contains. It stands between pieces of text and at both ends.
BREAK = 0


def transform(words: np.ndarray) -> np.ndarray:
    """The word before each suffix, suffixes in the order of their first four words."""
    if not len(words):
        return words.astype(np.int32)
    one = words.astype(np.int64)
    two = one * (int(one.max()) + 1) + np.roll(one, -1)
    order = np.argsort(two)
    rank = np.empty(len(two), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(np.diff(two[order]) != 0)))
    four = rank * (int(rank.max()) + 1) + np.roll(rank, -2)
    return words[np.argsort(four) - 1].astype(np.int32)


@dataclass(frozen=True)
class Phrases:
    """Intervals of phrases: `low` to `low + count` in the transform, from `back` on in the reversed one."""

    low: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def __getitem__(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.low[chosen], self.back[chosen], self.count[chosen])


@dataclass(frozen=True)
class Extensions:
    """`word` extends the phrase at place `of`; `phrases` are the extended ones, which occur `phrases.count` times."""

    of: np.ndarray
    word: np.ndarray
    phrases: Phrases

    def __getitem__(self, chosen: np.ndarray) -> Extensions:
        return Extensions(self.of[chosen], self.word[chosen], self.phrases[chosen])


class Index:
    """Counts of words by number (`counts[0]` is that of `BREAK`) and the transforms of both directions."""

    def __init__(self, counts: np.ndarray, forward: np.ndarray, backward: np.ndarray | None = None):
        self.counts = np.asarray(counts, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        self.forward, self.backward = forward, backward
        self._places: dict[str, np.ndarray] = {}

    def words(self, numbers: np.ndarray) -> Phrases:
        """Phrases of one word."""
        return Phrases(self.first[numbers], self.first[numbers], self.counts[numbers])

    def _narrowed(self, side: str, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the interval of an extended phrase begins: words further up that equal the extension come before."""
        transformed = getattr(self, side)
        if side not in self._places:
            places = np.argsort(transformed, kind="stable")
            self._places[side] = transformed[places].astype(np.int64) * (len(transformed) + 1) + places
        return np.searchsorted(self._places[side], word.astype(np.int64) * (len(transformed) + 1) + low)

    def _extend(self, side: str, low: np.ndarray, count: np.ndarray):
        """Distinct words in intervals of a transform: (interval, word, times, times of smaller words, breaks included)."""
        of = np.repeat(np.arange(len(low)), count)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(of)) if len(of) else of
        width = len(self.counts)
        keys, times = np.unique(of.astype(np.int64) * width + getattr(self, side)[rows], return_counts=True)
        before = np.cumsum(times) - times
        of, word = keys // width, keys % width
        begins = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
        return of, word, times, before - begins[of]

    def left(self, phrases: Phrases) -> Extensions:
        of, word, times, smaller = self._extend("forward", phrases.low, phrases.count)
        kept = word != BREAK
        of, word, times, smaller = of[kept], word[kept], times[kept], smaller[kept]
        low = self._narrowed("forward", word, phrases.low[of])
        return Extensions(of, word, Phrases(low, phrases.back[of] + smaller, times))

    def right(self, phrases: Phrases) -> Extensions:
        of, word, times, smaller = self._extend("backward", phrases.back, phrases.count)
        kept = word != BREAK
        of, word, times, smaller = of[kept], word[kept], times[kept], smaller[kept]
        back = self._narrowed("backward", word, phrases.back[of])
        return Extensions(of, word, Phrases(phrases.low[of] + smaller, back, times))
