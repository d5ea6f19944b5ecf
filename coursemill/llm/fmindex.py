"""A bidirectional FM-index over delimited words, and the words at exactly one edit from others.

The words stand sorted behind one another, each between delimiters. A suffix array orders all their
suffixes; an interval of its ranks stands for the places of a string. A wavelet matrix over the symbols
before each suffix narrows an interval by a symbol to the left. A second index over the reversed words
narrows to the right, and both intervals are kept in step: within a string's interval the strings that it is
extended to stand in order of their symbols, so that the number of smaller symbols gives the new place.

Searches run for many words at once, as arrays of intervals.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0


class OneWay:
    """Ranks of the suffixes of sorted, distinct words; extends strings to the left."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, alphabet: int):
        """``symbols``: those of all words behind one another, from 1; ``sizes``: each word's number of them."""
        words = len(sizes)
        text = np.zeros(len(symbols) + words + 1, dtype=np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(1, words + 1), sizes)] = symbols
        places = self._sorted_suffixes(text, sizes, alphabet)
        before = text[places - 1]
        before[places == 0] = alphabet + 1  # the text's first suffix has none; no search asks for it
        self.depth = int(alphabet + 1).bit_length()
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 2))])
        self.zeros, self.cuts = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (before >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32))
            self.cuts.append(int(self.zeros[-1][-1]))
            before = np.concatenate([before[ones == 0], before[ones == 1]])
        every = np.arange(alphabet + 2)
        self.first = self._walk(np.zeros(len(every), np.int32), np.zeros(len(every), np.int32), every)[0]

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, sizes: np.ndarray, alphabet: int) -> np.ndarray:
        """Places in order of what stands there up to the next delimiter; equal ones in order of place, so of the words behind."""
        n, bits = len(text), int(alphabet).bit_length()
        step = 62 // bits
        behind = np.flatnonzero(text == DELIMITER)
        left = behind[np.searchsorted(behind, np.arange(n))] - np.arange(n)  # symbols before the delimiter
        key = np.zeros(n, dtype=np.int64)
        for i in range(step):
            key <<= bits
            inside = left > i
            key[inside] |= text[np.flatnonzero(inside) + i]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        longest = int(sizes.max(initial=0))
        while step < longest:
            more = left > step
            key = rank * (n + 1)
            key[more] += rank[np.flatnonzero(more) + step] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            step *= 2
        return np.argsort(rank, kind="stable")

    def _walk(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(low), dtype=np.int32)
        for level, (zeros, cut) in enumerate(zip(self.zeros, self.cuts)):
            one = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            zero_low, zero_high = zeros[low], zeros[high]
            smaller += np.where(one, zero_high - zero_low, 0)
            low = np.where(one, cut + low - zero_low, zero_low)
            high = np.where(one, cut + high - zero_high, zero_high)
        return low, high, smaller

    def extended(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first rank, size, number with a smaller symbol before) of intervals with ``symbol`` put before their strings."""
        begin, end, smaller = self._walk(low, low + size, symbol)
        return (self.below[symbol] + begin - self.first[symbol]).astype(np.int32), end - begin, smaller

    def spread(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval's number, symbol, first rank, size, smaller) for all symbols that stand before an interval's strings."""
        which, symbol = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        high, smaller = low + size, np.zeros(len(low), dtype=np.int32)
        for zeros, cut in zip(self.zeros, self.cuts):
            zero_low, zero_high = zeros[low], zeros[high]
            count = zero_high - zero_low
            no, yes = count > 0, high - low > count
            which = np.concatenate([which[no], which[yes]])
            symbol = np.concatenate([symbol[no] * 2, symbol[yes] * 2 + 1])
            smaller = np.concatenate([smaller[no], (smaller + count)[yes]])
            low, high = (
                np.concatenate([zero_low[no], (cut + low - zero_low)[yes]]),
                np.concatenate([zero_high[no], (cut + high - zero_high)[yes]]),
            )
        return which, symbol, (self.below[symbol] + low - self.first[symbol]).astype(np.int32), high - low, smaller


class Words:
    """Words as one array of symbols, which are ranks from 1 in a given order of code points."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.symbols = np.searchsorted(alphabet, points) + 1
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The symbol at a place of each word, the delimiter at its end."""
        inside = place < self.sizes[word]
        out = np.full(len(word), DELIMITER, dtype=np.int64)
        out[inside] = self.symbols[self.begins[word[inside]] + place[inside]]
        return out


def alphabet_of(*words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer("".join(w).encode("utf-32-le"), np.uint32) for w in words]))


class BothWays:
    """The index of sorted, distinct words for strings that grow at either end."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        n = len(alphabet)
        self.alphabet = alphabet
        plain, turned = Words(words, alphabet), Words(sorted(w[::-1] for w in words), alphabet)
        self.forward, self.backward = OneWay(plain.symbols, plain.sizes, n), OneWay(turned.symbols, turned.sizes, n)
        self.size = len(plain.symbols) + len(words) + 1

    def one_edit_after(self, asked: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number among ``asked``, number of an indexed word) that share the first ``halves`` code points
        and differ by exactly one inserted, deleted or replaced code point in the rest. No pair comes twice.

        An insertion stands behind a run of its own symbol and a deletion takes a run's last one, so that each
        word is reached in one way.
        """
        words = Words(asked, self.alphabet)
        who = np.arange(len(asked))
        low, back = np.zeros(len(who), np.int32), np.zeros(len(who), np.int32)
        size = np.full(len(who), self.size, dtype=np.int32)
        # the half exactly, to the left from its end, and the delimiter before it
        for step in range(1, int(halves.max(initial=0)) + 2):
            going = np.flatnonzero(halves[who] + 1 >= step)
            if not len(going):
                break
            place = halves[who[going]] - step
            symbol = np.where(place >= 0, words.at(who[going], np.maximum(place, 0)), DELIMITER)
            low[going], size[going], smaller = self.forward.extended(low[going], size[going], symbol)
            # the empty string's interval has the symbols of the whole text, its first delimiter included
            back[going] += smaller if step > 1 else self.backward.below[symbol].astype(np.int32)
            alive = size > 0
            who, low, back, size = who[alive], low[alive], back[alive], size[alive]
        exact = (who, halves[who], low, back, size)
        bent = tuple(np.zeros(0, x.dtype) for x in exact)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        while len(exact[0]) or len(bent[0]):
            # one error made: only the word's own symbols, to the right
            who, place, low, back, size = bent
            symbol = words.at(who, place)
            back, size, smaller = self.backward.extended(back, size, symbol)
            low = low + smaller
            alive = size > 0
            over = alive & (symbol == DELIMITER)
            found.append((who[over], low[over]))
            alive &= ~over
            grown = [(who[alive], place[alive] + 1, low[alive], back[alive], size[alive])]
            # none made yet: all symbols that occur
            who, place, low, back, size = exact
            symbol = words.at(who, place)
            which, other, new_back, new_size, smaller = self.backward.spread(back, size)
            new_low = low[which] + smaller
            same = (other == symbol[which]) & (other != DELIMITER)
            exact = (who[which[same]], place[which[same]] + 1, new_low[same], new_back[same], new_size[same])
            odd = (other != symbol[which]) & (other != DELIMITER)
            grown.append((who[which[odd]], place[which[odd]], new_low[odd], new_back[odd], new_size[odd]))  # inserted
            odd &= symbol[which] != DELIMITER
            grown.append((who[which[odd]], place[which[odd]] + 1, new_low[odd], new_back[odd], new_size[odd]))  # replaced
            lost = (symbol != DELIMITER) & (symbol != words.at(who, place + 1))
            grown.append((who[lost], place[lost] + 1, low[lost], back[lost], size[lost]))  # deleted
            bent = tuple(np.concatenate(x) for x in zip(*grown))
        return tuple(np.concatenate(x) for x in zip(*found))
