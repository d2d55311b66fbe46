"""An FM-index over a shard of words: suffix array, wavelet matrix over the last column, sampled positions.

All of it is vectorised: one call searches all phrases of a length.
"""

from __future__ import annotations

import numpy as np

from wardline.llm import words as W


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (numbers from 0), by prefix doubling.

    The first key packs as many symbols as fit in 63 bits; then only suffixes that are not yet told apart are
    sorted again, by their own rank and that of the suffix as many symbols on.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max() + 1).bit_length())
    step = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for j in range(step):
        key <<= np.uint64(bits)
        key[:n - j or None] |= text[j:].astype(np.uint64) + np.uint64(1) if j < n else np.uint64(0)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group
    rank[n] = -1
    alone = head & np.append(head[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        key = (rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1).astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(head, slots, 0))
        rank[at] = first
        alone = head & np.append(head[1:], True)
        slots = slots[~alone]
        step *= 2
    return order


class Bits:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        room = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(room, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, the highest first."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = sequence
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            is_one = bit.astype(bool)
            self.levels.append(Bits(bit))
            now = np.concatenate([now[~is_one], now[is_one]])
            self.zeros.append(len(now) - self.levels[-1].ones)

    def place(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """Where positions land among all equal-prefixed symbols; differences of places are ranks."""
        out = list(positions)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            for m, i in enumerate(out):
                ones = self.levels[k].rank(i)
                out[m] = np.where(one, self.zeros[k] + ones, i - ones)
        return out

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, place of i)."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            one, ones = self.levels[k].at(i), self.levels[k].rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return symbol, i


class FMIndex:
    """Symbols are numbers from 1; 0 ends the text and must not be searched for."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.size = len(text)
        symbols = int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.wavelet = WaveletMatrix(text[order - 1], max(1, (symbols - 1).bit_length()))
        sampled = order % self.SAMPLE == 0
        self.sampled, self.positions = Bits(sampled.astype(np.uint8)), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) rows of each phrase, from its last word backward; phrases: one in each row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbol = column[live]
            a, b, base = self.wavelet.place(symbol, low[live], high[live], np.zeros(len(live), np.int64))
            low[live], high[live] = self.first[symbol] + a - base, self.first[symbol] + b - base
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back through the text to the next sampled position."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled.at(rows[live])
            done = live[known]
            out[done] = self.positions[self.sampled.rank(rows[done])] + steps
            live = live[~known]
            if len(live):
                symbol, place = self.wavelet.read(rows[live])
                base, = self.wavelet.place(symbol, np.zeros(len(live), np.int64))
                rows[live] = self.first[symbol] + place - base
                steps += 1
        return out


def occurrences(index: FMIndex, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, text position) of every occurrence."""
    count = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(low)), count), index.locate(W.ragged(low, count))
