"""Words, shingles and rolling hashes of whole Arrow batches, in numpy inside tasks.

Everything works on the UTF-8 bytes of a batch. Temporary arrays follow the batch, and the largest
ones (eight bytes for a byte of text) follow ``CHUNK``, so a very long text costs little more than
its own bytes. All hashes are 64-bit; two independent ones are available where more bits are needed.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, CHUNK + 1), base, np.uint64)
        table[0] = 1
        have = np.cumprod(table, dtype=np.uint64)
        if len(have) <= 8 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Every output bit depends on every input bit (a 64-bit finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


class Words:
    """Words of a batch: byte ranges ``start``/``stop``; words of text i are ``first[i]:first[i+1]``."""

    def __init__(self, texts, separators: np.ndarray = SPACE, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = ~separators[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        if len(inside):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        return range_hashes(self.data, self.start, self.stop)


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges are in order and don't overlap. Works in chunks of bytes."""
    out = np.empty(len(start), np.uint64)
    at, n = 0, len(start)
    while at < n:
        low = start[at]
        to = max(at + 1, int(np.searchsorted(stop, low + CHUNK, "right")))
        size = int(stop[to - 1] - low)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[low:low + size]] * powers(_P, size), out=sums[1:])
        a, b = start[at:to] - low, stop[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * powers(inverse(_P), size + 1)[a] + (b - a).astype(np.uint64)
        at = to
    return mix(out)


def window_hashes(words: np.ndarray, width: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """Rabin-Karp: hash of ``words[i:i+width]`` for every i, by differences of one running sum."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, CHUNK):
        part = words[low:min(n, low + CHUNK) + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        k = len(part) - width + 1
        out[low:low + k] = (sums[width:] - sums[:-width]) * powers(inverse(base), k)
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word indices where a whole window of ``width`` words of one text starts."""
    lengths = np.maximum(np.diff(first) - width + 1, 0)
    return ragged(first[:-1], lengths)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .. : the indices of many slices."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start index of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.Table]:
    """Batches regrouped, and cut between rows, to tables of about ``max_bytes`` of text.

    A longer text makes a table of its own. What earlier tasks left to the worker is given back first.
    """
    give_back()
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, ends = 0, np.cumsum(lengths)
        while low < len(lengths):
            room = max_bytes - size + (ends[low - 1] if low else 0)
            to = int(np.searchsorted(ends, room, "right"))
            if to <= low:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                to = low + 1
            held.append(batch.slice(low, to - low))
            size += int(ends[to - 1] - (ends[low - 1] if low else 0))
            low = to
    if held:
        yield pa.Table.from_batches(held)
        del held
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
