"""A signature tree over shingle sets and the dual traversal that joins two of them.

A leaf is one set: a bitmap of its shingles, its size, and its slack (shingles beyond one for each
bit). Sets of like size have bitmaps of one length and stand in one tree; a tree is also held against the
next one, of folded bitmaps, as sets of more different sizes cannot be similar enough. A node holds the OR of its children's bitmaps, the range of their sizes and their largest slack.
Two sets below nodes A and B share at most popcount(OR_A & OR_B) + min(slack_A, slack_B) shingles, and no
more than the smaller size; node pairs that cannot reach the threshold that way are never opened.
"""

from __future__ import annotations

import numpy as np

from wardline.llm import words as W

LEAST_BITS = 1024
FAN = 8
_STEP = 1 << 15


def map_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, two to four for each shingle.

    Two sets of n shingles without a common one then seem to share half of n at most, far from a similarity of 0.75.
    """
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))


def bitmaps(shingles: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A bitmap for each set ``shingles[off[i]:off[i+1]]``: bit ``shingle mod bits`` is set."""
    sizes = np.diff(off)
    bits = map_bits(sizes)
    out: list[bytes] = [b""] * len(sizes)
    for width in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == width)
        for low in range(0, len(rows), max(1, (1 << 25) // width)):
            some = rows[low:low + max(1, (1 << 25) // width)]
            own = shingles[W.ragged(off[some], sizes[some])]
            flat = np.zeros((len(some), width), bool)
            flat[np.repeat(np.arange(len(some)), sizes[some]), (own & np.uint64(width - 1)).astype(np.int64)] = True
            for i, row in zip(some.tolist(), np.packbits(flat, axis=1), strict=True):
                out[i] = row.tobytes()
    return out


def stacked(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words; longer ones are folded, which keeps all that the bounds need."""
    out = np.empty((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        one = np.frombuffer(m, np.uint64)
        out[i] = one if len(one) == words else np.bitwise_or.reduce(one.reshape(-1, words), axis=0)
    return out


class SignatureTree:
    """Levels from the leaves (0) up to a root; sets are arranged by size, then by signature."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((maps[:, 0], sizes))
        maps, sizes = maps[self.order], sizes[self.order].astype(np.int64)
        slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """(len(node), FAN) nodes one level down; -1 where there are fewer."""
        if level == 0:
            return node[:, None]
        below = node[:, None] * FAN + np.arange(FAN)
        below[below >= len(self.levels[level - 1][0])] = -1
        return below


def _possible(one, i, two, j, num: int, den: int) -> np.ndarray:
    """Whether sets below nodes i and j can have num / den of Jaccard similarity."""
    maps1, low1, high1, slack1 = one
    maps2, low2, high2, slack2 = two
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), _STEP):
        a, b = i[at:at + _STEP], j[at:at + _STEP]
        shared = np.bitwise_count(maps1[a] & maps2[b]).sum(axis=1, dtype=np.int64) + np.minimum(slack1[a], slack2[b])
        shared = np.minimum(shared, np.minimum(high1[a], high2[b]))
        # shared / (sizes - shared) >= num / den, for the smallest sizes and the largest overlap
        out[at:at + _STEP] = (num + den) * shared >= num * (low1[a] + low2[b])
    return out


def dual_traversal(one: SignatureTree, two: SignatureTree, num: int, den: int, same: bool = False):
    """(i, j) positions in the two inputs whose sets may reach the threshold; ``same``: i before j in one tree."""
    up1, up2 = len(one.levels) - 1, len(two.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        keep = _possible(one.levels[up1], i, two.levels[up2], j, num, den)
        i, j = i[keep], j[keep]
        if up1 == 0 and up2 == 0:
            break
        a, b = one.children(up1, i), two.children(up2, j)
        up1, up2 = max(0, up1 - 1), max(0, up2 - 1)
        i = np.repeat(a, b.shape[1], axis=1).ravel()
        j = np.tile(b, (1, a.shape[1])).ravel()
        keep = (i >= 0) & (j >= 0)
        if same:
            keep &= i <= j
        i, j = i[keep], j[keep]
    if same:
        i, j = i[i < j], j[i < j]
    return one.order[i], two.order[j]


def candidates(maps: list[bytes], sizes: np.ndarray, num: int, den: int, probe: np.ndarray | None = None):
    """(i, j) of sets that may reach the threshold; with ``probe``, i of its marked sets and j of all (a pair of
    two marked ones comes twice)."""
    words = np.array([len(m) // 8 for m in maps], np.int64)
    left, right = [], []

    def tree(rows: np.ndarray, width: int) -> SignatureTree:
        return SignatureTree(stacked([maps[r] for r in rows.tolist()], width), sizes[rows])

    def keep(one: np.ndarray, two: np.ndarray, found) -> None:
        left.append(one[found[0]])
        right.append(two[found[1]])

    reach = int(np.ceil(np.log2(den / num)))  # how many lengths apart similar sets can be
    for width in np.unique(words).tolist():
        for apart in range(reach + 1):
            other = width << apart
            if probe is None:
                one, two = np.flatnonzero(words == width), np.flatnonzero(words == other)
                if apart == 0:
                    own = tree(one, width)
                    keep(one, one, dual_traversal(own, own, num, den, same=True))
                elif len(two):
                    keep(one, two, dual_traversal(tree(one, width), tree(two, width), num, den))
                continue
            one, two = np.flatnonzero((words == width) & probe), np.flatnonzero(words == other)
            if len(one) and len(two):
                keep(one, two, dual_traversal(tree(one, width), tree(two, width), num, den))
            if apart:
                one, two = np.flatnonzero(words == width), np.flatnonzero((words == other) & probe)
                if len(one) and len(two):
                    keep(two, one, dual_traversal(tree(one, width), tree(two, width), num, den)[::-1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])
