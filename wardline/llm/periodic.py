"""Periodic runs of words, found by recompression.

A run is a stretch of consecutive words with smallest period q, at least ``exponent`` periods and ``shortest`` words
long, that cannot be extended with that period. Every such run covers ``exponent`` neighbouring points of the grid 0, q,
2q, .., whose words are then equal: these are the candidates (the grids of all periods together have n ln n points). Two
longest-common-extension queries, forward and backward from two neighbouring grid points, give a candidate's exact ends.

The queries are answered by a run-length grammar without suffix arrays. Recompression builds it in levels: by turns, maximal
blocks of one letter, and pairs of a letter from one half of the alphabet and one from the other half, become new letters.
Both steps look at neighbours only, so equal stretches get equal letters but at their edges, and a query has to look at
one or two letters a level, going up while letters agree and down again where they don't.

Spark deals documents; a block of documents is one sequence in which every border has a letter of its own, so one grammar
serves them all. It is only built where a candidate exists.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import prepare, rows_of

BLOCK_BYTES = 2 << 20
GRID_POINTS = 1 << 20
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("text", pa.string())])
FOUND_DDL = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


class Grammar:
    """Levels of letters over a sequence; ``extend`` tells how far two places agree.

    ``up[k]``: place of a letter's parent in level k + 1; ``first[k]``: place in level k of each parent's first letter.
    The sequence must end with a letter that occurs nowhere else.
    """

    def __init__(self, sequence: np.ndarray):
        letters = np.unique(sequence, return_inverse=True)[1].astype(np.int32).ravel()
        self.letters, self.up, self.first, self.blocks = [letters], [], [], []
        fresh = int(letters.max(initial=-1)) + 1
        seed = 0
        while len(letters) > 1:
            start = W.runs(letters)
            if len(start) < len(letters):
                size = np.diff(np.append(start, len(letters)))
                above = letters[start].copy()
                long = size > 1
                fresh = self._name(above, long, above[long].astype(np.int64), size[long], fresh)
                letters = self._level(start, above, len(letters), True)
            seed += 1
            left = (W.mix(letters.astype(np.uint64), seed) & np.uint64(1)).astype(bool)
            paired = left[:-1] & ~left[1:]
            if not paired.any():
                continue
            inner = np.concatenate(([False], paired))
            start = np.flatnonzero(~inner)
            above = letters[start].copy()
            joined = np.append(paired, False)[start]
            at = start[joined]
            fresh = self._name(above, joined, letters[at].astype(np.int64), letters[at + 1], fresh)
            letters = self._level(start, above, len(letters), False)

    @staticmethod
    def _name(above: np.ndarray, where: np.ndarray, one: np.ndarray, two: np.ndarray, fresh: int) -> int:
        """New letters for pairs of numbers, equal ones for equal pairs."""
        kinds, which = np.unique(one * (int(two.max(initial=0)) + 1) + two, return_inverse=True)
        above[where] = fresh + which.ravel()
        return fresh + len(kinds)

    def _level(self, start: np.ndarray, above: np.ndarray, below: int, blocks: bool) -> np.ndarray:
        first = np.append(start, below).astype(np.int32)
        self.first.append(first)
        self.up.append(np.repeat(np.arange(len(start), dtype=np.int32), np.diff(first)))
        self.blocks.append(blocks)
        self.letters.append(above)
        return above

    def extend(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many letters of the sequence agree from there on."""
        i, j = one.astype(np.int64), two.astype(np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: queries whose letters differ there
        query = np.arange(len(i))
        for level in range(len(self.letters)):
            letters = self.letters[level]
            same = letters[i] == letters[j]
            waiting.append((query[~same], i[~same], j[~same]))
            query, i, j = query[same], i[same], j[same]
            if not len(query):
                break
            up, first = self.up[level], self.first[level]  # the topmost letter is unique, so some level is left
            if self.blocks[level]:
                rest_i, rest_j = first[up[i] + 1] - i, first[up[j] + 1] - j
                step = np.minimum(rest_i, rest_j)
                i, j = i + step, j + step
                uneven = rest_i != rest_j
                if uneven.any():
                    w = waiting[level]
                    waiting[level] = (np.append(w[0], query[uneven]), np.append(w[1], i[uneven]), np.append(w[2], j[uneven]))
                    query, i, j = query[~uneven], i[~uneven], j[~uneven]
            else:
                second = (first[up[i]] != i) | (first[up[j]] != j)
                i, j = i + second, j + second
            i, j = up[i].astype(np.int64), up[j].astype(np.int64)
        query, i, j = waiting[-1]
        for level in range(len(waiting) - 2, -1, -1):
            letters, first = self.letters[level], self.first[level]
            next_i, next_j = first[i + 1], first[j + 1]
            i, j = first[i].astype(np.int64), first[j].astype(np.int64)
            same = letters[i] == letters[j]
            step = np.where(same, np.minimum(next_i - i, next_j - j) if self.blocks[level] else 1, 0)
            w = waiting[level]
            query, i, j = np.append(query, w[0]), np.append(i + step, w[1]), np.append(j + step, w[2])
        out = np.zeros(len(one), np.int64)
        out[query] = i
        return out - one


class Finder:
    """Runs of a block of documents, given as words (any numbers) and the first word of each document."""

    def __init__(self, words: np.ndarray, first: np.ndarray, exponent: int = 4, shortest: int = 6):
        self.exponent, self.shortest = exponent, shortest
        self.size = np.diff(first)
        self.number = np.unique(words, return_inverse=True)[1].ravel()
        self.first = first
        self.grammars: tuple[Grammar, Grammar] | None = None

    def _bordered(self) -> np.ndarray:
        """All words with a letter of its own before every document and after the last."""
        docs = len(self.size)
        out = np.empty(len(self.number) + docs + 1, np.int64)
        border = self.first + np.arange(docs + 1)
        inner = np.ones(len(out), bool)
        inner[border] = False
        out[inner] = self.number
        out[border] = len(self.number) + np.arange(docs + 1)
        return out

    def _ends(self, doc: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of, and first word after, the longest stretch around ``at`` and ``at + period`` with that period."""
        if self.grammars is None:
            sequence = self._bordered()
            self.grammars = Grammar(sequence), Grammar(sequence[::-1])
        place = self.first[doc] + doc + 1 + at
        ahead = self.grammars[0].extend(place, place + period)
        last = len(self.number) + len(self.size)
        back = self.grammars[1].extend(last - (place - 1), last - (place + period - 1))
        return at - back, at + period + ahead

    def _candidates(self, doc: np.ndarray, period: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grid points from which ``exponent`` neighbouring ones hold the same word."""
        which = np.repeat(np.arange(len(doc)), points)
        q = period[which]
        at = W.ragged(np.zeros(len(points), np.int64), points) * q
        place = self.first[doc[which]] + at
        word = self.number[place]
        for _ in range(self.exponent - 1):
            place = place + q
            same = self.number[place] == word
            which, q, at, place, word = which[same], q[same], at[same], place[same], word[same]
        return doc[which], q, at

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, stop, period) of all runs, by document, start, period."""
        most = self.size // self.exponent
        most[self.size < self.shortest] = 0
        doc = np.repeat(np.arange(len(most)), most)
        period = W.ragged(np.ones(len(most), np.int64), most)
        points = (self.size[doc] - 1) // period - (self.exponent - 2)
        ends = np.cumsum(points)
        found, low = [], 0
        while low < len(doc):
            to = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GRID_POINTS, "right")))
            found.append(self._exact(*self._candidates(doc[low:to], period[low:to], points[low:to])))
            low = to
        if not found:
            return (np.zeros(0, np.int64),) * 4
        doc, start, stop, period = map(np.concatenate, zip(*found, strict=True))
        # A stretch with smallest period p is also found with its multiples.
        order = np.lexsort((period, stop, start, doc))
        doc, start, stop, period = doc[order], start[order], stop[order], period[order]
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)
        doc, start, stop, period = doc[new], start[new], stop[new], period[new]
        order = np.lexsort((period, start, doc))
        return doc[order], start[order], stop[order], period[order]

    def _exact(self, doc: np.ndarray, period: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(doc):
            return (np.zeros(0, np.int64),) * 4
        # Of neighbouring candidates the first is asked; those within its stretch are the same run.
        head = np.ones(len(doc), bool)
        head[1:] = (np.diff(doc) != 0) | (np.diff(period) != 0) | (np.diff(at) != period[1:])
        start, stop = self._ends(doc[head], at[head], period[head])
        chain = np.cumsum(head) - 1
        rest = at + period >= stop[chain]
        more = self._ends(doc[rest], at[rest], period[rest])
        doc, period = np.append(doc[head], doc[rest]), np.append(period[head], period[rest])
        start, stop = np.append(start, more[0]), np.append(stop, more[1])
        long = stop - start >= np.maximum(self.shortest, self.exponent * period)
        return doc[long], start[long], stop[long], period[long]


def _collapse(exponent: int, shortest: int):
    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            words = W.Words(table.column("text"))
            doc, start, stop, period = Finder(words.hashes(), words.first, exponent, shortest).runs()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, words.first[doc] + start + period, 1)
            np.add.at(edge, words.first[doc] + stop, -1)
            stays = np.cumsum(edge[:-1]) == 0
            raw, texts = words.data.tobytes(), []
            hit = np.zeros(table.num_rows, bool)
            hit[doc] = True
            for i in range(table.num_rows):
                own = raw[words.offsets[i]:words.offsets[i + 1]].split()
                texts.append(b" ".join(compress(own, stays[words.first[i]:words.first[i + 1]].tolist()) if hit[i] else own))
            bounds = np.searchsorted(doc, np.arange(table.num_rows + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start), pa.array(stop - start), pa.array(period)], ["start", "length", "period"]))
            texts = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(words.counts, pa.int64()), runs, texts], schema=FOUND)

    return work


def collapse_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), text (without a run's repetitions).

    A word goes if a run holds it after its first period; kept words are joined by single spaces. A null or empty text has
    neither words nor runs. Repeated rows and rows without an id are treated like any others; an empty table gives an empty
    one, other columns don't matter. Words are compared by 64-bit hashes.
    """
    prepare(docs.sparkSession)
    rows = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_collapse(exponent, shortest), FOUND_DDL)


def digest(found: DataFrame) -> DataFrame:
    """Longest run (ties: smallest start, then period) and digests."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-top["start"]).alias("start"), top["length"].alias("length"),
                        (-top["period"]).alias("period"), F.floor(1000 * top["length"] / -top["period"]).alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
