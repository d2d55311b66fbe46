"""Packing of token sequences by the sum-of-squares rule.

Documents are tokenized where they are read; only narrow rows of pieces move. They are written with a hash of each
piece's place (task and position), which differs between copies of a text too, and dealt by it from the written table to
groups of a bounded size, so that every group sees the same mix of lengths. Each group is packed on its own: a piece
goes to the open bin that makes the sum, over all residual gaps, of the squared number of open bins with that gap
smallest. Pieces come longest first, and a new bin is opened only for a piece that no open one has room for (opening
bins to lower the sum, as the rule allows for pieces in order of arrival, cost 0.7 % more sequences on 40,000 pieces). A group leaves a few bins open at most, so the loss against one packing of everything is a few bins a group.

A null or empty text is the one token that ends a document. Repeated rows and rows without an id are packed
like any others.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import cut_lineage, pieces, prepare, rows_of

BLOCK_BYTES = 1 << 20
GROUP_ROWS = 40_000
CACHE_KEYS = 600_000
# White space other than ASCII, and the separators some engines count as white space.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

_INNER_SPACE = re.compile(rb"[\t-\r\x1c-\x1f]|(?!^) |^ ?$|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
# Of a byte: 1 letter or digit, 2 white space, 3 other ASCII signs but the apostrophe, 4 lead byte of letters only, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[W.SPACE] = 2
_KIND[0x27] = 0
_KIND[[0xC4, 0xC5]] = 4

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64())])
PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint"
PACKED = pa.schema([*list(PIECE)[:-1], ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class ByteTokens:
    """Ids of whole texts for a byte-level vocabulary whose words never run on over white space.

    Such a tokenizer cuts a text before a white space that follows something else, and between letters or digits and
    other signs (but an apostrophe may belong to letters after it). So a text's ids are those of the stretches
    between such places, one after the other, and equal stretches are encoded once. Letters here are the Latin
    ones up to U+017F, others are not cut off; texts with other than ASCII white space, or with the name of a special token, are encoded as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library turns the names of special tokens in a text into these tokens, whatever stands around.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in special)) if special else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.bounds = array("q", [0])

    def _learn(self, keys: list[bytes]) -> None:
        """Encode new stretches: many in one text, a line each; those with other white space one by one.

        A line end is a token of its own wherever one stretch, with a space before it or none, follows another.
        """
        plain, other = [], []
        for key in keys:
            alone = self.line is None or _INNER_SPACE.search(key) or self.special is not None and self.special.search(key)
            (other if alone else plain).append(key)
        step = 2048
        lines = [b"\n".join(plain[i:i + step]).decode() for i in range(0, len(plain), step)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        parts = [np.array(e.ids + [self.line], np.uint32) for e in found]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(flat == self.line) - np.arange(len(plain))
        flat = flat[flat != self.line]
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([k.decode() for k in other], add_special_tokens=False)]
            ends = np.concatenate([ends, len(flat) + np.cumsum(list(map(len, ids)), dtype=np.int64)])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        if self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.size:self.size + len(flat)] = flat
        self.known.update(zip(plain + other, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.bounds.frombytes((self.size + ends).astype(np.int64).tobytes())
        self.size += len(flat)

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        """Places where the tokenizer cuts whatever stands around: cut[i] is before byte i."""
        cut = np.zeros(len(data) + 1, bool)
        kind = _KIND[data]
        after_c3 = np.concatenate(([False], data[:-1] == 0xC3))
        sign = (data == 0x97) | (data == 0xB7)  # of the characters that begin with C3, all but these two are letters
        ends = (kind == 1) | (np.concatenate(([False], kind[:-1] == 4))) | (after_c3 & ~sign)
        begins = (kind == 1) | (kind == 4) | ((data == 0xC3) & ~np.append(sign[1:], False))
        cut[1:-1] = ((kind[1:] == 2) & (kind[:-1] != 2)) | (ends[:-1] & (kind[1:] == 3)) | ((kind[:-1] == 3) & begins[1:])
        return cut

    def encode(self, texts, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by ``last``; bounds of each text)."""
        if len(self.known) > CACHE_KEYS:
            self._clear()
        data, offsets = W.text_bytes(texts)
        cut = self._cuts(data)
        raw = data.tobytes()
        odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in _OTHER_SPACE.finditer(raw)}
        if self.special is not None:
            odd |= {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.special.finditer(raw)}
        for i in odd:
            cut[offsets[i]:offsets[i + 1]] = False
        filled = np.diff(offsets) > 0
        cut[offsets[:-1][filled]] = True
        start = np.flatnonzero(cut[:-1])
        stop = np.append(start[1:], len(data))[:len(start)]
        hashes = W.range_hashes(data, start, stop)
        order = np.argsort(hashes)
        begin = W.runs(hashes[order])
        kind = np.empty(len(start), np.int64)
        kind[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        some = order[begin]
        keys = [raw[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)]
        at = list(map(self.known.get, keys))
        new = [i for i, k in enumerate(at) if k is None]
        if new:
            self._learn(list(dict.fromkeys(keys[i] for i in new)))
            for i in new:
                at[i] = self.known[keys[i]]
        at = np.array(at, np.int64)
        bounds = np.frombuffer(self.bounds.tobytes(), np.int64)
        starts, lengths = bounds[at][kind], (bounds[at + 1] - bounds[at])[kind]
        owner = np.searchsorted(offsets[:-1][filled], start, "right") - 1
        per_text = np.zeros(len(filled), np.int64)
        per_text[filled] = np.bincount(owner, weights=lengths, minlength=int(filled.sum())).astype(np.int64) if len(start) else 0
        bounds = np.concatenate(([0], np.cumsum(per_text + 1)))
        ids = np.full(int(bounds[-1]), last, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[bounds[1:] - 1] = False
        ids[inner] = self.flat[W.ragged(starts, lengths)]
        return ids, bounds


@cache
def _tokens(path: str) -> ByteTokens:
    """One for each Python worker: what it has learnt serves later tasks."""
    return ByteTokens(path)


def _pieces(path: str, capacity: int, last: int):
    def work(batches):
        tokens = _tokens(path)
        place = TaskContext.get().partitionId() << 40  # of the next piece
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            ids, bounds = tokens.encode(table.column("text"), last)
            size = np.diff(bounds)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            number = W.ragged(np.zeros(len(count), np.int64), count)
            head = size - capacity * (count - 1)  # the first piece takes what is left over
            length = np.where(number == 0, head[row], capacity)
            start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip((bounds[row] + start).tolist(), (bounds[row] + start + length).tolist(), strict=True)]
            doc = table.column("doc_id").combine_chunks().take(pa.array(row))
            part = W.mix(np.arange(place, place + len(row), dtype=np.uint64)) >> np.uint64(1)
            place += len(row)
            yield pa.RecordBatch.from_arrays([doc, pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(part.astype(np.int64))], schema=PIECE)

    return work


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    where, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == capacity
    where[full] = np.arange(int(full.sum()))
    bins = int(full.sum())
    open_bins: list[list[int]] = [[] for _ in range(capacity)]
    squares = np.zeros(capacity + 1, np.int64)  # open bins for each gap; a closed bin has none
    order = np.flatnonzero(~full)
    for k in order[np.argsort(-lengths[order], kind="stable")].tolist():
        size = int(lengths[k])
        count = squares[size:capacity]
        after = squares[:capacity - size].copy()
        after[:1] = -1  # a bin that is filled leaves the sum: 2 * -1 + 1 and the 1 of a new gap make 0
        cost = np.where(count > 0, 2 * (after - count) + 2, np.iinfo(np.int64).max)
        gap = int(np.argmin(cost)) if len(cost) else 0  # equal costs: the smallest gap
        if count.any():
            gap += size
            number = open_bins[gap].pop()
            squares[gap] -= 1
        else:
            gap, number = capacity, bins
            bins += 1
        where[k], offset[k] = number, capacity - gap
        if gap > size:
            open_bins[gap - size].append(number)
            squares[gap - size] += 1
    return where, offset


def _pack(capacity: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("part", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        group = table.column("group")[0].as_py()
        columns = [table.column(c) for c in PACKED.names[:-2]]
        return pa.table([*columns, pa.array(where + (group << 32)), pa.array(offset)], schema=PACKED)

    return work


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, last: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    ``path``: a byte-level vocabulary of the ``tokenizers`` library, at the same place on every executor.
    """
    prepare(docs.sparkSession)
    rows = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # written, so that a task run again deals the same pieces to the same groups
    cut = cut_lineage(rows.mapInArrow(_pieces(path, capacity, last), PIECE_DDL))
    groups = pieces(cut.count(), GROUP_ROWS)
    return cut.withColumn("group", F.pmod("part", F.lit(groups))).groupBy("group").applyInArrow(_pack(capacity), PACKED_DDL)
