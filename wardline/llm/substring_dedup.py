"""Removal of repeated passages: every window of ``width`` words that also starts earlier is cut.

Rabin-Karp hashes of all windows are counted over the corpus; windows that are not the first of their
hash mark their words, and marks that touch merge to maximal removal intervals. Windows are judged on
the input. A window is told apart by more than 64 bits: its bucket comes from one hash, the 56 bits
that travel from another, and buckets grow in number with the input.

Order of occurrences: doc_id, then place; rows without an id come last, by home, then text. Of repeated
rows the later one loses all its whole windows. A null text has no words. A text of fewer words than a
window loses nothing.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import prepare
from wardline.llm.homes import SENT, SENT_DDL, Homes, bucket_of, by_bucket, first_of_each, ids_of, in_order

KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("text", pa.string())])
KEPT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, text string"
ANSWER = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("later", pa.binary())])
ANSWER_DDL = "home int, bucket int, later binary"


class _Windows:
    """Windows of one home: which are the first in the home, and how these are dealt to buckets."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.table = in_order(table)
        self.words = W.Words(self.table.column("text"))
        hashes = self.words.hashes()
        self.starts = W.window_starts(self.words.first, width)
        sent = W.window_hashes(hashes, width, W.WINDOW_BASES[0])[self.starts]
        self.first = first_of_each(sent)
        self.sent = sent[self.first]
        dealt = W.window_hashes(hashes, width, W.WINDOW_BASES[1])[self.starts[self.first]] if len(self.first) else self.sent
        self.order, self.bounds = by_bucket(bucket_of(dealt, buckets), buckets)


def _send(width: int, buckets: int):
    def work(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        own = _Windows(table, width, buckets)
        ids = ids_of(own.table)
        doc = np.searchsorted(own.words.first, own.starts[own.first], "right") - 1
        rows = []
        for b in range(buckets):
            at = own.order[own.bounds[b]:own.bounds[b + 1]]
            if not len(at):
                continue
            docs = doc[at]  # rises within a bucket
            change = W.runs(docs)
            packed = own.sent[at].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
            sizes = np.diff(np.append(change, len(at))).astype(np.int32)
            rows.append((b, home, packed, ids[docs[change]].tobytes(), sizes.tobytes()))
        return pa.Table.from_pydict(dict(zip(SENT.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in SENT.names}, SENT)

    return work


def _later(table: pa.Table) -> pa.Table:
    """For one bucket: which entries have an equal one with a smaller id (or the same and a smaller home)."""
    table = table.sort_by("home")
    bucket, homes = table.column("bucket")[0].as_py(), table.column("home").to_numpy()
    hashes, ids, counts = [], [], []
    for packed, doc, sizes in zip(*[table.column(c).to_pylist() for c in ("hashes", "extra", "sizes")], strict=True):
        seven = np.frombuffer(packed, np.uint8).reshape(-1, 7)
        wide = np.zeros((len(seven), 8), np.uint8)
        wide[:, :7] = seven
        hashes.append(wide.view(np.uint64).ravel())
        ids.append(np.repeat(np.frombuffer(doc, np.int64), np.frombuffer(sizes, np.int32)))
        counts.append(len(seven))
    hashes, ids = np.concatenate(hashes), np.concatenate(ids)
    later = np.zeros(len(hashes), bool)
    order = np.argsort(hashes)
    begin = W.runs(hashes[order])
    size = np.diff(np.append(begin, len(order)))
    shared = W.ragged(begin[size > 1], size[size > 1])
    if len(shared):
        at = order[shared]
        run = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
        by = np.lexsort((at, ids[at], run))  # entries stand in order of home
        later[at[by]] = np.concatenate(([False], run[by][1:] == run[by][:-1]))
    ends = np.cumsum(counts)
    rows = [(int(h), bucket, np.packbits(later[e - c:e]).tobytes()) for h, c, e in zip(homes, counts, ends, strict=True) if later[e - c:e].any()]
    return pa.Table.from_pydict(dict(zip(ANSWER.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in ANSWER.names}, ANSWER)


def _cut(width: int, buckets: int):
    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return KEPT.empty_table()
        own = _Windows(table, width, buckets)
        repeated = np.ones(len(own.starts), bool)
        repeated[own.first] = False
        for bucket, later in zip(answers.column("bucket").to_pylist(), answers.column("later").to_pylist(), strict=True):
            at = own.order[own.bounds[bucket]:own.bounds[bucket + 1]]
            repeated[own.first[at]] = np.unpackbits(np.frombuffer(later, np.uint8), count=len(at)).astype(bool)
        words = own.words
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, own.starts[repeated], 1)
        np.add.at(edge, own.starts[repeated] + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[words.first[1:]] - total[words.first[:-1]]
        texts, spans = [], []
        raw = words.data.tobytes()
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            own_words = raw[words.offsets[i]:words.offsets[i + 1]].split()
            if removed[i]:
                mask = gone[a:b]
                step = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
                own_words = compress(own_words, (~mask).tolist())
            else:
                spans.append([])
            texts.append(b" ".join(own_words))
        return pa.table([own.table.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, KEPT.field("spans").type),
                         pa.array(texts, pa.binary()).cast(pa.string())], schema=KEPT)

    return work


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges cut, maximal), text (kept words, single spaces)."""
    prepare(docs.sparkSession)
    homes = Homes(docs, id, text)
    sent = homes.send(_send(width, homes.buckets), SENT_DDL)
    answers = sent.groupBy("bucket").applyInArrow(_later, ANSWER_DDL)
    return homes.receive(answers, _cut(width, homes.buckets), KEPT_DDL)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
