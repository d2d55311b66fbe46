"""Benchmark passages in documents: an FM-index for each shard of documents, searched for benchmark windows.

Where documents are read, whole documents are gathered to shards of a bounded size (a longer document is a shard of
its own). Each shard's words become an FM-index; every window of the benchmark goes through it by backward search,
occurrences are located by sampled positions, and their words merge to removal spans. No document moves.
The benchmark is sent to the tasks in blocks of bounded size: a larger benchmark takes more passes, none of them larger.

A null text or item has no words; an item without words has no window. An item shorter than a window is one
window. An item without an id hits words but is not listed. Repeated rows give a row each; items of one id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import pieces, prepare, rows_of, text_volume
from wardline.llm.fm_index import FMIndex, occurrences

# A shard's index and the arrays it is made from take some 30 times its text.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20

SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", SPAN), ("items", pa.list_(pa.int64()))])
FOUND_DDL = "doc_id bigint, text string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<bigint>"


class Phrases:
    """Distinct windows of benchmark items, by their number of words, and the items that have them.

    A window is a row of places in ``vocabulary``, so that a shard looks up each distinct word once.
    """

    def __init__(self, items: pa.Table, width: int):
        words = W.Words(items.column("text"), W.NOT_ALNUM, lower=True)
        hashes = words.hashes()
        ids = items.column("item_id").to_pylist()
        by_window: dict[tuple, set] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            for k in range(a, max(b - width, a) + 1 if b > a else a):
                by_window.setdefault(tuple(hashes[k:min(k + width, b)].tolist()), set()).add(ids[i])
        self.vocabulary = np.unique(hashes)
        self.groups = []
        for size in sorted({len(w) for w in by_window}):
            same = [w for w in by_window if len(w) == size]
            windows = np.searchsorted(self.vocabulary, np.array(same, np.uint64).reshape(-1, size)).astype(np.int32)
            self.groups.append((size, windows, [sorted(x for x in by_window[w] if x is not None) for w in same]))


def _merged(marks: np.ndarray) -> list[dict]:
    step = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(step[::2], step[1::2], strict=True)]


def _search(phrases, last: bool):
    def work(batches):
        groups, vocabulary = phrases.value.groups, phrases.value.vocabulary
        for table in W.blocks(batches, "text", SHARD_BYTES):
            words = W.Words(table.column("text"), W.NOT_ALNUM, lower=True)
            hashes = words.hashes()
            n = table.num_rows
            # Words get numbers from 1; a 1 stands between documents, so that no phrase runs on over their bounds.
            known, number = _numbers(hashes)
            text = np.ones(len(hashes) + n, np.int64)
            doc = np.repeat(np.arange(n), words.counts)
            text[np.arange(len(hashes)) + doc] = number + 2
            begin = words.first[:-1] + np.arange(n)
            index = FMIndex(text) if len(hashes) and groups else None
            at = np.minimum(np.searchsorted(known, vocabulary), len(known) - 1)
            met = known[at] == vocabulary if len(known) else np.zeros(len(vocabulary), bool)
            hit: dict[int, np.ndarray] = {}
            items: dict[int, set] = {}
            for size, windows, owners in groups if index else []:
                there = np.flatnonzero(met[windows].all(axis=1))
                if not len(there):
                    continue
                which, position = occurrences(index, *index.search(at[windows[there]] + 2))
                where = np.searchsorted(begin, position, "right") - 1
                for k, p, d in zip(there[which].tolist(), position.tolist(), where.tolist(), strict=True):
                    if d not in hit:
                        hit[d], items[d] = np.zeros(int(words.counts[d]), bool), set()
                    hit[d][p - begin[d]:p - begin[d] + size] = True
                    items[d].update(owners[k])
            spans, named = [], []
            before = [table.column(c).to_pylist() if c in table.column_names else [None] * n for c in ("spans", "items")]
            for d in range(n):
                marks = hit.get(d)
                for span in before[0][d] or []:
                    marks = np.zeros(int(words.counts[d]), bool) if marks is None else marks
                    marks[span["start"]:span["stop"]] = True
                spans.append([] if marks is None else _merged(marks))
                named.append(sorted(items.get(d, set()) | set(before[1][d] or [])))
            texts = pa.nulls(n, pa.string()) if last else table.column("text").combine_chunks()
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), texts, pa.array(words.counts, pa.int64()), pa.array(spans, SPAN), pa.array(named, pa.list_(pa.int64()))], schema=FOUND)

    return work


def _numbers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, ascending; number of each value among them)."""
    order = np.argsort(hashes)
    begin = W.runs(hashes[order])
    number = np.empty(len(hashes), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    return hashes[order[begin]], number


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """doc_id, n_words, spans (word ranges inside any occurrence, merged), items (ids with occurring windows)."""
    spark = prepare(docs.sparkSession)
    out = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = rows_of(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    rows, size = text_volume(items)
    blocks = pieces(size + 64 * rows, BLOCK_BYTES)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(blocks)) == block).toArrow()
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(Phrases(part, width)), block == blocks - 1), FOUND_DDL)
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
