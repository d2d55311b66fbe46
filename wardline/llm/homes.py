"""Documents dealt to homes, and facts about their hashes brought back to them.

Several operators need, for every hash a document holds, a fact that only the whole corpus knows (does
it occur earlier, how often). Moving a row for each hash would cost many times the input. Instead
documents are dealt by id to *homes* of a bounded size. A home sends each of its distinct hashes once,
packed by bucket of the hash: a hash that a third of all rows hold travels once from each home. A
bucket answers each home with one packed array in the order it was sent, and the home, which works out
the same hashes again from the same documents, reads the answers off by position. The answer depends
on the documents of a home only, not on the order or the task they arrive in, so tasks can be run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, rows_of, shuffle_partitions, text_volume

HOME_BYTES = 12 << 20
BUCKET_WORDS = 3 << 20
LAST = np.iinfo(np.int64).max

SENT = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary()), ("sizes", pa.binary())])
SENT_DDL = "bucket int, home int, hashes binary, extra binary, sizes binary"


class Homes:
    """``table``: home, doc_id, text, dealt by home; ``buckets``: how many buckets hashes are dealt to."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", home_bytes: int = HOME_BYTES, bucket_words: int = BUCKET_WORDS):
        rows = rows_of(docs, doc_id=id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        self.rows, self.bytes = text_volume(rows)
        self.homes = pieces(self.bytes + 64 * self.rows, home_bytes)
        self.buckets = pieces(self.bytes // 5, bucket_words)
        # Rows without an id are dealt by their text, as there may be many.
        key = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64(F.coalesce("text", F.lit(""))))
        dealt = rows.select(F.pmod(key, F.lit(self.homes)).cast("int").alias("home"), "doc_id", "text")
        self.table = dealt.repartition(max(self.homes, shuffle_partitions(docs.sparkSession)), "home")

    def send(self, work: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
        return self.table.groupBy("home").applyInArrow(work, ddl)

    def receive(self, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
        """``work(documents, answers)`` for each home. The documents' exchange is the one of ``send``."""
        return self.table.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(work, ddl)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id, then text; rows without an id last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids for comparing; no id comes after all others."""
    return table.column("doc_id").fill_null(int(LAST)).to_numpy()


def by_bucket(numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order of entries by bucket, bounds of each bucket in it)."""
    order = np.argsort(numbers.astype(np.uint16) if buckets <= 65536 else numbers, kind="stable")
    return order, np.searchsorted(numbers[order], np.arange(buckets + 1))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def first_of_each(values: np.ndarray) -> np.ndarray:
    """Positions of the first occurrence of each distinct value, ascending."""
    if not len(values):
        return np.zeros(0, np.int64)
    order = np.argsort(values)
    firsts = np.minimum.reduceat(order, np.flatnonzero(np.concatenate(([True], np.diff(values[order]) != 0))))
    firsts.sort()
    return firsts
