"""Exact deduplication over a persistent digest index. DataFrame functions only.

The index is a table bucketed and sorted by digest. A batch is first grouped by digest on its own,
then joined against the index with a sort-merge anti-join that reads the index without a shuffle,
and what is new is appended. Nulls: a null text counts as empty; a row without an id stays only if
no row of its group has one. Repeated rows (same id, same text) count each, one of them stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import cut_lineage, lower_az, prepare, rows_of

SCHEMA = "digest string, keep_id bigint, group_size bigint, batch string"


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row number of this run, and the digest of each row's normalised text."""
    rows = rows_of(docs, doc_id=id, text=text)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                       F.sha2(lower_az(F.coalesce("text", F.lit(""))), 256).alias("digest"))


class DigestIndex:
    """A table of the digests seen so far, in the session's catalog."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 32):
        self.spark, self.table, self.buckets = prepare(spark), table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table) if self.exists() else self.spark.createDataFrame([], SCHEMA)

    def create(self) -> None:
        """An empty index where there is none."""
        empty = self.spark.createDataFrame([], SCHEMA)
        empty.write.mode("ignore").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index does not hold: the index side is read bucket by bucket."""
        known = self.read().select("digest")
        return groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Write groups to the index; one task writes one bucket, so that files stay few."""
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        dealt = rows.repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def deduplicate(self, docs: DataFrame, id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """doc_id, keep_id, group_size, kept, known, text_sha256 for every row of a new batch.

        ``keep_id`` is the largest id of the batch's equal rows, or the id kept by an earlier batch
        (``known``; then no row of this batch stays). New digests are appended to the index.
        """
        batch = batch or uuid.uuid4().hex
        rows = cut_lineage(digests(docs, id, text))
        # The order puts rows without an id first, so that any row with one beats them.
        groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_last"))
        groups = groups.select("digest", "group_size", F.col("_last.doc_id").alias("keep_id"), F.col("_last._row").alias("_keep_row"))
        self.create()
        fresh = cut_lineage(self.unseen(groups))  # the append below changes the table that this reads
        earlier = cut_lineage(self.read().select("digest", F.col("keep_id").alias("_earlier"), F.lit(True).alias("_known")))
        self.append(fresh, batch)
        both = groups.join(earlier, "digest", "left_outer").withColumn("known", F.col("_known").isNotNull())
        both = both.withColumn("keep_id", F.when(F.col("known"), F.col("_earlier")).otherwise(F.col("keep_id"))).drop("_earlier", "_known")
        # A group of copies may hold much of the input: a plain join of two shuffled sides, which Spark splits.
        out = rows.join(both, "digest")
        return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                          (~F.col("known") & (F.col("_row") == F.col("_keep_row"))).alias("kept"), "known",
                          F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", table: str | None = None, buckets: int = 32) -> DataFrame:
    """Deduplicate one batch against an index; without a name, against a new and empty one."""
    spark = docs.sparkSession
    index = DigestIndex(spark, table or f"digest_index_{uuid.uuid4().hex}", buckets)
    return index.deduplicate(docs, id, text)
