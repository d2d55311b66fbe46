"""From raw documents to packed training sequences, in stages that are each written as Parquet.

Decisions are made and applied by row: rows without a doc_id, and rows that share one, get numbers of their own in a written
table first, so neither is dropped for its id and no row goes with a namesake. Null texts count as empty, and extra columns pass
through all filtering stages. An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from wardline.llm.common import BROADCAST_ROWS, cut_lineage, prepare
from wardline.session import checkpoint_dir


ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row: its doc_id where no other row has it, else one below all ids."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = F.least(F.coalesce(F.min("doc_id"), F.lit(0)), F.lit(0)).alias("least")
    shared = cut_lineage(ids.where("doc_id IS NOT NULL AND rows > 1").select("doc_id", F.lit(True).alias("_shared")))
    few = shared.count()
    whole = ids.agg(least, F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    if not few and not whole["without"]:
        return docs.withColumn(ROW, F.col("doc_id").cast("bigint"))
    met = docs.join(F.broadcast(shared) if few <= BROADCAST_ROWS else shared, "doc_id", "left")
    own = F.when(F.col("doc_id").isNull() | F.col("_shared"), F.lit(whole["least"] - 1) - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    return cut_lineage(met.select(*docs.columns, own.cast("bigint").alias(ROW)))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose number is no doc_id of ``gone``, without their numbers; ``gone`` is broadcast if it is counted to be small."""
    gone = cut_lineage(gone.select(F.col("doc_id").alias(ROW)).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, ROW, "left_anti").select(*[c for c in rows.columns if c != ROW])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = _numbered(docs)
    own = rows.select("doc_id", ROW).join(labels, "doc_id").select(F.col(ROW).alias("doc_id"), "quality", "toxic")
    return _without(rows, quality.quality_filter(rows, own, id=ROW).where("NOT kept"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id, if an id is its row's alone."""
    rows = _numbered(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, id=ROW).where("NOT kept"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, or number where an id is shared."""
    rows = _numbered(docs)
    return _without(rows, jaccard_join.jaccard_join(rows, id=ROW).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a document with one goes as a whole."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    return _without(rows, decontaminate.decontaminate(rows, benchmark, id=ROW).where(F.size("spans") > 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_equal), ("n-gram Jaccard join", drop_similar),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]
# A trained classifier and a packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{checkpoint_dir(prepare(spark)).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
