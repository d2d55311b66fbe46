"""Boilerplate lines by the spread of their sites.

Every line is known by a hash of its trimmed text; a HyperLogLog sketch of the sites it occurs on is built for each hash
and merged by aggregation, so a line that a third of all documents hold costs one sketch in each task. Lines whose
estimate is near the threshold get an exact distinct count; only these are read a second time. Lines
on ``min_sites`` sites or more are removed wherever they stand.

Blank lines are neither counted nor removed. A null site counts for no site, a null text has no lines (an empty one
has one, blank). Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import attach, cut_lineage, prepare, rows_of, shuffle_partitions

LG_K = 10
# Three standard errors of a sketch of 2^LG_K registers (1.04 / sqrt(2^LG_K)), and one for rounding.
NEAR_SHARE, NEAR_LEAST = 3 * 1.04 / 2 ** (LG_K / 2), 1.0


# Lines on many sites are few among all: their tables are written in one file for so many partitions, not in one for each.
PARTITIONS_PER_FILE = 16


def _few_files(df: DataFrame) -> DataFrame:
    return cut_lineage(df.repartition(-(-shuffle_partitions(df.sparkSession) // PARTITIONS_PER_FILE)))


def _key(line) -> list:
    """Two hashes of a line, 96 bits together."""
    return [F.xxhash64(line).alias("h1"), F.hash(line, F.lit(7)).alias("h2")]


def _lines(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, place, h1, h2 of every line that is not blank."""
    cut = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    cut = cut.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''")
    return cut.select("doc_id", "text_hash", "site", "place", *_key(F.col("line")))


def site_spread(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8) -> DataFrame:
    """h1, h2 of the lines on ``min_sites`` sites or more."""
    lines = _lines(rows_of(docs, doc_id=id, text=text, site=site)).where("site IS NOT NULL")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = NEAR_LEAST + NEAR_SHARE * min_sites
    # What is clearly below is dropped here: only lines at or above the margin are written.
    spread = _few_files(spread.where(F.col("sites") >= min_sites - margin))
    sure = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = spread.where(F.col("sites") <= min_sites + margin).select(F.struct("h1", "h2").alias("key"))
    again = attach(lines.withColumn("key", F.struct("h1", "h2")), near, "key").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = again.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def _without(parts: Column, gone: Column) -> Column:
    """The lines ``parts`` but for the places ``gone`` (ascending), as one text: the stretches between these, in linear time."""

    def stretches(both: Column) -> Column:
        lines, places = both["lines"], both["places"]

        def stretch(k: Column) -> Column:
            start = F.coalesce(F.get(places, k - 1) + 1, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(places, k), F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch)), "\n")

    # An array of one, so that both sides are worked out once for each row.
    return F.get(F.transform(F.array(F.struct(parts.alias("lines"), gone.alias("places"))), stretches), F.lit(0))


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8) -> DataFrame:
    """doc_id, n_lines, n_removed, text without the lines that spread over ``min_sites`` sites or more."""
    prepare(docs.sparkSession)
    rows = rows_of(docs, doc_id=id, text=text, site=site)
    wide = _few_files(site_spread(docs, id, text, site, min_sites).select(F.struct("h1", "h2").alias("key")))
    hits = attach(_lines(rows).withColumn("key", F.struct("h1", "h2")), wide, "key")
    gone = hits.groupBy(F.col("doc_id").alias("_id"), "text_hash").agg(F.collect_set("place").alias("gone"))
    whole = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    met = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    parts = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(parts, F.sort_array("gone")))
    lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0))
    return met.select("doc_id", lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                      F.coalesce(kept, F.lit("")).alias("text"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
