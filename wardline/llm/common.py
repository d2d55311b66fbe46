"""Settings and small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import configure, cut_lineage

RUNTIME = {
    # Rows are whole documents: few of them make an Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Steps end in written tables, so the shuffle files of a step that is over can go at once.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in columns.items()])


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Spark's fast ``lower`` does just that for texts without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))


def text_volume(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of all the input; plans take their number of groups from it."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(big: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join to a side of unique keys: broadcast if it is counted to be small, else a sort-merge join.

    The broadcast saves moving the large side. ``side`` must be a written table, as it is counted.
    """
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return big.join(side, on, how)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


__all__ = ["all_of", "attach", "cut_lineage", "lower_az", "pieces", "prepare", "rows_of", "shuffle_partitions", "text_volume"]
