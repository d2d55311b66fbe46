"""Writing derived tables, exports and per-run results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, target: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Drop-and-create a derived table (a Parquet path, or a catalog name) and read it back."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if "/" in target:
        writer.parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target)
    writer.saveAsTable(target)
    return df.sparkSession.table(target)


def write_csv(df: DataFrame, path: str, null_text: str = "NA") -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue=null_text, emptyValue="")


def append_run_result(df: DataFrame, path: str, run_keys: dict[str, str]) -> None:
    """Add one run's rows to a compendium partitioned by the run keys.

    A run that is repeated replaces its own rows only, so a retried run adds nothing twice.
    """
    keyed = df.withColumns({k: F.lit(str(v)) for k, v in run_keys.items()})
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*run_keys).parquet(path))
