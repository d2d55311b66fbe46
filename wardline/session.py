"""Session settings, lineage cuts and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every plan here relies on. All are plain SQL settings, so a
# caller's own session can take them; nothing is static.
RUNTIME = {
    # timestamp_ntz values are turned to epoch numbers and back, so the zone must not shift
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even if the split costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SMALL_ROWS = 50_000


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only on one machine where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardline-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of any executor.

    A written table, unlike a checkpoint of rows, keeps column pruning and tells the planner its
    size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """Evaluate ``df`` once if it has at most ``max_rows`` rows, else return None.

    The result is a local table of proven size, so a broadcast of it is safe at any input
    size. The driver never receives more than ``max_rows + 1`` rows.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def _equal(on: list[str], null_safe: bool) -> Column:
    """Condition of ``on`` columns against their ``_r_`` copies."""
    test = (lambda c: F.col(c).eqNullSafe(F.col(f"_r_{c}"))) if null_safe else (lambda c: F.col(c) == F.col(f"_r_{c}"))
    return reduce(lambda a, b: a & b, [test(c) for c in on])


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str],
                how: str = "inner", salts: int = 16, null_safe: bool = False) -> DataFrame:
    """Equi-join where a few ``on`` values may hold most of ``big``.

    ``small`` holds one row per key. Each of its rows is copied once per salt and the rows of
    ``big`` are spread over the salts by a hash of ``spread`` (columns that differ inside a hot
    key), so one key is served by ``salts`` tasks. Nothing is dropped. It is for sides that Spark
    cannot split by itself, such as one grouped by the join key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    right = small.withColumnsRenamed({c: f"_r_{c}" for c in on}).withColumn("_r_salt", copies)
    cond = (F.col("_salt") == F.col("_r_salt")) & _equal(on, null_safe)
    return left.join(right, cond, how).drop("_salt", "_r_salt", *[f"_r_{c}" for c in on])


def attach_small(big: DataFrame, small: DataFrame, on: list[str], spread: list[str],
                 how: str = "inner", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join per-key values onto a large table: broadcast if proven small, else salted.

    Columns come in one order both ways: those of ``big``, then the others of ``small``.
    """
    local = small_table(small, max_rows)
    order = [*big.columns, *[c for c in small.columns if c not in on]]
    met = salted_join(big, small, on, spread, how) if local is None else big.join(F.broadcast(local), on, how)
    return met.select(*[F.col(f"`{c}`") for c in order])
