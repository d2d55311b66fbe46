"""Scaling, imputation, principal components and complete cases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.scale import exact_quantiles


def complete_case(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=cols)


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean, unit population variance; a constant column becomes 0. One pass, one row back."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    scaled = {}
    for c in cols:
        mean, sd = row[f"m_{c}"], row[f"s_{c}"]
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(sd or 1.0)
    return df.withColumns(scaled)


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centre by the median, scale by the interquartile range (exact quantiles); no range becomes 1."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    table = exact_quantiles(long, ["variable"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    limits = {r["variable"]: r for r in table.collect()}  # one row per column
    return df.withColumns({c: (F.col(c) - F.lit(limits[c]["q50"])) / F.lit((limits[c]["q75"] - limits[c]["q25"]) or 1.0)
                           for c in cols if c in limits})


@dataclass
class Components:
    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame
    k: int


def pca(df: DataFrame, features: list[str] | str, keep: list[str], k: int | None = None, variance: float | None = None) -> Components:
    """Principal components of centred columns (or of one array column).

    ``k`` fixes their number, ``variance`` takes the fewest that reach a share, default all.
    The centred vectors are what is transformed, so scores have mean zero.
    """
    if isinstance(features, str):
        rows = df.select(*keep, array_to_vector(F.col(features).cast("array<double>")).alias("_raw"))
        width = df.select(F.max(F.size(features))).first()[0]
    else:
        rows = VectorAssembler(inputCols=features, outputCol="_raw").transform(df.select(*keep, *features)).select(*keep, "_raw")
        width = len(features)
    centred = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(rows).transform(rows)
    full = PCA(k=width, inputCol="_centred", outputCol="_all").fit(centred)
    shares = full.explainedVariance.toArray()
    running = np.cumsum(shares)
    if variance is not None:
        k = int(np.searchsorted(running, variance - 1e-12) + 1)
    k = min(k or width, width)
    spark = df.sparkSession
    scores = full.transform(centred).select(*keep, F.slice(vector_to_array("_all"), 1, k).alias("scores"))
    table = spark.createDataFrame([(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares[:k], running[:k]))],
                                  "component int, share double, cumulative double")
    names = features if isinstance(features, list) else [str(i) for i in range(width)]
    matrix = full.pc.toArray()
    loadings = spark.createDataFrame([(names[i], j + 1, float(matrix[i, j])) for i in range(width) for j in range(k)],
                                     "variable string, component int, loading double")
    return Components(scores, table, loadings, k)


def seeded_uniform(seed: int, *cols: str | Column) -> Column:
    """Uniform in (0, 1) from a 64-bit hash, so a retried task draws the same number."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def seeded_normal(seed: int, *cols: str | Column) -> Column:
    u1, u2 = seeded_uniform(2 * seed + 1, *cols), seeded_uniform(2 * seed + 2, *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * np.pi) * u2)
