"""Static-feature model: first stay per patient, encode, scale, impute, reduce, split, fit, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import evaluate, impute, learn, prep, ranking, reshape, select
from wardline.session import cut_lineage


@dataclass
class StaticModel:
    coefficients: DataFrame
    scored: DataFrame
    metrics: DataFrame
    variance: DataFrame


def static_model(df: DataFrame, key: str, order: list[str], outcome: str, category: str, levels: list[str], merge: dict[str, str | None],
                 numeric: list[str], max_missing: float = 0.7, k: int = 2, variance: float = 0.95, test_share: float = 0.3,
                 seed: int = 0, scale: bool = True) -> StaticModel:
    """Outcome model from first-stay features; sparse columns are dropped before anything is fitted."""
    first = ranking.first_nonnull_per(df, [key], order, [outcome, category, *numeric])
    coded = reshape.one_hot(first.withColumn(category, select.recode(category, merge)), category, levels)
    coded = reshape.drop_sparse_columns(coded, numeric, max_missing)
    kept = [c for c in numeric if c in coded.columns]
    features = [*kept, *[f"{category}_{l}" for l in levels]]
    coded = cut_lineage(coded.filter(F.col(outcome).isNotNull()))
    scaled = prep.standardise(coded, features) if scale else coded
    filled = cut_lineage(impute.knn_impute(scaled, key, features, k))
    parts = prep.pca(filled, features, [key, outcome], variance=variance)
    names = [f"pc{i + 1}" for i in range(parts.k)]
    wide = parts.scores.select(key, outcome, *[F.col("scores")[i].alias(n) for i, n in enumerate(names)])
    split = cut_lineage(evaluate.stratified_split(wide, outcome, key, test_share, seed))
    table, _ = learn.logit_l2(split.filter("part = 'train'"), outcome, names, [key])
    b = {r["variable"]: r["estimate"] for r in table.collect()}  # one row per component
    eta = F.lit(b["(Intercept)"])
    for n in names:
        eta = eta + F.lit(b[n]) * F.col(n)
    scored = split.select(key, "part", F.col(outcome).cast("int").alias("y"), (1 / (1 + F.exp(-eta))).alias("p"))
    return StaticModel(table, scored, evaluate.all_metrics(scored, ["part"]), parts.variance)
