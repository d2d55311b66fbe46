"""Logistic, penalised and selected models with repeated cross-validation."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import evaluate
from wardline.operators.grid import (Fit, Model, coefficients, design, fit_models, held_out_deviance, null_penalty, scores,
                                     sums_at_zero, _aliased, _unpack)
from wardline.session import cut_lineage


# --- single fits -------------------------------------------------------------------

def aliased_columns(df: DataFrame, outcome: str, features: list[str]) -> list[str]:
    """Features that are linear combinations of earlier ones, from one pass over the rows."""
    rows = design(df.withColumn("_id", F.lit(0)), "_id", [outcome], features, settle=False)
    sums = sums_at_zero(rows, [Model((("model", "all"),), tuple(range(len(features))))])[0]
    curve = _unpack(sums, len(features) + 1)[4]
    return [features[j - 1] for j in _aliased(curve) if j > 0]


def logit_fit(df: DataFrame, outcome: str, features: list[str]) -> DataFrame:
    """(variable, estimate, std_error, p_value, odds_ratio, lower, upper) with Wald intervals.

    Collinear features are found first and reported with null numbers.
    """
    dropped = set(aliased_columns(df, outcome, features))
    used = [f for f in features if f not in dropped]
    rows = VectorAssembler(inputCols=used, outputCol="features", handleInvalid="skip").transform(
        df.select(F.col(outcome).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in used]).dropna())
    fitted = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-10).fit(rows)
    s = fitted.summary
    numbers = list(zip([*fitted.coefficients.toArray().tolist(), fitted.intercept], s.coefficientStandardErrors, s.pValues))
    table = dict(zip([*used, "(Intercept)"], numbers))
    data = []
    for name in ["(Intercept)", *features]:
        if name in dropped:
            data.append((name, *[None] * 6))
        else:
            b, se, p = (float(v) for v in table[name])
            data.append((name, b, se, p, math.exp(b), math.exp(b - 1.959963984540054 * se), math.exp(b + 1.959963984540054 * se)))
    return df.sparkSession.createDataFrame(
        data, "variable string, estimate double, std_error double, p_value double, odds_ratio double, lower double, upper double")


def logit_l2(df: DataFrame, outcome: str, features: list[str], keep: list[str], c: float = 1.0):
    """L2 logistic with weight C on the loss: (coefficient table, scored rows)."""
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(
        df.select(*keep, F.col(outcome).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=[outcome] if outcome in keep else None))
    n = rows.count()
    fitted = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    table = df.sparkSession.createDataFrame(
        [("(Intercept)", float(fitted.intercept)), *[(f, float(b)) for f, b in zip(features, fitted.coefficients.toArray())]],
        "variable string, estimate double")
    scored = fitted.transform(rows).select(*keep, F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    return table, scored


def predict_prob(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    return scores(rows, fits, "all")


# --- folds as an array per row ----------------------------------------------------------

def with_folds(df: DataFrame, key: str, outcome: str, repeats: int, k: int, seed: int = 0, inner: int = 0,
               both_classes: bool = False) -> DataFrame:
    """Add ``folds``: the fold of every repeat, then one more entry for inner folds if asked."""
    outer = evaluate.repeated_folds(df, key, outcome, repeats, k, seed, both_classes=both_classes)
    slots = [F.max(F.when(F.col("repeat") == r, F.col("fold"))) for r in range(1, repeats + 1)]
    if inner:
        extra = evaluate.one_round_of_folds(df, key, [(repeats + 1, 0)], inner, seed + 1, [outcome]).drop("attempt")
        outer = outer.unionByName(extra)
        slots.append(F.max(F.when(F.col("repeat") == repeats + 1, F.col("fold"))))
    wide = outer.groupBy(key).agg(F.array(*slots).cast("array<int>").alias("folds"))
    return df.join(wide, key)


def fold_models(template: Model, repeats: int, k: int) -> list[Model]:
    return [replace(template, key=(*template.key, ("repeat", r), ("fold", f)), held=(r - 1, f))
            for r in range(1, repeats + 1) for f in range(1, k + 1)]


# --- penalised path ---------------------------------------------------------------------

def penalty_grid(top: float, n: int, ratio: float) -> list[float]:
    return [float(v) for v in np.geomspace(max(top, 1e-8), max(top, 1e-8) * ratio, n)]


def choose_penalty(per_fold: dict[float, list[tuple[float, float]]]) -> tuple[float, float, dict[float, tuple[float, float]]]:
    """Penalty of least held-out deviance, the largest within one standard error, and the curve."""
    curve = {}
    for lam, parts in per_fold.items():
        dev = np.array([d for d, w in parts if w > 0])
        w = np.array([w for d, w in parts if w > 0])
        mean = float(np.average(dev, weights=w))
        se = float(np.sqrt(np.average((dev - mean) ** 2, weights=w) / max(len(dev) - 1, 1)))
        curve[lam] = (mean, se)
    best = min(curve, key=lambda lam: (curve[lam][0], -lam))
    limit = curve[best][0] + curve[best][1]
    return best, max(lam for lam, (mean, _) in curve.items() if mean <= limit), curve


def lasso_fits(rows: DataFrame, templates: list[Model], inner_slot: int, inner_folds: int, n_penalties: int = 20,
               ratio: float = 0.01) -> list[dict]:
    """Penalty path with inner cross-validation for each template, all in one grid.

    Returns per template the path, lambda.min, lambda.1se and the fit at every penalty.
    """
    zero = sums_at_zero(rows, templates)
    plans, models = [], []
    for t, s in zip(templates, zero):
        grid = penalty_grid(null_penalty(s, len(t.terms)), n_penalties, ratio)
        plans.append((grid, len(models)))
        for lam in grid:
            models.append(replace(t, l1=lam))
            models += [replace(t, l1=lam, inner=(inner_slot, f)) for f in range(1, inner_folds + 1)]
    fits = fit_models(rows, models)
    inner = [f for f in fits if f.model.inner is not None]
    tested = dict(zip((id(f) for f in inner), held_out_deviance(rows, inner)))
    out = []
    for grid, start in plans:
        per_fold, at = {}, {}
        for i, lam in enumerate(grid):
            block = fits[start + i * (inner_folds + 1): start + (i + 1) * (inner_folds + 1)]
            at[lam], per_fold[lam] = block[0], [tested[id(f)] for f in block[1:]]
        low, one_se, curve = choose_penalty(per_fold)
        out.append({"lambda_min": low, "lambda_1se": one_se, "curve": curve, "fits": at})
    return out


def lasso_path(rows: DataFrame, features: list[str], inner_slot: int, inner_folds: int, n_penalties: int = 20) -> DataFrame:
    """(penalty, deviance, std_error, n_variables, is_min, is_1se) of a whole-sample path."""
    res = lasso_fits(rows, [Model((("model", "lasso"),), tuple(range(len(features))))], inner_slot, inner_folds, n_penalties)[0]
    data = [(lam, *res["curve"][lam], int(np.sum(np.abs(f.beta[1:]) > 0)), lam == res["lambda_min"], lam == res["lambda_1se"])
            for lam, f in res["fits"].items()]
    return rows.sparkSession.createDataFrame(
        data, "penalty double, deviance double, std_error double, n_variables int, is_min boolean, is_1se boolean")


# --- cross-validation and validation elsewhere -----------------------------------------------

def cross_validate(rows: DataFrame, terms: list[int], repeats: int, k: int, learner: str = "glm", inner_folds: int = 0,
                   n_penalties: int = 10, name: str = "all", outcome: int = 0, case: int = 0) -> list[Fit]:
    """One fit per repeat and fold on the other folds; ``learner`` is glm or lasso."""
    models = fold_models(Model((("model_name", name),), tuple(terms), outcome=outcome, case=case), repeats, k)
    if learner == "glm":
        return fit_models(rows, models)
    paths = lasso_fits(rows, models, repeats, inner_folds, n_penalties)
    return [p["fits"][p["lambda_min"]] for p in paths]


BY_FOLD = ["model_name", "repeat", "fold"]


def fold_metrics(scored: DataFrame, by: list[str] = BY_FOLD) -> DataFrame:
    """AUC, class Brier score, accuracy, sensitivity and specificity per fold, from one grouping."""
    return evaluate.all_metrics(scored, by).select(
        *by, "auc", "brier", "accuracy", "sensitivity", "specificity", "balanced_accuracy")


def external_validate(fits: list[Fit], rows: DataFrame, by: list[str] = BY_FOLD) -> DataFrame:
    """Every fitted model on all rows of another site."""
    return fold_metrics(scores(rows, fits, "all"), by)


def cross_validated_metrics(rows: DataFrame, fits: list[Fit], by: list[str] = BY_FOLD) -> DataFrame:
    return fold_metrics(scores(rows, fits), by)


# --- marker screen -----------------------------------------------------------------------------

def single_marker_screen(rows: DataFrame, features: list[str], control: list[int], groups: dict[str, tuple[list[int], int | None]],
                         repeats: int, k: int, outcome: int = 0) -> dict[str, DataFrame]:
    """Each marker group with the control terms, against the control terms alone.

    ``groups`` maps a name to (its level columns, its missing column or None); rows with the
    marker missing are left out of its models. Gives ``coefficients`` (whole sample), ``auc``
    (whole sample and cross-validated) and ``difference`` (control minus group, per fold).
    """
    whole, folded = [], []
    everyone = {**{g: (tuple([*control, *cols]), (na,) if na is not None else ()) for g, (cols, na) in groups.items()}, "control": (tuple(control), ())}
    for g, (terms, skip) in everyone.items():
        base = Model((("model_name", g),), terms, outcome=outcome, skip=skip)
        whole.append(base)
        folded += fold_models(base, repeats, k)
    fits = fit_models(rows, whole + folded)
    full, cv = fits[:len(whole)], fits[len(whole):]
    sample = evaluate.auc(scores(rows, full, "all"), ["model_name"]).withColumnRenamed("auc", "sample_auc")
    # one row per group and fold, used three times
    per_fold = cut_lineage(evaluate.auc(scores(rows, cv), BY_FOLD))
    ranges = evaluate.interval_summary(per_fold, ["model_name"], "auc").select("model_name", "q025", "q500", "q975")
    base = per_fold.filter("model_name = 'control'").select("repeat", "fold", F.col("auc").alias("control_auc"))
    diff = per_fold.filter("model_name <> 'control'").join(base, ["repeat", "fold"]).withColumn("difference", F.col("control_auc") - F.col("auc"))
    table = coefficients(rows, [f for f in full if dict(f.model.key)["model_name"] != "control"], features)
    return {"coefficients": table, "auc": sample.join(ranges, "model_name"),
            "difference": evaluate.interval_summary(diff, ["model_name"], "difference").select("model_name", "n", "q025", "q500", "q975")}


# --- bootstrap and forward selection --------------------------------------------------------------

def bootstrap_odds_ratios(rows: DataFrame, features: list[str], replicates: int, outcome: int = 0) -> DataFrame:
    """Odds ratio of each term with its 2.5/50/97.5 % bootstrap quantiles (Poisson weights)."""
    terms = tuple(range(len(features)))
    models = [Model((("replicate", 0),), terms, outcome=outcome)]
    models += [Model((("replicate", b),), terms, outcome=outcome, replicate=b) for b in range(1, replicates + 1)]
    coefs = coefficients(rows, fit_models(rows, models), features)
    q = F.percentile(F.when(F.col("replicate") > 0, F.col("odds_ratio")), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    table = coefs.groupBy("variable").agg(F.max(F.when(F.col("replicate") == 0, F.col("odds_ratio"))).alias("odds_ratio"), q.alias("_q"))
    return table.select("variable", "odds_ratio", F.col("_q")[0].alias("q025"), F.col("_q")[1].alias("q500"), F.col("_q")[2].alias("q975"))


def forward_select(rows: DataFrame, features: list[str], start: list[int], max_terms: int, repeats: int, k: int, outcome: int = 0) -> DataFrame:
    """(step, variable, auc): the term that adds most held-out AUC, step by step.

    All candidates of a step, in all folds, are one grid. A candidate without an AUC in any fold is never chosen; if none has
    one, the path ends.
    """
    chosen, path = list(start), []
    for step in range(1, max_terms + 1):
        rest = [j for j in range(len(features)) if j not in chosen]
        if not rest:
            break
        models = [m for j in rest for m in fold_models(Model((("model_name", features[j]),), tuple([*chosen, j]), outcome=outcome), repeats, k)]
        fits = fit_models(rows, models)
        per_fold = evaluate.auc(scores(rows, fits), BY_FOLD)
        # one number per candidate
        means = {r["model_name"]: r["auc"] for r in per_fold.groupBy("model_name").agg(F.avg("auc").alias("auc")).collect()}
        rest = [j for j in rest if means.get(features[j]) is not None]
        if not rest:
            break
        best = min(rest, key=lambda j: (-means[features[j]], j))
        chosen.append(best)
        path.append((step, features[best], float(means[features[best]])))
    return rows.sparkSession.createDataFrame(path, "step int, variable string, auc double")
