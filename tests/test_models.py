"""Splits, scores and models against hand-worked or independent answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import evaluate, grid, impute, learn, prep


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "age": rng.normal(60, 10, n), "sex": rng.integers(0, 2, n), "mark": rng.integers(0, 2, n), "noise": rng.normal(size=n)})
    p = 1 / (1 + np.exp(-(-1 + 0.05 * (pdf.age - 60) + 0.9 * pdf.mark)))
    pdf["y"] = (rng.random(n) < p).astype(int)
    pdf["twin"] = 2 * pdf.mark + 1
    return spark.createDataFrame(pdf), pdf


TERMS = ["age", "sex", "mark", "noise"]


def irls(x, y, w=None):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if w is None else w
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)))
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (w * p * (1 - p))[:, None]))))


def test_grid_and_library_agree_with_irls(spark, people):
    df, pdf = people
    b, se = irls(pdf[TERMS].to_numpy(float), pdf.y.to_numpy(float))
    rows = grid.design(df, "id", ["y"], TERMS)
    own = grid.coefficients(rows, grid.fit_models(rows, [grid.Model((("m", "a"),), (0, 1, 2, 3))]), TERMS).toPandas().set_index("variable")
    lib = learn.logit_fit(df, "y", TERMS).toPandas().set_index("variable")
    for i, name in enumerate(["(Intercept)", *TERMS]):
        assert own.loc[name, "estimate"] == pytest.approx(b[i], abs=1e-6) and own.loc[name, "std_error"] == pytest.approx(se[i], abs=1e-5)
        assert lib.loc[name, "estimate"] == pytest.approx(b[i], abs=1e-5) and lib.loc[name, "upper"] == pytest.approx(math.exp(b[i] + 1.959964 * se[i]), rel=1e-4)
    assert own.p_value["mark"] == pytest.approx(lib.p_value["mark"], abs=1e-6)


def test_aliased_column_is_reported(spark, people):
    df, _ = people
    assert learn.aliased_columns(df, "y", ["age", "mark", "twin"]) == ["twin"]
    table = learn.logit_fit(df, "y", ["age", "mark", "twin"]).toPandas().set_index("variable")
    assert np.isnan(table.loc["twin", "estimate"]) and not np.isnan(table.loc["mark", "estimate"])


def test_lasso_meets_its_optimality_conditions(spark, people):
    df, pdf = people
    rows = grid.design(df, "id", ["y"], TERMS)
    lam = 0.03
    fit = grid.fit_models(rows, [grid.Model((("m", "l"),), (0, 1, 2, 3), l1=lam)], max_iter=60, tol=1e-13)[0]
    x = pdf[TERMS].to_numpy(float)
    sd = x.std(axis=0)
    p = 1 / (1 + np.exp(-(fit.beta[0] + x @ fit.beta[1:])))
    grad = x.T @ (pdf.y - p) / len(x) / sd
    for g, b in zip(grad, fit.beta[1:]):
        assert abs(g) <= lam + 1e-5 if b == 0 else g == pytest.approx(lam * np.sign(b), abs=1e-5)
    assert 0 < np.sum(fit.beta[1:] != 0) < 4


def test_largest_penalty_empties_the_model(spark, people):
    df, _ = people
    rows = grid.design(learn.with_folds(df, "id", "y", 1, 3, inner=3), "id", ["y"], TERMS, F.col("folds"))
    path = learn.lasso_path(rows, TERMS, 1, 3, 6).toPandas().sort_values("penalty", ascending=False)
    assert path.n_variables.iloc[0] == 0 and path.n_variables.iloc[-1] >= 3
    assert path.is_min.sum() == 1 and path.is_1se.sum() == 1
    assert path[path.is_1se].penalty.iloc[0] >= path[path.is_min].penalty.iloc[0]


def test_l2_is_smaller_than_plain(spark, people):
    df, _ = people
    plain = learn.logit_l2(df, "y", ["mark"], ["id"], c=1e9)[0].toPandas().set_index("variable").estimate["mark"]
    small = learn.logit_l2(df, "y", ["mark"], ["id"], c=0.01)[0].toPandas().set_index("variable").estimate["mark"]
    assert 0 < small < plain


def test_folds_partition_and_hold_events(spark, people):
    df, pdf = people
    folds = evaluate.repeated_folds(df, "id", "y", 3, 5, 2).toPandas()
    for _, part in folds.groupby("repeat"):
        assert sorted(part.id) == list(range(400))
        assert part.groupby("fold").y.sum().min() > 0 and set(part.groupby("fold").size()) == {80}


def test_folds_are_shuffled_again_until_each_has_an_event(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "id int, y int")
    folds = evaluate.repeated_folds(df, "id", "y", 4, 3, 0).toPandas()
    assert folds.groupby(["repeat", "fold"]).y.sum().tolist() == [1] * 12


def test_split_keeps_label_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "id int, l string")
    got = evaluate.stratified_split(df, "l", "id", 0.3, 1).groupBy("l", "part").count().collect()
    assert {(r["l"], r["part"]): r["count"] for r in got} == {("a", "train"): 49, ("a", "test"): 21, ("b", "train"): 21, ("b", "test"): 9}


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.mark.parametrize("ranges", [1, 30, None])
def test_auc_with_ties(spark, ranges):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 300), "y": rng.integers(0, 2, 300), "p": np.round(rng.random(300), 1)})
    pdf["q"] = 1 - pdf.p
    df = spark.createDataFrame(pdf)
    up = {r["g"]: r["auc"] for r in evaluate.auc(df, ["g"], ranges=ranges).collect()}
    down = {r["g"]: r["auc"] for r in evaluate.auc(df, ["g"], p="q", ranges=ranges).collect()}
    for g, part in pdf.groupby("g"):
        assert up[g] == pytest.approx(auc_by_pairs(part.y.to_numpy(), part.p.to_numpy())) and up[g] + down[g] == pytest.approx(1)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert evaluate.auc(df, []).first()["auc"] is None


def test_rates_follow_the_positive_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (1, 0.8), (0, 0.1), (0, 0.5)], "y int, p double")
    counts = evaluate.confusion(df, [])
    assert tuple(counts.first()) == (2, 0, 1, 2)
    assert evaluate.rates(counts).first()["sensitivity"] == pytest.approx(2 / 3)
    assert evaluate.rates(counts, positive=0).first()["sensitivity"] == 1.0
    every = evaluate.all_metrics(df, []).first()
    assert (every["tp"], every["fp"], every["fn"], every["tn"]) == (2, 0, 1, 2) and every["brier"] == pytest.approx(0.2)


def test_calibration_includes_one(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.95), (0, 0.05)], "y int, p double")
    assert {r["bin"]: (r["n"], r["observed"]) for r in evaluate.calibration(df, []).collect()} == {9: (2, 0.5), 0: (1, 0.0)}


def test_t_interval(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21)], "v double").withColumn("g", F.lit("a"))
    row = evaluate.interval_summary(df, ["g"], "v").first()
    half = 2.093024 * np.std(np.arange(1, 21), ddof=1) / math.sqrt(20)
    assert row["t_low"] == pytest.approx(10.5 - half, abs=1e-4) and row["q025"] == pytest.approx(np.quantile(np.arange(1, 21), 0.025))


def test_cross_validation_equals_separate_fits(spark, people):
    df, pdf = people
    with_folds = learn.with_folds(df, "id", "y", 1, 4, 3)
    rows = grid.design(with_folds, "id", ["y"], TERMS, F.col("folds"))
    fits = learn.cross_validate(rows, [0, 1, 2, 3], 1, 4)
    folds = with_folds.select("id", F.col("folds")[0].alias("f")).toPandas().set_index("id").f
    scored = grid.scores(rows, fits).toPandas()
    assert len(scored) == 400
    for f, part in scored.groupby("fold"):
        held = pdf[pdf.id.map(folds) == f]
        rest = pdf[pdf.id.map(folds) != f]
        b, _ = irls(rest[TERMS].to_numpy(float), rest.y.to_numpy(float))
        want = 1 / (1 + np.exp(-(b[0] + held[TERMS].to_numpy(float) @ b[1:])))
        assert part.set_index("id").p.loc[held.id].to_numpy() == pytest.approx(want, abs=1e-6)


def test_external_scores_on_training_rows_equal_in_sample(spark, people):
    df, _ = people
    rows = grid.design(df, "id", ["y"], TERMS)
    fit = grid.fit_models(rows, [grid.Model((("model_name", "m"), ("repeat", 1), ("fold", 1)), (0, 2))])
    out = learn.external_validate(fit, rows).first()
    sample = evaluate.auc(grid.scores(rows, fit, "all"), ["model_name"]).first()
    assert out["auc"] == pytest.approx(sample["auc"])


def test_screen_leaves_missing_out(spark, people):
    df, pdf = people
    df = df.withColumn("absent", (F.col("id") < 50).cast("int"))
    rows = grid.design(learn.with_folds(df, "id", "y", 1, 3, 3), "id", ["y"], ["age", "sex", "mark", "absent"], F.col("folds"))
    res = learn.single_marker_screen(rows, ["age", "sex", "mark", "absent"], [0, 1], {"mark": ([2], 3)}, 1, 3)
    part = pdf[pdf.id >= 50]
    b, _ = irls(part[["age", "sex", "mark"]].to_numpy(float), part.y.to_numpy(float))
    got = res["coefficients"].filter("variable = 'mark'").first()
    assert got["odds_ratio"] == pytest.approx(math.exp(b[3]), rel=1e-5)
    assert res["difference"].first()["n"] == 3


def test_bootstrap_covers_the_estimate(spark, people):
    df, _ = people
    rows = grid.design(df, "id", ["y"], TERMS)
    got = learn.bootstrap_odds_ratios(rows, TERMS, 40).toPandas().set_index("variable")
    assert (got.q025 < got.odds_ratio).all() and (got.odds_ratio < got.q975).all()
    again = learn.bootstrap_odds_ratios(rows, TERMS, 40).toPandas().set_index("variable")
    assert again.q025["mark"] == pytest.approx(got.q025["mark"])


def test_poisson_weights_have_mean_one():
    w = grid.poisson_weights(np.arange(50_000), 3)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)


def test_forward_selection_finds_the_signal(spark, people):
    df, _ = people
    rows = grid.design(learn.with_folds(df, "id", "y", 1, 3, 3), "id", ["y"], TERMS, F.col("folds"))
    path = learn.forward_select(rows, TERMS, [], 2, 1, 3).collect()
    assert {r["variable"] for r in path} == {"age", "mark"}


# --- preparation ---------------------------------------------------------------------

@pytest.mark.parametrize("leaf_rows, width", [(4, 4), (1000, 4), (16, 40)])
def test_knn_equals_brute_force(spark, leaf_rows, width):
    """At 40 columns nearly every row has a null pattern of its own."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, width)), 1)
    x[rng.random((150, width)) < 0.2] = np.nan
    x[:40] = x[0]  # one group of copies
    x[149] = np.nan
    cols = [f"c{j}" for j in range(width)]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               ", ".join(["id int", *[f"{c} double" for c in cols]]))
    got = impute.knn_impute(df, "id", cols, 2, leaf_rows=leaf_rows).toPandas().sort_values("id")[cols].to_numpy()
    want = x.copy()
    for i in range(150):
        for j in np.flatnonzero(np.isnan(x[i])):
            donors = np.flatnonzero(~np.isnan(x[:, j]))
            diff = x[donors] - x[i]
            common = ~np.isnan(diff)
            d = np.where(common.any(1), np.where(common, diff, 0).__pow__(2).sum(1) * width / np.maximum(common.sum(1), 1), np.inf)
            near = np.lexsort((donors, d))[:2]
            near = near[np.isfinite(d[near])]
            want[i, j] = x[donors[near], j].mean() if len(near) else np.nanmean(x[:, j])
    assert got == pytest.approx(want, abs=1e-9)


def test_donor_boxes_do_not_follow_null_patterns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 40))
    x[rng.random((300, 40)) < 0.3] = np.nan
    donors = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")
    _, leaves = impute._grow_leaves(donors, 40, 300, 50_000)
    assert len(leaves.ids) == 1 and leaves.some.all()


def test_chained_imputation_keeps_observed_values(spark, people):
    df, pdf = people
    holed = df.select("id", F.when(F.col("id") >= 80, F.col("age")).alias("age"), F.col("mark").cast("double").alias("mark"),
                      F.when(F.col("id") < 350, F.col("y")).cast("double").alias("y"))
    out = impute.chained_impute(holed, "id", {"age": "numeric", "mark": "binary", "y": "binary"}, copies=3, rounds=2, seed=1).toPandas()
    assert len(out) == 1200 and not out.isna().any().any()
    first = out[out.imputation == 1].set_index("id").sort_index()
    assert first.age.loc[100:].to_numpy() == pytest.approx(pdf.age.loc[100:].to_numpy()) and set(first.y) == {0.0, 1.0}
    spread = out[out.id < 80].groupby("id").age.std()
    assert spread.min() > 0 and abs(first.age.loc[:79].mean() - 60) < 4


def test_pca_centres_and_reaches_the_share(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.diag([5, 2, 0.5]) + 10
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    out = prep.pca(df, ["a", "b", "c"], ["id"], variance=0.9)
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = share / share.sum()
    assert out.k == int(np.searchsorted(np.cumsum(share), 0.9) + 1)
    assert [r["share"] for r in out.variance.orderBy("component").collect()] == pytest.approx(share[:out.k].tolist(), abs=1e-9)
    assert out.scores.select(F.avg(F.col("scores")[0])).first()[0] == pytest.approx(0, abs=1e-9)


def test_standardise_and_robust_scale(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (10.0, 7.0)], "a double, b double")
    a = [r["a"] for r in prep.standardise(df, ["a", "b"]).collect()]
    assert np.mean(a) == pytest.approx(0) and np.std(a) == pytest.approx(1)
    assert [r["a"] for r in prep.robust_scale(df, ["a", "b"]).collect()] == pytest.approx([-0.5, -0.16666667, 0.16666667, 2.5], abs=0.2)
    assert [r["b"] for r in prep.robust_scale(df, ["b"]).collect()] == [0.0] * 4


# --- selection ---------------------------------------------------------------------------

def test_pairs_and_sets(spark):
    data = [(1, "a", 0.01), (1, "b", 0.02), (1, "c", 0.5), (2, "a", 0.01), (2, "b", 0.04), (3, "c", 0.9)]
    df = spark.createDataFrame(data, "model int, variable string, p_value double")
    chosen = evaluate.chosen_by_p()
    pairs = {(r["variable"], r["other"]): r["n"] for r in evaluate.pair_frequency(df, ["model"], chosen).collect()}
    assert pairs == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2, ("b", "b"): 2}
    sets = evaluate.model_frequency(df, ["model"], chosen).collect()
    assert [(r["variables"], r["n"]) for r in sets] == [("a,b", 2), ("", 1)] and sets[1]["cumulative_share"] == pytest.approx(1)


def test_median_ratio_needs_more_than_the_limit(spark):
    df = spark.createDataFrame([(i, "a", 2.0) for i in range(51)] + [(i, "b", 2.0) for i in range(50)], "m int, variable string, odds_ratio double")
    got = {r["variable"]: r["median_odds_ratio"] for r in evaluate.odds_ratio_summary(df).collect()}
    assert got == {"a": 2.0, "b": None}
