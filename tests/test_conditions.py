"""Counted design rows, nested folds, fits of many conditions and their report."""

import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import conditions as C
from wardline.operators import evaluate, grid, learn
from wardline.session import checkpoint_dir, cut_lineage

FEATURES = ["a", "b", "c", "d", "twin"]
OUTCOMES = ["y", "z"]


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), **{f: rng.integers(0, 2, n) for f in "abcd"}})
    pdf["twin"] = 1 - pdf.a
    for name, shift in (("y", -0.5), ("z", 0.3)):
        pdf[name] = (rng.random(n) < 1 / (1 + np.exp(-(shift + 1.1 * pdf.a - 0.7 * pdf.b)))).astype(int)
    rows = pd.concat([pdf.assign(case=0), pdf.assign(case=1, a=1 - pdf.a)])
    return spark.createDataFrame(rows), pdf


@pytest.fixture(scope="module")
def folds(spark, people):
    return evaluate.nested_folds(people[0].where("case = 0"), "id", OUTCOMES, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def counts(people, folds):
    return C.frequency_table(people[0], folds, "id", FEATURES, OUTCOMES)


@pytest.fixture(scope="module")
def fitted(counts):
    return cut_lineage(C.fit_conditions(counts, FEATURES, OUTCOMES))


def test_nested_folds_partition_and_hold_events(folds, people):
    table = folds.toPandas().merge(people[1], on="id")
    for _, one in table.groupby("repeat"):
        assert sorted(one.id) == list(range(500)) and one.groupby("fold").size().tolist() == pytest.approx([500 / 3] * 3, abs=1)
        for f in (1, 2, 3):
            assert one[one.fold == f].groupby("inner").size().between(40, 43).all()
            for o in OUTCOMES:
                assert one[one.fold == f][o].sum() > 0 and (one[one.fold != f].groupby("inner")[o].sum() > 0).all()


def test_repeats_are_drawn_again_until_they_hold_events(spark):
    df = spark.createDataFrame([(i, int(i < 6)) for i in range(36)], "id int, y int")
    table = evaluate.nested_folds(df, "id", ["y"], 4, 3, 2, 1).toPandas()
    assert sorted(table.id) == sorted(list(range(36)) * 4)
    table["y"] = (table.id < 6).astype(int)
    for (_, f), _ in table.groupby(["repeat", "fold"]):
        assert (table.groupby(["repeat", "fold"]).y.sum() > 0).all()
    with pytest.raises(ValueError):
        evaluate.nested_folds(spark.createDataFrame([(i, int(i < 1)) for i in range(12)], "id int, y int"), "id", ["y"], 1, 3, 2, 1, attempts=3)
    with pytest.raises(ValueError):
        evaluate.repeated_folds(spark.createDataFrame([(i, 0) for i in range(12)], "id int, y int"), "id", "y", 1, 3, attempts=2)


def test_frequency_table_counts_rows(counts, folds, people):
    rows = people[0].toPandas().merge(folds.toPandas(), on="id")
    want = rows.groupby(["case", "repeat", "fold", "inner", *FEATURES]).agg(n=("id", "size"), y=("y", "sum"), z=("z", "sum"))
    got = {(r["case"], r["repeat"], r["fold"], r["inner"], *map(int, r["x"])): (r["n"], *r["events"]) for r in counts.collect()}
    assert got == {k: tuple(v) for k, v in zip(want.index, want.itertuples(index=False))}


def test_null_features_and_outcomes_are_left_out(spark, folds):
    df = spark.createDataFrame([(1, 0, 1, None), (2, 0, None, 1), (3, 0, 1, 0), (3, 0, 1, 0)], "id int, case int, a int, y int")
    got = C.frequency_table(df, None, "id", ["a"], ["y"]).collect()
    assert [(r["repeat"], r["fold"], r["inner"], r["x"], r["n"], r["events"]) for r in got] == [(0, 0, 0, [1.0], 2, [0])]
    assert C.fit_conditions(C.frequency_table(df.limit(0), folds, "id", ["a"], ["y"]), ["a"], ["y"]).count() == 0


def test_plain_fits_equal_the_grid_of_rows(spark, people, folds, fitted):
    wide = folds.groupBy("id").agg(F.array(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))) for r in (1, 2)]).alias("folds"))
    rows = grid.design(people[0].join(wide, "id"), "id", OUTCOMES, FEATURES, F.col("folds"), F.col("case"))
    models = [grid.Model((("case", c), ("outcome", o), ("repeat", r), ("fold", f)), (0, 1, 2, 3, 4), outcome=i, case=c, held=(r - 1, f))
              for c in (0, 1) for i, o in enumerate(OUTCOMES) for r in (1, 2) for f in (1, 2, 3)]
    want = {tuple(v for _, v in fit.model.key): fit for fit in grid.fit_models(rows, models, tol=1e-13)}
    for r in fitted.where("learner = 'glm'").collect():
        fit = want[r["case"], r["outcome"], r["repeat"], r["fold"]]
        j = [C.INTERCEPT, *FEATURES].index(r["variable"])
        if r["variable"] == "twin":
            assert r["estimate"] is None and r["std_error"] is None
            continue
        assert r["estimate"] == pytest.approx(fit.beta[j], abs=1e-8) and r["std_error"] == pytest.approx(math.sqrt(fit.cov[j, j]), abs=1e-8)
        assert r["converged"] and r["n"] == fit.n


def test_every_fit_meets_its_optimality_conditions(counts, fitted):
    residual = C.optimality(counts, fitted, FEATURES, OUTCOMES)
    assert residual.count() == fitted.count() == 2 * 2 * 2 * 3 * 2 * 6
    assert residual.agg(F.max("residual")).first()[0] < 1e-9
    moved = fitted.withColumn("estimate", F.col("estimate") + 0.01)
    assert C.optimality(counts, moved, FEATURES, OUTCOMES).agg(F.min(F.when(F.col("variable") == C.INTERCEPT, F.col("residual")))).first()[0] > 1e-4


def test_penalties_are_those_of_a_plain_search(people, folds, fitted):
    """One condition's nested path by proximal gradient steps over rows."""
    pdf = people[1].merge(folds.toPandas(), on="id")
    part = pdf[(pdf["repeat"] == 2) & (pdf.fold != 1)]
    x, y, inner = part[FEATURES].to_numpy(float), part.y.to_numpy(float), part.inner.to_numpy()

    def fit(x, y, lam):
        sd = x.std(axis=0)
        z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / sd])
        b, step = np.zeros(6), 4.0 / np.linalg.eigvalsh(z.T @ z / len(z)).max()
        for _ in range(3000):
            b = b - step * z.T @ (1 / (1 + np.exp(-z @ b)) - y) / len(y)
            b[1:] = np.sign(b[1:]) * np.maximum(np.abs(b[1:]) - step * lam, 0)
        return np.r_[b[0] - (b[1:] * x.mean(axis=0) / sd).sum(), b[1:] / sd]

    centred = (x - x.mean(axis=0)) / x.std(axis=0)
    top = np.abs(centred.T @ (y - y.mean())).max() / len(y)
    path = top * np.geomspace(1, 0.01, 20)
    dev, weight = np.zeros((4, 20)), np.zeros(4)
    for g in range(1, 5):
        out = inner == g
        weight[g - 1] = out.sum()
        for i, lam in enumerate(path):
            eta = fit(x[~out], y[~out], lam) @ np.column_stack([np.ones(out.sum()), x[out]]).T
            dev[g - 1, i] = 2 * np.mean(np.logaddexp(0, eta) - y[out] * eta)
    mean = np.average(dev, axis=0, weights=weight)
    se = np.sqrt(np.average((dev - mean) ** 2, axis=0, weights=weight) / 3)
    low = int(np.argmin(mean))
    row = fitted.where("learner = 'lasso' AND case = 0 AND outcome = 'y' AND repeat = 2 AND fold = 1").toPandas().set_index("variable")
    assert row.lambda_min.iloc[0] == pytest.approx(path[low]) and row.lambda_1se.iloc[0] == pytest.approx(path[np.flatnonzero(mean <= mean[low] + se[low])[0]])
    want = fit(x, y, path[low])
    # a and its twin share one effect in any proportion
    got = row.estimate[[C.INTERCEPT, *FEATURES]].to_numpy(float)
    assert got[2:5] == pytest.approx(want[2:5], abs=1e-5) and got[1] - got[5] == pytest.approx(want[1] - want[5], abs=1e-5)


def test_passes_over_counts_give_the_same_fits(people, folds, counts, fitted):
    one = C.frequency_table(people[0].where("case = 1"), folds.where("repeat = 1"), "id", FEATURES[:4], OUTCOMES)
    slow = C.fit_conditions(one, FEATURES[:4], OUTCOMES, penalties=5, most_cells=1).toPandas().set_index([*C.KEYS, "variable"]).sort_index()
    quick = C.fit_conditions(one, FEATURES[:4], OUTCOMES, penalties=5).toPandas().set_index([*C.KEYS, "variable"]).sort_index()
    assert slow.index.equals(quick.index) and len(slow) == 2 * 3 * 2 * 5
    for c in ("estimate", "std_error", "lambda_min", "lambda_1se", "n"):
        assert slow[c].astype(float).to_numpy() == pytest.approx(quick[c].astype(float).to_numpy(), abs=1e-4, nan_ok=True)
    few = C.fit_conditions(counts, FEATURES, OUTCOMES, ("glm",), most_cells=32 * 3 * 4).toPandas()  # a repeat a task
    assert few.estimate.sum() == pytest.approx(fitted.where("learner = 'glm'").toPandas().estimate.sum(), abs=1e-8)


def test_scores_and_metrics_equal_those_of_rows(people, folds, counts, fitted):
    rows = people[0].toPandas().merge(folds.toPandas(), on="id")
    beta = {tuple(r[k] for k in C.KEYS): [r["b0"], *r["b"]] for r in C.betas(fitted, FEATURES).collect()}
    got = {tuple(r[k] for k in C.KEYS): r for r in C.model_metrics(C.held_out_scores(counts, fitted, FEATURES, OUTCOMES)).collect()}
    assert len(got) == 48
    for (case, outcome, repeat, fold, learner), r in got.items():
        part = rows[(rows.case == case) & (rows["repeat"] == repeat) & (rows.fold == fold)]
        b = beta[case, outcome, repeat, fold, learner]
        p = np.round(1 / (1 + np.exp(-(b[0] + part[FEATURES].to_numpy(float) @ b[1:]))), 12)
        y = part[outcome].to_numpy()
        wins = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
        assert r["auc"] == pytest.approx(wins / (y.sum() * (1 - y).sum()), abs=1e-3) and r["brier"] == pytest.approx(np.mean((p > 0.5) != y))
        assert r["sensitivity"] == pytest.approx(np.mean(p[y == 1] > 0.5)) and r["specificity"] == pytest.approx(np.mean(p[y == 0] <= 0.5))


def test_other_site_takes_every_model(people, fitted):
    other = C.frequency_table(people[0].where("id < 100"), None, "id", FEATURES, OUTCOMES)
    scored = C.generalised_scores(other, fitted, FEATURES, OUTCOMES)
    assert {r["n"] for r in scored.groupBy(*C.KEYS).agg(F.sum(F.col("n1") + F.col("n0")).alias("n")).collect()} == {100}
    assert C.model_metrics(scored).count() == 48


def test_store_goes_on_where_it_is(spark, counts):
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    assert C.stored(spark, path) is None
    first = C.fill_store(path, counts.where("case = 0"), FEATURES, OUTCOMES, ("glm",))
    assert first.count() == 2 * 2 * 3 * 6
    before = {r["f"] for r in first.select(F.input_file_name().alias("f")).distinct().collect()}
    everything = C.fill_store(path, counts, FEATURES, OUTCOMES, ("glm",))
    assert everything.count() == 2 * 2 * 2 * 3 * 6 and everything.groupBy(*C.KEYS, "variable").count().where("count <> 1").isEmpty()
    assert before <= {r["f"] for r in everything.select(F.input_file_name().alias("f")).distinct().collect()}
    again = C.fill_store(path, counts, FEATURES, OUTCOMES, ("glm",))
    assert {r["f"] for r in again.select(F.input_file_name().alias("f")).distinct().collect()} == {r["f"] for r in everything.select(F.input_file_name().alias("f")).distinct().collect()}


def test_aliased_and_separated_groups():
    x = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]] * 6)
    ones = np.ones(24)
    out = C.fit_group(x, ones, np.arange(24) % 3, np.arange(24) // 3 % 2, ones, x[:, 0], ("glm", "lasso"), 8, 0.05)
    for f in out:
        assert np.isfinite(f["beta"]).all()
        assert f["learner"] == "lasso" or (f["aliased"] == [2, 3] and f["converged"])  # a part without events leaves lasso unconverged
    nothing = C.fit_group(x, ones, np.arange(24) % 3, np.arange(24) // 3 % 2, ones, np.zeros(24), ("glm", "lasso"), 4, 0.1)
    assert all(np.isfinite(f["beta"]).all() for f in nothing)


def test_reduced_model_on_both_sites(people, folds):
    df = people[0].where("case = 0")
    got = {(r["site"], r["outcome"], r["metric"]): r for r in C.reduced_report(df, folds, df.where("id < 200"), "id", ["a", "b"], OUTCOMES).collect()}
    assert len(got) == 2 * 2 * 4 and all(r["n"] == 6 for r in got.values())
    assert got["train", "y", "auc"]["mean_value"] > 0.6 and got["other", "y", "auc"]["mean_value"] > 0.6


def test_report_tables_of_fixed_coefficients(spark):
    rows = [(0, "y", 1, f, "lasso", v, b, None, None, 0.1 * f, 0.2 * f, 10.0, True) for f in (1, 2, 3) for v, b in ((C.INTERCEPT, 1.0), ("a", 0.5 * (f - 1)), ("b", 0.0 if f < 3 else -1.0))]
    table = spark.createDataFrame(rows, C.FITTED_DDL)
    assert {r["variable"]: (r["n"], round(r["percent"], 3)) for r in C.selection_report(table).collect()} == {"a": (2, 66.667), "b": (1, 33.333)}
    assert {(r["variable"], r["other"]): r["n"] for r in C.pair_report(table).collect()} == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1}
    assert [(r["variables"], r["n"], r["place"]) for r in C.set_report(table).orderBy("place").collect()] == [("", 1, 1), ("a", 1, 2), ("a,b", 1, 3)]
    assert {r["rule"]: round(r["q500"], 6) for r in C.penalty_report(table).collect()} == {"lambda_min": 0.2, "lambda_1se": 0.4}
    assert {r["variable"]: round(r["q500"], 6) for r in C.ratio_report(table).collect()} == {"a": round(math.exp(0.5), 6), "b": 1.0}
    scored = spark.createDataFrame([(0, "y", 1, f, "lasso", p, a, b) for f in (1, 2, 3) for p, a, b in ((0.05, 1, 9), (1.0, f, 1))],
                                   "case int, outcome string, repeat int, fold int, learner string, p double, n1 bigint, n0 bigint")
    assert {r["bin"]: (r["n"], round(r["median_observed"], 6)) for r in C.calibration_report(scored).collect()} == {0: (30, 0.1), 9: (9, 0.666667)}
