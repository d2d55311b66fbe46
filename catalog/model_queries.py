"""Scaling, imputation, folds, scores, selection stability and models on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.summary_queries import rounded
from wardline.operators import evaluate, grid, impute, learn, prep
from wardline.plans import mortality

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query("standardise", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in NUMERIC)} FROM lineitem")
def standardise(t):
    return rounded(prep.standardise(t.lineitem.select("l_orderkey", "l_linenumber", *NUMERIC), NUMERIC), *NUMERIC)


@query("robust_scale", f"""WITH q AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}' for c in NUMERIC)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / r_{c}, 6) AS {c}' for c in NUMERIC)} FROM lineitem, q""")
def robust_scale(t):
    return rounded(prep.robust_scale(t.lineitem.select("l_orderkey", "l_linenumber", *NUMERIC), NUMERIC), *NUMERIC)


# --- missing values ------------------------------------------------------------------------

def gappy(t):
    df = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("n_chars") >= 300, F.col("n_chars") / 1024.0).alias("size"),
                     F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


def _fill_sql(target: str, cols=("size", "quality", "toxic")) -> str:
    common = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INTEGER)" for c in cols)
    dist = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in cols)
    return f"""SELECT doc_id, avg(v) AS v FROM (SELECT a.doc_id, b.{target} AS v, row_number() OVER (PARTITION BY a.doc_id
  ORDER BY ({dist}) * (3.0 / ({common})), b.doc_id) AS rn FROM g a JOIN g b ON b.{target} IS NOT NULL AND ({common}) > 0 WHERE a.{target} IS NULL) WHERE rn <= 2 GROUP BY doc_id"""


@query("knn_impute", f"""WITH g AS (SELECT d.doc_id, CASE WHEN n_chars >= 300 THEN n_chars / 1024.0 END AS size, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), fs AS ({_fill_sql('size')}), fq AS ({_fill_sql('quality')}), ft AS ({_fill_sql('toxic')})
SELECT g.doc_id, round(coalesce(size, fs.v, avg(size) OVER ()), 6) AS size, round(coalesce(quality, fq.v, avg(quality) OVER ()), 6) AS quality,
round(coalesce(toxic, ft.v, avg(toxic) OVER ()), 6) AS toxic FROM g LEFT JOIN fs ON g.doc_id = fs.doc_id LEFT JOIN fq ON g.doc_id = fq.doc_id LEFT JOIN ft ON g.doc_id = ft.doc_id""")
def knn_impute(t):
    return rounded(impute.knn_impute(gappy(t), "doc_id", ["size", "quality", "toxic"], 2), "size", "quality", "toxic")


@query("chained_impute")
def chained_impute(t):
    return impute.chained_impute(gappy(t), "doc_id", {"size": "numeric", "quality": "binary", "toxic": "binary"}, copies=3, rounds=2, seed=5)


@query("pca_scores")
def pca_scores(t):
    out = prep.pca(t.embeddings, "embedding", ["vec_id", "label"], k=5)
    return out.scores.select("vec_id", "label", *[F.round(F.col("scores")[i], 6).alias(f"pc{i + 1}") for i in range(5)])


@query("pca_variance")
def pca_variance(t):
    return prep.pca(t.embeddings, "embedding", ["vec_id"], variance=0.95).variance


# --- splits and folds -------------------------------------------------------------------------

@query("stratified_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '11', CAST(doc_id AS VARCHAR))), doc_id) AS rk,
count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN rk <= round(0.3 * n) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(t):
    return evaluate.stratified_split(t.labels.select("doc_id", "quality"), "quality", "doc_id", 0.3, 11)


REPEATS, FOLDS, SEED = 2, 5, 21

FOLDS_SQL = f"""reps AS (SELECT doc_id, quality, toxic, unnest([1, 2]) AS repeat FROM labels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', '{SEED}', CAST(repeat AS VARCHAR), '0', CAST(doc_id AS VARCHAR))), doc_id) AS rk,
  count(*) OVER (PARTITION BY repeat) AS n FROM reps),
folds AS (SELECT doc_id, quality, toxic, repeat, CAST(greatest(1, ceil((rk - 1) * {FOLDS} / (n - 1))) AS INTEGER) AS fold FROM ranked),
scored AS (SELECT f.doc_id, repeat, fold, toxic AS y, least(n_chars / 4000.0, 1.0) AS p FROM folds f JOIN documents d ON d.doc_id = f.doc_id)"""


def folds(t):
    return evaluate.repeated_folds(t.labels, "doc_id", "toxic", REPEATS, FOLDS, SEED)


@query("folds", f"WITH {FOLDS_SQL} SELECT doc_id, toxic, repeat, fold FROM folds")
def folds_query(t):
    return folds(t)


def scored(t):
    """A fixed score (text length) held against the toxic label, per repeat and fold."""
    sizes = t.documents.select("doc_id", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"))
    return folds(t).join(sizes, "doc_id").select("doc_id", "repeat", "fold", F.col("toxic").alias("y"), "p")


BY = ["repeat", "fold"]

CONFUSION_SQL = f"""WITH {FOLDS_SQL}, c AS (SELECT repeat, fold, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp,
count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn FROM scored GROUP BY repeat, fold)"""


@query("confusion", CONFUSION_SQL + " SELECT * FROM c")
def confusion(t):
    return evaluate.confusion(scored(t), BY)


RATES_SQL = """SELECT repeat, fold, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c"""


@query("rates", CONFUSION_SQL + " " + RATES_SQL)
def rates(t):
    out = evaluate.rates(evaluate.confusion(scored(t), BY)).drop("tp", "fp", "fn", "tn")
    return rounded(out, "accuracy", "sensitivity", "specificity", "balanced_accuracy")


@query("balanced_accuracy_negative", CONFUSION_SQL + """ SELECT repeat, fold, round(tn / nullif(tn + fp, 0), 6) AS sensitivity, round(tp / nullif(tp + fn, 0), 6) AS specificity,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def balanced_accuracy_negative(t):
    out = evaluate.rates(evaluate.confusion(scored(t), BY), positive=0).drop("tp", "fp", "fn", "tn", "accuracy")
    return rounded(out, "sensitivity", "specificity", "balanced_accuracy")


@query("brier", f"WITH {FOLDS_SQL} SELECT repeat, fold, round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY repeat, fold")
def brier(t):
    return rounded(evaluate.brier(scored(t), BY), "brier")


@query("brier_class", f"WITH {FOLDS_SQL} SELECT repeat, fold, round(avg(CASE WHEN (p > 0.5) <> (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS brier FROM scored GROUP BY repeat, fold")
def brier_class(t):
    return rounded(evaluate.brier(scored(t), BY, on="class"), "brier")


@query("roc", f"""WITH {FOLDS_SQL}, g AS (SELECT repeat, fold, p, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM scored GROUP BY repeat, fold, p)
SELECT repeat, fold, round(p, 6) AS threshold, round(sum(n0) OVER w / sum(n0) OVER (PARTITION BY repeat, fold), 6) AS fpr,
round(sum(n1) OVER w / sum(n1) OVER (PARTITION BY repeat, fold), 6) AS tpr FROM g WINDOW w AS (PARTITION BY repeat, fold ORDER BY p DESC)""")
def roc(t):
    return rounded(evaluate.roc_points(scored(t), BY), "threshold", "fpr", "tpr")


AUC_SQL = """rk AS (SELECT repeat, fold, y, rank() OVER (PARTITION BY repeat, fold ORDER BY p) + (count(*) OVER (PARTITION BY repeat, fold, p) - 1) / 2.0 AS r FROM scored),
au AS (SELECT repeat, fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) /
  (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM rk GROUP BY repeat, fold)"""


@query("auc", f"WITH {FOLDS_SQL}, {AUC_SQL} SELECT repeat, fold, round(auc, 6) AS auc FROM au")
def auc(t):
    return rounded(evaluate.auc(scored(t), BY), "auc")


CAL_SQL = "cal AS (SELECT repeat, fold, CAST(least(floor(p / 0.1), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS observed FROM scored GROUP BY 1, 2, 3)"


@query("calibration", f"WITH {FOLDS_SQL}, {CAL_SQL} SELECT repeat, fold, bin, n, round(observed, 6) AS observed FROM cal")
def calibration(t):
    return rounded(evaluate.calibration(scored(t), BY), "observed")


@query("calibration_over_folds", f"WITH {FOLDS_SQL}, {CAL_SQL} SELECT bin, round(quantile_cont(observed, 0.5), 6) AS median_observed, CAST(sum(n) AS BIGINT) AS n FROM cal GROUP BY bin")
def calibration_over_folds(t):
    return rounded(evaluate.calibration_over_folds(evaluate.calibration(scored(t), BY)), "median_observed")


Z = 1.959963984540054
T_SQL = f"""({Z} + {(Z**3 + Z) / 4!r} / v + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r} / pow(v, 2) + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384!r} / pow(v, 3)
  + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160!r} / pow(v, 4))"""


@query("metric_intervals", f"""WITH {FOLDS_SQL}, {AUC_SQL}, s AS (SELECT count(auc) AS n, avg(auc) AS m, stddev_samp(auc) AS sd, count(auc) - 1.0 AS v, quantile_cont(auc, 0.025) AS a,
quantile_cont(auc, 0.5) AS b, quantile_cont(auc, 0.975) AS c FROM au)
SELECT 'auc' AS metric, n, round(m, 6) AS mean_value, round(a, 6) AS q025, round(b, 6) AS q500, round(c, 6) AS q975, round(m - {T_SQL} * sd / sqrt(n), 6) AS t_low,
round(m + {T_SQL} * sd / sqrt(n), 6) AS t_high FROM s""")
def metric_intervals(t):
    per_fold = evaluate.auc(scored(t), BY).withColumn("metric", F.lit("auc"))
    return rounded(evaluate.interval_summary(per_fold, ["metric"], "auc"), "mean_value", "q025", "q500", "q975", "t_low", "t_high")


# --- selection stability: an order is a model, a part type a variable ------------------------------

COEF_SQL = """coefs AS (SELECT l_orderkey AS model, p_type AS variable, min(l_discount) AS p_value, exp(avg(l_tax) - 0.04) AS odds_ratio
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def coefs(t):
    joined = t.lineitem.select("l_orderkey", "l_partkey", "l_discount", "l_tax").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("model"), F.col("p_type").alias("variable")).agg(
        F.min("l_discount").alias("p_value"), F.exp(F.avg("l_tax") - 0.04).alias("odds_ratio"))


@query("selection_frequency", f"""WITH {COEF_SQL} SELECT variable, count(*) FILTER (p_value <= 0.05) AS n,
round(count(*) FILTER (p_value <= 0.05) / (SELECT count(DISTINCT model) FROM coefs), 6) AS share FROM coefs GROUP BY variable""")
def selection_frequency(t):
    return rounded(evaluate.selection_frequency(coefs(t), ["model"], evaluate.chosen_by_p()), "share")


@query("selection_by_ratio", f"""WITH {COEF_SQL} SELECT variable, count(*) FILTER (round(odds_ratio, 3) < 0.999 OR round(odds_ratio, 3) > 1.001) AS n,
round(count(*) FILTER (round(odds_ratio, 3) < 0.999 OR round(odds_ratio, 3) > 1.001) / (SELECT count(DISTINCT model) FROM coefs), 6) AS share FROM coefs GROUP BY variable""")
def selection_by_ratio(t):
    return rounded(evaluate.selection_frequency(coefs(t), ["model"], evaluate.chosen_by_ratio()), "share")


@query("variables_per_model", f"WITH {COEF_SQL} SELECT model, count(*) FILTER (p_value <= 0.05) AS n_variables FROM coefs GROUP BY model")
def variables_per_model(t):
    return evaluate.variables_per_model(coefs(t), ["model"], evaluate.chosen_by_p())


@query("events_per_variable", f"""WITH {COEF_SQL}, v AS (SELECT model, count(*) FILTER (p_value <= 0.05) AS n FROM coefs GROUP BY model), e AS (SELECT 1000.0 / nullif(n, 0) AS epv FROM v)
SELECT count(*) AS models, round(min(epv), 6) AS min_epv, round(max(epv), 6) AS max_epv, round(avg(epv), 6) AS mean_epv FROM e""")
def events_per_variable(t):
    per_model = evaluate.variables_per_model(coefs(t), ["model"], evaluate.chosen_by_p())
    return rounded(evaluate.events_per_variable(per_model, F.lit(1000.0)), "min_epv", "max_epv", "mean_epv")


SETS_SQL = """sets AS (SELECT model, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (p_value <= 0.05), '') AS variables FROM coefs GROUP BY model),
freq AS (SELECT variables, count(*) AS n FROM sets GROUP BY variables)"""


@query("model_frequency", f"""WITH {COEF_SQL}, {SETS_SQL}, top AS (SELECT *, n / (SELECT count(*) FROM sets) AS s FROM freq ORDER BY n DESC, variables LIMIT 20)
SELECT variables, n, round(s, 6) AS share, round(sum(s) OVER (ORDER BY n DESC, variables), 6) AS cumulative_share FROM top""")
def model_frequency(t):
    return rounded(evaluate.model_frequency(coefs(t), ["model"], evaluate.chosen_by_p()), "share", "cumulative_share")


PAIR_SQL = """pairs AS (SELECT a.variable, b.variable AS other, count(*) AS n FROM coefs a JOIN coefs b ON a.model = b.model
WHERE a.p_value <= 0.05 AND b.p_value <= 0.05 GROUP BY 1, 2)"""


@query("pair_frequency", f"WITH {COEF_SQL}, {PAIR_SQL} SELECT * FROM pairs")
def pair_frequency(t):
    return evaluate.pair_frequency(coefs(t), ["model"], evaluate.chosen_by_p())


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("pair_correlation", f"""WITH {COEF_SQL}, {PAIR_SQL} SELECT a.variable, b.variable AS other, round(corr(a.n, b.n), 6) AS correlation
FROM pairs a JOIN pairs b ON a.other = b.other GROUP BY 1, 2""")
def pair_correlation(t):
    return rounded(evaluate.pair_correlation(evaluate.pair_frequency(coefs(t), ["model"], evaluate.chosen_by_p()), TYPES), "correlation")


@query("odds_ratio_summary", f"""WITH {COEF_SQL} SELECT variable, count(*) FILTER (odds_ratio > 1.01 OR odds_ratio < 0.99) AS kept,
CASE WHEN count(*) FILTER (odds_ratio > 1.01 OR odds_ratio < 0.99) > 50 THEN round(quantile_cont(odds_ratio, 0.5), 6) END AS median_odds_ratio FROM coefs GROUP BY variable""")
def odds_ratio_summary(t):
    return rounded(evaluate.odds_ratio_summary(coefs(t)), "median_odds_ratio")


# --- models ----------------------------------------------------------------------------------------

FEATURES = ["size", "lang_de", "lang_es", "lang_fr", "late_source"]


def modelled(t):
    """Labelled documents: length and language against the poor-quality and toxic labels."""
    df = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    langs = {f"lang_{l}": (F.col("lang") == l).cast("int") for l in ("de", "es", "fr")}
    late = F.substring("source", 4, 2).cast("int") >= 10
    return df.withColumns({"size": F.log10(F.col("n_chars")), **langs, "late_source": late.cast("int"), "poor": 1 - F.col("quality")})


def model_rows(t, repeats=REPEATS, k=3, inner=0, df=None):
    df = modelled(t) if df is None else df
    return grid.design(learn.with_folds(df, "doc_id", "poor", repeats, k, SEED, inner), "doc_id", ["poor", "toxic"], FEATURES, F.col("folds"))


@query("logit_fit")
def logit_fit(t):
    return learn.logit_fit(modelled(t), "poor", FEATURES)


@query("logit_l2")
def logit_l2(t):
    return learn.logit_l2(modelled(t), "poor", FEATURES, ["doc_id"])[0]


@query("lasso_path")
def lasso_path(t):
    return learn.lasso_path(model_rows(t, 1, 3, 3), FEATURES, 1, 3, 10)


@query("cross_validate")
def cross_validate(t):
    rows = model_rows(t)
    return learn.cross_validated_metrics(rows, learn.cross_validate(rows, list(range(len(FEATURES))), REPEATS, 3))


@query("cross_validate_lasso")
def cross_validate_lasso(t):
    rows = model_rows(t, 1, 3, 3)
    fits = learn.cross_validate(rows, list(range(len(FEATURES))), 1, 3, "lasso", 3, 5)
    return learn.cross_validated_metrics(rows, fits)


@query("cross_validated_selection")
def cross_validated_selection(t):
    rows = model_rows(t)
    fits = learn.cross_validate(rows, list(range(len(FEATURES))), REPEATS, 3)
    table = grid.coefficients(rows, fits, FEATURES).filter("variable <> '(Intercept)'")
    return evaluate.selection_frequency(table, ["repeat", "fold"], evaluate.chosen_by_p())


@query("external_validate")
def external_validate(t):
    df = modelled(t).withColumn("train", F.col("late_source") == 0)
    terms = [0, 1, 2, 3]
    rows = model_rows(t, df=df.filter("train"))
    fits = learn.cross_validate(rows, terms, REPEATS, 3)
    other = grid.design(df.filter("NOT train"), "doc_id", ["poor", "toxic"], FEATURES)
    return learn.external_validate(fits, other)


def screen(t):
    df = modelled(t).withColumn("size_missing", (F.col("n_chars") < 100).cast("int"))
    df = df.withColumn("size_high", (F.col("n_chars") > 2000).cast("int"))
    features = [*FEATURES, "size_missing", "size_high"]
    rows = grid.design(learn.with_folds(df, "doc_id", "poor", REPEATS, 3, SEED, both_classes=True), "doc_id", ["poor"], features, F.col("folds"))
    return learn.single_marker_screen(rows, features, [4], {"language": ([1, 2, 3], None), "size": ([6], 5)}, REPEATS, 3)


@query("marker_screen")
def marker_screen(t):
    return screen(t)["coefficients"]


@query("marker_screen_auc")
def marker_screen_auc(t):
    return screen(t)["auc"]


@query("marker_screen_difference")
def marker_screen_difference(t):
    return screen(t)["difference"]


@query("bootstrap_odds_ratios")
def bootstrap_odds_ratios(t):
    return learn.bootstrap_odds_ratios(model_rows(t), FEATURES, 50)


@query("forward_select")
def forward_select(t):
    return learn.forward_select(model_rows(t), FEATURES, [4], 2, REPEATS, 3)


@query("static_model")
def static_model(t):
    df = modelled(t).withColumn("longish", F.when(F.col("n_chars") >= 300, F.sqrt("n_chars")))
    return mortality.static_model(df, "doc_id", ["n_chars"], "poor", "lang", ["de", "en", "fr"], {"es": "fr"}, ["size", "longish", "toxic"], seed=4).metrics
