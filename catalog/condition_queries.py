"""Nested validation, counted design rows and the model report, on labelled documents and on the readings grid.

The report tables' twins are fed by coefficients that SQL can work out: the log odds ratio of each flag alone, in the rows
outside the held-out fold (the penalised kind: drawn 0.2 towards zero). Real fits are held against their optimality conditions,
and where a model has as many terms as groups, against its closed form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import study_queries as st
from catalog.registry import query
from catalog.summary_queries import rounded
from wardline.operators import conditions as C
from wardline.operators import evaluate, grid, learn
from wardline.plans import study
from wardline.session import attach_small, checkpoint_dir, cut_lineage

FEATURES = ["lang_de", "lang_es", "lang_fr", "over_low", "over_high"]
OUTCOMES = ["poor", "toxic"]
LIMITS = [(300, 1000), (500, 1500), (800, 2500)]
REPEATS, FOLDS, INNER, SEED = 2, 3, 3, 21


def labelled(t):
    df = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    return df.select("doc_id", "lang", "n_chars", (1 - F.col("quality")).alias("poor"), "toxic", (F.substring("source", 4, 2).cast("int") >= 10).alias("late"))


def flags(t):
    """One row per document and pair of length limits (the case)."""
    cases = F.explode(F.array(*[F.struct(F.lit(i).alias("case"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(LIMITS)])).alias("_c")
    df = labelled(t).select("*", cases)
    langs = [(F.col("lang") == l).cast("int").alias(f"lang_{l}") for l in ("de", "es", "fr")]
    return df.select("doc_id", "late", *OUTCOMES, "_c.case", *langs, (F.col("n_chars") > F.col("_c.lo")).cast("int").alias("over_low"),
                     (F.col("n_chars") > F.col("_c.hi")).cast("int").alias("over_high"))


def folds(t):
    return evaluate.nested_folds(labelled(t).where("NOT late"), "doc_id", OUTCOMES, REPEATS, FOLDS, INNER, SEED)


def counts(t):
    return C.frequency_table(flags(t).where("NOT late"), folds(t), "doc_id", FEATURES, OUTCOMES)


FOLDS_SQL = f"""base AS (SELECT d.doc_id, d.lang, d.n_chars, 1 - quality AS poor, toxic, CAST(substr(source, 4, 2) AS INTEGER) >= 10 AS late
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
reps AS (SELECT doc_id, unnest([1, 2]) AS repeat FROM base WHERE NOT late),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', '{SEED}', CAST(repeat AS VARCHAR), '0', CAST(doc_id AS VARCHAR))), doc_id) AS rk,
  count(*) OVER (PARTITION BY repeat) AS n FROM reps),
outer_folds AS (SELECT doc_id, repeat, CAST(greatest(1, ceil((rk - 1) * {FOLDS} / (n - 1))) AS INTEGER) AS fold FROM ranked),
inside AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY md5(concat_ws('|', '{SEED + 1}', CAST(repeat AS VARCHAR), '0', CAST(doc_id AS VARCHAR))), doc_id) AS rk,
  count(*) OVER (PARTITION BY repeat, fold) AS n FROM outer_folds),
folds AS (SELECT doc_id, repeat, fold, CAST(greatest(1, ceil((rk - 1) * {INNER} / (n - 1))) AS INTEGER) AS inner_fold FROM inside)"""

FLAGS_SQL = f"""cases AS (SELECT unnest({list(range(len(LIMITS)))}) AS "case", unnest({[lo for lo, _ in LIMITS]}) AS lo, unnest({[hi for _, hi in LIMITS]}) AS hi),
flags AS (SELECT "case", doc_id, late, poor, toxic, CAST(lang = 'de' AS INTEGER) AS x1, CAST(lang = 'es' AS INTEGER) AS x2, CAST(lang = 'fr' AS INTEGER) AS x3,
  CAST(n_chars > lo AS INTEGER) AS x4, CAST(n_chars > hi AS INTEGER) AS x5 FROM base, cases),
rows_of AS (SELECT *, unnest(['poor', 'toxic']) AS outcome, unnest([poor, toxic]) AS y FROM flags)"""


@query("nested_folds", f"WITH {FOLDS_SQL} SELECT doc_id, repeat, fold, inner_fold FROM folds")
def nested_folds(t):
    return folds(t).withColumnRenamed("inner", "inner_fold")


@query("frequency_table", f"""WITH {FOLDS_SQL}, {FLAGS_SQL} SELECT "case", repeat, fold, inner_fold, concat(x1, x2, x3, x4, x5) AS pattern, count(*) AS n,
CAST(sum(poor) AS BIGINT) AS n_poor, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM flags JOIN folds USING (doc_id) GROUP BY ALL""")
def frequency_table(t):
    return counts(t).select("case", "repeat", "fold", F.col("inner").alias("inner_fold"), F.array_join(F.transform("x", lambda v: v.cast("int").cast("string")), "").alias("pattern"),
                            "n", F.col("events")[0].alias("n_poor"), F.col("events")[1].alias("n_toxic"))


# --- coefficients with a closed form -------------------------------------------------------

def marginal(table):
    """Log odds ratio of each flag alone, outside every fold, in the layout of ``fit_conditions``."""
    cells = C.by_outcome(table, OUTCOMES).groupBy("case", "outcome", "repeat", "fold", "x").agg(F.sum("n").alias("n"), F.sum("events").alias("e"))
    held = cells.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(FOLDS)))).where("fold <> _own")
    sums = [F.sum("n").alias("n"), F.sum("e").alias("e")]
    for j in range(len(FEATURES)):
        sums += [F.sum(F.col("n") * F.col("x")[j]).alias(f"n{j}"), F.sum(F.col("e") * F.col("x")[j]).alias(f"e{j}")]
    total = held.groupBy("case", "outcome", "repeat", "fold").agg(*sums)
    n, e = F.col("n"), F.col("e")
    terms = [F.struct(F.lit(C.INTERCEPT).alias("variable"), F.log((e + 0.5) / (n - e + 0.5)).alias("b"))]
    for j, name in enumerate(FEATURES):
        a, m = F.col(f"e{j}"), F.col(f"n{j}")
        odds = ((a + 0.5) * (n - m - e + a + 0.5)) / ((m - a + 0.5) * (e - a + 0.5))
        terms.append(F.struct(F.lit(name).alias("variable"), F.log(odds).alias("b")))
    long = total.select("case", "outcome", "repeat", "fold", F.explode(F.array(*terms)).alias("_t"), F.lit("glm").alias("learner"),
                        (e / n / 10).alias("low"), (F.col("n3") / n / 5).alias("high"))
    plain = long.select(*C.KEYS, "_t.variable", F.col("_t.b").alias("estimate"), F.lit(None).cast("double").alias("lambda_min"), F.lit(None).cast("double").alias("lambda_1se"))
    drawn = F.when(F.col("_t.variable") == C.INTERCEPT, F.col("_t.b")).otherwise(F.signum("_t.b") * F.greatest(F.abs("_t.b") - 0.2, F.lit(0.0)))
    lasso = long.select("case", "outcome", "repeat", "fold", F.lit("lasso").alias("learner"), "_t.variable", drawn.alias("estimate"), F.col("low").alias("lambda_min"), F.col("high").alias("lambda_1se"))
    return cut_lineage(plain.unionByName(lasso))


_SUMS = ", ".join(f"sum(x{j}) AS n{j}, sum(x{j} * y) AS e{j}" for j in range(1, 6))
_ODDS = ", ".join(f"ln(((e{j} + 0.5) * (n - n{j} - e + e{j} + 0.5)) / ((n{j} - e{j} + 0.5) * (e - e{j} + 0.5)))" for j in range(1, 6))
FITTED_SQL = f"""{FOLDS_SQL}, {FLAGS_SQL},
total AS (SELECT "case", outcome, repeat, h.fold, count(*) AS n, sum(y) AS e, {_SUMS} FROM rows_of JOIN folds f USING (doc_id) JOIN (SELECT unnest([1, 2, 3]) AS fold) h ON h.fold <> f.fold GROUP BY ALL),
terms AS (SELECT "case", outcome, repeat, fold, e / n / 10 AS low, n4 / n / 5 AS high, unnest(['(Intercept)', {', '.join(f"'{f}'" for f in FEATURES)}]) AS variable,
  unnest([ln((e + 0.5) / (n - e + 0.5)), {_ODDS}]) AS b FROM total),
fitted AS (SELECT "case", outcome, repeat, fold, 'glm' AS learner, variable, b AS estimate, NULL AS lambda_min, NULL AS lambda_1se FROM terms
  UNION ALL SELECT "case", outcome, repeat, fold, 'lasso', variable, CASE WHEN variable = '(Intercept)' THEN b ELSE sign(b) * greatest(abs(b) - 0.2, 0) END, low, high FROM terms),
betas AS (SELECT "case", outcome, repeat, fold, learner, {', '.join(f"max(estimate) FILTER (variable = '{f}') AS b{j}" for j, f in enumerate(['(Intercept)', *FEATURES]))} FROM fitted GROUP BY ALL),
ratios AS (SELECT *, exp(estimate) AS odds_ratio, round(exp(estimate), 3) < 0.999 OR round(exp(estimate), 3) > 1.001 AS chosen FROM fitted WHERE variable <> '(Intercept)')"""
_P = "round(1 / (1 + exp(-(b0 + (" + " + ".join(f"x{j} * b{j}" for j in range(1, 6)) + ")))), 9)"
HELD_SQL = f"""scored AS (SELECT b."case", b.outcome, b.repeat, b.fold, learner, {_P} AS p, y FROM rows_of r JOIN folds f USING (doc_id)
  JOIN betas b ON b."case" = r."case" AND b.outcome = r.outcome AND b.repeat = f.repeat AND b.fold = f.fold)"""
OTHER_SQL = f"""scored AS (SELECT b."case", b.outcome, b.repeat, b.fold, learner, {_P} AS p, y FROM rows_of r JOIN betas b ON b."case" = r."case" AND b.outcome = r.outcome WHERE late)"""
_BY = '"case", outcome, repeat, fold, learner'
METRICS_SQL = f"""rk AS (SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY p) + (count(*) OVER (PARTITION BY {_BY}, p) - 1) / 2.0 AS r FROM scored),
metrics AS (SELECT {_BY}, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc, avg(CASE WHEN (p > 0.5) <> (y = 1) THEN 1.0 ELSE 0.0 END) AS brier,
  count(*) FILTER (p > 0.5 AND y = 1) / sum(y) AS sensitivity, count(*) FILTER (p <= 0.5 AND y = 0) / sum(1 - y) AS specificity FROM rk GROUP BY {_BY}),
long AS (SELECT "case", outcome, learner, unnest(['auc', 'brier', 'sensitivity', 'specificity']) AS metric, unnest([auc, brier, sensitivity, specificity]) AS v FROM metrics)"""
Z = 1.959963984540054
T_SQL = f"""({Z} + {(Z**3 + Z) / 4!r} / (count(v) - 1.0) + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r} / pow(count(v) - 1.0, 2) + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384!r} / pow(count(v) - 1.0, 3)
  + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160!r} / pow(count(v) - 1.0, 4))"""
INTERVAL_SQL = f"""count(v) AS n, round(avg(v), 6) AS mean_value, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.5), 6) AS q500, round(quantile_cont(v, 0.975), 6) AS q975,
round(avg(v) - {T_SQL} * stddev_samp(v) / sqrt(count(v)), 6) AS t_low, round(avg(v) + {T_SQL} * stddev_samp(v) / sqrt(count(v)), 6) AS t_high"""
NUMBERS = ["mean_value", "q025", "q500", "q975", "t_low", "t_high"]


def nine_digits(scores):
    """Patterns whose scores differ only by the order of additions tie in every engine."""
    return scores.withColumn("p", F.round("p", 9))


@query("report_metrics", f'WITH {FITTED_SQL}, {HELD_SQL}, {METRICS_SQL} SELECT "case", outcome, learner, metric, {INTERVAL_SQL} FROM long GROUP BY ALL')
def report_metrics(t):
    table = counts(t)
    return rounded(C.metric_report(C.model_metrics(nine_digits(C.held_out_scores(table, marginal(table), FEATURES, OUTCOMES)))), *NUMBERS)


@query("report_metrics_other_site", f'WITH {FITTED_SQL}, {OTHER_SQL}, {METRICS_SQL} SELECT "case", outcome, learner, metric, {INTERVAL_SQL} FROM long GROUP BY ALL')
def report_metrics_other_site(t):
    other = C.frequency_table(flags(t).where("late"), None, "doc_id", FEATURES, OUTCOMES)
    return rounded(C.metric_report(C.model_metrics(nine_digits(C.generalised_scores(other, marginal(counts(t)), FEATURES, OUTCOMES)))), *NUMBERS)


@query("report_penalties", f"""WITH {FITTED_SQL}, long AS (SELECT "case", outcome, learner, unnest(['lambda_min', 'lambda_1se']) AS rule, unnest([lambda_min, lambda_1se]) AS v
FROM fitted WHERE learner = 'lasso' AND variable = '(Intercept)') SELECT "case", outcome, learner, rule, {INTERVAL_SQL} FROM long GROUP BY ALL""")
def report_penalties(t):
    return rounded(C.penalty_report(marginal(counts(t))), *NUMBERS)


@query("report_selection", f"""WITH {FITTED_SQL} SELECT "case", outcome, learner, variable, count(*) FILTER (chosen) AS n, round(100.0 * count(*) FILTER (chosen) / count(*), 6) AS percent
FROM ratios GROUP BY ALL""")
def report_selection(t):
    return rounded(C.selection_report(marginal(counts(t))), "percent")


@query("report_ratios", f'WITH {FITTED_SQL}, long AS (SELECT *, odds_ratio AS v FROM ratios) SELECT "case", outcome, learner, variable, {INTERVAL_SQL} FROM long GROUP BY "case", outcome, learner, variable')
def report_ratios(t):
    return rounded(C.ratio_report(marginal(counts(t))), *NUMBERS)


@query("report_pairs", f"""WITH {FITTED_SQL} SELECT a."case", a.outcome, a.learner, a.variable, b.variable AS other, count(*) AS n FROM ratios a JOIN ratios b
ON a."case" = b."case" AND a.outcome = b.outcome AND a.learner = b.learner AND a.repeat = b.repeat AND a.fold = b.fold WHERE a.chosen AND b.chosen GROUP BY ALL""")
def report_pairs(t):
    return C.pair_report(marginal(counts(t)))


@query("report_sets", f"""WITH {FITTED_SQL}, sets AS (SELECT {_BY}, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (chosen), '') AS variables FROM ratios GROUP BY ALL),
freq AS (SELECT "case", outcome, learner, variables, count(*) AS n FROM sets GROUP BY ALL)
SELECT *, round(n / {REPEATS * FOLDS}, 6) AS share, row_number() OVER (PARTITION BY "case", outcome, learner ORDER BY n DESC, variables) AS place FROM freq""")
def report_sets(t):
    return rounded(C.set_report(marginal(counts(t))), "share")


@query("report_calibration", f"""WITH {FITTED_SQL}, {HELD_SQL}, cal AS (SELECT {_BY}, CAST(least(floor(p / 0.1), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS observed FROM scored GROUP BY ALL)
SELECT "case", outcome, learner, bin, CAST(sum(n) AS BIGINT) AS n, round(quantile_cont(observed, 0.5), 6) AS median_observed FROM cal GROUP BY ALL""")
def report_calibration(t):
    table = counts(t)
    return rounded(C.calibration_report(nine_digits(C.held_out_scores(table, marginal(table), FEATURES, OUTCOMES))), "median_observed")


# --- real fits -----------------------------------------------------------------------------

_ALL_SQL = f"""(SELECT unnest({list(range(len(LIMITS)))}) AS "case"), (SELECT unnest({OUTCOMES}) AS outcome), (SELECT unnest([1, 2]) AS repeat), (SELECT unnest([1, 2, 3]) AS fold),
(SELECT unnest(['glm', 'lasso']) AS learner), (SELECT unnest(['(Intercept)', {', '.join(f"'{f}'" for f in FEATURES)}]) AS variable)"""


@query("fit_optimality", f"SELECT *, true AS optimal FROM {_ALL_SQL}")
def fit_optimality(t):
    """Every coefficient of every fit meets its optimality condition: the slope is zero, or matched by the penalty."""
    table = counts(t)
    fitted = cut_lineage(C.fit_conditions(table, FEATURES, OUTCOMES))
    return C.optimality(table, fitted, FEATURES, OUTCOMES).select(*C.KEYS, "variable", (F.col("residual") < 1e-8).alias("optimal"))


@query("saturated_logit", f"""WITH {FOLDS_SQL}, g AS (SELECT outcome, repeat, h.fold, lang <> 'en' AS other, sum(y) AS e, sum(1 - y) AS o
FROM (SELECT *, unnest(['poor', 'toxic']) AS outcome, unnest([poor, toxic]) AS y FROM base) JOIN folds f USING (doc_id) JOIN (SELECT unnest([1, 2, 3]) AS fold) h ON h.fold <> f.fold GROUP BY ALL)
SELECT outcome, repeat, fold, unnest(['(Intercept)', 'other']) AS variable, round(unnest([ln(e0 / o0), ln(e1 / o1) - ln(e0 / o0)]), 6) AS estimate,
round(unnest([sqrt(1 / e0 + 1 / o0), sqrt(1 / e0 + 1 / o0 + 1 / e1 + 1 / o1)]), 6) AS std_error
FROM (SELECT outcome, repeat, fold, max(e) FILTER (other) AS e1, max(o) FILTER (other) AS o1, max(e) FILTER (NOT other) AS e0, max(o) FILTER (NOT other) AS o0 FROM g GROUP BY ALL)""")
def saturated_logit(t):
    """With one flag, coefficients are differences of log odds and their errors come from sums of reciprocal counts."""
    rows = labelled(t).where("NOT late").select("doc_id", *OUTCOMES, F.lit(0).alias("case"), (F.col("lang") != "en").cast("int").alias("other"))
    table = C.frequency_table(rows, folds(t), "doc_id", ["other"], OUTCOMES)
    fitted = C.fit_conditions(table, ["other"], OUTCOMES, ("glm",))
    return rounded(fitted.select("outcome", "repeat", "fold", "variable", "estimate", "std_error"), "estimate", "std_error")


@query("store_resumes", f"SELECT *, CAST(1 AS BIGINT) AS n FROM {_ALL_SQL}")
def store_resumes(t):
    """A store that was given one case, then all: every coefficient is there once."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    table = counts(t)
    C.fill_store(path, table.where("case = 1"), FEATURES, OUTCOMES)
    return C.fill_store(path, table, FEATURES, OUTCOMES).groupBy(*C.KEYS, "variable").agg(F.count(F.lit(1)).alias("n"))


# --- the grid of readings --------------------------------------------------------------------

def readings_grid(t, repeats: int = 20, k: int = 5, inner: int = 5):
    """Flag rows of every window and way of reading, and nested folds of the cohort."""
    late = attach_small(t.events.select("event_id", "user_id", "ts", "event_type", "value"), st.anchors(t).select("user_id", "anchor"), ["user_id"], ["event_id"]).filter(F.datediff("ts", "anchor") >= 8)
    outcome = late.groupBy("user_id").agg(F.max((F.col("event_type") == "error").cast("int") * F.col("value")).alias("_e"),
                                          F.max((F.col("event_type") == "purchase").cast("int") * F.col("value")).alias("_p"))
    cohort = cut_lineage(st.anchors(t).join(outcome, "user_id").select("user_id", "anchor", "sex", "age", (F.col("_e") > 120).cast("int").alias("late_error"),
                                                                       (F.col("_p") > 120).cast("int").alias("late_purchase")))
    outcomes = ["late_error", "late_purchase"]
    rows, cases, names = study.grid_design(t.events.filter("event_type <> 'signup'"), cohort, "user_id", "event_type", "ts", "value", "event_id", "anchor",
                                           st.RULES, [1, 3, 5, 7], ["worst", "first", "mean"], outcomes, sex="sex", age="age")
    return rows, evaluate.nested_folds(cohort, "user_id", outcomes, repeats, k, inner, 21), cases, names, outcomes


@query("run_grid")
def run_grid(t):
    """Plain models of 24 conditions in 2 x 3 folds: metrics with their intervals."""
    rows, folds_, cases, names, outcomes = readings_grid(t, 2, 3, 1)
    return C.run_grid(rows, folds_, "user_id", cases, names, outcomes, ("glm",))


@query("model_report")
def model_report(t):
    """Plain and penalised models of 24 conditions in 20 x 5 folds, nested in 5: metrics and penalties with their intervals."""
    rows, folds_, cases, names, outcomes = readings_grid(t)
    return C.run_grid(rows, folds_, "user_id", cases, names, outcomes)


@query("run_grid_optimality", f"""SELECT d, o, outcome, repeat, fold, learner, true AS optimal FROM (SELECT unnest([0, 1, 2, 3]) AS d), (SELECT unnest([0, 1, 2]) AS o),
(SELECT unnest(['late_error', 'late_purchase']) AS outcome), (SELECT unnest([1, 2]) AS repeat), (SELECT unnest([1, 2, 3]) AS fold), (SELECT unnest(['glm', 'lasso']) AS learner)
WHERE (SELECT count(*) FROM events) > 0""")
def run_grid_optimality(t):
    """Two repeats of three folds of the same grid: the fits' largest departure from their optimality conditions is nil."""
    rows, folds_, _, names, outcomes = readings_grid(t, 2, 3, 3)
    table = C.frequency_table(rows, folds_, "user_id", names, outcomes)
    fitted = cut_lineage(C.fit_conditions(table, names, outcomes))
    worst = C.optimality(table, fitted, names, outcomes).groupBy(*C.KEYS).agg(F.max("residual").alias("r"))
    return worst.select(F.floor(F.col("case") / 3).alias("d"), (F.col("case") % 3).alias("o"), "outcome", "repeat", "fold", "learner", (F.col("r") < 1e-8).alias("optimal"))


# --- one flag: models in closed form ------------------------------------------------------------

ONE_SQL = f"""{FOLDS_SQL}, one AS (SELECT doc_id, late, CAST(lang <> 'en' AS INTEGER) AS other, unnest(['poor', 'toxic']) AS outcome, unnest([poor, toxic]) AS y FROM base),
train AS (SELECT outcome, repeat, h.fold, other, avg(y) AS p FROM one JOIN folds f USING (doc_id) JOIN (SELECT unnest([1, 2, 3]) AS fold) h ON h.fold <> f.fold GROUP BY ALL),
both_sites AS (SELECT 'train' AS site, 0 AS "case", t.outcome, t.repeat, t.fold, 'glm' AS learner, round(p, 9) AS p, y FROM one JOIN folds f USING (doc_id)
    JOIN train t ON t.outcome = one.outcome AND t.other = one.other AND t.repeat = f.repeat AND t.fold = f.fold
  UNION ALL SELECT 'other', 0, t.outcome, t.repeat, t.fold, 'glm', round(p, 9), y FROM one JOIN train t ON t.outcome = one.outcome AND t.other = one.other WHERE late)"""


def one_flag(t, late: bool):
    return labelled(t).where("late" if late else "NOT late").select("doc_id", *OUTCOMES, F.lit(0).alias("case"), (F.col("lang") != "en").cast("int").alias("other"))


@query("reduced_model", f"""WITH {ONE_SQL}, {METRICS_SQL.replace('FROM scored', 'FROM both_sites').replace(_BY, 'site, ' + _BY).replace('SELECT "case", outcome, learner,', 'SELECT site, "case", outcome, learner,')}
SELECT site, "case", outcome, learner, metric, {INTERVAL_SQL} FROM long GROUP BY ALL""")
def reduced_model(t):
    """A chosen term's model on the folds it leaves out and on the other site; its scores are the training groups' rates."""
    return rounded(C.reduced_report(one_flag(t, False), folds(t), one_flag(t, True), "doc_id", ["other"], OUTCOMES), *NUMBERS)


_TABLE_SQL = """g AS (SELECT lang <> 'en' AS other, sum(1 - quality) AS e, sum(quality) AS o FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
w AS (SELECT max(e) FILTER (other) AS e1, max(o) FILTER (other) AS o1, max(e) FILTER (NOT other) AS e0, max(o) FILTER (NOT other) AS o0 FROM g),
c AS (SELECT unnest(['(Intercept)', 'other']) AS variable, unnest([ln(e0 / o0), ln(e1 / o1) - ln(e0 / o0)]) AS b, unnest([sqrt(1 / e0 + 1 / o0), sqrt(1 / e0 + 1 / o0 + 1 / e1 + 1 / o1)]) AS s FROM w)"""
_WALD_SQL = f"variable, round(b, 6) AS estimate, round(s, 6) AS std_error, round(exp(b), 5) AS odds_ratio, round(exp(b - {Z} * s), 5) AS lower, round(exp(b + {Z} * s), 5) AS upper"


def poor_by_flag(t):
    return labelled(t).select("doc_id", "poor", (F.col("lang") != "en").cast("int").alias("other"))


def wald(table):
    return rounded(table, "estimate", "std_error").select("variable", "estimate", "std_error", *[F.round(c, 5).alias(c) for c in ("odds_ratio", "lower", "upper")])


@query("logit_fit_closed", f"WITH {_TABLE_SQL} SELECT {_WALD_SQL} FROM c")
def logit_fit_closed(t):
    return wald(learn.logit_fit(poor_by_flag(t), "poor", ["other"]))


def flag_rows(t, repeats=2, k=3, inner=0):
    df = poor_by_flag(t)
    return grid.design(learn.with_folds(df, "doc_id", "poor", repeats, k, SEED, inner), "doc_id", ["poor"], ["other"], F.col("folds"))


@query("marker_screen_closed", f"WITH {_TABLE_SQL} SELECT 'language' AS model_name, {_WALD_SQL} FROM c")
def marker_screen_closed(t):
    table = learn.single_marker_screen(flag_rows(t), ["other"], [], {"language": ([0], None)}, 2, 3)["coefficients"]
    return wald(table).select(F.lit("language").alias("model_name"), "*")


@query("bootstrap_closed", f"WITH {_TABLE_SQL} SELECT variable, round(exp(b), 5) AS odds_ratio, true AS inside FROM c")
def bootstrap_closed(t):
    """The estimate has a closed form, and lies within the quantiles of its copies."""
    table = learn.bootstrap_odds_ratios(flag_rows(t), ["other"], 40)
    return table.select("variable", F.round("odds_ratio", 5).alias("odds_ratio"), F.col("odds_ratio").between(F.col("q025"), F.col("q975")).alias("inside"))


_CV_SQL = f"""cvreps AS (SELECT d.doc_id, CAST(lang <> 'en' AS INTEGER) AS other, 1 - quality AS y, unnest([1, 2]) AS repeat FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
cvranked AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', '{SEED}', CAST(repeat AS VARCHAR), '0', CAST(doc_id AS VARCHAR))), doc_id) AS rk, count(*) OVER (PARTITION BY repeat) AS n FROM cvreps),
cvfolds AS (SELECT *, CAST(greatest(1, ceil((rk - 1) * 3 / (n - 1))) AS INTEGER) AS fold FROM cvranked),
rate AS (SELECT repeat, h.fold, other, avg(y) AS p FROM cvfolds f JOIN (SELECT unnest([1, 2, 3]) AS fold) h ON h.fold <> f.fold GROUP BY ALL),
scored AS (SELECT 0 AS "case", 'poor' AS outcome, f.repeat, f.fold, 'glm' AS learner, r.p, y FROM cvfolds f JOIN rate r ON r.repeat = f.repeat AND r.fold = f.fold AND r.other = f.other)"""


@query("cross_validate_closed", f"""WITH {_CV_SQL}, {METRICS_SQL} SELECT repeat, fold, round(auc, 6) AS auc, round(brier, 6) AS brier, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM metrics""")
def cross_validate_closed(t):
    rows = flag_rows(t)
    table = learn.cross_validated_metrics(rows, learn.cross_validate(rows, [0], 2, 3))
    return rounded(table.select("repeat", "fold", "auc", "brier", "sensitivity", "specificity"), "auc", "brier", "sensitivity", "specificity")


@query("external_validate_closed", f"""WITH {_CV_SQL.replace('scored AS (', 'own AS (')}, scored AS (SELECT 0 AS "case", 'poor' AS outcome, r.repeat, r.fold, 'glm' AS learner, r.p, f.y FROM (SELECT other, y FROM cvreps WHERE repeat = 1) f
JOIN rate r ON r.other = f.other), {METRICS_SQL} SELECT repeat, fold, round(auc, 6) AS auc, round(brier, 6) AS brier, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM metrics""")
def external_validate_closed(t):
    """Every fold's model on all rows of a site (here the whole table)."""
    rows = flag_rows(t)
    table = learn.external_validate(learn.cross_validate(rows, [0], 2, 3), rows)
    return rounded(table.select("repeat", "fold", "auc", "brier", "sensitivity", "specificity"), "auc", "brier", "sensitivity", "specificity")


@query("lasso_path_penalties", """WITH r AS (SELECT CAST(lang <> 'en' AS INTEGER) AS x, 1 - quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT abs(covar_pop(x, y)) / stddev_pop(x) AS top FROM r)
SELECT i + 1 AS step, round(top * pow(0.01, i / 9.0), 8) AS penalty, CAST(i > 0 AS INTEGER) AS n_variables FROM t, (SELECT unnest(range(10)) AS i)""")
def lasso_path_penalties(t):
    """The first penalty empties the model of one term, which all smaller ones let in."""
    path = learn.lasso_path(flag_rows(t, 1, 3, 3), ["other"], 1, 3, 10)
    step = F.row_number().over(Window.orderBy(F.desc("penalty"))).cast("bigint")  # ten rows
    return path.select(step.alias("step"), F.round("penalty", 8).alias("penalty"), "n_variables")


@query("logit_l2_optimality", "SELECT unnest(['(Intercept)', 'other']) AS variable, true AS optimal WHERE (SELECT count(*) FROM labels) > 0")
def logit_l2_optimality(t):
    """The slope of the loss is matched by that of the penalty: C times the loss plus half the squared coefficients."""
    df = poor_by_flag(t)
    table, scored = learn.logit_l2(df, "poor", ["other"], ["doc_id"], 0.5)
    off = (F.col("y") - F.col("p"))
    sums = scored.join(df.select("doc_id", "other"), "doc_id").agg(F.sum(off).alias("a"), F.sum(off * F.col("other")).alias("b"))
    slopes = sums.select(F.explode(F.array(F.struct(F.lit("(Intercept)").alias("variable"), F.col("a").alias("slope")), F.struct(F.lit("other").alias("variable"), F.col("b").alias("slope")))).alias("_s"))
    met = table.join(slopes.select("_s.variable", "_s.slope"), "variable")
    gap = F.abs(F.col("slope") * 0.5 - F.when(F.col("variable") == "other", F.col("estimate")).otherwise(0.0))
    return met.select("variable", (gap < 1e-3).alias("optimal"))
