"""Splits, folds, scores and selection stability.

Scored rows are (groups..., y 0/1, p). Every measure takes the group columns, so all folds of
all repeats are done in one job.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.scale import hash_key, hash_numbered, ranged, running
from wardline.session import cut_lineage


# --- splits ----------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """Add ``part`` (train or test), keeping label shares exactly; the order is a hash of the key."""
    hashed = df.withColumn("_h", hash_key(seed, key))
    ranked = hash_numbered(hashed, [label], "_h", [key], "_rank", total="_size")
    in_test = F.col("_rank") <= F.round(F.lit(test_share) * F.col("_size"))
    return ranked.withColumn("part", F.when(in_test, "test").otherwise("train")).drop("_h", "_rank", "_size")


def fold_number(rank: Column, n: Column, k: int) -> Column:
    """Fold of a rank when 1..n is cut into k intervals of equal width."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(k) / F.greatest(n - 1, F.lit(1)))).cast("int")


def one_round_of_folds(df: DataFrame, key: str, repeats: list[tuple[int, int]], k: int, seed: int, keep: list[str]) -> DataFrame:
    """Folds for (repeat, attempt) pairs: rank by hash within the repeat, cut into k."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(a).alias("attempt")) for r, a in repeats]))
    spread = df.select(key, *keep, pairs.alias("_p")).select(key, *keep, "_p.repeat", "_p.attempt")
    hashed = spread.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"),
                                                       F.col("attempt").cast("string"), F.col(key).cast("string"))))
    ranked = hash_numbered(hashed, ["repeat"], "_h", [key], "_rank", total="_n")
    return ranked.withColumn("fold", fold_number(F.col("_rank"), F.col("_n"), k)).drop("_h", "_rank", "_n")


def repeated_folds(df: DataFrame, key: str, outcome: str, repeats: int, k: int, seed: int = 0, attempts: int = 100,
                   both_classes: bool = False) -> DataFrame:
    """(key, outcome, repeat, fold): shuffled k folds per repeat, each holding an event.

    A repeat with a fold that has no event (or only events, with ``both_classes``) is shuffled
    again. The check returns one number per repeat.
    """
    attempt = {r: 0 for r in range(1, repeats + 1)}
    for _ in range(attempts):
        # checked here and joined by every user of the folds
        folds = cut_lineage(one_round_of_folds(df, key, sorted(attempt.items()), k, seed, [outcome]))
        least = folds.groupBy("repeat", "fold").agg(F.sum(F.col(outcome).cast("int")).alias("e"), F.count("*").alias("n"))
        bad = (F.col("e") == 0) | ((F.col("e") == F.col("n")) if both_classes else F.lit(False))
        failed = [r["repeat"] for r in least.filter(bad).select("repeat").distinct().collect()]
        if not failed:
            return folds.drop("attempt")
        for r in failed:
            attempt[r] += 1
    raise ValueError(f"no {k} folds with an event each in {attempts} draws of repeats {sorted(failed)}")


def nested_folds(df: DataFrame, key: str, outcomes: list[str], repeats: int, k: int, inner: int, seed: int = 0, attempts: int = 100) -> DataFrame:
    """(key, repeat, fold, inner): shuffled outer folds per repeat, and inner folds drawn inside every outer fold.

    The rows outside an outer fold thus have inner folds of their own. A repeat is drawn again until every outer fold, and every
    inner fold of the rows outside each outer one, holds an event of every outcome; ``ValueError`` if it never does. The check returns
    repeats x folds x inner folds numbers.
    """
    attempt = {r: 0 for r in range(1, repeats + 1)}
    kept: list[DataFrame] = []
    for _ in range(attempts):
        outer = one_round_of_folds(df, key, sorted(attempt.items()), k, seed, outcomes)
        hashed = outer.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.col("repeat").cast("string"), F.col("attempt").cast("string"), F.col(key).cast("string"))))
        ranked = hash_numbered(cut_lineage(hashed), ["repeat", "fold"], "_h", [key], "_rank", total="_n")
        both = cut_lineage(ranked.withColumn("inner", fold_number(F.col("_rank"), F.col("_n"), inner)).select(key, *outcomes, "repeat", "fold", "inner"))
        cells = both.groupBy("repeat", "fold", "inner").agg(*[F.sum(F.col(o).cast("int")).alias(f"_e{i}") for i, o in enumerate(outcomes)]).collect()
        events = {r: np.zeros((len(outcomes), k, inner)) for r in attempt}
        for c in cells:
            events[c["repeat"]][:, c["fold"] - 1, c["inner"] - 1] = [c[f"_e{i}"] for i in range(len(outcomes))]
        bad = [r for r, e in events.items() if (e.sum(axis=2) == 0).any() or ((e.sum(axis=1, keepdims=True) - e) == 0).any()]
        kept.append(both.where(~F.col("repeat").isin(bad)).drop(*outcomes))
        if not bad:
            return reduce(DataFrame.unionByName, kept)
        attempt = {r: attempt[r] + 1 for r in bad}
    raise ValueError(f"no {k} x {inner} folds with an event each in {attempts} draws of repeats {bad}")


# --- scores -----------------------------------------------------------------------

def classify(p: str | Column, threshold: float = 0.5) -> Column:
    col = F.col(p) if isinstance(p, str) else p
    return F.when(col > threshold, 1).when(col.isNotNull(), 0)


def confusion(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """2x2 counts per group; absent cells are 0."""
    hit, real = classify(p, threshold) == 1, F.col(y) == 1
    return df.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
                               F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))


def rates(counts: DataFrame, positive: int = 1) -> DataFrame:
    """Accuracy, sensitivity, specificity and balanced accuracy for an explicit positive class."""
    tp, fp, fn, tn = (F.col(c) for c in (("tp", "fp", "fn", "tn") if positive == 1 else ("tn", "fn", "fp", "tp")))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "sensitivity": sens, "specificity": spec,
                               "balanced_accuracy": (sens + spec) / 2})


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p", on: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Mean squared error of the probability, or of the 0/1 class (``on="class"``)."""
    guess = F.col(p) if on == "probability" else classify(p, threshold).cast("double")
    return df.groupBy(*by).agg(F.avg(F.pow(guess - F.col(y), F.lit(2.0))).alias("brier"))


def _ranked_scores(df: DataFrame, by: list[str], y: str, p: str, ranges: int | None) -> DataFrame:
    """One row per group and distinct score with counts and running counts of both classes."""
    return _ranked_counts(df, by, p, F.count_if(F.col(y) == 1), F.count_if(F.col(y) != 1), ranges)


def _ranked_counts(df: DataFrame, by: list[str], p: str, ones: Column, others: Column, ranges: int | None) -> DataFrame:
    counted = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(ones.alias("_n1"), others.alias("_n0"))
    rows = ranged(counted, [*[F.col(c) for c in by], F.col(p)], ranges)
    return running(rows, by, "_bucket", [F.col(p)], {"_c1": F.col("_n1"), "_c0": F.col("_n0")},
                   totals={"_c1": "_all1", "_c0": "_all0"})


def roc_points(df: DataFrame, by: list[str], y: str = "y", p: str = "p", ranges: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr): rates when scores at or above the threshold count as positive."""
    r = _ranked_scores(df, by, y, p, ranges)
    above = lambda c, n, total: F.try_divide(F.col(total) - F.col(c) + F.col(n), F.col(total))
    return r.select(*by, F.col(p).alias("threshold"), above("_c0", "_n0", "_all0").alias("fpr"),
                    above("_c1", "_n1", "_all1").alias("tpr"))


def _auc() -> Column:
    # pairs won twice over, kept whole until the one division
    twice = F.col("_n1") * (2 * (F.col("_c0") - F.col("_n0")) + F.col("_n0"))
    return F.try_divide(F.sum(twice.cast("double")), (2 * F.max("_all1") * F.max("_all0")).cast("double"))


def auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p", ranges: int | None = None) -> DataFrame:
    """Area under the curve, ties counted half; a group with one class gives null. Never flipped."""
    return _ranked_scores(df, by, y, p, ranges).groupBy(*by).agg(_auc().alias("auc"))


def all_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5,
                ranges: int | None = None) -> DataFrame:
    """AUC, 2x2 counts, rates and class Brier score per group from one grouping of the scores."""
    return _all_rates(_ranked_scores(df, by, y, p, ranges), by, p, threshold)


def metrics_of_counts(df: DataFrame, by: list[str], p: str = "p", n1: str = "n1", n0: str = "n0", threshold: float = 0.5,
                      ranges: int | None = None) -> DataFrame:
    """The same from rows that each stand for ``n1`` rows of class 1 and ``n0`` of class 0 with one score."""
    return _all_rates(_ranked_counts(df, by, p, F.sum(n1), F.sum(n0), ranges), by, p, threshold)


def _all_rates(ranked: DataFrame, by: list[str], p: str, threshold: float) -> DataFrame:
    hit = F.col(p) > threshold
    count = lambda cond, n: F.sum(F.when(cond, F.col(n)).otherwise(0))
    table = ranked.groupBy(*by).agg(
        _auc().alias("auc"), count(hit, "_n1").alias("tp"), count(hit, "_n0").alias("fp"),
        count(~hit, "_n1").alias("fn"), count(~hit, "_n0").alias("tn"))
    return rates(table).withColumn("brier", 1 - F.col("accuracy"))


def calibration(df: DataFrame, by: list[str], y: str = "y", p: str = "p", width: float = 0.1) -> DataFrame:
    """Rows and observed share per risk bin; the last bin includes 1."""
    last = round(1 / width) - 1
    bin_ = F.least(F.floor(F.col(p) / F.lit(width)), F.lit(last)).cast("int")
    return df.filter(F.col(p).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_over_folds(table: DataFrame, by: list[str] = ()) -> DataFrame:
    return table.groupBy(*by, "bin").agg(F.percentile("observed", F.lit(0.5)).alias("median_observed"), F.sum("n").alias("n"))


def t_quantile(n: Column, z: float = 1.959963984540054) -> Column:
    """Student quantile from the normal one by the usual expansion in 1/df (good from about 5 on)."""
    v = n - F.lit(1.0)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.lit(z) + g1 / v + g2 / (v * v) + g3 / (v * v * v) + g4 / (v * v * v * v)


def interval_summary(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, 2.5/50/97.5 % quantiles and t-interval over folds (a table with one row per fold)."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    base = metrics.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"),
                                    F.stddev_samp(value).alias("_sd"), q.alias("_q"))
    half = F.when(F.col("n") > 1, t_quantile(F.col("n")) * F.col("_sd") / F.sqrt(F.col("n")))
    return base.select(*by, "n", "mean_value", F.col("_q")[0].alias("q025"), F.col("_q")[1].alias("q500"),
                       F.col("_q")[2].alias("q975"), (F.col("mean_value") - half).alias("t_low"),
                       (F.col("mean_value") + half).alias("t_high"))


# --- selection stability: coefficients as (model..., variable, odds_ratio, p_value) ----------------

def chosen_by_p(threshold: float = 0.05) -> Column:
    return F.coalesce(F.col("p_value") <= threshold, F.lit(False))


def chosen_by_ratio(digits: int = 3, band: float = 0.001) -> Column:
    r = F.round("odds_ratio", digits)
    return F.coalesce((r < 1 - band) | (r > 1 + band), F.lit(False))


def selection_frequency(coefs: DataFrame, model: list[str], chosen: Column) -> DataFrame:
    """How many models choose each variable, and the share of all models."""
    n_models = coefs.agg(F.count_distinct(*model)).scalar()
    return coefs.groupBy("variable").agg(F.count_if(chosen).alias("n")).withColumn("share", F.col("n") / n_models)


def variables_per_model(coefs: DataFrame, model: list[str], chosen: Column) -> DataFrame:
    return coefs.groupBy(*model).agg(F.count_if(chosen).alias("n_variables"))


def events_per_variable(per_model: DataFrame, events: Column) -> DataFrame:
    """Events per chosen variable over the models; models without a variable have none."""
    epv = F.when(F.col("n_variables") > 0, events / F.col("n_variables"))
    return per_model.agg(F.count("*").alias("models"), F.min(epv).alias("min_epv"), F.max(epv).alias("max_epv"), F.avg(epv).alias("mean_epv"))


def _variable_sets(coefs: DataFrame, model: list[str], chosen: Column) -> DataFrame:
    # the set of a model is bounded by the number of variables, and repeats are combined first
    picked = F.sort_array(F.collect_set(F.when(chosen, F.col("variable"))))
    return coefs.groupBy(*model).agg(picked.alias("variables")).groupBy("variables").agg(F.count("*").alias("n"))


def model_frequency(coefs: DataFrame, model: list[str], chosen: Column, k: int = 20) -> DataFrame:
    """Most frequent variable sets with their share and running share, at most ``k``."""
    sets = _variable_sets(coefs, model, chosen).withColumn("variables", F.array_join("variables", ","))
    order = [F.col("n").desc(), F.col("variables").asc()]
    n_models = coefs.agg(F.count_distinct(*model)).scalar()
    top = sets.orderBy(*order).limit(k).withColumn("share", F.col("n") / n_models)
    # at most k rows from here on
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumn("cumulative_share", F.sum("share").over(upto))


def pair_frequency(coefs: DataFrame, model: list[str], chosen: Column) -> DataFrame:
    """Models that choose both variables, for every ordered pair.

    Pairs are formed once per distinct variable set (bounded by the variables), not per model.
    """
    sets = _variable_sets(coefs, model, chosen)
    pairs = sets.select("n", F.explode("variables").alias("variable"), "variables").select(
        "n", "variable", F.explode("variables").alias("other"))
    return pairs.groupBy("variable", "other").agg(F.sum("n").alias("n"))


def pair_correlation(pairs: DataFrame, variables: list[str]) -> DataFrame:
    """Correlation of the co-selection columns, for a given variable list."""
    wide = pairs.groupBy("other").agg(*[F.sum(F.when(F.col("variable") == v, F.col("n")).otherwise(0)).alias(v) for v in variables])
    cells = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in variables for b in variables])
    long = cells.unpivot([], [f"{a}|{b}" for a in variables for b in variables], "pair", "correlation")
    pair = F.split("pair", r"\|")
    return long.select(pair[0].alias("variable"), pair[1].alias("other"), "correlation")


def odds_ratio_summary(coefs: DataFrame, min_models: int = 50, band: float = 0.01) -> DataFrame:
    """Median odds ratio of a variable if more than ``min_models`` models keep it, else null."""
    r = F.col("odds_ratio")
    kept = F.count_if((r > 1 + band) | (r < 1 - band))
    table = coefs.groupBy("variable").agg(kept.alias("kept"), F.percentile("odds_ratio", F.lit(0.5)).alias("_median"))
    return table.select("variable", "kept", F.when(F.col("kept") > min_models, F.col("_median")).alias("median_odds_ratio"))
