"""Filling missing values: nearest rows, and chained equations."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.grid import Model, design, fit_models
from wardline.operators.prep import seeded_normal, seeded_uniform
from wardline.session import cut_lineage, salted_join

# --- nearest rows ---------------------------------------------------------------------


class Leaves:
    """Boxes around groups of donors: number, columns that some and that all of them have, lowest and highest values."""

    def __init__(self, ids: np.ndarray, some: np.ndarray, every: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.ids, self.some, self.every, self.lo, self.hi = ids, some, every, lo, hi

    def distances(self, x: np.ndarray, target: int) -> np.ndarray:
        """Least possible null-aware distance from a row to each box; infinite where it cannot donate.

        A donor's distance is the mean of its squared gaps over the columns both have, times the width. Columns that
        all donors of a box have are in that mean; of the others those that make it smallest, the narrowest gaps first.
        """
        seen = ~np.isnan(x)
        gap = np.maximum(np.maximum(self.lo - x, x - self.hi), 0.0) ** 2
        sure = self.every & seen
        free = np.sort(np.where(self.some & seen & ~sure, gap, np.inf), axis=1)
        total = np.where(sure, gap, 0.0).sum(axis=1)[:, None] + np.concatenate([np.zeros((len(gap), 1)), np.cumsum(free, axis=1)], axis=1)
        count = sure.sum(axis=1)[:, None] + np.arange(x.size + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(count > 0, total / count, np.inf)
        # a hair lower, so that rounding cannot put a box beyond a donor in it
        d = mean.min(axis=1) * x.size * (1 - 1e-9)
        return np.where(self.some[:, target], d, np.inf)


def _grow_leaves(donors: DataFrame, width: int, leaf_rows: int, max_leaves: int) -> tuple[DataFrame, Leaves]:
    """Split donors at medians of their widest column until groups are small.

    A null goes to the lower side, so rows of any null patterns share groups: any number of columns will do, and the
    number of groups does not follow that of patterns. Only one summary row per group comes to the driver, and there
    are at most ``max_leaves``.
    """
    rows = donors.withColumn("leaf", F.lit(1).cast("bigint"))
    spark, round_ = donors.sparkSession, 0
    while True:
        stats = rows.groupBy("leaf").agg(
            F.count("*").alias("n"), *[F.min(F.col("v")[j]).alias(f"lo{j}") for j in range(width)],
            *[F.count(F.col("v")[j]).alias(f"n{j}") for j in range(width)],
            *[F.max(F.col("v")[j]).alias(f"hi{j}") for j in range(width)],
            *[F.percentile_approx(F.col("v")[j], 0.5).alias(f"mid{j}") for j in range(width)]).toPandas()
        lo = stats[[f"lo{j}" for j in range(width)]].to_numpy(float)
        hi = stats[[f"hi{j}" for j in range(width)]].to_numpy(float)
        spread = np.nan_to_num(hi - lo, nan=-1.0)
        axis = spread.argmax(axis=1)
        big = (stats["n"].to_numpy() > leaf_rows) & (spread.max(axis=1) > 0)
        if not big.any() or len(stats) + big.sum() > max_leaves or round_ >= 60:
            break
        cuts = []
        for i in np.flatnonzero(big):
            j = int(axis[i])
            mid = float(stats[f"mid{j}"][i])
            # a median at the top would leave one side empty
            cuts.append((int(stats["leaf"][i]), j, mid if mid < hi[i, j] else float((lo[i, j] + hi[i, j]) / 2)))
        table = spark.createDataFrame(cuts, "leaf bigint, axis int, cut double")
        split = rows.join(F.broadcast(table), "leaf", "left")
        side = F.when(F.expr("v[axis]") > F.col("cut"), 1).otherwise(0)
        # the number is the path: a leading one, then one bit per split
        moved = F.when(F.col("axis").isNull(), F.col("leaf")).otherwise(F.col("leaf") * 2 + side)
        rows = split.withColumn("leaf", moved).drop("axis", "cut")
        round_ += 1
        if round_ % 4 == 0:
            rows = cut_lineage(rows)
    have = stats[[f"n{j}" for j in range(width)]].to_numpy(np.int64)
    return rows, Leaves(stats["leaf"].to_numpy(np.int64), have > 0, have == stats[["n"]].to_numpy(np.int64), np.nan_to_num(lo), np.nan_to_num(hi))


def _nearest_leaf(leaves: Leaves):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x, t in zip(pdf["q"], pdf["target"]):
                d = leaves.distances(np.array(x, dtype=float), t)
                i = int(d.argmin()) if d.size else -1
                found.append(int(leaves.ids[i]) if i >= 0 and np.isfinite(d[i]) else None)
            yield pdf.assign(leaf=pd.array(found, dtype="Int64"))
    return run


def _other_leaves(leaves: Leaves):
    """Leaves that may hold a donor as near as the worst one found so far."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, t, own, worst in zip(pdf["q"], pdf["target"], pdf["leaf"], pdf["worst"]):
                d = leaves.distances(np.array(x, dtype=float), t)
                keep = np.isfinite(d) & (d <= worst) & (leaves.ids != own)
                out.append(leaves.ids[keep].tolist())
            yield pdf[["qid", "target", "q"]].assign(leaf=out)
    return run


def _best_in_leaf(width: int, k: int):
    """k nearest donors of one leaf per row, as (distance, donor, value) lists."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dist, who, value = [], [], []
            for x, t, ids, flat in zip(pdf["q"], pdf["target"], pdf["ids"], pdf["flat"]):
                x, m = np.array(x, dtype=float), np.asarray(flat, dtype=float).reshape(-1, width)
                ids = np.asarray(ids)
                diff = m - x
                common = ~np.isnan(diff)
                count = common.sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.where(common, diff, 0.0).__pow__(2).sum(axis=1) * (width / count)
                d = np.where((count > 0) & ~np.isnan(m[:, t]), d, np.inf)
                order = np.lexsort((ids, d))[:k]
                order = order[np.isfinite(d[order])]
                dist.append(d[order].tolist())
                who.append(ids[order].tolist())
                value.append(m[order, t].tolist())
            yield pdf[["qid", "target", "q", "leaf"]].assign(dist=dist, who=who, value=value)
    return run


ASKED = "qid bigint, target int, q array<double>"
FOUND = ASKED + ", leaf bigint, dist array<double>, who array<bigint>, value array<double>"


def knn_impute(df: DataFrame, key: str, cols: list[str], k: int = 2, leaf_rows: int = 256, max_leaves: int = 50_000) -> DataFrame:
    """Fill each null by the mean over the k nearest rows that have the value.

    Distance is over the columns both rows have, scaled up for those they lack; ties go to the
    lower key; a row that shares no column with any donor takes the column mean. Exact: a row
    asks the leaf nearest to it, then every other leaf whose box reaches within its k-th best
    distance. Equal rows are asked once, and of equal donors only the first k can matter, so
    repeated rows cost nothing.
    """
    width = len(cols)
    # adding zero turns a negative zero into a plain one, so equal points have equal text
    values = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])
    rows = df.select(F.col(key).cast("bigint").alias("id"), values.alias("v"))
    gaps = F.exists("v", lambda x: x.isNull())
    told = rows.filter(F.exists("v", lambda x: x.isNotNull()))
    point = [F.col("v")[j] for j in range(width)]
    keyed = told.withColumns({f"_p{j}": p for j, p in enumerate(point)})
    donors = keyed.select("id", "v", F.row_number().over(_by_point(width)).alias("_rn")).filter(F.col("_rn") <= k).drop("_rn")
    placed, leaves = _grow_leaves(cut_lineage(donors), width, leaf_rows, max_leaves)
    flat = F.flatten(F.transform(F.col("d"), lambda s: s["v"]))
    packed = placed.groupBy("leaf").agg(F.collect_list(F.struct("id", "v")).alias("d")).select(
        "leaf", F.transform("d", lambda s: s["id"]).alias("ids"), flat.alias("flat"))
    asked = rows.filter(gaps).groupBy("v").agg(F.min("id").alias("qid")).select(
        "qid", F.explode(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get("v", j).isNull())).alias("target"), F.col("v").alias("q"))
    asked = cut_lineage(asked)
    near = asked.mapInPandas(_nearest_leaf(leaves), ASKED + ", leaf bigint")
    first = salted_join(near.filter("leaf IS NOT NULL"), packed, ["leaf"], ["qid"]).mapInPandas(_best_in_leaf(width, k), FOUND)
    first = cut_lineage(first)
    # fewer than k found so far: any donor may still count
    worst = F.when(F.size("dist") < k, F.lit(float("inf"))).otherwise(F.element_at("dist", -1))
    more = first.withColumn("worst", worst).mapInPandas(_other_leaves(leaves), ASKED + ", leaf array<bigint>")
    more = more.withColumn("leaf", F.explode("leaf"))
    rest = salted_join(more, packed, ["leaf"], ["qid"]).mapInPandas(_best_in_leaf(width, k), FOUND)
    every = first.unionByName(rest).select("qid", "target", F.explode(F.arrays_zip("dist", "who", "value")).alias("e")).select("qid", "target", "e.*")
    ranked = every.withColumn("_rn", F.row_number().over(Window.partitionBy("qid", "target").orderBy("dist", "who"))).filter(F.col("_rn") <= k)
    filled = ranked.groupBy("qid").pivot("target", list(range(width))).agg(F.avg("value"))
    by_point = asked.groupBy("qid").agg(F.first("q").alias("q")).join(filled, "qid", "left").select(
        _point_text(F.col("q"), width).alias("_point"), *[F.col(str(j)).alias(f"_f{j}") for j in range(width)])
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    complete = df.dropna(subset=cols)
    holed = df.filter(_any_null(cols)).withColumn("_point", _point_text(values, width))
    joined = salted_join(holed, by_point, ["_point"], [key], "left")
    out = joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{j}"), F.lit(means[c])) for j, c in enumerate(cols)})
    out = out.select(*df.columns)
    return complete.withColumns({c: F.col(c).cast("double") for c in cols}).unionByName(out)


def _by_point(width: int):
    return Window.partitionBy(*[f"_p{j}" for j in range(width)]).orderBy("id")


def _any_null(cols: list[str]) -> Column:
    cond = F.col(cols[0]).isNull()
    for c in cols[1:]:
        cond = cond | F.col(c).isNull()
    return cond


def _point_text(v: Column, width: int) -> Column:
    return F.concat_ws("|", *[F.coalesce(v[j].cast("string"), F.lit("?")) for j in range(width)])


# --- chained equations --------------------------------------------------------------------

def chained_impute(df: DataFrame, key: str, cols: dict[str, str], copies: int = 5, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Multiple imputation: (key, imputation, columns...), ``copies`` filled versions of every row.

    Each round refits every incomplete column on the others (least squares for ``numeric``,
    logistic for ``binary``) on the rows that have it, draws coefficients from their sampling
    distribution and fills the gaps with a prediction plus a draw. All copies are fitted in one
    grid. Draws come from hashes of (seed, round, column, copy, key), so a retry repeats them.
    """
    names = list(cols)
    width = len(names)
    start = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in names]).first()
    open_ = [j for j, c in enumerate(names) if start[f"n_{c}"] > 0]
    fill = {c: start[c] if cols[c] == "numeric" else float((start[c] or 0.0) >= 0.5) for c in names}
    state = df.select(F.col(key).cast("bigint").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"),
                      *[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(c) for c in names],
                      *[F.col(c).isNull().cast("double").alias(f"_miss_{c}") for c in names])
    state = cut_lineage(state)
    features = [*names, *[f"_miss_{c}" for c in names]]
    rng = np.random.default_rng(seed)
    for round_ in range(rounds):
        for j in open_:
            c = names[j]
            family = "gaussian" if cols[c] == "numeric" else "binomial"
            terms = tuple(i for i in range(width) if i != j)
            rows = design(state, "id", [c], features, case=F.col("copy"), settle=False)
            fits = fit_models(rows, [Model((("copy", m),), terms, case=m, skip=(width + j,), family=family) for m in range(1, copies + 1)], max_iter=12)
            drawn = []
            for f in fits:
                sigma = float(np.sqrt(2 * f.loss / max(f.n - len(f.beta), 1))) if family == "gaussian" else 1.0
                cov = f.cov * sigma**2
                beta = rng.multivariate_normal(f.beta, (cov + cov.T) / 2, method="eigh")
                drawn.append((dict(f.model.key)["copy"], [float(b) for b in beta], sigma))
            table = state.sparkSession.createDataFrame(drawn, "copy int, _beta array<double>, _sigma double")
            eta = F.col("_beta")[0]
            for place, i in enumerate(terms, start=1):
                eta = eta + F.col("_beta")[place] * F.col(names[i])
            mark = 1000 * seed + 100 * round_ + j
            draw = (eta + F.col("_sigma") * seeded_normal(mark, "copy", "id") if family == "gaussian"
                    else (seeded_uniform(mark, "copy", "id") < 1 / (1 + F.exp(-eta))).cast("double"))
            state = state.join(F.broadcast(table), "copy").withColumn(c, F.when(F.col(f"_miss_{c}") == 1, draw).otherwise(F.col(c))).drop("_beta", "_sigma")
            state = cut_lineage(state)
    return state.select(F.col("id").alias(key), F.col("copy").alias("imputation"), *names)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
