"""Cross-validated models of many conditions from one table of counted design rows.

A condition is a case (a window and a way of reading) and an outcome. Design rows are mostly 0/1 flags, so equal ones are
counted before anything is fitted: ``frequency_table`` has one row for each pattern, repeat and fold cell, whatever the
number of people. All models of a condition (every repeat and outer fold, plain and penalised, with nested inner folds and a
whole penalty path) are then fitted together in one task from its counts, and all conditions are one job. A condition whose
patterns are counted to be too many for a task is fitted by the passes of ``grid`` over the same counts instead.

Results are long tables: coefficients with the penalties of both rules, then scores, metrics and the report tables, which
need nothing but coefficients and counts.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import evaluate, grid
from wardline.session import cut_lineage

MOST_CELLS = 4 << 20
KEYS = ["case", "outcome", "repeat", "fold", "learner"]
CONDITION = ["case", "outcome", "learner"]
INTERCEPT = "(Intercept)"
FITTED_DDL = ("case int, outcome string, repeat int, fold int, learner string, variable string, estimate double, std_error double, p_value double, "
              "lambda_min double, lambda_1se double, n double, converged boolean")
FITTED = pa.schema([("case", pa.int32()), ("outcome", pa.string()), ("repeat", pa.int32()), ("fold", pa.int32()), ("learner", pa.string()),
                    ("variable", pa.string()), ("estimate", pa.float64()), ("std_error", pa.float64()), ("p_value", pa.float64()),
                    ("lambda_min", pa.float64()), ("lambda_1se", pa.float64()), ("n", pa.float64()), ("converged", pa.bool_())])


# --- counted rows -----------------------------------------------------------------------

def frequency_table(rows: DataFrame, folds: DataFrame | None, key: str, features: list[str], outcomes: list[str]) -> DataFrame:
    """case, repeat, fold, inner, x, n, events (one number per outcome): equal design rows of a cell, counted.

    ``rows``: one for each key and ``case``; ``folds``: key, repeat, fold, inner. Without folds (another site) there is one
    repeat, fold and inner fold 0. Rows with a null feature or outcome are left out. A written table.
    """
    clean = rows.dropna(subset=[*features, *outcomes]).select(
        F.col(key).alias("_key"), F.col("case").cast("int").alias("case"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        *[F.col(o).cast("bigint").alias(f"_y{i}") for i, o in enumerate(outcomes)])
    if folds is None:
        cells = clean.withColumns({c: F.lit(0) for c in ("repeat", "fold", "inner")})
    else:
        cells = clean.join(folds.select(F.col(key).alias("_key"), "repeat", "fold", "inner"), "_key")
    counted = cells.groupBy("case", "repeat", "fold", "inner", "x").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_y{i}").alias(f"_y{i}") for i in range(len(outcomes))])
    return cut_lineage(counted.select("case", "repeat", "fold", "inner", "x", "n", F.array(*[F.col(f"_y{i}") for i in range(len(outcomes))]).alias("events")))


def by_outcome(counts: DataFrame, outcomes: list[str]) -> DataFrame:
    """The counts once for each outcome: outcome (name), events (a number)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col("events")[i].alias("events")) for i, o in enumerate(outcomes)]))
    return counts.select("case", "repeat", "fold", "inner", "x", "n", pairs.alias("_o")).select(
        "case", F.col("_o.outcome").alias("outcome"), "repeat", "fold", "inner", "x", "n", F.col("_o.events").alias("events"))


# --- fits of one group of counts ---------------------------------------------------------

class Counts:
    """Patterns (with an intercept) and, for each of many models, how many rows and events of each it sees."""

    def __init__(self, x: np.ndarray, n: np.ndarray, events: np.ndarray):
        self.x, self.n, self.events = x, n, events
        self.total = n.sum(axis=1)
        mean = (n @ x) / np.maximum(self.total, 1e-300)[:, None]
        self.sd = np.sqrt(np.maximum((n @ x**2) / np.maximum(self.total, 1e-300)[:, None] - mean**2, 0.0))
        self.sd[self.sd < 1e-12] = 0.0

    def loss(self, beta: np.ndarray) -> np.ndarray:
        eta = beta @ self.x.T
        return np.sum(self.n * np.logaddexp(0.0, eta) - self.events * eta, axis=1)

    def slopes(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the log-likelihood, curvature weight of each pattern)."""
        p = 1.0 / (1.0 + np.exp(-np.clip(beta @ self.x.T, -500, 500)))
        return (self.events - self.n * p) @ self.x, self.n * p * (1 - p)

    def curvature(self, weight: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """models x columns x columns, added up over blocks of patterns."""
        size = len(columns)
        out = np.zeros((len(weight), size * size))
        step = max(1, (1 << 21) // (size * size))
        for low in range(0, len(self.x), step):
            part = self.x[low:low + step, columns]
            out += weight[:, low:low + step] @ (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
        return out.reshape(-1, size, size)


def plain_fits(counts: Counts, tol: float = 1e-12, most: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(coefficients, covariances, converged, aliased columns) of an unpenalised logistic fit for every model."""
    models, width = len(counts.n), counts.x.shape[1]
    every = np.arange(width)
    gram = counts.curvature(counts.n, every)
    aliased = [grid._aliased(g) if t > 0 else list(range(width)) for g, t in zip(gram, counts.total)]
    free = np.ones((models, width), bool)
    for b, columns in enumerate(aliased):
        free[b, columns] = False
    beta = np.zeros((models, width))
    loss = counts.loss(beta)
    done = ~free.any(axis=1)

    def bounded(curve: np.ndarray) -> np.ndarray:
        """Curvature of the free columns; the others stay as they are."""
        out = np.where(free[:, :, None] & free[:, None, :], curve, 0.0)
        out[:, every, every] += np.where(free, 1e-10 * np.maximum(1.0, np.trace(curve, axis1=1, axis2=2) / width)[:, None], 1.0)
        return out

    for _ in range(most):
        slope, weight = counts.slopes(beta)
        step = np.linalg.solve(bounded(counts.curvature(weight, every)), np.where(free, slope, 0.0)[:, :, None])[:, :, 0]
        step[done] = 0.0
        scale = np.ones(models)
        for _ in range(40):  # half way back where the loss went up
            new = counts.loss(beta + scale[:, None] * step)
            worse = new > loss + 1e-12 * np.abs(loss)
            if not worse.any():
                break
            scale[worse] /= 2
        beta = beta + scale[:, None] * step
        done |= loss - new <= tol * (np.abs(new) + counts.total)
        loss = new
        if done.all():
            break
    _, weight = counts.slopes(beta)
    cov = np.linalg.pinv(np.where(free[:, :, None] & free[:, None, :], counts.curvature(weight, every), 0.0), hermitian=True)
    return beta, cov, done, aliased


def largest_penalty(counts: Counts) -> np.ndarray:
    """For each model, the smallest penalty at which every coefficient is zero."""
    rate = counts.events.sum(axis=1) / np.maximum(counts.total, 1e-300)
    score = np.abs((counts.events - counts.n * rate[:, None]) @ counts.x) / np.maximum(counts.total, 1e-300)[:, None]
    return np.max(np.where(counts.sd > 0, score / np.maximum(counts.sd, 1e-300), 0.0)[:, 1:], axis=1, initial=0.0)


class Path:
    """L1-penalised logistic fits of many models along their penalties, each started from the one before.

    The strong rule leaves out columns whose slope is too small for them to come in at the next penalty; only the others'
    curvature is worked out, and any that were left out wrongly (by the optimality conditions) come back in.
    """

    def __init__(self, counts: Counts):
        self.counts = counts
        self.beta = np.zeros((len(counts.n), counts.x.shape[1]))
        rate = np.clip(counts.events.sum(axis=1) / np.maximum(counts.total, 1e-300), 1e-12, 1 - 1e-12)
        self.beta[:, 0] = np.log(rate / (1 - rate))
        self.before = largest_penalty(counts)
        # Without an event, or with events only, there is nothing to fit: the intercept stays where it is.
        self.flat = (counts.events.sum(axis=1) <= 0) | (counts.events.sum(axis=1) >= counts.total)
        self.converged = ~self.flat

    def _scaled(self, slope: np.ndarray) -> np.ndarray:
        c = self.counts
        return np.where(c.sd > 0, np.abs(slope) / np.maximum(c.total[:, None] * c.sd, 1e-300), 0.0)

    def step(self, penalty: np.ndarray) -> np.ndarray:
        """Coefficients at the next penalty of every model."""
        c = self.counts
        slope, _ = c.slopes(self.beta)
        keep = (self._scaled(slope) >= (2 * penalty - self.before)[:, None]) | (self.beta != 0)
        keep &= c.sd > 0
        keep[:, 0] = True
        while True:
            ok = self._solve(penalty, keep)
            slope, _ = c.slopes(self.beta)
            wrong = ~keep & (self._scaled(slope) > penalty[:, None] * (1 + 1e-9) + 1e-12)
            wrong[:, 0] = False
            if not wrong.any():
                break
            keep |= wrong
        self.converged &= ok
        self.before = penalty
        return self.beta.copy()

    def _value(self, beta: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        return self.counts.loss(beta) + np.sum(threshold * np.abs(beta), axis=1)

    def _solve(self, penalty: np.ndarray, keep: np.ndarray, most: int = 100) -> np.ndarray:
        c = self.counts
        threshold = c.total[:, None] * penalty[:, None] * c.sd
        threshold[:, 0] = 0.0
        columns = np.flatnonzero(keep.any(axis=0))
        held = keep[:, columns]
        done = self.flat.copy()
        value = self._value(self.beta, threshold)
        for _ in range(most):
            slope, weight = c.slopes(self.beta)
            curve = c.curvature(weight, columns)
            new = self._descend(self.beta[:, columns], slope[:, columns], curve, threshold[:, columns], held)
            move = np.zeros_like(self.beta)
            move[:, columns] = new - self.beta[:, columns]
            move[done] = 0.0
            scale = np.ones(len(c.n))
            for _ in range(40):
                after = self._value(self.beta + scale[:, None] * move, threshold)
                worse = after > value + 1e-12 * np.abs(value)
                if not worse.any():
                    break
                scale[worse] /= 2
            size = np.abs(scale[:, None] * move * np.where(c.sd > 0, c.sd, 1.0)).max(axis=1)
            self.beta = self.beta + scale[:, None] * move
            value = after
            done |= size < 1e-9
            if done.all():
                break
        return done

    @staticmethod
    def _descend(start: np.ndarray, slope: np.ndarray, curve: np.ndarray, threshold: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The least value of the local quadratic with its penalty, for every model at once.

        Sweeps of coordinate descent find which coefficients are not zero and their signs; with these given, the rest is one
        linear system. Its answer stands if it keeps the signs and the zero coefficients' slopes stay under the penalty.
        """
        new = start.copy()
        base = slope + np.einsum("bij,bj->bi", curve, start)  # slope of the quadratic at ``new`` is base - curve @ new
        rest = slope.copy()
        diagonal = np.maximum(np.einsum("bii->bi", curve), 1e-300)
        every = np.arange(start.shape[1])
        open_ = np.ones(len(start), bool)
        for sweep in range(2000):
            most = 0.0
            for j in every:
                target = rest[:, j] + diagonal[:, j] * new[:, j]
                value = np.sign(target) * np.maximum(np.abs(target) - threshold[:, j], 0.0) / diagonal[:, j]
                change = np.where(held[:, j] & open_, value - new[:, j], 0.0)
                if change.any():
                    rest -= curve[:, :, j] * change[:, None]
                    new[:, j] += change
                    most = max(most, float(np.max(np.abs(change) * np.sqrt(diagonal[:, j] / diagonal[:, 0]))))
            if most < 1e-11:
                break
            if sweep % 4 == 3:
                active = held & ((new != 0) | (threshold == 0))
                sign = np.where(threshold > 0, np.sign(new), 0.0)
                system = np.where(active[:, :, None] & active[:, None, :], curve, 0.0)
                system[:, every, every] += np.where(active, 1e-13 * diagonal, 1.0)
                exact = np.linalg.solve(system, np.where(active, base - threshold * sign, 0.0)[:, :, None])[:, :, 0]
                left = base - np.einsum("bij,bj->bi", curve, exact)
                kept = ~active | (threshold == 0) | (np.sign(exact) == sign)
                under = active | ~held | (np.abs(left) <= threshold * (1 + 1e-10))
                solved = open_ & (kept & under).all(axis=1)
                new[solved], rest[solved] = exact[solved], left[solved]
                open_ &= ~solved
                if not open_.any():
                    break
        return new


def chosen_penalties(penalties: np.ndarray, deviance: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """(index of least mean deviance, index of the largest penalty within one standard error of it).

    ``deviance``: inner folds x penalties, ``weight``: rows of each inner fold; penalties fall.
    """
    used = weight > 0
    dev, w = deviance[used], weight[used]
    mean = np.average(dev, axis=0, weights=w)
    error = np.sqrt(np.average((dev - mean) ** 2, axis=0, weights=w) / max(len(dev) - 1, 1))
    low = int(np.argmin(mean))
    return low, int(np.flatnonzero(mean <= mean[low] + error[low])[0])


def fit_group(x: np.ndarray, repeat: np.ndarray, fold: np.ndarray, inner: np.ndarray, n: np.ndarray, events: np.ndarray, learners: tuple[str, ...],
              penalties: int, ratio: float) -> list[dict]:
    """Every repeat's and outer fold's models of one condition, from its counts.

    Folds may have any numbers; inner fold g of an outer part is what has inner number g and lies outside that part.
    """
    patterns, which = np.unique(x, axis=0, return_inverse=True)
    which = which.ravel()
    (repeats, repeat), (outer, fold), (parts, inner) = (np.unique(c, return_inverse=True) for c in (repeat, fold, inner))
    cells = np.zeros((2, len(repeats), len(outer), len(parts), len(patterns)))
    np.add.at(cells, (0, repeat, fold, inner, which), n)
    np.add.at(cells, (1, repeat, fold, inner, which), events)
    models = [(int(r), int(f)) for r in repeats for f in outer]
    full = np.column_stack([np.ones(len(patterns)), patterns])
    by_part = (cells.sum(axis=2, keepdims=True) - cells).reshape(2, len(models), len(parts), len(patterns))  # outside the outer part, by inner part
    train = by_part.sum(axis=2)
    out = []
    if "glm" in learners:
        counts = Counts(full, train[0], train[1])
        beta, cov, done, aliased = plain_fits(counts)
        for f, (number, held) in enumerate(models):
            out.append({"repeat": number, "fold": held, "learner": "glm", "beta": beta[f], "se": np.sqrt(np.maximum(np.diag(cov[f]), 0.0)), "aliased": aliased[f],
                        "n": counts.total[f], "converged": bool(done[f])})
    if "lasso" in learners:
        whole = Counts(full, train[0], train[1])
        top = np.maximum(largest_penalty(whole), 1e-8)
        steps = top[:, None] * np.geomspace(1.0, ratio, penalties)
        path = Path(whole)
        along = np.stack([path.step(steps[:, i]) for i in range(penalties)], axis=1)  # model, penalty, column
        rest = train[:, :, None] - by_part  # fitted without inner part g
        shape = (len(models) * len(parts), len(patterns))
        nested = Path(Counts(full, rest[0].reshape(shape), rest[1].reshape(shape)))
        test = Counts(full, by_part[0].reshape(shape), by_part[1].reshape(shape))
        spread = np.repeat(steps, len(parts), axis=0)
        deviance = np.stack([2 * test.loss(nested.step(spread[:, i])) / np.maximum(test.total, 1e-300) for i in range(penalties)], axis=1)
        for f, (number, held) in enumerate(models):
            own = slice(f * len(parts), (f + 1) * len(parts))
            low, one_se = chosen_penalties(steps[f], deviance[own], test.total[own])
            out.append({"repeat": number, "fold": held, "learner": "lasso", "beta": along[f, low], "se": None, "aliased": [], "n": whole.total[f],
                        "lambda_min": steps[f, low], "lambda_1se": steps[f, one_se], "converged": bool(path.converged[f] and nested.converged[own].all())})
    return out


def _fitted_rows(case: int, outcome: str, found: list[dict], names: list[str]) -> list[tuple]:
    rows = []
    for f in found:
        for j, name in enumerate(names):
            head = (case, outcome, f["repeat"], f["fold"], f["learner"], name)
            tail = (f.get("lambda_min"), f.get("lambda_1se"), float(f["n"]), f["converged"])
            if j in f["aliased"]:
                rows.append((*head, None, None, None, *tail))
                continue
            b = float(f["beta"][j])
            se = float(f["se"][j]) if f["se"] is not None else None
            rows.append((*head, b, se, math.erfc(abs(b / se) / math.sqrt(2)) if se else None, *tail))
    return rows


def _fit_task(features: list[str], learners: tuple[str, ...], penalties: int, ratio: float) -> Callable[[pa.Table], pa.Table]:
    names = [INTERCEPT, *features]

    def work(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(x) != table.num_rows * len(features):
            raise ValueError(f"the counts are not of these {len(features)} features")
        x = x.reshape(table.num_rows, len(features))
        column = lambda c: table.column(c).to_numpy().astype(float)
        found = fit_group(x, *[column(c).astype(int) for c in ("repeat", "fold", "inner")], column("n"), column("events"), learners, penalties, ratio)
        rows = _fitted_rows(table.column("case")[0].as_py(), table.column("outcome")[0].as_py(), found, names)
        return pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(FITTED.names)}, FITTED)

    return work


def _fit_by_passes(counts: DataFrame, groups: list[tuple[int, str, int]], features: list[str], folds: int, inner: int, learners: tuple[str, ...],
                   penalties: int, ratio: float) -> DataFrame:
    """The same table from passes over the counts as weighted rows: for groups too large for a task."""
    from wardline.operators import learn

    number = {g: i for i, g in enumerate(groups)}
    spark = counts.sparkSession
    ids = spark.createDataFrame([(*g, i) for g, i in number.items()], "case int, outcome string, repeat int, _case int")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("events").cast("double").alias("w")),
                             F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("events")).cast("double").alias("w"))))
    weighted = counts.join(F.broadcast(ids), ["case", "outcome", "repeat"]).select("_case", "x", "fold", "inner", both.alias("_b")).where("_b.w > 0")
    rows = cut_lineage(weighted.select(F.lit(0).cast("bigint").alias("id"), F.array("_b.y").alias("y"), "x", F.array("fold", "inner").cast("array<int>").alias("folds"),
                                       F.col("_case").cast("int").alias("case"), F.col("_b.w").alias("weight")))
    out = []
    models = [grid.Model((("case", c), ("outcome", o), ("repeat", r), ("fold", f)), tuple(range(len(features))), case=i, held=(0, f))
              for (c, o, r), i in number.items() for f in range(1, folds + 1)]
    if "glm" in learners:
        for fit in grid.fit_models(rows, models, max_iter=60, tol=1e-12):
            case, outcome, repeat, fold = (v for _, v in fit.model.key)
            aliased = [fit.model.terms.index(t) + 1 for t in fit.aliased]
            out += _fitted_rows(case, outcome, [{"repeat": repeat, "fold": fold, "learner": "glm", "beta": fit.beta, "se": np.sqrt(np.maximum(np.diag(fit.cov), 0)), "aliased": aliased,
                                                         "n": fit.n, "converged": fit.converged}], [INTERCEPT, *features])
    if "lasso" in learners:
        for model, found in zip(models, learn.lasso_fits(rows, [replace(m) for m in models], 1, inner, penalties, ratio)):
            case, outcome, repeat, fold = (v for _, v in model.key)
            fit = found["fits"][found["lambda_min"]]
            out += _fitted_rows(case, outcome, [{"repeat": repeat, "fold": fold, "learner": "lasso", "beta": fit.beta, "se": None, "aliased": [], "n": fit.n, "converged": fit.converged,
                                                         "lambda_min": found["lambda_min"], "lambda_1se": found["lambda_1se"]}], [INTERCEPT, *features])
    return spark.createDataFrame(out, FITTED_DDL)


def fit_conditions(counts: DataFrame, features: list[str], outcomes: list[str], learners: tuple[str, ...] = ("glm", "lasso"), penalties: int = 20,
                   ratio: float = 0.01, most_cells: int = MOST_CELLS) -> DataFrame:
    """Coefficients of every condition, repeat, outer fold and learner (``FITTED_DDL``), each fitted without its outer fold.

    ``counts``: a frequency table with folds. Lasso fits are at the penalty of least nested held-out deviance (lambda_min); the
    largest penalty within one standard error is given beside it. Aliased terms have null numbers. A task holds the cells (patterns x
    repeats x folds x inner folds) of as many repeats as ``most_cells`` allows; a case of which not even one repeat fits goes by passes.
    """
    spark = counts.sparkSession
    long = by_outcome(counts, outcomes)
    shape = counts.agg(F.max("fold"), F.max("inner")).first()
    if shape[0] is None:
        return spark.createDataFrame([], FITTED_DDL)
    sizes = counts.select("case", "x").distinct().groupBy("case").agg(F.count(F.lit(1)).alias("patterns")).collect()  # one number a case
    at_once = {r["case"]: most_cells // (r["patterns"] * shape[0] * shape[1]) for r in sizes}
    together = spark.createDataFrame([(c, n) for c, n in at_once.items() if n], "case int, _at_once bigint")
    parts = long.join(F.broadcast(together), "case").withColumn("_part", F.floor(F.col("repeat") / F.col("_at_once")))
    fitted = parts.groupBy("case", "outcome", "_part").applyInArrow(_fit_task(features, learners, penalties, ratio), FITTED_DDL)
    large = [c for c, n in at_once.items() if not n]
    if not large:
        return fitted
    repeats = [r["repeat"] for r in counts.select("repeat").distinct().orderBy("repeat").collect()]
    groups = [(c, o, r) for c in large for o in outcomes for r in repeats]
    return fitted.unionByName(_fit_by_passes(long.where(F.col("case").isin(large)), groups, features, shape[0], shape[1], learners, penalties, ratio))


# --- the store of results ------------------------------------------------------------------

def stored(spark, path: str) -> DataFrame | None:
    """What a store holds so far; None if there is none yet."""
    try:
        return spark.read.parquet(path).select(*[f.split(" ")[0] for f in FITTED_DDL.split(", ")])
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fill_store(path: str, counts: DataFrame, features: list[str], outcomes: list[str], learners: tuple[str, ...] = ("glm", "lasso"), penalties: int = 20,
               ratio: float = 0.01, most_cells: int = MOST_CELLS) -> DataFrame:
    """Fit the conditions a store at ``path`` lacks, in one job, and return all of it.

    The store is partitioned by case and outcome. A condition is there if all its repeats have every learner; one that is there in
    part is written anew. So a run that broke off, or was given more cases, goes on where it is.
    """
    spark = counts.sparkSession
    wanted = by_outcome(counts, outcomes).select("case", "outcome", "repeat").distinct().groupBy("case", "outcome").agg(F.count(F.lit(1)).alias("wanted"))
    have = stored(spark, path)
    todo = wanted
    if have is not None:
        full = have.where(F.col("learner").isin(*learners)).select("case", "outcome", "repeat", "learner").distinct()
        full = full.groupBy("case", "outcome").agg(F.count(F.lit(1)).alias("have"))
        todo = wanted.join(full, ["case", "outcome"], "left").where(F.coalesce("have", F.lit(0)) < F.col("wanted") * len(learners))
    open_ = todo.select("case", "outcome").collect()  # conditions, set by the caller
    if open_:
        outcome_of = {}
        for r in open_:
            outcome_of.setdefault(r["outcome"], []).append(r["case"])
        which = [i for i, o in enumerate(outcomes) if o in outcome_of]
        kept = counts.select("case", "repeat", "fold", "inner", "x", "n", F.array(*[F.col("events")[i] for i in which]).alias("events"))
        some = [outcomes[i] for i in which]
        fitted = fit_conditions(kept.where(F.col("case").isin(sorted({r["case"] for r in open_}))), features, some, learners, penalties, ratio, most_cells)
        asked = F.concat_ws("|", "case", "outcome").isin([f"{r['case']}|{r['outcome']}" for r in open_])
        fitted.where(asked).repartition("case", "outcome").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case", "outcome").parquet(path)
    return stored(spark, path)


# --- scores and metrics from coefficients and counts ----------------------------------------

def betas(fitted: DataFrame, features: list[str]) -> DataFrame:
    """One row per model: intercept and an array of coefficients (null ones count as zero)."""
    pick = lambda v: F.coalesce(F.max(F.when(F.col("variable") == v, F.col("estimate"))), F.lit(0.0))
    return fitted.groupBy(*KEYS).agg(pick(INTERCEPT).alias("b0"), F.array(*[pick(v) for v in features]).alias("b"))


def _probability(b0: str = "b0", b: str = "b", x: str = "x"):
    dot = F.aggregate(F.zip_with(b, x, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return 1.0 / (1.0 + F.exp(-(F.col(b0) + dot)))


def held_out_scores(counts: DataFrame, fitted: DataFrame, features: list[str], outcomes: list[str]) -> DataFrame:
    """model keys, p, n1, n0: the patterns of every model's own held-out fold."""
    cells = by_outcome(counts, outcomes).groupBy("case", "outcome", "repeat", "fold", "x").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    met = cells.join(betas(fitted, features), ["case", "outcome", "repeat", "fold"])
    return met.select(*KEYS, _probability().alias("p"), F.col("events").alias("n1"), (F.col("n") - F.col("events")).alias("n0"))


def generalised_scores(other: DataFrame, fitted: DataFrame, features: list[str], outcomes: list[str]) -> DataFrame:
    """model keys, p, n1, n0: every model on the patterns of another site (its frequency table has no folds)."""
    cells = by_outcome(other, outcomes).select("case", "outcome", "x", "n", "events")
    met = cells.join(betas(fitted, features), ["case", "outcome"])
    return met.select(*KEYS, _probability().alias("p"), F.col("events").alias("n1"), (F.col("n") - F.col("events")).alias("n0"))


def model_metrics(scored: DataFrame) -> DataFrame:
    """model keys, auc, brier, accuracy, sensitivity, specificity, balanced_accuracy."""
    return evaluate.metrics_of_counts(scored, KEYS).select(*KEYS, "auc", "brier", "accuracy", "sensitivity", "specificity", "balanced_accuracy")


def run_grid(rows: DataFrame, folds: DataFrame, key: str, cases: dict[int, dict[str, object]], features: list[str], outcomes: list[str],
             learners: tuple[str, ...] = ("glm", "lasso"), penalties: int = 20) -> DataFrame:
    """Cross-validated metrics of every case's settings, outcome and learner, with the penalties of both rules as metrics too."""
    counts = frequency_table(rows, folds, key, features, outcomes)
    fitted = cut_lineage(fit_conditions(counts, features, outcomes, learners, penalties))
    table = metric_report(model_metrics(held_out_scores(counts, fitted, features, outcomes)))
    both = table.unionByName(penalty_report(fitted).withColumnRenamed("rule", "metric")) if "lasso" in learners else table
    names = list(next(iter(cases.values())))
    kinds = ", ".join(f"{n} {grid._kind(v)}" for n, v in next(iter(cases.values())).items())
    settings = rows.sparkSession.createDataFrame([(c, *s.values()) for c, s in cases.items()], f"case int, {kinds}")
    return both.join(F.broadcast(settings), "case").select(*names, *[c for c in both.columns if c != "case"])


def reduced_report(train: DataFrame, folds: DataFrame, other: DataFrame, key: str, chosen: list[str], outcomes: list[str]) -> DataFrame:
    """The plain model of a chosen set of terms: its metrics on the folds it leaves out, and on all rows of another site.

    ``train`` and ``other`` have a row for each key and ``case``. Gives ``metric_report`` with ``site`` (train or other).
    """
    counts = frequency_table(train, folds, key, chosen, outcomes)
    fitted = cut_lineage(fit_conditions(counts, chosen, outcomes, ("glm",)))
    elsewhere = generalised_scores(frequency_table(other, None, key, chosen, outcomes), fitted, chosen, outcomes)
    sites = {"train": held_out_scores(counts, fitted, chosen, outcomes), "other": elsewhere}
    tables = [metric_report(model_metrics(scored)).withColumn("site", F.lit(name)) for name, scored in sites.items()]
    return tables[0].unionByName(tables[1])


# --- report tables ---------------------------------------------------------------------------

def metric_report(metrics: DataFrame) -> DataFrame:
    """condition, learner, metric, n, mean_value, q025, q500, q975, t_low, t_high over all folds."""
    long = metrics.unpivot(KEYS, ["auc", "brier", "sensitivity", "specificity"], "metric", "value")
    return evaluate.interval_summary(long, [*CONDITION, "metric"], "value")


def penalty_report(fitted: DataFrame) -> DataFrame:
    """condition, rule (lambda_min or lambda_1se) and the interval of its penalties over all folds."""
    one = fitted.where(f"variable = '{INTERCEPT}' AND lambda_min IS NOT NULL")
    long = one.unpivot(["case", "outcome", "learner", "repeat", "fold"], ["lambda_min", "lambda_1se"], "rule", "penalty")
    return evaluate.interval_summary(long, [*CONDITION, "rule"], "penalty")


def _with_ratio(fitted: DataFrame) -> DataFrame:
    return fitted.where(f"variable <> '{INTERCEPT}'").withColumn("odds_ratio", F.exp("estimate"))


def selection_report(fitted: DataFrame) -> DataFrame:
    """condition, variable, n, percent: how many of a condition's models choose a variable (by its odds ratio)."""
    table = _with_ratio(fitted).groupBy(*CONDITION, "variable").agg(F.count_if(evaluate.chosen_by_ratio()).alias("n"), F.count(F.lit(1)).alias("_models"))
    return table.select(*CONDITION, "variable", "n", (100.0 * F.col("n") / F.col("_models")).alias("percent"))


def ratio_report(fitted: DataFrame) -> DataFrame:
    """condition, variable and the interval of its odds ratios over all folds."""
    return evaluate.interval_summary(_with_ratio(fitted), [*CONDITION, "variable"], "odds_ratio")


def pair_report(fitted: DataFrame) -> DataFrame:
    """condition, variable, other, n: how many of a condition's models choose both."""
    chosen = F.sort_array(F.collect_set(F.when(evaluate.chosen_by_ratio(), F.col("variable"))))  # no more than the variables
    sets = _with_ratio(fitted).groupBy(*KEYS).agg(chosen.alias("v")).groupBy(*CONDITION, "v").agg(F.count(F.lit(1)).alias("n"))
    left = sets.select(*CONDITION, "n", F.explode("v").alias("variable"), "v")
    return left.select(*CONDITION, "n", "variable", F.explode("v").alias("other")).groupBy(*CONDITION, "variable", "other").agg(F.sum("n").alias("n"))


def set_report(fitted: DataFrame, k: int = 20) -> DataFrame:
    """condition, variables, n, share, place: the ``k`` most frequent sets of chosen variables."""
    from pyspark.sql import Window

    chosen = F.array_join(F.sort_array(F.collect_set(F.when(evaluate.chosen_by_ratio(), F.col("variable")))), ",")
    sets = _with_ratio(fitted).groupBy(*KEYS).agg(chosen.alias("variables")).groupBy(*CONDITION, "variables").agg(F.count(F.lit(1)).alias("n"))
    models = fitted.select(*KEYS).distinct().groupBy(*CONDITION).agg(F.count(F.lit(1)).alias("_models"))
    place = F.row_number().over(Window.partitionBy(*CONDITION).orderBy(F.desc("n"), F.asc("variables")))
    return sets.join(models, CONDITION).withColumn("place", place).where(F.col("place") <= k).select(
        *CONDITION, "variables", "n", (F.col("n") / F.col("_models")).alias("share"), "place")


def calibration_report(scored: DataFrame, width: float = 0.1) -> DataFrame:
    """condition, bin, n, median_observed: share of events in each band of risk, the median over folds."""
    last = round(1 / width) - 1
    bin_ = F.least(F.floor(F.col("p") / F.lit(width)), F.lit(last)).cast("int")
    per_fold = scored.groupBy(*KEYS, bin_.alias("bin")).agg(F.sum("n1").alias("n1"), F.sum(F.col("n1") + F.col("n0")).alias("n"))
    return per_fold.withColumn("observed", F.col("n1") / F.col("n")).groupBy(*CONDITION, "bin").agg(
        F.sum("n").alias("n"), F.percentile("observed", F.lit(0.5)).alias("median_observed"))


def optimality(counts: DataFrame, fitted: DataFrame, features: list[str], outcomes: list[str]) -> DataFrame:
    """model keys, variable, residual: how far each coefficient is from its optimality condition, per row.

    Plain fits: the slope of the likelihood. Penalised ones: what the slope lacks to the penalty (coefficient not zero) or exceeds
    it by (zero), on the standardised column.
    """
    cells = by_outcome(counts, outcomes).groupBy("case", "outcome", "repeat", "fold", "x").agg(F.sum("n").alias("n"), F.sum("events").alias("e"))
    models = betas(fitted, features).withColumnRenamed("fold", "_held")
    seen = cells.join(models, ["case", "outcome", "repeat"]).where("fold <> _held").withColumn("p", _probability())
    by = ["case", "outcome", "repeat", "_held", "learner"]
    slope, first, second = F.col("e") - F.col("n") * F.col("p"), F.col("n"), F.col("n")
    sums = [F.sum(slope).alias("s0"), F.sum("n").alias("_n")]
    for j in range(len(features)):
        v = F.col("x")[j]
        sums += [F.sum(slope * v).alias(f"s{j + 1}"), F.sum(first * v).alias(f"a{j + 1}"), F.sum(second * v * v).alias(f"q{j + 1}")]
    total = seen.groupBy(*by).agg(*sums)
    each = F.array(*[F.struct(F.lit(name).alias("variable"), (F.col(f"s{j}") / F.col("_n")).alias("slope"),
                              (F.sqrt(F.greatest(F.col(f"q{j}") / F.col("_n") - F.pow(F.col(f"a{j}") / F.col("_n"), F.lit(2.0)), F.lit(0.0))) if j else F.lit(0.0)).alias("sd"))
                     for j, name in enumerate([INTERCEPT, *features])])
    long = total.select("case", "outcome", "repeat", F.col("_held").alias("fold"), "learner", F.explode(each).alias("_e")).select(
        *KEYS, "_e.variable", "_e.slope", "_e.sd")
    met = long.join(fitted.select(*KEYS, "variable", "estimate", "lambda_min"), [*KEYS, "variable"])
    limit = F.coalesce("lambda_min", F.lit(0.0)) * F.col("sd")
    gap = F.when(F.col("estimate").isNull(), 0.0).when((F.col("estimate") == 0) & (F.col("variable") != INTERCEPT), F.greatest(F.abs("slope") - limit, F.lit(0.0))).otherwise(
        F.abs(F.col("slope") - limit * F.signum("estimate")))
    return met.select(*KEYS, "variable", gap.alias("residual"))


# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
