"""Many logistic models in one pass each.

Cross-validation, marker screens, bootstraps and penalty paths need hundreds of small models on
the same large rows. Each Newton step of all of them is one Spark job: every task adds up
gradients and curvature of its rows for every open model, Spark sums these over the tasks, and
only models x terms^2 numbers come back. No fold, group or model is ever gathered in one task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage


@dataclass(frozen=True)
class Model:
    """One model of a grid. ``key`` are its reported names; ``terms`` index the features.

    ``held`` and ``inner`` are (fold column, fold) pairs that are left out of the fit;
    ``family`` is binomial or gaussian (least squares).
    ``skip`` names features that exclude a row when they are 1 (a missing-marker column);
    ``replicate`` draws Poisson weights from the row id. ``l1`` applies to standardised features,
    ``l2`` to raw ones, both per row and never to the intercept.
    """

    key: tuple[tuple[str, object], ...]
    terms: tuple[int, ...]
    outcome: int = 0
    case: int = 0
    held: tuple[int, int] | None = None
    inner: tuple[int, int] | None = None
    skip: tuple[int, ...] = ()
    replicate: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    family: str = "binomial"


@dataclass
class Fit:
    model: Model
    beta: np.ndarray
    cov: np.ndarray
    n: float
    events: float
    loss: float
    converged: bool
    aliased: tuple[int, ...] = ()
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))


def design(df: DataFrame, key: str, outcomes: list[str], features: list[str], folds: Column | None = None,
           case: Column | None = None, weight: Column | None = None, settle: bool = True) -> DataFrame:
    """Rows in the grid's layout; rows with a null feature or outcome are left out.

    A grid reads its rows once per step, so they are written to the checkpoint folder first.
    """
    number = lambda c: F.col(c).cast("double")
    rows = df.dropna(subset=[*outcomes, *features]).select(
        F.col(key).cast("bigint").alias("id"), F.array(*[number(c) for c in outcomes]).alias("y"),
        F.array(*[number(c) for c in features]).alias("x"),
        (folds if folds is not None else F.array().cast("array<int>")).alias("folds"),
        (case if case is not None else F.lit(0)).cast("int").alias("case"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"))
    return cut_lineage(rows) if settle else rows


def poisson_weights(ids: np.ndarray, replicate: int) -> np.ndarray:
    """Poisson(1) counts from a hash of row id and replicate: the same in every retry."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(replicate + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    u = (z >> np.uint64(11)).astype(float) / float(1 << 53)
    steps = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u, side="right").astype(float)


class Block:
    """One Arrow batch as matrices."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows

        def matrix(name: str) -> np.ndarray:
            col = batch.column(name)
            return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.y, self.folds = matrix("y"), matrix("folds")
        self.x = np.hstack([np.ones((n, 1)), matrix("x")])
        self.case = batch.column("case").to_numpy(zero_copy_only=False)
        self.weight = batch.column("weight").to_numpy(zero_copy_only=False)

    def rows(self, m: Model, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and weights a model uses: to fit, to test on what it holds out, or all."""
        keep = self.case == m.case
        for s in m.skip:
            keep &= self.x[:, s + 1] != 1.0
        if part == "fit":
            for out in (m.held, m.inner):
                if out is not None:
                    keep &= self.folds[:, out[0]] != out[1]
        elif part == "held":
            at = m.inner or m.held
            keep &= self.folds[:, at[0]] == at[1]
            if m.inner is not None and m.held is not None:
                keep &= self.folds[:, m.held[0]] != m.held[1]
        idx = np.flatnonzero(keep)
        w = self.weight[idx]
        if m.replicate is not None and part == "fit":
            w = w * poisson_weights(self.ids[idx], m.replicate)
        return idx, w


def _sums(block: Block, m: Model, beta: np.ndarray, part: str) -> np.ndarray:
    """[loss, weight, events, gradient, curvature] of one model on one batch."""
    idx, w = block.rows(m, part)
    z = block.x[np.ix_(idx, [0, *[t + 1 for t in m.terms]])]
    y = block.y[idx, m.outcome]
    eta = z @ beta
    if m.family == "gaussian":
        res = y - eta
        head = [0.5 * float(np.sum(w * res**2)), float(w.sum()), float((w * y).sum())]
        if part != "fit":
            return np.array(head)
        return np.concatenate([head, z.T @ (w * res), (z.T @ (z * w[:, None])).ravel()])
    loss = float(np.sum(w * (np.logaddexp(0.0, eta) - y * eta)))
    head = [loss, float(w.sum()), float((w * y).sum())]
    if part != "fit":
        return np.array(head)
    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
    grad = z.T @ (w * (y - p))
    curve = z.T @ (z * (w * p * (1 - p))[:, None])
    return np.concatenate([head, grad, curve.ravel()])


def _pass(rows: DataFrame, models: list[Model], betas: list[np.ndarray], part: str) -> list[np.ndarray]:
    """Sums of all models over all rows: one job."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = Block(batch)
            parts = [_sums(block, m, b, part) for m, b in zip(models, betas)]
            total = parts if total is None else [t + p for t, p in zip(total, parts)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))],
                                             names=["model", "sums"])

    sums = rows.mapInArrow(add_up, "model int, sums array<double>")
    cells = sums.select("model", F.posexplode("sums").alias("pos", "value")).groupBy("model", "pos").agg(F.sum("value").alias("value"))
    sizes = [3 if part != "fit" else 3 + len(b) + len(b) ** 2 for b in betas]
    out = [np.zeros(s) for s in sizes]
    for r in cells.collect():  # models x terms^2 numbers, set by the caller's grid
        out[r["model"]][r["pos"]] = r["value"]
    return out


def _unpack(s: np.ndarray, t: int):
    return s[0], s[1], s[2], s[3:3 + t], s[3 + t:].reshape(t, t)


def _aliased(gram: np.ndarray) -> list[int]:
    """Columns that are linear combinations of earlier ones (the intercept is first)."""
    kept: list[int] = []
    out = []
    for j in range(gram.shape[0]):
        left = gram[j, j]
        if kept:
            sub = gram[np.ix_(kept, kept)]
            left = gram[j, j] - gram[j, kept] @ np.linalg.solve(sub, gram[kept, j])
        if left <= 1e-9 * max(gram[j, j], 1e-300) or gram[j, j] <= 0:
            out.append(j)
        else:
            kept.append(j)
    return out


def _step(beta, grad, curve, n, l1, l2, scale, free):
    """Newton step, or for an L1 penalty coordinate descent on the local quadratic."""
    new = beta.copy()
    pen = np.zeros(len(beta))
    pen[1:] = n * l2
    if l1 == 0.0:
        a = (curve + np.diag(pen))[np.ix_(free, free)] + 1e-10 * np.eye(len(free)) * max(1.0, np.trace(curve) / len(beta))
        new[free] += np.linalg.solve(a, (grad - pen * beta)[free])
        return new
    thr = n * l1 * scale
    thr[0] = 0.0
    for _ in range(1000):
        old = new.copy()
        for j in free:
            slope = grad[j] - curve[j] @ (new - beta) + curve[j, j] * new[j]
            denom = curve[j, j] + pen[j]
            new[j] = np.sign(slope) * max(abs(slope) - thr[j], 0.0) / denom if denom > 0 else 0.0
        if np.max(np.abs(new - old) * np.maximum(scale, 1e-12)) < 1e-10:
            break
    return new


def fit_models(rows: DataFrame, models: list[Model], max_iter: int = 30, tol: float = 1e-9) -> list[Fit]:
    """Fit every model of the grid; the number of jobs is the largest number of steps any needs."""
    if not models:
        return []
    beta = [np.zeros(len(m.terms) + 1) for m in models]
    first = _pass(rows, models, beta, "fit")
    fits, free = [], []
    for m, b, s in zip(models, beta, first):
        loss, n, events, _, curve = _unpack(s, len(b))
        gram = curve * (4.0 if m.family == "binomial" else 1.0)  # at zero every row has curvature 1/4
        drop = _aliased(gram) if n > 0 else list(range(len(b)))
        mean = gram[0] / max(n, 1e-300)
        scale = np.sqrt(np.maximum(np.diag(gram) / max(n, 1e-300) - mean**2, 0.0))
        free.append([j for j in range(len(b)) if j not in drop])
        fits.append(Fit(m, b, np.zeros((len(b), len(b))), n, events, loss, False,
                        tuple(m.terms[j - 1] for j in drop if j > 0), scale))
    state = {i: (beta[i], first[i]) for i in range(len(models)) if free[i]}
    best = {i: math.inf for i in state}
    tried = {i: beta[i] for i in state}
    for _ in range(max_iter):
        trial = {}
        for i, (b, s) in state.items():
            m, f = models[i], fits[i]
            loss, n, _, grad, curve = _unpack(s, len(b))
            value = loss + n * (m.l1 * float(np.sum(f.scale[1:] * np.abs(b[1:]))) + m.l2 / 2 * float(np.sum(b[1:] ** 2)))
            if value > best[i] + 1e-7 * abs(best[i]) and math.isfinite(best[i]):
                trial[i] = (b + tried[i]) / 2  # overshot: half way back to the last good point
                continue
            done = best[i] - value <= tol * (abs(value) + tol) if math.isfinite(best[i]) else False
            best[i], tried[i] = min(value, best[i]), b
            f.beta, f.loss = b, loss
            ridge = np.diag([0.0] + [n * m.l2] * (len(b) - 1))
            sub = np.ix_(free[i], free[i])
            f.cov = np.zeros_like(curve)
            f.cov[sub] = np.linalg.pinv((curve + ridge)[sub])
            if done:
                f.converged = True
            else:
                trial[i] = _step(b, grad, curve, n, m.l1, m.l2, f.scale.copy(), free[i])
        if not trial:
            break
        open_ = sorted(trial)
        sums = _pass(rows, [models[i] for i in open_], [trial[i] for i in open_], "fit")
        state = {i: (trial[i], s) for i, s in zip(open_, sums)}
    return fits


def held_out_deviance(rows: DataFrame, fits: list[Fit]) -> list[tuple[float, float]]:
    """Mean deviance and weight of each model on the rows it holds out."""
    sums = _pass(rows, [f.model for f in fits], [f.beta for f in fits], "held")
    return [(2 * s[0] / s[1] if s[1] > 0 else math.nan, s[1]) for s in sums]


def null_penalty(fit_at_zero: np.ndarray, terms: int) -> float:
    """Smallest L1 penalty at which every coefficient is zero, from the sums at zero."""
    _, n, events, grad, curve = _unpack(fit_at_zero, terms + 1)
    gram = 4.0 * curve
    total = gram[0]
    cross = grad + 0.5 * total
    mean = total / n
    sd = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0.0))
    score = np.abs(cross - events / n * total)[1:]
    return float(np.max(np.where(sd[1:] > 1e-12, score / np.maximum(n * sd[1:], 1e-300), 0.0)))


def sums_at_zero(rows: DataFrame, models: list[Model]) -> list[np.ndarray]:
    return _pass(rows, models, [np.zeros(len(m.terms) + 1) for m in models], "fit")


def scores(rows: DataFrame, fits: list[Fit], part: str = "held") -> DataFrame:
    """(model key..., id, y, p): predictions on held-out rows, or on all rows (``part="all"``)."""
    models, betas = [f.model for f in fits], [f.beta for f in fits]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = Block(batch)
            for i, (m, b) in enumerate(zip(models, betas)):
                idx, _ = block.rows(m, part)
                if len(idx) == 0:
                    continue
                z = block.x[np.ix_(idx, [0, *[t + 1 for t in m.terms]])]
                p = 1.0 / (1.0 + np.exp(-np.clip(z @ b, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), i, dtype=np.int32)), pa.array(block.ids[idx].astype(np.int64)),
                     pa.array(block.y[idx, m.outcome].astype(np.int32)), pa.array(p)], names=["model", "id", "y", "p"])

    scored = rows.mapInArrow(predict, "model int, id bigint, y int, p double")
    keys = key_table(rows, models)
    names = [c for c in keys.columns if c != "model"]
    return scored.join(F.broadcast(keys), "model").select(*names, "id", "y", "p")


def _kind(value) -> str:
    return "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def key_table(rows: DataFrame, models: list[Model]) -> DataFrame:
    """One row per model of the grid."""
    kinds = ", ".join(f"{n} {_kind(v)}" for n, v in models[0].key)
    data = [(i, *[v for _, v in m.key]) for i, m in enumerate(models)]
    return rows.sparkSession.createDataFrame(data, f"model int, {kinds}")


def coefficients(rows: DataFrame, fits: list[Fit], features: list[str], z: float = 1.959963984540054) -> DataFrame:
    """(model key..., variable, estimate, std_error, p_value, odds_ratio, lower, upper); Wald intervals.

    Aliased terms have null numbers, as they have no estimate of their own.
    """
    data = []
    for f in fits:
        names = ["(Intercept)", *[features[t] for t in f.model.terms]]
        for j, name in enumerate(names):
            key = [v for _, v in f.model.key]
            if j > 0 and f.model.terms[j - 1] in f.aliased:
                data.append((*key, name, *[None] * 6))
                continue
            b, se = float(f.beta[j]), float(math.sqrt(max(f.cov[j, j], 0.0)))
            p = math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else None
            ratio = lambda v: math.exp(min(max(v, -700.0), 700.0))
            data.append((*key, name, b, se, p, ratio(b), ratio(b - z * se), ratio(b + z * se)))
    kinds = ", ".join(f"{n} {_kind(v)}" for n, v in fits[0].model.key)
    return rows.sparkSession.createDataFrame(
        data, f"{kinds}, variable string, estimate double, std_error double, p_value double, odds_ratio double, lower double, upper double")


# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
