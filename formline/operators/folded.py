"""Fits of all folds at once, over one narrow stored table.

A fold's training rows are those before its first tested row, so one row counts for every later
fold. Nothing is copied for that: a task goes once over its rows and adds each of them to the sums
of every fold that it precedes. One small aggregate per Newton step adds the tasks' losses, gradients and
curvatures, for all folds and regressions together; its size depends on the numbers of features and folds only.

A fit may hold back the last tenth of its training rows: it then stops at the step after which
their loss no longer falls, and keeps the coefficients of the best one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.session import materialize

CLASSES = 3
#: Steps without a lower loss on the rows held back.
PATIENCE = 2


def narrow(folds: DataFrame, features: list[str], labels: list[str | Column], keep: tuple[str, ...] = ("pos", "fold")) -> DataFrame:
    """``pos, fold``, the labels, and all features in one array ``x``; stored once."""
    return materialize(folds.select(*keep, *labels, F.array(*[F.col(f).cast("double") for f in features]).alias("x")))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fold_starts(rows: DataFrame) -> dict[int, int]:
    """First tested position of every fold: at most as many rows as folds."""
    found = rows.where(F.col("fold") >= 1).groupBy("fold").agg(F.min("pos").alias("start")).collect()
    return {r["fold"]: r["start"] for r in sorted(found, key=lambda r: r["fold"])}


def summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum of the ``width`` numbers that ``part`` makes of every batch."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width), "value": total})

    sums = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return out


@dataclass
class Problem:
    """One fit: the rows before ``end``, of which those from ``held`` on are held back, on some columns of ``x``."""
    columns: list[int]
    label: str
    end: float = math.inf
    held: float = math.inf
    weight: str | None = None
    center: np.ndarray = field(default=None, repr=False)
    scale: np.ndarray = field(default=None, repr=False)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.columns] - self.center) * self.scale
        return np.column_stack([np.ones(len(z)), z])


def softmax(eta: np.ndarray) -> np.ndarray:
    p = np.exp(eta - eta.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class Multinomial:
    """Softmax regression of classes 0, 1, 2; coefficients by class, intercept first."""

    def size(self, problem: Problem) -> int:
        return CLASSES * (len(problem.columns) + 1)

    def loss(self, z, y, w, beta):
        eta = z @ beta.reshape(CLASSES, -1).T
        top = eta.max(axis=1)
        return float((w * (top + np.log(np.exp(eta - top[:, None]).sum(axis=1)) - eta[np.arange(len(y)), y.astype(int)])).sum())

    def slopes(self, z, y, w, beta):
        return self.step(z, y, w, beta)[1:]

    def step(self, z, y, w, beta):
        """Loss, gradient and curvature. Shares add up to one, so the blocks of two different classes give those of one."""
        eta = z @ beta.reshape(CLASSES, -1).T
        top = eta.max(axis=1)
        mass = np.exp(eta - top[:, None])
        whole = mass.sum(axis=1)
        loss = float((w * (top + np.log(whole) - eta[np.arange(len(y)), y.astype(int)])).sum())
        p = mass / whole[:, None]
        off = p - (y[:, None] == np.arange(CLASSES))
        wide = z.shape[1]
        curve = np.zeros((CLASSES, wide, CLASSES, wide))
        for a in range(CLASSES):
            for b in range(a):
                block = (z * (w * p[:, a] * p[:, b])[:, None]).T @ z
                curve[a, :, b] -= block
                curve[b, :, a] -= block
                curve[a, :, a] += block
                curve[b, :, b] += block
        return loss, ((off * w[:, None]).T @ z).ravel(), curve.reshape(CLASSES * wide, -1)

    def free(self, size: int) -> np.ndarray:
        """Coefficients without penalty."""
        return np.arange(size) % (size // CLASSES) == 0


class LogRate:
    """Poisson regression with the logarithm as link; intercept first."""

    def size(self, problem: Problem) -> int:
        return len(problem.columns) + 1

    def loss(self, z, y, w, beta):
        eta = z @ beta
        with np.errstate(over="ignore"):
            return float((w * (np.exp(eta) - y * eta)).sum())

    def slopes(self, z, y, w, beta):
        return self.step(z, y, w, beta)[1:]

    def step(self, z, y, w, beta):
        eta = z @ beta
        with np.errstate(over="ignore"):
            mu = np.exp(eta)
        return float((w * (mu - y * eta)).sum()), (w * (mu - y)) @ z, (z * (w * mu)[:, None]).T @ z

    def free(self, size: int) -> np.ndarray:
        return np.arange(size) == 0


def taken(own: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The own rows of the arrays; rows come in order of their positions, so mostly all or none are, and nothing is copied."""
    if own.all():
        return arrays
    return tuple(a[own] if own.any() else a[:0] for a in arrays)


def _read(batch, problem: Problem):
    y = batch.column(problem.label).to_numpy(zero_copy_only=False).astype(float)
    w = batch.column(problem.weight).to_numpy(zero_copy_only=False).astype(float) if problem.weight else np.ones(len(y))
    return batch.column("pos").to_numpy(zero_copy_only=False), matrix(batch.column("x")), y, w


def standardize(rows: DataFrame, problems: list[Problem]) -> None:
    """Centers and scales every problem by its own training rows (rows held back excluded)."""
    first = rows.select("x").first()
    about = np.array(first["x"], float)
    widths = [1 + 2 * len(p.columns) for p in problems]

    def part(batch):
        pos, x, out = batch.column("pos").to_numpy(zero_copy_only=False), matrix(batch.column("x")) - about, []
        for p in problems:
            mine = x[(pos < p.end) & (pos < p.held)][:, p.columns]
            out += [[len(mine)], mine.sum(axis=0), (mine * mine).sum(axis=0)]
        return np.concatenate(out)

    sums, at = summed(rows, part, sum(widths)), 0
    for p, width in zip(problems, widths):
        k, n = len(p.columns), sums[at]
        mean = sums[at + 1:at + 1 + k] / n
        spread = np.sqrt(np.maximum(sums[at + 1 + k:at + width] / n - mean * mean, 0) * n / max(n - 1, 1))
        p.center, p.scale = about[p.columns] + mean, np.where(spread > 1e-12, 1 / np.where(spread > 0, spread, 1), 0.0)
        at += width


def plain(problems: list[Problem]) -> None:
    """Leaves the features as they are."""
    for p in problems:
        p.center, p.scale = np.zeros(len(p.columns)), np.ones(len(p.columns))


class _Walk:
    """The way of one fit: where the last step began, what it was, the loss there; the best loss of held rows."""

    def __init__(self, beta: np.ndarray):
        self.beta, self.begin, self.delta, self.loss = beta, None, None, math.inf
        self.best, self.best_held, self.since, self.done = beta, math.inf, 0, False

    def take(self, n, loss, gradient, curve, held, penalty: np.ndarray, tolerance: float) -> None:
        value = loss / n + float(penalty @ (self.beta * self.beta)) / 2
        if self.begin is not None and not value <= self.loss + 1e-12 * (1 + abs(self.loss)):
            self.delta = self.delta / 2
        else:
            if held is not None:
                better = held < self.best_held
                self.since = 0 if better else self.since + 1
                if better:
                    self.best, self.best_held = self.beta, held
                if self.since >= PATIENCE:
                    self.done = True
                    return
            self.begin, self.loss = self.beta, value
            self.delta = np.linalg.lstsq(curve / n + np.diag(penalty), gradient / n + penalty * self.beta, rcond=None)[0]
        self.done = float(np.abs(self.delta).max(initial=0.0)) < tolerance
        self.beta = self.begin - self.delta


def newton(rows: DataFrame, family, problems: list[Problem], penalty: float, start: list[np.ndarray] | None = None,
           max_iter: int = 100, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Coefficients (of the scaled features) of all problems, minimising weighted mean loss plus penalty/2 |b|^2.

    A step that did not lower a problem's loss is halved. Problems that do not settle stop the job.
    """
    sizes = [family.size(p) for p in problems]
    walks = [_Walk(np.zeros(s) if start is None else start[i].copy()) for i, s in enumerate(sizes)]
    ridges = [np.where(family.free(s), 0.0, penalty) for s in sizes]
    for _ in range(max_iter):
        todo = [i for i, w in enumerate(walks) if not w.done]
        if not todo:
            break
        betas = [w.beta for w in walks]
        widths = [4 + sizes[i] + sizes[i] ** 2 for i in todo]

        def part(batch, todo=todo, betas=betas):
            out = []
            for i in todo:
                p = problems[i]
                pos, x, y, w = _read(batch, p)
                own, held = (pos < p.end) & (pos < p.held), (pos < p.end) & (pos >= p.held)
                x_own, y_own, w_own = taken(own, x, y, w)
                loss, gradient, curve = family.step(p.design(x_own), y_own, w_own, betas[i])
                aside = family.loss(p.design(x[held]), y[held], w[held], betas[i]) if held.any() else 0.0
                out += [[w_own.sum(), loss, w[held].sum(), aside], gradient, curve.ravel()]
            return np.concatenate(out)

        sums, at = summed(rows, part, sum(widths)), 0
        for i, width in zip(todo, widths):
            n, loss, n_held, held = sums[at:at + 4]
            gradient, curve = sums[at + 4:at + 4 + sizes[i]], sums[at + 4 + sizes[i]:at + width].reshape(sizes[i], -1)
            walks[i].take(n, loss, gradient, curve, held / n_held if n_held else None, ridges[i], tolerance)
            at += width
    else:
        raise RuntimeError(f"regressions did not settle in {max_iter} steps")
    return [w.best if p.held < p.end else w.beta for w, p in zip(walks, problems)]


def gradients(rows: DataFrame, family, problems: list[Problem], betas: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Slope of the penalised mean loss of every problem at its coefficients, from one more pass."""
    sizes = [family.size(p) for p in problems]

    def part(batch):
        out = []
        for p, beta in zip(problems, betas):
            pos, x, y, w = _read(batch, p)
            own = (pos < p.end) & (pos < p.held)
            out += [[w[own].sum()], family.slopes(p.design(x[own]), y[own], w[own], beta)[0]]
        return np.concatenate(out)

    sums, at, found = summed(rows, part, sum(sizes) + len(sizes)), 0, []
    for size, beta in zip(sizes, betas):
        found.append(sums[at + 1:at + 1 + size] / sums[at] + np.where(family.free(size), 0.0, penalty) * beta)
        at += size + 1
    return found


def unscaled(problem: Problem, beta: np.ndarray) -> np.ndarray:
    """Coefficients on the features as given; a row per class if there are several."""
    b = beta.reshape(-1, len(problem.columns) + 1)
    slopes = b[:, 1:] * problem.scale
    out = np.column_stack([b[:, 0] - slopes @ problem.center, slopes])
    return out if len(out) > 1 else out[0]
