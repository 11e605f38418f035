"""Model fits as Spark jobs: outcome classifiers, goal regressions, low-score rho.

Only coefficients and other values of fixed size reach the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import scores
from formline.operators import folded
from formline.session import materialize

# Feature sets of the goal regressions (home side, away side) and their penalties
GOAL_FEATURES = {
    "mixed": (["Elo_Diff", "Home_Avg_GF", "Away_Avg_GA", "Home_Form"],
              ["Elo_Diff", "Away_Avg_GF", "Home_Avg_GA", "Away_Form"]),
    "raw": (["DC_Home_Att", "DC_Away_Def", "Elo_Diff"],
            ["DC_Away_Att", "DC_Home_Def", "Elo_Diff"]),
    "minimal": (["Elo_Diff", "xG_diff", "home_advantage"], ["Elo_Diff", "xG_diff"]),
}
GOAL_PENALTY = {"mixed": 0.01, "raw": 0.01, "minimal": 1.0}


def class_weight(res: Column, draw: float = K.DRAW_WEIGHT) -> Column:
    return F.when(res == 1, draw).otherwise(1.0)


#: Penalty of the softmax regression on standardised features.
OUTCOME_PENALTY = 1e-3


class OutcomeFit:
    """A softmax regression: a row of coefficients per class, intercept first."""

    def __init__(self, features: list[str], beta: np.ndarray):
        self.features, self.beta = list(features), beta

    def with_probabilities(self, rows: DataFrame) -> DataFrame:
        """Native columns ``p_away``, ``p_draw`` and ``p_home``."""
        terms = [F.lit(1.0)] + [F.col(f).cast("double") for f in self.features]
        etas = [scores.total(x * float(b) for x, b in zip(terms, row)) for row in self.beta]
        out = rows.withColumns({f"_eta{k}": eta for k, eta in enumerate(etas)})
        top = F.greatest(*[F.col(f"_eta{k}") for k in range(len(etas))])
        out = out.withColumns({f"_mass{k}": F.exp(F.col(f"_eta{k}") - top) for k in range(len(etas))})
        whole = scores.total(F.col(f"_mass{k}") for k in range(len(etas)))
        names = ("p_away", "p_draw", "p_home")
        return out.select(*rows.columns, *[(F.col(f"_mass{k}") / whole).alias(n) for k, n in enumerate(names)])


def fit_outcome_folds(folds: DataFrame, features: list[str], draw_weight: float = 1.0, early_stopping: bool = False,
                      final: bool = False, max_iter: int = 60) -> tuple[dict[int | None, OutcomeFit], DataFrame, dict]:
    """(fits, narrow rows, parts) of the softmax regressions of all folds, fitted together.

    A fold trains on the rows placed before its first tested row; ``final`` adds a fit of all rows under the key
    None. With ``early_stopping`` the folds hold back the last tenth of their training rows (at least one),
    as ``splits.early_stop_flag`` marks them. Parts are the problems, coefficients and penalty of the fit.
    """
    weight = class_weight(F.col("res"), draw_weight).cast("double").alias("w")
    rows = folded.narrow(folds, features, [F.col("res").cast("int").alias("y"), weight])
    ends: dict[int | None, float] = dict(folded.fold_starts(rows))
    if final:
        ends[None] = math.inf
    columns = list(range(len(features)))
    problems = [folded.Problem(columns, "y", end, end - max(end // 10, 1) if early_stopping and f is not None else math.inf, "w")
                for f, end in ends.items()]
    if not problems:
        return {}, rows, {"problems": [], "betas": []}
    folded.standardize(rows, problems)
    betas = folded.newton(rows, folded.Multinomial(), problems, OUTCOME_PENALTY, max_iter=max_iter)
    fits = {f: OutcomeFit(features, folded.unscaled(p, b)) for f, p, b in zip(ends, problems, betas)}
    return fits, rows, {"problems": problems, "betas": betas}


def score_folds(rows: DataFrame, fits: dict[int | None, OutcomeFit]) -> DataFrame:
    """``pos, fold, y_true`` and probabilities of all tested rows, each under its fold's fit."""
    import pyarrow as pa

    betas = {f: fit.beta for f, fit in fits.items() if f is not None}

    def run(batches):
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(zero_copy_only=False), folded.matrix(batch.column("x"))
            p = np.zeros((len(fold), folded.CLASSES))
            for f in np.unique(fold):
                mine = fold == f
                p[mine] = folded.softmax(np.column_stack([np.ones(mine.sum()), x[mine]]) @ betas[int(f)].T)
            yield pa.RecordBatch.from_pydict({"pos": batch.column("pos"), "fold": batch.column("fold"), "y_true": batch.column("y")}
                                             | {n: p[:, k] for k, n in enumerate(("p_away", "p_draw", "p_home"))})

    tested = rows.where(F.col("fold") >= 1).select("pos", F.col("fold").cast("int").alias("fold"), "y", "x")
    return tested.mapInArrow(run, "pos long, fold int, y_true int, p_away double, p_draw double, p_home double")


def outcome_pipeline(features: list[str], kind: str, trees: int = 40, depth: int | None = None, step: float = 0.05,
                     seed: int = 42) -> Pipeline:
    """Three-class tree estimator over the features; rows carry weight ``w``.

    ``trees`` is the size of a forest or the number of boosting rounds, the caller's choice of quality against time.
    """
    steps = [VectorAssembler(inputCols=features, outputCol="raw_features"),
             StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    if kind == "forest":
        steps.append(RandomForestClassifier(labelCol="res", weightCol="w", numTrees=trees, maxDepth=depth or 6, seed=seed))
    elif kind == "boosted":
        base = GBTClassifier(maxIter=trees, maxDepth=depth or 4, stepSize=step, seed=seed)
        steps.append(OneVsRest(classifier=base, labelCol="res", weightCol="w"))
    else:
        raise ValueError(f"unknown model kind: {kind}")
    return Pipeline(stages=steps)


def fit_outcome(train: DataFrame, features: list[str], draw_weight: float = 1.0, kind: str = "logistic", **settings):
    """A fitted outcome model; ``settings`` are those of ``outcome_pipeline``, or ``max_iter`` of the regression."""
    if kind == "logistic":
        rows = train.withColumns({"pos": F.lit(0).cast("long"), "fold": F.lit(0)})
        return fit_outcome_folds(rows, features, draw_weight, final=True, **settings)[0][None]
    weighted = train.withColumn("w", class_weight(F.col("res"), draw_weight)).withColumn("res", F.col("res").cast("double"))
    return outcome_pipeline(features, kind, **settings).fit(weighted)


def with_probabilities(model, rows: DataFrame) -> DataFrame:
    """Add ``p_away``, ``p_draw`` and ``p_home``. One-versus-rest margins are
    squashed and scaled to sum to one."""
    if isinstance(model, OutcomeFit):
        return model.with_probabilities(rows)
    out = model.transform(rows)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-m * 2.0)))
        p = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("_p", p)
    out = out.withColumns({n: F.col("_p")[i] for i, n in enumerate(("p_away", "p_draw", "p_home"))})
    return out.select(*rows.columns, "p_away", "p_draw", "p_home")


def cross_validate(folds: DataFrame, features: list[str], draw_weight: float = 1.0,
                   kind: str = "logistic", early_stopping: bool = False, **settings) -> DataFrame:
    """Out-of-fold probabilities: each fold is scored by a model fitted on the
    rows before it. Regressions of all folds are one fit; the distributed fits of tree models run side
    by side. ``folds`` should be stored. Without tested rows the result is empty."""
    if kind == "logistic":
        fits, rows, _ = fit_outcome_folds(folds, features, draw_weight, early_stopping, **settings)
        return score_folds(rows, fits)
    starts = folded.fold_starts(folds)
    if not starts:
        none = [F.lit(0.0).alias(n) for n in ("p_away", "p_draw", "p_home")]
        return folds.select("pos", "fold", F.col("res").cast("int").alias("y_true"), *none).limit(0)

    @inheritable_thread_target(folds.sparkSession)
    def scored_fold(item: tuple[int, int]) -> DataFrame:
        fold, start = item
        model = fit_outcome(folds.filter(F.col("pos") < start), features, draw_weight, kind, **settings)
        return with_probabilities(model, folds.filter(F.col("fold") == fold))

    with ThreadPoolExecutor(max_workers=len(starts)) as pool:
        scored = reduce(DataFrame.unionByName, pool.map(scored_fold, starts.items()))
    return scored.select("pos", "fold", F.col("res").cast("int").alias("y_true"), "p_away", "p_draw", "p_home")


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted forest, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


class PoissonFit:
    """Coefficients of log-linear goal models, one set per group 1..k."""

    def __init__(self, features: list[str], betas: list[np.ndarray]):
        self.features, self.betas = features, betas

    @property
    def beta(self) -> np.ndarray:
        return self.betas[0]

    def log_rate(self, group: str | None = None) -> Column:
        terms = [F.lit(1.0)] + [F.col(f).cast("double") for f in self.features]
        return scores.total(x * _by_group([b[i] for b in self.betas], group) for i, x in enumerate(terms))

    def rate(self, group: str | None = None) -> Column:
        return F.exp(self.log_rate(group))


def _by_group(values, group: str | None) -> Column:
    """The value of a row's group (1..k), or the only value."""
    if group is None or len(values) == 1:
        return F.lit(float(values[0]))
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(group))


def fit_poisson(train: DataFrame, specs: list[tuple[list[str], str]], penalty: float, group: str | None = None,
                n_groups: int = 1, max_iter: int = 100, tolerance: float = 1e-9) -> list[PoissonFit]:
    """Penalised Poisson regressions by Newton steps, all at once.

    Each (features, label) is fitted in every group 1..``n_groups``, minimising
    mean(mu - y*eta) + penalty/2*|b|^2 with a free intercept. A step is one
    native aggregate of losses, gradients and curvatures for all models together; its
    size depends on the numbers of features and groups only. A step that did not
    lower a model's loss is halved. Models that do not settle stop the job.
    """
    rows = train.withColumn("_g", F.col(group).cast("int") if group else F.lit(1))
    means = {r["_g"]: r for r in rows.groupBy("_g").agg(
        *[F.avg(label).alias(f"m{k}") for k, (_, label) in enumerate(specs)]).collect()}
    fits = []
    for k, (features, _) in enumerate(specs):
        start = [math.log(max(means[g + 1][f"m{k}"], 1e-9)) for g in range(n_groups)]
        fits.append(PoissonFit(features, [np.array([s] + [0.0] * len(features)) for s in start]))
    walks = {(k, g): _Walk() for k in range(len(specs)) for g in range(1, n_groups + 1)}
    for _ in range(max_iter):
        step, cells = rows, []
        for k, ((features, label), fit) in enumerate(zip(specs, fits)):
            step = step.withColumn(f"_eta{k}", fit.log_rate("_g")).withColumn(f"_mu{k}", F.exp(f"_eta{k}"))
            xs = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
            mu = F.col(f"_mu{k}")
            cells.append(F.avg(mu - F.col(label) * F.col(f"_eta{k}")))
            cells += [F.avg((mu - F.col(label)) * x) for x in xs]
            cells += [F.avg(mu * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i + 1)]
        moved = 0.0
        for row in step.groupBy("_g").agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).collect():
            values, g = list(row)[1:], row["_g"]
            for k, fit in enumerate(fits):
                size = len(fit.features) + 1
                used = 1 + size + size * (size + 1) // 2
                before = fit.betas[g - 1]
                fit.betas[g - 1] = walks[k, g].step(values[:used], before, penalty)
                values = values[used:]
                moved = max(moved, float(np.abs(fit.betas[g - 1] - before).max()))
        if moved < tolerance:
            return fits
    raise RuntimeError(f"goal regressions did not settle in {max_iter} steps")


class _Walk:
    """The way of one model: where the last step began, what it was, and the loss there."""

    def __init__(self):
        self.begin, self.delta, self.loss = None, None, math.inf

    def step(self, cells: list[float], beta: np.ndarray, penalty: float) -> np.ndarray:
        loss = cells[0] + penalty / 2 * float(beta[1:] @ beta[1:])
        if self.begin is not None and not loss <= self.loss + 1e-12 * (1 + abs(self.loss)):
            self.delta = self.delta / 2
            return self.begin - self.delta
        self.begin, self.loss, self.delta = beta, loss, _newton_step(cells[1:], beta, penalty)
        return beta - self.delta


def _newton_step(cells: list[float], beta: np.ndarray, penalty: float) -> np.ndarray:
    size = len(beta)
    ridge = np.diag([0.0] + [penalty] * (size - 1))
    curve = np.zeros((size, size))
    curve[np.tril_indices(size)] = cells[size:]
    curve = curve + np.tril(curve, -1).T + ridge
    return np.linalg.lstsq(curve, np.array(cells[:size]) + ridge @ beta, rcond=None)[0]


def fit_goal_folds(folds: DataFrame, mode: str = "mixed", final: bool = False):
    """(home fit, away fit, narrow rows, parts): the goal regressions of all folds and both sides, fitted together.

    The fits hold one set of coefficients per fold 1, 2, ...; with ``final`` there is one set only, of all rows.
    """
    sides = list(zip(GOAL_FEATURES[mode], ("hg", "ag")))
    features = list(dict.fromkeys(f for names, _ in sides for f in names))
    rows = folded.narrow(folds, features, [F.col("hg").cast("int").alias("hg"), F.col("ag").cast("int").alias("ag")])
    starts = folded.fold_starts(rows)
    ends = [math.inf] if final else [starts.get(f, math.inf) for f in range(1, max(starts, default=0) + 1)]
    problems = [folded.Problem([features.index(n) for n in names], label, end) for names, label in sides for end in ends]
    folded.plain(problems)
    sums = folded.summed(rows, lambda batch: np.array([v for p in problems for v in _mean_parts(batch, p)]), 2 * len(problems)).reshape(-1, 2)
    start = [np.array([math.log(max(total / max(n, 1), 1e-9))] + [0.0] * len(p.columns)) for p, (n, total) in zip(problems, sums)]
    betas = folded.newton(rows, folded.LogRate(), problems, GOAL_PENALTY[mode], start)
    fits = [PoissonFit(names, betas[k * len(ends):(k + 1) * len(ends)]) for k, (names, _) in enumerate(sides)]
    return *fits, rows, {"problems": problems, "betas": betas, "means": sums}


def _mean_parts(batch, problem: folded.Problem) -> tuple[float, float]:
    own = batch.column("pos").to_numpy(zero_copy_only=False) < problem.end
    return own.sum(), batch.column(problem.label).to_numpy(zero_copy_only=False)[own].sum()


def fit_goal_models(train: DataFrame, mode: str = "mixed") -> tuple[PoissonFit, PoissonFit]:
    """The goal regressions of all rows."""
    rows = train.withColumns({"pos": F.lit(0).cast("long"), "fold": F.lit(0)})
    return fit_goal_folds(rows, mode, final=True)[:2]


def minimal_frame(df: DataFrame) -> DataFrame:
    return df.withColumn("home_advantage", F.lit(K.MINIMAL_HOME_ADVANTAGE))


RHO_STEPS = (0.02, 0.002, 0.0002, 0.00002)


def estimate_rho(rows: DataFrame, lam_h: str, lam_a: str, hg: str = "hg", ag: str = "ag", bound: float = 0.3,
                 floor: float = 1e-15, group: str | None = None, n_groups: int = 1) -> list[float]:
    """Low-score rho of highest likelihood on [-bound, bound], per group.

    Only scores up to 1:1 depend on rho, and their factor is linear in it. The
    likelihood is concave, so a grid of sums, one aggregate per pass for all
    groups, is narrowed around its best point.
    """
    low = rows.filter((F.col(hg) <= 1) & (F.col(ag) <= 1))
    lh, la = (F.greatest(F.col(c), F.lit(floor)) for c in (lam_h, lam_a))

    def goal_mass(goals: str, lam: Column) -> Column:
        return F.exp(-lam) * F.when(F.col(goals) == 1, lam).otherwise(1.0)

    slope = scores.dc_tau(F.col(hg), F.col(ag), lh, la, F.lit(1.0)) - 1.0
    low = low.select((F.col(group).cast("int") if group else F.lit(1)).alias("_g"),
                     (goal_mass(hg, lh) * goal_mass(ag, la)).alias("_p"), slope.alias("_s"))
    best = [0.0] * n_groups
    spans = [(-bound, bound)] * n_groups
    for step in RHO_STEPS:
        grids = [[a + i * step for i in range(int(round((b - a) / step)) + 1)] for a, b in spans]
        width = max(len(g) for g in grids)
        padded = [g + [g[-1]] * (width - len(g)) for g in grids]
        sums = low.groupBy("_g").agg(*[
            F.sum(F.log(F.greatest(F.col("_p") * (F.col("_s") * _by_group([g[i] for g in padded], "_g") + 1.0),
                                   F.lit(floor)))).alias(f"g{i}") for i in range(width)]).collect()
        for row in sums:
            g = row["_g"] - 1
            values = list(row)[1:]
            best[g] = padded[g][max(range(width), key=lambda i: values[i])]
            spans[g] = (max(best[g] - step, -bound), min(best[g] + step, bound))
    return best


def rho_folds(rows: DataFrame, parts: dict, bound: float = 0.3, floor: float = 1e-15) -> list[float]:
    """``estimate_rho`` on the training rows of every fold of ``fit_goal_folds``, all folds in one pass per grid."""
    half = len(parts["problems"]) // 2
    pairs = [(parts["problems"][f], parts["problems"][half + f], parts["betas"][f], parts["betas"][half + f]) for f in range(half)]
    best, spans = [0.0] * half, [(-bound, bound)] * half
    for step in RHO_STEPS:
        grids = [np.array([a + i * step for i in range(int(round((b - a) / step)) + 1)]) for a, b in spans]

        def part(batch, grids=grids):
            hg, ag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hg", "ag"))
            low = (hg <= 1) & (ag <= 1)
            pos, x, hg, ag = batch.column("pos").to_numpy(zero_copy_only=False)[low], folded.matrix(batch.column("x"))[low], hg[low], ag[low]
            out = []
            for (home, away, beta_h, beta_a), grid in zip(pairs, grids):
                own = pos < home.end
                lh = np.maximum(np.exp(home.design(x[own]) @ beta_h), floor)
                la = np.maximum(np.exp(away.design(x[own]) @ beta_a), floor)
                h, a = hg[own], ag[own]
                mass = np.exp(-lh) * np.where(h == 1, lh, 1.0) * (np.exp(-la) * np.where(a == 1, la, 1.0))
                slope = np.where(h == 0, np.where(a == 0, -lh * la, lh), np.where(a == 0, la, -1.0))
                out.append(np.array([np.log(np.maximum(mass * (slope * rho + 1.0), floor)).sum() for rho in grid]))
            return np.concatenate(out)

        sums = np.split(folded.summed(rows, part, sum(map(len, grids))), np.cumsum([len(g) for g in grids])[:-1])
        for f, (grid, values) in enumerate(zip(grids, sums)):
            best[f] = float(grid[int(values.argmax())])
            spans[f] = (max(best[f] - step, -bound), min(best[f] + step, bound))
    return best


def goal_model_cv(folds: DataFrame, mode: str = "mixed", rho: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities of the goal models, and the rho of each fold.

    The regressions of all folds are one fit, as are their rhos. The minimal mode has a fixed rho and scales
    the whole diagonal instead.
    """
    home, away, rows, parts = fit_goal_folds(folds, mode)
    n_folds = len(home.betas)
    tested = folds.filter(F.col("fold") >= 1)
    tested = tested.withColumns({"lam_h": home.rate("fold"), "lam_a": away.rate("fold")})
    if mode == "minimal":
        values = [K.DIAGONAL_RHO] * n_folds
        scored = scores.with_diagonal_grid(tested, "lam_h", "lam_a", K.DIAGONAL_RHO)
    else:
        values = [rho] * n_folds if rho is not None else rho_folds(rows, parts)
        scored = scores.with_dc_grid(tested, "lam_h", "lam_a", _by_group(values, "fold"))
    oof = scored.select("pos", "fold", F.col("res").cast("int").alias("y_true"), "p_away", "p_draw", "p_home")
    fitted = [(f + 1, float(v)) for f, v in enumerate(values)]
    return oof, folds.sparkSession.createDataFrame(fitted, "fold int, rho double")


def _fit_report(rows: DataFrame, family, parts: dict, penalty: float) -> list[tuple[int, float]]:
    """(training rows, largest slope of the objective) of every problem of a fit."""
    problems, betas = parts["problems"], parts["betas"]
    slopes = folded.gradients(rows, family, problems, betas, penalty)
    counts = folded.summed(rows, lambda b: np.array([(b.column("pos").to_numpy(zero_copy_only=False) < p.end).sum() for p in problems], float), len(problems))
    return [(int(n), float(np.abs(g).max(initial=0.0))) for n, g in zip(counts, slopes)]


def outcome_report(rows: DataFrame, fits: dict, parts: dict) -> DataFrame:
    """Per fold (null: all rows) and class: training rows, weighted mean probability, largest slope of the objective.

    At the optimum slopes are zero, and mean probabilities are the shares of the classes."""
    problems, betas, k = parts["problems"], parts["betas"], folded.CLASSES

    def part(batch):
        out = []
        for p, beta in zip(problems, betas):
            pos, x, _, w = folded._read(batch, p)
            own = pos < p.end
            eta = p.design(x[own]) @ beta.reshape(k, -1).T
            out += [[w[own].sum()], w[own] @ folded.softmax(eta)]
        return np.concatenate(out)

    sums = folded.summed(rows, part, (k + 1) * len(problems)).reshape(-1, k + 1)
    found = [(f, c, n, float(m[1 + c] / m[0]), worst) for (f, m, (n, worst)) in
             zip(fits, sums, _fit_report(rows, folded.Multinomial(), parts, OUTCOME_PENALTY)) for c in range(k)]
    return rows.sparkSession.createDataFrame(found, "fold int, res int, n_train long, mean_probability double, worst_slope double")


def goal_report(rows: DataFrame, parts: dict, mode: str) -> DataFrame:
    """Per side and fold: training rows, mean goals, mean rate, largest slope of the objective."""
    problems, betas = parts["problems"], parts["betas"]

    def part(batch):
        pos, x = batch.column("pos").to_numpy(zero_copy_only=False), folded.matrix(batch.column("x"))
        return np.array([np.exp(p.design(x[pos < p.end]) @ b).sum() for p, b in zip(problems, betas)])

    rates, half = folded.summed(rows, part, len(problems)), len(problems) // 2
    found = [(p.label, i % half + 1, n, float(total / n), float(rate / n), worst) for i, (p, (_, total), rate, (n, worst)) in
             enumerate(zip(problems, parts["means"], rates, _fit_report(rows, folded.LogRate(), parts, GOAL_PENALTY[mode])))]
    return rows.sparkSession.createDataFrame(found, "goals string, fold int, n_train long, mean_goals double, mean_rate double, worst_slope double")


def feature_means(features: DataFrame, columns=K.FEATURE_COLUMNS) -> DataFrame:
    """One row with the mean of every feature."""
    return features.agg(*[F.avg(c).alias(c) for c in columns])


def calibration(matches: DataFrame, draw_factors: list[float], boosts: list[float],
                lam_h: str = "xG_home", lam_a: str = "xG_away", res: str = "res") -> DataFrame:
    """Mean predicted shares of home, draw and away for every (draw factor, home
    boost) and their distance from the observed shares.

    Each grid point is a pair of sums in one aggregate, so matches are scanned
    once and never multiplied by the grid.
    """
    raw = scores.raw_shares(matches, F.col(lam_h), F.col(lam_a))
    mass = F.col("_win") + F.col("_tie") + F.col("_loss")
    raw = raw.select(F.col(res).alias("res"), (F.col("_tie") / mass).alias("tie"),
                     (F.col("_win") / (F.col("_win") + F.col("_loss"))).alias("ratio"))
    points = [(d, b) for d in draw_factors for b in boosts]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg((F.col("res") == k).cast("double")).alias(f"o{k}") for k in (0, 1, 2)]
    for i, (d, b) in enumerate(points):
        rest = 1.0 - F.col("tie") * d
        home = F.least(F.greatest(F.col("ratio") * rest + b, F.lit(0.0)), F.lit(1.0))
        away = F.least(F.greatest((1.0 - F.col("ratio")) * rest - b / 2, F.lit(0.0)), F.lit(1.0))
        whole = home + away + F.col("tie") * d
        aggs += [F.avg(home / whole).alias(f"h{i}"), F.avg(away / whole).alias(f"a{i}")]
    row = raw.agg(*aggs)
    out = row.select("o0", "o1", "o2", F.inline(F.array(*[
        F.struct(F.lit(float(d)).alias("draw_factor"), F.lit(float(b)).alias("home_boost"),
                 F.col(f"h{i}").alias("home_share"), F.col(f"a{i}").alias("away_share"))
        for i, (d, b) in enumerate(points)])))
    draw = 1.0 - F.col("home_share") - F.col("away_share")
    out = out.withColumn("draw_share", draw)
    gap = (F.abs(F.col("home_share") - F.col("o2")) + F.abs(F.col("draw_share") - F.col("o1"))
           + F.abs(F.col("away_share") - F.col("o0")))
    return out.withColumn("distance", gap).drop("o0", "o1", "o2")
