"""Rating, goal and outcome probability kernels.

Column kernels are plain arithmetic, and the grid jobs add their intermediate
terms as columns, so every row stays inside generated code: no explode, no
array functions on the hot path. Only the market's root search is a vector function
of whole batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sealed(df: DataFrame, names: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Emit computed columns through a one-row generator.

    The optimizer would otherwise write a formula out in full wherever its column
    is used by a filter, or by the next formula if its inputs are constants; over
    several steps that grows without bound. Filters on all other columns still
    pass through to the scan. The array always has its one row, so the generator need not
    be an outer one: columns that are never null stay so, and later formulas carry no null
    checks, which keeps a task's generated method small enough to be compiled (8,000 bytes).
    """
    kept = [c for c in df.columns if c not in names and c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def expected_result(team: Column, opponent: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (opponent - team) / K.ELO_DIVISOR))


def updated_elo(home: Column, away: Column, res: Column) -> tuple[Column, Column]:
    """Both ratings after one match."""
    exp_home = expected_result(home + K.HOME_ADVANTAGE, away)
    score = F.when(res == 2, 1.0).when(res == 1, 0.5).otherwise(0.0)
    gain = (score - exp_home) * K.K_FACTOR
    return clip(home + gain, K.ELO_MIN, K.ELO_MAX), clip(away - gain, K.ELO_MIN, K.ELO_MAX)


def expected_goals(elo_h, elo_a, gf_h, gf_a, ga_h, ga_a) -> tuple[Column, Column]:
    """Expected goals of both sides; missing averages take the league rate."""
    gf_h, gf_a, ga_h, ga_a = (F.coalesce(c, F.lit(K.BASE_GOAL_RATE)) for c in (gf_h, gf_a, ga_h, ga_a))
    factor = 1.0 + (elo_h - elo_a) / K.ELO_FACTOR_DENOM
    home = (gf_h * K.GOAL_WEIGHT_ATTACK + ga_a * K.GOAL_WEIGHT_DEFENSE) * K.HOME_BOOST * factor
    away = (gf_a * K.GOAL_WEIGHT_ATTACK + ga_h * K.GOAL_WEIGHT_DEFENSE) / factor
    return clip(home, K.XG_MIN, K.XG_MAX), clip(away, K.XG_MIN, K.XG_MAX)


def pmf(k: int, lam: Column) -> Column:
    return F.exp(-lam) * F.pow(lam, F.lit(float(k))) * (1.0 / math.factorial(k))


def total(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


def _weight(k: int, lam: Column) -> Column:
    """Goal weight ``lam^k/k!``; the common ``exp(-lam)`` cancels on normalising."""
    return F.pow(lam, F.lit(float(k))) * (1.0 / math.factorial(k)) if k else F.lit(1.0)


def _up_to(k: int, lam: Column) -> Column:
    """Sum of the weights 0..k, as nested products."""
    out = F.lit(1.0)
    for j in range(k, 0, -1):
        out = lam * out * (1.0 / j) + 1.0
    return out


def raw_shares(df: DataFrame, lam_h: Column, lam_a: Column) -> DataFrame:
    """Win/draw/loss mass and goal moments of the independent grid, up to a
    common factor. Missing intensities count as zero here; callers null them."""
    goals = range(1, K.MAX_GOALS + 1)
    df = sealed(df.withColumns({"_lh": F.coalesce(lam_h.cast("double"), F.lit(0.0)),
                                "_la": F.coalesce(lam_a.cast("double"), F.lit(0.0))}), ["_lh", "_la"])
    lh, la = F.col("_lh"), F.col("_la")
    df = df.withColumns({f"_H{k}": _up_to(k, lh) for k in goals} | {f"_A{k}": _up_to(k, la) for k in goals})
    below_h = [F.lit(1.0)] + [F.col(f"_H{k}") for k in goals]
    below_a = [F.lit(1.0)] + [F.col(f"_A{k}") for k in goals]
    df = df.withColumns({
        "_win": total(_weight(k, lh) * below_a[k - 1] for k in goals),
        "_tie": total([F.lit(1.0)] + [_weight(k, lh) * _weight(k, la) for k in goals]),
        "_loss": total(_weight(k, la) * below_h[k - 1] for k in goals),
        "_gh": lh * below_h[-2] * below_a[-1],
        "_ga": la * below_a[-2] * below_h[-1],
    })
    return df.drop(*[f"_{s}{k}" for s in "HA" for k in goals])


_SHARES = ("_lh", "_la", "_win", "_tie", "_loss", "_gh", "_ga")


OUTCOME = ["Poisson_Home_Win", "Poisson_Draw", "Poisson_Away_Win",
           "Expected_Home_Goals", "Expected_Away_Goals", "Expected_Total_Goals"]


def with_outcome(df: DataFrame, lam_h: str = "xG_home", lam_a: str = "xG_away") -> DataFrame:
    """Calibrated home/draw/away probabilities and expected goals per row."""
    df = raw_shares(df, F.col(lam_h), F.col(lam_a))
    df = df.withColumn("_inv", F.coalesce(1.0 / (F.col("_win") + F.col("_tie") + F.col("_loss")), F.lit(0.0)))
    inv = F.col("_inv")
    df = df.withColumns({
        "_pd": F.col("_tie") * inv * K.DRAW_ADJUSTMENT,
        "_sh": F.coalesce(F.try_divide(F.col("_win"), F.col("_win") + F.col("_loss")), F.lit(0.5)),
    })
    rest = 1.0 - F.col("_pd")
    df = df.withColumns({
        "_ph": F.least(F.greatest(F.col("_sh") * rest + K.HOME_ADVANTAGE_BOOST, F.lit(0.0)), F.lit(1.0)),
        "_pa": F.least(F.greatest((1.0 - F.col("_sh")) * rest - K.HOME_ADVANTAGE_BOOST / 2, F.lit(0.0)), F.lit(1.0)),
    }).withColumn("_pt", F.col("_ph") + F.col("_pd") + F.col("_pa"))
    known = F.col(lam_h).isNotNull() & F.col(lam_a).isNotNull()

    def share(p: str) -> Column:
        fair = F.when(F.col("_pt") > 1e-10, F.col(p) / F.col("_pt")).otherwise(1.0 / 3.0)
        return F.when(known, fair)

    df = df.withColumns({
        "Poisson_Home_Win": share("_ph"),
        "Poisson_Draw": share("_pd"),
        "Poisson_Away_Win": share("_pa"),
        "Expected_Home_Goals": F.when(known, F.col("_gh") * inv),
        "Expected_Away_Goals": F.when(known, F.col("_ga") * inv),
        "Expected_Total_Goals": F.when(known, (F.col("_gh") + F.col("_ga")) * inv),
    })
    return sealed(df, OUTCOME, (*_SHARES, "_inv", "_pd", "_sh", "_ph", "_pa", "_pt"))


def with_poisson_features(df: DataFrame) -> DataFrame:
    """The nine goal features from ratings and trailing averages."""
    home, away = expected_goals(*(F.col(c) for c in (
        "Home_Elo", "Away_Elo", "Home_Avg_GF", "Away_Avg_GF", "Home_Avg_GA", "Away_Avg_GA")))
    df = df.withColumns({"xG_home": home, "xG_away": away})
    return with_outcome(df.withColumn("xG_diff", F.col("xG_home") - F.col("xG_away")))


def with_balances(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Elo_Diff": F.col("Home_Elo") - F.col("Away_Elo"),
        "Attack_Balance": F.col("Home_Avg_GF") - F.col("Away_Avg_GF"),
        "Def_Balance": F.col("Away_Avg_GA") - F.col("Home_Avg_GA"),
        "Form_Balance": F.col("Home_Form") - F.col("Away_Form"),
    })


SHIN_STEPS = 8
SHIN_MORE_STEPS = 60
SHIN_SETTLED = 1e-13


def _shin_root(w: Column, pi: Column) -> Column:
    return F.sqrt(w * w + (w + 1.0) * 4.0 * pi)


def shin_insiders(pis: list[np.ndarray]) -> np.ndarray:
    """The root ``w`` of every row by Newton steps, which never leave a root that has been reached: a few for all rows,
    more for those that are still above it."""
    w = np.zeros(len(pis[0]))
    for n, far in ((SHIN_STEPS, np.ones(len(w), bool)), (SHIN_MORE_STEPS, None)):
        if far is None:
            far = sum(((np.sqrt(w * w + (w + 1.0) * 4.0 * p) - w) * 0.5) ** 2 for p in pis) - 1.0 > SHIN_SETTLED
        v, mine = w[far], [p[far] for p in pis]
        for _ in range(n if len(v) else 0):
            roots = [np.sqrt(v * v + (v + 1.0) * 4.0 * p) for p in mine]
            halves = [(r - v) * 0.5 for r in roots]
            excess = sum(h * h for h in halves) - 1.0
            slope = sum(h * (np.divide(v + p * 2.0, r, out=np.zeros(len(v)), where=r > 0) - 1.0) for h, p, r in zip(halves, mine, roots))
            v = v - np.divide(excess, slope, out=np.zeros(len(v)), where=slope != 0)
        w[far] = v
    return w


def _shin_insider(pis: list[Column], root: Column) -> Column:
    """``shin_insiders`` of the rows that have a root, 0 elsewhere."""
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series, c: pd.Series, has: pd.Series) -> pd.Series:
        w, own = np.zeros(len(a)), has.to_numpy(bool)
        w[own] = shin_insiders([x.to_numpy(float)[own] for x in (a, b, c)])
        return pd.Series(w)

    return of(*pis, root)


def with_shin(df: DataFrame, odds=("odds_h", "odds_d", "odds_a"),
              names=("Shin_Prob_H", "Shin_Prob_D", "Shin_Prob_A"), z_name: str = "shin_z",
              missing=(1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Market probabilities net of the insider share ``z``.

    In ``w = z/(1-z)`` each probability is ((sqrt(w^2+4(1+w)pi)-w)/2)^2, so their
    sum is convex and falls with ``w``: Newton steps from zero rise to the root
    and cannot pass it. They run on batches of rows as vector operations (an expression
    of higher order would be interpreted row by row).
    """
    valid = F.lit(True)
    for o in odds:
        valid = valid & F.coalesce((F.col(o) > 0) & ~F.isnan(F.col(o).cast("double")), F.lit(False))
    df = df.withColumn("_ok", valid)
    df = df.withColumns({f"_pi{i}": F.coalesce(F.when(F.col("_ok"), F.try_divide(F.lit(1.0), F.col(o))), F.lit(0.3))
                         for i, o in enumerate(odds)})
    df = sealed(df, ["_ok", "_pi0", "_pi1", "_pi2"])
    pis = [F.col(f"_pi{i}") for i in range(3)]
    book = total(pis)
    # For w -> infinity each probability falls to pi^2, which tells whether a root exists.
    root = F.col("_ok") & (book >= 1.0) & (total(p * p for p in pis) < 1.0)

    df = sealed(df.withColumn("_root", root), ["_root"])
    df = sealed(df.withColumn("_w", F.coalesce(_shin_insider(pis, F.col("_root")), F.lit(0.0))), ["_w"])
    w = F.col("_w")
    out = {}
    for p, name, default in zip(pis, names, missing):
        half = (_shin_root(w, p) - w) * 0.5
        fair = F.when(F.col("_root"), half * half).otherwise(p / book)
        out[name] = F.when(F.col("_ok"), fair).otherwise(F.lit(default))
    out[z_name] = F.when(F.col("_root"), w / (w + 1.0)).otherwise(0.0)
    return sealed(df.withColumns(out), list(out), ("_ok", "_root", "_w", "_pi0", "_pi1", "_pi2"))


def shrunk(x: Column, matchday: Column, mean: float = K.LEAGUE_MEAN_XG, c: float = K.SHRINKAGE_C) -> Column:
    m = F.greatest(matchday.cast("double"), F.lit(0.0))
    return (x * m + mean * c) / (m + c)


def dc_tau(h: Column, a: Column, lam_h: Column, lam_a: Column, rho: Column) -> Column:
    """Low-score correction factor."""
    return (
        F.when((h == 0) & (a == 0), 1.0 - lam_h * lam_a * rho)
        .when((h == 1) & (a == 0), 1.0 + lam_a * rho)
        .when((h == 0) & (a == 1), 1.0 + lam_h * rho)
        .when((h == 1) & (a == 1), 1.0 - rho)
        .otherwise(1.0)
    )


def with_dc_grid(df: DataFrame, lam_h: str, lam_a: str, rho: float | Column, floor: float = 1e-6,
                 names=("p_away", "p_draw", "p_home"), goals: tuple[str, str] | None = None,
                 matrix: str | None = None) -> DataFrame:
    """3-class probabilities of the low-score corrected grid, in closed form.

    Only four cells differ from the independent grid, so their corrections are
    added to its sums. ``goals`` names optional expected-goal outputs and
    ``matrix`` an optional row-major array of all cells. Negative corrected
    cells count as zero when a matrix or goals are asked for.
    """
    rho = rho if isinstance(rho, Column) else F.lit(float(rho))
    low_h, low_a = (F.greatest(F.col(c).cast("double"), F.lit(floor)) for c in (lam_h, lam_a))
    df = raw_shares(df.withColumn("_rho", rho), low_h, low_a)
    lh, la, keep_positive = F.col("_lh"), F.col("_la"), goals is not None or matrix is not None
    # Weights of the four cells are 1, la, lh and lh*la; each gains weight*(tau-1).
    factors = {}
    for i in (0, 1):
        for j in (0, 1):
            tau = dc_tau(F.lit(i), F.lit(j), lh, la, F.col("_rho"))
            factors[f"_c{i}{j}"] = F.greatest(tau, F.lit(0.0)) if keep_positive else tau
    df = df.withColumns(factors)
    fix = {(i, j): F.pow(lh, F.lit(float(i))) * F.pow(la, F.lit(float(j))) * (F.col(f"_c{i}{j}") - 1.0)
           for i in (0, 1) for j in (0, 1)}
    df = df.withColumns({
        "_w": F.col("_win") + fix[1, 0],
        "_d": F.col("_tie") + fix[0, 0] + fix[1, 1],
        "_l": F.col("_loss") + fix[0, 1],
        "_eh": F.col("_gh") + fix[1, 0] + fix[1, 1],
        "_ea": F.col("_ga") + fix[0, 1] + fix[1, 1],
    }).withColumn("_t", F.col("_w") + F.col("_d") + F.col("_l"))

    def share(x: str) -> Column:
        return F.when(F.col("_t") > 1e-12, F.col(x) / F.col("_t")).otherwise(1.0 / 3.0)

    out = dict(zip(names, (share("_l"), share("_d"), share("_w"))))
    if goals is not None:
        out |= dict(zip(goals, (F.col("_eh") / F.col("_t"), F.col("_ea") / F.col("_t"))))
    if matrix is not None:
        size = range(K.MAX_GOALS + 1)
        cells = [
            _weight(i, lh) * _weight(j, la) * (F.col(f"_c{i}{j}") if i < 2 and j < 2 else F.lit(1.0)) / F.col("_t")
            for i in size for j in size
        ]
        out[matrix] = F.array(*cells)
    return sealed(df.withColumns(out), list(out), (*_SHARES, "_rho", *factors, "_w", "_d", "_l", "_t", "_eh", "_ea"))


def with_diagonal_grid(df: DataFrame, lam_h: str, lam_a: str, rho: float = K.DIAGONAL_RHO,
                       names=("p_away", "p_draw", "p_home")) -> DataFrame:
    """3-class probabilities with the whole diagonal scaled by ``1-2*rho``."""
    df = raw_shares(df, F.col(lam_h), F.col(lam_a))
    df = df.withColumns({"_w": F.col("_win") * (1.0 + rho), "_d": F.col("_tie") * (1.0 - 2.0 * rho),
                         "_l": F.col("_loss") * (1.0 + rho)})
    df = df.withColumn("_t", F.col("_w") + F.col("_d") + F.col("_l"))
    df = df.withColumns(dict(zip(names, (F.col(x) / F.col("_t") for x in ("_l", "_d", "_w")))))
    return sealed(df, list(names), (*_SHARES, "_w", "_d", "_l", "_t"))


# Offsets, weights of rating gap, attack and defence, and the travel charge of the goal intensities.
BIV_HOME, BIV_AWAY, BIV_GAP, BIV_ATTACK, BIV_DEFENCE, BIV_FLOOR = 0.15, -0.10, 0.0012, 0.45, 0.35, 0.2
BIV_KM, BIV_PER_KM, BIV_MOST = 1500.0, 0.08, 0.15


def with_bivariate_lambdas(df: DataFrame, elo_h: str, elo_a: str, h_gf: str, h_ga: str, a_gf: str,
                           a_ga: str, km: Column | float = 0.0) -> DataFrame:
    """Log-linear goal intensities from the rating gap and venue form."""
    km = km if isinstance(km, Column) else F.lit(float(km))

    def log_floor(c: str) -> Column:
        return F.log(F.greatest(F.col(c).cast("double"), F.lit(BIV_FLOOR)))

    df = df.withColumns({
        "Biv_Elo_Diff": F.col(elo_h) + K.HOME_ADVANTAGE - F.col(elo_a),
        "Travel_Penalty": clip(km / BIV_KM * BIV_PER_KM, 0.0, BIV_MOST),
    })
    gap = F.col("Biv_Elo_Diff") * BIV_GAP
    return df.withColumns({
        "Lambda_Home": F.exp(gap + BIV_HOME + log_floor(h_gf) * BIV_ATTACK + log_floor(a_ga) * BIV_DEFENCE),
        "Lambda_Away": F.exp(-gap + BIV_AWAY + log_floor(a_gf) * BIV_ATTACK + log_floor(h_ga) * BIV_DEFENCE
                             - F.col("Travel_Penalty")),
    })


def with_bivariate_features(df: DataFrame, elo_h: str, elo_a: str, h_gf: str, h_ga: str, a_gf: str,
                            a_ga: str, km: Column | float = 0.0) -> DataFrame:
    """The eleven values of the bivariate model: ratings and their gap, travel charge, intensities, and the
    probabilities and expected goals of its score grid."""
    df = with_bivariate_lambdas(df, elo_h, elo_a, h_gf, h_ga, a_gf, a_ga, km)
    df = df.withColumns({"Home_Elo": F.col(elo_h), "Away_Elo": F.col(elo_a), "Elo_Diff": F.col("Biv_Elo_Diff")})
    return with_dc_grid(df, "Lambda_Home", "Lambda_Away", K.BIVARIATE_RHO, 0.1, names=("Bivariate_P_Away", "Bivariate_P_Draw", "Bivariate_P_Home"),
                        goals=("Expected_Home_Goals", "Expected_Away_Goals"))


def with_scoreline(df: DataFrame, exp_h: str, exp_a: str, pred: str, p_h: str, p_d: str, p_a: str,
                   names=("Pred_Home_Goals", "Pred_Away_Goals")) -> DataFrame:
    """Whole-number score: goal modes bent towards the predicted class."""
    df = df.withColumns({
        "_mh": F.floor(F.greatest(F.col(exp_h), F.lit(0.0))).cast("int"),
        "_ma": F.floor(F.greatest(F.col(exp_a), F.lit(0.0))).cast("int"),
        "_top": F.greatest(F.col(p_h), F.col(p_d), F.col(p_a)),
    })
    mh, ma, top = F.col("_mh"), F.col("_ma"), F.col("_top")
    sure = top >= 0.35
    home = sure & (F.col(pred) == 2) & (F.col(p_h) == top)
    away = sure & (F.col(pred) == 0) & (F.col(p_a) == top)
    draw = sure & (F.col(pred) == 1) & (F.col(p_d) == top)
    new_h = (F.when(home & (mh <= ma), ma + 1).when(home & (F.col(p_h) >= 0.5), mh + 1)
             .when(draw, F.greatest(mh, ma)).otherwise(mh))
    new_a = (F.when(away & (ma <= mh), mh + 1).when(away & (F.col(p_a) >= 0.5), ma + 1)
             .when(draw, F.greatest(mh, ma)).otherwise(ma))
    limit = K.MAX_PREDICTED_GOALS
    df = df.withColumns({
        names[0]: F.least(F.greatest(new_h, F.lit(0)), F.lit(limit)).cast("int"),
        names[1]: F.least(F.greatest(new_a, F.lit(0)), F.lit(limit)).cast("int"),
    })
    return df.drop("_mh", "_ma", "_top")


def score_label(home: Column, away: Column) -> Column:
    return F.when(home > away, "Home Win").when(home < away, "Away Win").otherwise("Draw")


def top_pick(p_h: Column, p_d: Column, p_a: Column) -> Column:
    """``Outcome (Confidence)``; home wins ties, then away."""
    home, away = (p_h >= p_d) & (p_h >= p_a), (p_a >= p_h) & (p_a >= p_d)
    side = F.when(home, "Home").when(away, "Away").otherwise("Draw")
    prob = F.greatest(p_h, p_d, p_a)
    level = (F.when(prob >= K.CONFIDENCE_STRONG, "Strong")
             .when(prob >= K.CONFIDENCE_MODERATE, "Moderate").otherwise("Marginal"))
    return F.concat(side, F.lit(" ("), level, F.lit(")"))


def percent(p: Column) -> Column:
    """One-decimal percentage; halves go to the even digit."""
    return F.format_string("%.1f%%", F.bround(p * 100.0, 1))


def triple_text(p_a: Column, p_d: Column, p_h: Column) -> Column:
    return F.concat(F.lit("P(Away): "), percent(p_a), F.lit(" | P(Draw): "), percent(p_d),
                    F.lit(" | P(Home): "), percent(p_h))


def market_shown(s_h: Column, s_d: Column, s_a: Column) -> Column:
    """False for missing market triples and for the neutral one-third fill-in."""
    third = 1.0 / 3.0
    neutral = (F.abs(s_h - third) < 1e-4) & (F.abs(s_a - third) < 1e-4)
    return s_h.isNotNull() & s_d.isNotNull() & s_a.isNotNull() & ~F.coalesce(neutral, F.lit(True))


def market_text(s_h: Column, s_d: Column, s_a: Column) -> Column:
    return F.when(market_shown(s_h, s_d, s_a), triple_text(s_a, s_d, s_h)).otherwise("[Not available]")


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1.0


def blended(model: Column, poisson: Column, alpha: float = K.BLEND_RATIO) -> Column:
    return model * alpha + poisson * (1.0 - alpha)


def encode_result(code: Column) -> Column:
    return F.when(code == "H", 2).when(code == "D", 1).when(code == "A", 0)


def decode_result(res: Column) -> Column:
    return F.when(res == 2, "Home Win").when(res == 1, "Draw").when(res == 0, "Away Win")
