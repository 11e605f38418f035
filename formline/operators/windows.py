"""Point-in-time team form: what was known about a team before a batch.

Every match of a batch sees the team as it was before the batch, so the state
lives at the grain (league, team, batch). Only the last ``W`` results of a batch
can reach a later window, so each batch is cut to those first. What remains per
team is bounded by the calendar (batches are minutes), whatever the row count,
and a team or a date holding a third of all matches does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions.scores import total
from formline.session import materialize

TEAM = ["league", "team"]
STATE_KEY = ["league", "team", "batch_ts"]


def team_rows(batched: DataFrame, row_id: str = "match_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per team and match, with the match columns ``keep``; missing goals count as zero."""
    hg, ag = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("hg", "ag"))
    ident = F.concat_ws("\x1f", "home", "away")
    sides = F.array(
        F.struct(F.col("home").alias("team"), F.lit(True).alias("is_home"), hg.alias("gf"), ag.alias("ga")),
        F.struct(F.col("away").alias("team"), F.lit(False).alias("is_home"), ag.alias("gf"), hg.alias("ga")),
    )
    return batched.select(
        "league", "batch_ts", ident.alias("ident"), F.col(row_id).alias("row_id"), *keep, F.inline(sides)
    )


def points(gf: str = "gf", ga: str = "ga") -> Column:
    return F.when(F.col(gf) > F.col(ga), 3).when(F.col(gf) == F.col(ga), 1).otherwise(0)


def batch_tail(rows: DataFrame, window: int) -> DataFrame:
    """Keep the last ``window`` results per team, side and batch (exact for all
    frames up to ``window``). The rank filter is applied before the shuffle. The hash comes first in the
    sort: one number tells most rows of different groups apart, without comparing their names."""
    group = ["league", "team", "is_home", "batch_ts"]
    w = Window.partitionBy("_g", *group).orderBy(F.desc("ident"), F.desc("row_id"))
    rows = rows.withColumn("_g", F.xxhash64(*group))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window).drop("_r", "_g")


def _team_order():
    return Window.partitionBy(*TEAM).orderBy("batch_ts", "ident", "row_id", F.desc("is_home"))


def _batch_order():
    return Window.partitionBy(*STATE_KEY).orderBy("ident", "row_id", F.desc("is_home"))


def _averages(window, n: int, prefix: str = "") -> dict[str, Column]:
    frame = window.rowsBetween(-n, -1)
    return {
        f"{prefix}avg_gf": F.avg("gf").over(frame),
        f"{prefix}avg_ga": F.avg("ga").over(frame),
        f"{prefix}form": F.avg("pts").over(frame),
        f"{prefix}matches": F.count("gf").over(frame).cast("int"),
    }


def _lags(window, n: int) -> dict[str, Column]:
    """The last ``n`` results as columns ``_pts1``.. (newest first)."""
    return {f"_{c}{age}": F.lag(c, age).over(window) for c in ("pts", "gf", "ga") for age in range(1, n + 1)}


def _decayed(n: int, halflife: float) -> dict[str, Column]:
    """Weighted means of the lag columns; weight halves every ``halflife`` rows."""
    weights = {age: F.lit(0.5 ** ((age - 1) / halflife)) for age in range(1, n + 1)}
    mass = total(F.when(F.col(f"_gf{age}").isNotNull(), w).otherwise(0.0) for age, w in weights.items())
    return {
        name: F.when(mass > 0, total(F.coalesce(F.col(f"_{c}{age}") * w, F.lit(0.0)) for age, w in weights.items()) / mass)
        for name, c in (("form", "pts"), ("gf", "gf"), ("ga", "ga"))
    }


def trailing_state(rows: DataFrame, window: int = K.TRAILING_WINDOW, halflives=(), rolling=()) -> DataFrame:
    """Pre-batch form per (league, team, batch): averages over the last
    ``window`` matches, plus optional decayed and rolling variants."""
    longest = max([window, *rolling])
    kept = batch_tail(rows, longest).withColumn("pts", points())
    order = _team_order()
    cols = _averages(order, window)
    for n in rolling:
        avg = _averages(order, n)
        cols |= {f"roll{n}_form": avg["form"], f"roll{n}_gd": avg["avg_gf"] - avg["avg_ga"]}
    lags = _lags(order, window) if halflives else {}
    state = (kept.withColumns(cols | lags).withColumn("_first", F.row_number().over(_batch_order()))
             .filter(F.col("_first") == 1))
    faded = {f"ewma{h}_{k}": v for h in halflives for k, v in _decayed(window, float(h)).items()}
    return (state.withColumns({"avg_gd": F.col("avg_gf") - F.col("avg_ga"), **faded})
            .select(*STATE_KEY, "avg_gd", *cols, *faded))


def venue_state(rows: DataFrame, window: int = K.TRAILING_WINDOW,
                minimum: int = K.VENUE_MIN_MATCHES) -> DataFrame:
    """Pre-batch form per (league, team, side, batch) from matches on that side,
    or from all matches while the side has fewer than ``minimum``."""
    kept = batch_tail(rows, window).withColumn("pts", points())
    overall = {f"all_{k}": v for k, v in _averages(_team_order(), window).items()}
    frozen = {k: F.first(k).over(_batch_order()) for k in overall}
    side = ["league", "team", "is_home"]
    order = Window.partitionBy(*side).orderBy("batch_ts", "ident", "row_id")
    first = Window.partitionBy(*side, "batch_ts").orderBy("ident", "row_id")
    out = (kept.withColumns(overall).withColumns(frozen)
           .withColumns(_averages(order, window, "side_"))
           .withColumn("_first", F.row_number().over(first))
           .filter(F.col("_first") == 1))
    enough = F.col("side_matches") >= minimum
    pick = {
        name: F.when(enough, F.col(f"side_{src}")).otherwise(F.col(f"all_{src}"))
        for name, src in (("venue_form", "form"), ("venue_gf", "avg_gf"), ("venue_ga", "avg_ga"))
    }
    return out.withColumns(pick).select(*side, "batch_ts", *pick)


def attach_state(batched: DataFrame, state: DataFrame, home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """Join a (league, team[, is_home], batch) state to both sides of a match.

    ``home`` and ``away`` map state columns to output names. The state is bounded by the calendar; it is stored, so it
    is computed once for both sides and joined by its true size, mostly without moving the matches.
    """
    out, state = batched, materialize(state)
    for side, names in (("home", home), ("away", away)):
        part = state
        if "is_home" in state.columns:
            part = part.filter(F.col("is_home") == F.lit(side == "home"))
        part = part.select("league", F.col("team").alias(side), "batch_ts",
                           *[F.col(c).alias(n) for c, n in names.items()])
        out = out.join(part, ["league", side, "batch_ts"])
    return out


def both_sides(names: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """``{state column: suffix}`` to the Home_ and Away_ name maps."""
    return tuple({c: f"{side}_{s}" for c, s in names.items()} for side in ("Home", "Away"))


TRAILING_NAMES = {"avg_gf": "Avg_GF", "avg_ga": "Avg_GA", "avg_gd": "Avg_GD", "form": "Form", "matches": "Matches"}


def with_trailing(batched: DataFrame, window: int = K.TRAILING_WINDOW) -> DataFrame:
    state = trailing_state(team_rows(batched), window)
    return attach_state(batched, state, *both_sides(TRAILING_NAMES))


def with_ewma(batched: DataFrame, halflives=K.EWMA_HALFLIVES, window: int = K.TRAILING_WINDOW) -> DataFrame:
    state = trailing_state(team_rows(batched), window, halflives=halflives)
    names = {f"ewma{h}_{k}": f"EWMA{h}_{n}" for h in halflives
             for k, n in (("form", "Form"), ("gf", "GF"), ("ga", "GA"))}
    return attach_state(batched, state, *both_sides(names))


def with_rolling(batched: DataFrame, windows=K.ROLLING_WINDOWS) -> DataFrame:
    state = trailing_state(team_rows(batched), max(windows), rolling=windows)
    names = {f"roll{n}_{k}": f"Roll{n}_{s}" for n in windows for k, s in (("form", "Form"), ("gd", "GD"))}
    return attach_state(batched, state, *both_sides(names))


def with_venue(batched: DataFrame, window: int = K.TRAILING_WINDOW) -> DataFrame:
    state = venue_state(team_rows(batched), window)
    names = {"venue_form": "Venue_Form", "venue_gf": "Venue_GF", "venue_ga": "Venue_GA"}
    return attach_state(batched, state, *both_sides(names))


def with_attack_defence(batched: DataFrame, window: int = K.TRAILING_WINDOW) -> DataFrame:
    """Venue-split attack and defence strengths for the goal models."""
    return attach_attack_defence(batched, venue_state(team_rows(batched), window))


def attach_attack_defence(batched: DataFrame, state: DataFrame) -> DataFrame:
    return attach_state(batched, state,
                        {"venue_gf": "DC_Home_Att", "venue_ga": "DC_Home_Def"},
                        {"venue_gf": "DC_Away_Att", "venue_ga": "DC_Away_Def"})


def impute_trailing(df: DataFrame) -> DataFrame:
    """Cold-start defaults for teams without history."""
    fill = {}
    for side in ("Home", "Away"):
        fill |= {f"{side}_Avg_GF": K.BASE_GOAL_RATE, f"{side}_Avg_GA": K.BASE_GOAL_RATE,
                 f"{side}_Avg_GD": 0.0, f"{side}_Form": 1.0, f"{side}_Matches": 0}
    return df.fillna({c: v for c, v in fill.items() if c in df.columns})


def latest_state(batched: DataFrame, window: int = K.TRAILING_WINDOW, row_id: str = "match_id") -> DataFrame:
    """Form of every team over its last ``window`` matches, by date and then by batch and row order.

    Counts by date, a table bounded by the calendar, say since when a team has ``window`` matches; only rows since then are ordered.
    """
    rows = team_rows(batched, row_id).withColumn("_day", F.to_date("batch_ts"))
    days = rows.groupBy(*TEAM, "_day").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*TEAM).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_later") < window)
    since = materialize(days.groupBy(*[F.col(c).alias(f"_{c}") for c in TEAM]).agg(F.min("_day").alias("_since")))  # a row per team, joined by its size
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TEAM]
    rows = rows.join(since, [*same, F.col("_day") >= F.col("_since")], "left_semi")
    w = Window.partitionBy(*TEAM).orderBy(F.desc(F.to_date("batch_ts")), F.desc("batch_ts"),
                                          F.desc("row_id"), "is_home")
    last = (rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window)
            .withColumn("pts", points()))
    return last.groupBy(*TEAM).agg(
        F.avg("gf").alias("avg_gf"), F.avg("ga").alias("avg_ga"),
        (F.avg("gf") - F.avg("ga")).alias("avg_gd"), F.avg("pts").alias("form"),
        F.count(F.lit(1)).cast("int").alias("matches"))


def season_segments(matches: DataFrame, gap_days: int = K.SEGMENT_GAP_DAYS) -> DataFrame:
    """Segments of the calendar: a new one starts at the first date, at a season
    change and after a gap of more than ``gap_days``.

    Works on distinct (date, season) pairs with their match counts, a table
    bounded by the calendar; rows of one date are taken season by season.
    """
    days = matches.groupBy("date", "season").agg(F.count(F.lit(1)).alias("n_matches"))
    order = Window.orderBy("date", "season")
    gap = F.datediff("date", F.lag("date").over(order)) > gap_days
    change = ~F.col("season").eqNullSafe(F.lag("season").over(order))
    starts = F.row_number().over(order) == 1
    flagged = days.withColumn("is_start", (starts | F.coalesce(gap, F.lit(False)) | change).cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (flagged.withColumn("segment", F.sum("is_start").over(running).cast("int") - 1)
            .withColumn("first_row", F.coalesce(F.sum("n_matches").over(before), F.lit(0))))
