"""Rating walks: sequential in time, parallel over leagues and time chunks.

A rating depends on all earlier matches of its league, so the walk cannot be a
window. It is still split: matches are first reduced to one counted row per
(batch, pair, result), which all move the ratings alike, and each league is then
cut into time chunks of bounded size. All chunks are walked in parallel from a
guess of their opening ratings, and the closing ratings of each chunk become the
next guess of the chunks after it. Chunk ``k`` is exact after ``k`` rounds at
the latest, and as ratings forget their start, a few rounds usually settle all.
The loop ends when no opening rating moves, so the result is that of one walk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators.ordering import with_ordinal
from formline.session import materialize

CHUNK_ROWS = 200_000
SETTLED = 1e-10
STATE = "league string, chunk long, team string, elo double, season_no int"


def _expected(home: float, away: float) -> float:
    return 1.0 / (1.0 + 10.0 ** ((away - home - K.HOME_ADVANTAGE) / K.ELO_DIVISOR))


def _bound(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def _opening(states: pd.DataFrame) -> dict:
    return {t: (e, s) for t, e, s in zip(states["team"], states["elo"], states["season_no"])}


def _codes(rows: pd.DataFrame, known) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Team names, and the rows' home and away teams as places in them."""
    names, codes = np.unique(np.concatenate([np.array(list(known), object), rows["home"].to_numpy(object), rows["away"].to_numpy(object)]), return_inverse=True)
    n = len(rows)
    return list(names), codes[-2 * n:-n], codes[-n:]


def _walk_batches(rows: pd.DataFrame, states: pd.DataFrame):
    """Batch walk of one chunk: (batch, team, rating before) columns, and the closing ratings.

    A batch is a few vector operations: gains of its rows from the ratings before it, added up by team in row
    order (home, then away), then applied.
    """
    opening = _opening(states)
    rows = rows.sort_values(["batch_ts", "home", "away", "res"], kind="stable")
    names, home, away = _codes(rows, opening)
    ratings = np.array([opening[t][0] if t in opening else K.BASE_ELO for t in names])
    stamps, batch = np.unique(rows["batch_ts"].to_numpy(), return_inverse=True)
    edges = np.searchsorted(batch, np.arange(len(stamps) + 1))
    score, count = rows["res"].to_numpy() / 2.0, rows["n"].to_numpy().astype(float)
    teams = np.column_stack([home, away]).ravel()
    pairs = np.unique(np.repeat(batch, 2) * len(names) + teams)
    where, who = pairs // len(names), pairs % len(names)
    parts, before = np.searchsorted(where, np.arange(len(stamps) + 1)), np.empty(len(pairs))
    for i in range(len(stamps)):
        at, part = slice(edges[i], edges[i + 1]), slice(parts[i], parts[i + 1])
        rh, ra = ratings[home[at]], ratings[away[at]]
        gain = K.K_FACTOR * (score[at] - 1.0 / (1.0 + 10.0 ** ((ra - rh - K.HOME_ADVANTAGE) / K.ELO_DIVISOR)))
        moves = np.column_stack([np.clip(rh + gain, K.ELO_MIN, K.ELO_MAX) - rh, np.clip(ra - gain, K.ELO_MIN, K.ELO_MAX) - ra])
        change = np.bincount(teams[2 * at.start:2 * at.stop], (moves * count[at, None]).ravel(), len(names))
        here = who[part]
        before[part] = ratings[here]
        ratings[here] = np.clip(ratings[here] + change[here], K.ELO_MIN, K.ELO_MAX)
    table = {"batch_ts": stamps[where], "team": np.array(names, object)[who], "elo": before}
    return table, {t: (float(e), 0) for t, e in zip(names, ratings)}


def _margin(goal_gap: int) -> float:
    return 1.0 if goal_gap <= 1 else 1.5 if goal_gap == 2 else (11.0 + goal_gap) / 8.0


def _walk_matches(rows: pd.DataFrame, states: pd.DataFrame):
    """Match-by-match walk with margin multiplier and season pull to the base."""
    ratings = _opening(states)
    keep = 1.0 - K.MOV_REVERSION

    def now(team: str, season: int) -> float:
        elo, seen = ratings.get(team, (K.BASE_ELO, season))
        return K.BASE_ELO + (elo - K.BASE_ELO) * keep ** (season - seen)

    rows = rows.sort_values("pos", kind="stable")
    around = np.empty((len(rows), 4))
    columns = [rows[c].array for c in ("home", "away", "hg", "ag", "season_no")]
    for i, (home, away, hg, ag, season) in enumerate(zip(*columns)):
        rh, ra = now(home, season), now(away, season)
        score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
        damp = 2.2 / (abs(rh + K.HOME_ADVANTAGE - ra) * 0.001 + 2.2)
        gain = K.MOV_K * _margin(abs(hg - ag)) * damp * (score - _expected(rh, ra))
        new_h = _bound(rh + gain, K.MOV_MIN, K.MOV_MAX)
        new_a = _bound(ra - gain, K.MOV_MIN, K.MOV_MAX)
        ratings[home], ratings[away] = (new_h, season), (new_a, season)
        around[i] = rh, ra, new_h, new_a
    names = ("home_before", "away_before", "home_after", "away_after")
    return {"match_id": rows["match_id"].to_numpy()} | dict(zip(names, around.T)), ratings


def _closing(walk: Callable):
    """Grouped job: the ratings at the end of a chunk, for teams that played in it."""
    def job(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"league": [], "chunk": [], "team": [], "elo": [], "season_no": []})
        _, ratings = walk(rows, states)
        played = sorted(set(rows["home"]) | set(rows["away"]))
        return pd.DataFrame({
            "league": rows["league"].iloc[0], "chunk": rows["chunk"].iloc[0], "team": played,
            "elo": [ratings[t][0] for t in played], "season_no": [ratings[t][1] for t in played],
        })
    return job


def _emitting(walk: Callable, names: list[str]):
    """Grouped job: the rows a chunk's walk puts out."""
    def job(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(walk(rows, states)[0] if not rows.empty else [], columns=names)
        out.insert(0, "league", rows["league"].iloc[0] if not rows.empty else None)
        return out
    return job


def _opening_states(closing: DataFrame) -> DataFrame:
    """Each chunk opens with what the team's previous chunk closed with."""
    w = Window.partitionBy("league", "team").orderBy("chunk")
    return closing.select(
        "league", "chunk", "team",
        F.lag("elo").over(w).alias("elo"), F.lag("season_no").over(w).alias("season_no"),
    ).filter(F.col("elo").isNotNull())


def settle_openings(chunked: DataFrame, walk: Callable, tolerance: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """(opening, closing) ratings of all (league, chunk) groups, iterated until no opening moves.

    A round walks only the chunks whose opening moved in the round before; the others close as they did.
    """
    spark = chunked.sparkSession
    opening, closing, dirty = spark.createDataFrame([], STATE), None, None
    bounds = chunked.groupBy("league").agg((F.max("chunk") - F.min("chunk")).alias("n"))
    rounds = bounds.agg(F.max("n")).first()[0] or 0
    for _ in range(rounds + 1):
        sides = (chunked, opening) if dirty is None else (t.join(dirty, ["league", "chunk"], "left_semi") for t in (chunked, opening))
        rows, states = (t.groupBy("league", "chunk") for t in sides)
        walked = rows.cogroup(states).applyInPandas(_closing(walk), STATE)
        if not rounds:
            return opening, walked
        if dirty is not None:
            walked = walked.unionByName(closing.join(dirty, ["league", "chunk"], "left_anti"))
        closing = materialize(walked)
        fresh = materialize(_opening_states(closing))
        old = opening.select("league", "chunk", "team", F.col("elo").alias("was"))
        moved = fresh.join(old, ["league", "chunk", "team"], "left").filter(
            F.abs(F.col("elo") - F.coalesce(F.col("was"), F.lit(float("inf")))) > tolerance)
        dirty = materialize(moved.select("league", "chunk").distinct())
        opening = fresh
        if dirty.isEmpty():
            break
    return opening, closing


def _chunk_batches(edges: DataFrame, chunk_rows: int) -> DataFrame:
    """Cut each league at batch borders into chunks of about ``chunk_rows`` rows."""
    sizes = edges.groupBy("league", "batch_ts").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("league").orderBy("batch_ts").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_rows)
    return edges.join(sizes.select("league", "batch_ts", chunk.alias("chunk")), ["league", "batch_ts"])


def counted_results(batched: DataFrame) -> DataFrame:
    """One counted row per league, batch, pair and result; unknown results are left out."""
    return (batched.filter(F.col("res").isNotNull())
            .groupBy("league", "batch_ts", "home", "away", F.col("res").cast("int").alias("res"))
            .agg(F.count(F.lit(1)).alias("n")))


class EloWalk:
    """Batch Elo of a match table: ratings before each batch and at the end."""

    def __init__(self, batched: DataFrame, chunk_rows: int = CHUNK_ROWS):
        self.edges = materialize(_chunk_batches(counted_results(batched), chunk_rows))
        self.opening, self.closing = settle_openings(self.edges, _walk_batches)

    def _groups(self):
        return self.edges.groupBy("league", "chunk").cogroup(self.opening.groupBy("league", "chunk"))

    def before(self) -> DataFrame:
        """(league, batch_ts, team, elo): the rating every batch starts from."""
        return self._groups().applyInPandas(
            _emitting(_walk_batches, ["batch_ts", "team", "elo"]),
            "league string, batch_ts timestamp_ntz, team string, elo double")

    def final(self) -> DataFrame:
        """(league, team, elo): the rating after the team's last batch."""
        return self.closing.groupBy("league", "team").agg(F.max_by("elo", "chunk").alias("elo"))


def with_season_number(matches: DataFrame) -> DataFrame:
    """Number the seasons of a league by their first date (0, 1, ...)."""
    seasons = matches.groupBy("league", "season").agg(F.min("date").alias("_first"))
    order = Window.partitionBy("league").orderBy("_first", "season")
    numbered = seasons.select("league", "season", (F.row_number().over(order) - 1).alias("season_no"))
    return matches.join(numbered, ["league", "season"])


def margin_ratings(batched: DataFrame, chunk_rows: int = CHUNK_ROWS, row_id: str = "match_id") -> DataFrame:
    """Margin-of-victory ratings around every match, in (batch, row) order, with
    a pull towards the base at each season change."""
    rows = with_season_number(batched).select(
        "league", F.col(row_id).alias("match_id"), "batch_ts", "home", "away",
        F.coalesce("hg", F.lit(0)).alias("hg"), F.coalesce("ag", F.lit(0)).alias("ag"), "season_no")
    # Positions run league by league, so a fixed number of them makes a chunk and
    # chunk numbers rise inside every league.
    placed = with_ordinal(rows, ["league", "batch_ts", "match_id"], "pos")
    chunked = placed.withColumn("chunk", F.floor(F.col("pos") / chunk_rows)).drop("batch_ts")
    opening, _ = settle_openings(chunked, _walk_matches)
    names = ["match_id", "home_before", "away_before", "home_after", "away_after"]
    schema = "league string, match_id long, " + ", ".join(f"{n} double" for n in names[1:])
    return chunked.groupBy("league", "chunk").cogroup(
        opening.groupBy("league", "chunk")).applyInPandas(_emitting(_walk_matches, names), schema)
