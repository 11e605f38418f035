"""Queries on batches, point-in-time form, ratings and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.catalog import tables as T
from formline.catalog.registry import query
from formline.catalog.sql import CTES, DEPENDS, expected, r, with_ctes
from formline.operators import ratings, windows as W
from formline.operators.batching import prepare_batches, with_identity
from formline.operators.ordering import with_ordinal


def rounded(df: DataFrame, *keys: str, digits: int = 6, **cols: str) -> DataFrame:
    """Keys as they are, and ``out=column`` pairs rounded."""
    return df.select(*keys, *[F.round(c, digits).alias(o) for o, c in cols.items()])


def batched(spark, sf_dir: str) -> DataFrame:
    return T.with_batches(spark, sf_dir).drop("_mid")


def _text(ts: str):
    return F.col(ts).cast("string").alias("batch")


_BATCH = "strftime(batch_ts, '%Y-%m-%d %H:%M:%S') AS batch"


@query("win_batch", with_ctes(["batched"], f"""
SELECT match_id, {_BATCH}, whole_day, row_number() OVER (ORDER BY batch_ts, match_id) - 1 AS row_no FROM batched"""))
def win_batch(spark, sf_dir):
    return prepare_batches(T.matches(spark, sf_dir)).select("match_id", _text("batch_ts"), "whole_day", "row_no")


@query("win_stable_ident", with_ctes(["batched"], f"""
SELECT match_id, {_BATCH}, home || chr(31) || away AS ident,
       row_number() OVER (ORDER BY batch_ts, home || chr(31) || away, match_id) - 1 AS update_no FROM batched"""))
def win_stable_ident(spark, sf_dir):
    rows = with_ordinal(with_identity(batched(spark, sf_dir)), ["batch_ts", "ident", "match_id"], "update_no")
    return rows.select("match_id", _text("batch_ts"), "ident", "update_no")


@query("win_long", with_ctes(["long"], f"SELECT league, {_BATCH}, match_id, team, is_home, gf, ga FROM long"))
def win_long(spark, sf_dir):
    rows = W.team_rows(batched(spark, sf_dir))
    return rows.select("league", _text("batch_ts"), F.col("row_id").alias("match_id"), "team", "is_home", "gf", "ga")


def _sides(cte: str, cols: dict[str, str]) -> str:
    """Match-grain SQL over a (match_id, is_home) block: {suffix: expression}."""
    parts = [f"{e.format(s=s)} AS {n}_{k}" for s, n in (("h", "Home"), ("a", "Away")) for k, e in cols.items()]
    return with_ctes([cte], f"""SELECT h.match_id, {', '.join(parts)}
FROM {cte} h JOIN {cte} a ON a.match_id = h.match_id AND NOT a.is_home WHERE h.is_home""")


@query("win_trailing", _sides("trail8", {
    "Avg_GF": r("{s}.gf"), "Avg_GA": r("{s}.ga"), "Avg_GD": r("{s}.gf - {s}.ga"), "Form": r("{s}.form"),
    "Matches": "CAST({s}.n AS INTEGER)"}))
def win_trailing(spark, sf_dir):
    out = W.with_trailing(batched(spark, sf_dir))
    names = [f"{s}_{c}" for s in ("Home", "Away") for c in ("Avg_GF", "Avg_GA", "Avg_GD", "Form")]
    return rounded(out, "match_id", "Home_Matches", "Away_Matches", **{n: n for n in names})


def _ewma_sql(halflife: int, col: str) -> str:
    terms = [(f"lag({col}, {i + 1}) OVER w", 0.5 ** (i / halflife)) for i in range(8)]
    top = " + ".join(f"coalesce({x} * CAST({w!r} AS DOUBLE), 0)" for x, w in terms)
    low = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE CAST({w!r} AS DOUBLE) END" for x, w in terms)
    return f"({top}) / nullif({low}, 0)"


_EW = {f"e{h}_{k}": _ewma_sql(h, c) for h in K.EWMA_HALFLIVES for k, c in (("Form", "pts"), ("GF", "gf"), ("GA", "ga"))}
CTES["ewma"] = f"""
SELECT match_id, is_home, {', '.join(f'first({n}) OVER b AS {n}' for n in _EW)} FROM (
  SELECT league, team, batch_ts, ident, match_id, is_home, {', '.join(f'{e} AS {n}' for n, e in _EW.items())}
  FROM long WINDOW w AS (PARTITION BY league, team ORDER BY batch_ts, ident, match_id, is_home DESC))
WINDOW b AS (PARTITION BY league, team, batch_ts ORDER BY ident, match_id, is_home DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
DEPENDS["ewma"] = ["long"]


@query("win_ewma", _sides("ewma", {
    f"EWMA{h}_{k}": r("{s}." + f"e{h}_{k}") for h in K.EWMA_HALFLIVES for k in ("Form", "GF", "GA")}))
def win_ewma(spark, sf_dir):
    names = [f"{s}_EWMA{h}_{k}" for s in ("Home", "Away") for h in K.EWMA_HALFLIVES for k in ("Form", "GF", "GA")]
    return rounded(W.with_ewma(batched(spark, sf_dir)), "match_id", **{n: n for n in names})


@query("win_multi", with_ctes(["trail5", "trail10"], "SELECT h5.match_id, " + ", ".join(
    f"{r(f'{s}{w}.form')} AS {n}_Roll{w}_Form, {r(f'{s}{w}.gf - {s}{w}.ga')} AS {n}_Roll{w}_GD"
    for s, n in (("h", "Home"), ("a", "Away")) for w in (5, 10)) + """
FROM trail5 h5 JOIN trail5 a5 ON a5.match_id = h5.match_id AND NOT a5.is_home
JOIN trail10 h10 ON h10.match_id = h5.match_id AND h10.is_home
JOIN trail10 a10 ON a10.match_id = h5.match_id AND NOT a10.is_home WHERE h5.is_home"""))
def win_multi(spark, sf_dir):
    names = [f"{s}_Roll{w}_{k}" for s in ("Home", "Away") for w in K.ROLLING_WINDOWS for k in ("Form", "GD")]
    return rounded(W.with_rolling(batched(spark, sf_dir)), "match_id", **{n: n for n in names})


@query("win_venue", _sides("venue", {
    "Venue_Form": r("{s}.form"), "Venue_GF": r("{s}.gf"), "Venue_GA": r("{s}.ga")}))
def win_venue(spark, sf_dir):
    names = [f"{s}_Venue_{k}" for s in ("Home", "Away") for k in ("Form", "GF", "GA")]
    return rounded(W.with_venue(batched(spark, sf_dir)), "match_id", **{n: n for n in names})


@query("win_dc_venue", with_ctes(["venue"], f"""
SELECT h.match_id, {r('h.gf')} AS DC_Home_Att, {r('h.ga')} AS DC_Home_Def, {r('a.gf')} AS DC_Away_Att, {r('a.ga')} AS DC_Away_Def
FROM venue h JOIN venue a ON a.match_id = h.match_id AND NOT a.is_home WHERE h.is_home"""))
def win_dc_venue(spark, sf_dir):
    names = ["DC_Home_Att", "DC_Home_Def", "DC_Away_Att", "DC_Away_Def"]
    return rounded(W.with_attack_defence(batched(spark, sf_dir)), "match_id", **{n: n for n in names})


@query("win_latest", with_ctes(["long"], f"""
SELECT league, team, {r('avg(gf)')} AS avg_gf, {r('avg(ga)')} AS avg_ga, {r('avg(gf) - avg(ga)')} AS avg_gd,
       {r('avg(pts)')} AS form, CAST(count(*) AS INTEGER) AS matches
FROM (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY CAST(batch_ts AS DATE) DESC, batch_ts DESC,
                                   match_id DESC, is_home) AS n FROM long) WHERE n <= 8 GROUP BY league, team"""))
def win_latest(spark, sf_dir):
    out = W.latest_state(batched(spark, sf_dir))
    return rounded(out, "league", "team", "matches", **{n: n for n in ("avg_gf", "avg_ga", "avg_gd", "form")})


@query("win_impute", _sides("trail8", {
    "Avg_GF": r("coalesce({s}.gf, 1.11)"), "Avg_GA": r("coalesce({s}.ga, 1.11)"), "Avg_GD": r("coalesce({s}.gf - {s}.ga, 0)"),
    "Form": r("coalesce({s}.form, 1)"), "Matches": "CAST({s}.n AS INTEGER)"}))
def win_impute(spark, sf_dir):
    out = W.impute_trailing(W.with_trailing(batched(spark, sf_dir)))
    names = [f"{s}_{c}" for s in ("Home", "Away") for c in ("Avg_GF", "Avg_GA", "Avg_GD", "Form")]
    return rounded(out, "match_id", "Home_Matches", "Away_Matches", **{n: n for n in names})


@query("win_elo", with_ctes(["elo"], f"""
SELECT match_id, {r('home_elo')} AS home_elo, {r('away_elo')} AS away_elo FROM elo"""))
def win_elo(spark, sf_dir):
    rows = batched(spark, sf_dir)
    out = W.attach_state(rows, ratings.EloWalk(rows).before(), {"elo": "home_elo"}, {"elo": "away_elo"})
    return rounded(out, "match_id", home_elo="home_elo", away_elo="away_elo")


@query("win_elo_final", with_ctes(["elo_fold"], f"""
SELECT p.league, p.team, {r('f.acc.cur[t.no]')} AS elo FROM (SELECT DISTINCT league, team FROM long) p
JOIN teams t ON t.team = p.team JOIN elo_fold f ON f.league = p.league"""))
def win_elo_final(spark, sf_dir):
    return rounded(ratings.EloWalk(batched(spark, sf_dir)).final(), "league", "team", elo="elo")



_MOV = f"""(24.0 * (CASE WHEN abs(x.hg - x.ag) <= 1 THEN 1.0 WHEN abs(x.hg - x.ag) = 2 THEN 1.5
 ELSE (11.0 + abs(x.hg - x.ag)) / 8.0 END) * (2.2 / (GAP * 0.001 + 2.2))
 * ((CASE WHEN x.hg > x.ag THEN 1.0 WHEN x.hg = x.ag THEN 0.5 ELSE 0.0 END) - EXP))"""


def _mov_fold() -> str:
    """Fold over a league's matches. Each step first pulls all ratings if the
    season changed, then applies the match."""
    pulled = "(CASE WHEN x.s <> acc.s THEN 1500.0 + (acc.cur[{i}] - 1500.0) * 0.8 ELSE acc.cur[{i}] END)"
    rh, ra = pulled.format(i="x.h"), pulled.format(i="x.a")
    gain = (_MOV.replace("GAP", f"abs({rh} + 65.0 - {ra})").replace("EXP", expected(f"{rh} + 65.0", ra)))
    nh = f"least(greatest({rh} + {gain}, 800.0), 2400.0)"
    na = f"least(greatest({ra} - {gain}, 800.0), 2400.0)"
    return f"""list_reduce(xs, lambda acc, x: struct_pack(id := x.id, h := x.h, a := x.a, hg := x.hg, ag := x.ag, s := x.s,
      log := list_append(acc.log, struct_pack(id := x.id, rh := {rh}, ra := {ra}, nh := {nh}, na := {na})),
      cur := list_transform(range(1, len(acc.cur) + 1), lambda t: CASE WHEN t = x.h THEN {nh} WHEN t = x.a THEN {na}
             ELSE {pulled.format(i='t')} END)),
    struct_pack(id := CAST(0 AS BIGINT), h := 0, a := 0, hg := 0, ag := 0, s := CAST(1 AS BIGINT),
      log := CAST([] AS STRUCT(id BIGINT, rh DOUBLE, ra DOUBLE, nh DOUBLE, na DOUBLE)[]),
      cur := list_transform(range(0, (SELECT count(*) FROM teams)), lambda i: CAST(1500.0 AS DOUBLE))))"""


CTES["mov"] = f"""
SELECT league, unnest(acc.log, recursive := true) FROM (
  SELECT league, {_mov_fold()} AS acc FROM (
    SELECT b.league, list(struct_pack(id := match_id, h := h.no, a := a.no, hg := hg, ag := ag, s := s,
             log := CAST([] AS STRUCT(id BIGINT, rh DOUBLE, ra DOUBLE, nh DOUBLE, na DOUBLE)[]),
             cur := CAST([] AS DOUBLE[])) ORDER BY batch_ts, match_id) AS xs
    FROM batched b JOIN teams h ON h.team = home JOIN teams a ON a.team = away
    JOIN (SELECT league, season, row_number() OVER (PARTITION BY league ORDER BY min(date), season) AS s
          FROM matches GROUP BY league, season) n ON n.league = b.league AND n.season = b.season
    GROUP BY b.league))"""
DEPENDS["mov"] = ["teams"]


@query("win_elo_mov", with_ctes(["mov"], f"""
SELECT id AS match_id, {r('rh')} AS home_before, {r('ra')} AS away_before, {r('nh')} AS home_after, {r('na')} AS away_after FROM mov"""))
def win_elo_mov(spark, sf_dir):
    out = ratings.margin_ratings(batched(spark, sf_dir))
    return rounded(out, "match_id", **{n: n for n in ("home_before", "away_before", "home_after", "away_after")})


@query("win_elo_season", with_ctes(["mov"], f"""
SELECT league, season, team, {r('first(elo ORDER BY batch_ts, match_id)')} AS opening_elo FROM (
  SELECT b.league, b.season, b.batch_ts, b.match_id, b.home AS team, rh AS elo FROM mov JOIN batched b ON b.match_id = id
  UNION ALL SELECT b.league, b.season, b.batch_ts, b.match_id, b.away, ra FROM mov JOIN batched b ON b.match_id = id)
GROUP BY league, season, team"""))
def win_elo_season(spark, sf_dir):
    """Rating of every team at its first match of a season, after the pull."""
    rows = batched(spark, sf_dir)
    walked = ratings.margin_ratings(rows).drop("league").join(rows, "match_id")
    sides = F.array(F.struct(F.col("home").alias("team"), F.col("home_before").alias("elo")),
                    F.struct(F.col("away").alias("team"), F.col("away_before").alias("elo")))
    long = walked.select("league", "season", "batch_ts", "match_id", F.inline(sides))
    out = long.groupBy("league", "season", "team").agg(
        F.min_by("elo", F.struct("batch_ts", "match_id")).alias("elo"))
    return rounded(out, "league", "season", "team", opening_elo="elo")


@query("win_segments", with_ctes(["matches"], """
SELECT date, season, n_matches, CAST(sum(st) OVER (ORDER BY date, season) AS INTEGER) - 1 AS segment, st AS is_start,
       CAST(coalesce(sum(n_matches) OVER (ORDER BY date, season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
FROM (SELECT *, CAST(CASE WHEN lag(date) OVER o IS NULL OR date - lag(date) OVER o > 21 OR season <> lag(season) OVER o
                          THEN 1 ELSE 0 END AS INTEGER) AS st
      FROM (SELECT date, season, count(*) AS n_matches FROM matches GROUP BY date, season) WINDOW o AS (ORDER BY date, season))"""))
def win_segments(spark, sf_dir):
    return W.season_segments(T.matches(spark, sf_dir)).select("date", "season", "n_matches", "segment", "is_start", "first_row")
