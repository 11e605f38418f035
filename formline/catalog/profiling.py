"""Queries on validation, profiling and statistic tables.

Feeds are derived from all rows of the given tables. Remainders of keys only pick
how a row is spelled (separator, gap, noise), so that every kind of line occurs;
a line a parser must refuse is missing from the result on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.catalog import tables as T
from formline.catalog.form import batched
from formline.catalog.probability import ALL24
from formline.catalog.registry import query
from formline.catalog.sql import CTES, DEPENDS, r, with_ctes
from formline.catalog.text import cust, glossary
from formline.catalog.shared import feature_table
from formline.operators import quality as Q, stat_tables as ST, windows as W
from formline.session import materialize


def check(source: str, rows: list[tuple[str, str, str, str]]) -> str:
    """SQL for check rows: (check, severity, count expression, message expression)."""
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS \"check\", '{s}' AS severity, CAST({e} AS BIGINT) AS n_bad, {m} AS message FROM {source}" for n, s, e, m in rows)


_GLOSS_CHECKS = check("gloss", [
    ("empty", "error", "count(*) = 0", "'glossary is empty'"),
    ("bad_key", "error", "count(*) FILTER (coalesce(variant, '') = '')", "'invalid keys'"),
    ("bad_value", "error", "count(*) FILTER (coalesce(target, '') = '')", "'invalid values'"),
    ("self_mapping", "warning", "count(*) FILTER (upper(variant) = upper(target))", "'entries map to themselves'"),
    ("total_mappings", "stat", "count(*)", "'entries'")])


@query("val_glossary", with_ctes(["gloss"], _GLOSS_CHECKS))
def val_glossary(spark, sf_dir):
    return Q.validate_glossary(glossary(spark, sf_dir))


CTES["dirty"] = """
SELECT match_id, CASE WHEN match_id % 41 <> 0 THEN home END AS home, CASE WHEN match_id % 43 <> 0 THEN away END AS away,
       CASE WHEN match_id % 31 = 0 THEN 'X' WHEN match_id % 53 = 0 THEN '7' WHEN match_id % 47 <> 0 THEN CAST(res AS VARCHAR) END AS res,
       CASE WHEN match_id % 59 = 0 THEN 'unknown' ELSE CAST(date AS VARCHAR) END AS date,
       CASE WHEN match_id % 61 = 0 THEN -1 ELSE hg END AS hg, ag FROM matches"""
DEPENDS["dirty"] = ["matches"]


def dirty(spark, sf_dir) -> DataFrame:
    """Match rows with gaps, odd codes, bad dates and negative goals."""
    key = F.col("match_id")
    return T.matches(spark, sf_dir).select(
        "match_id", F.when(key % 41 != 0, F.col("home")).alias("home"), F.when(key % 43 != 0, F.col("away")).alias("away"),
        F.when(key % 31 == 0, "X").when(key % 53 == 0, "7").when(key % 47 != 0, F.col("res").cast("string")).alias("res"),
        F.when(key % 59 == 0, "unknown").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(key % 61 == 0, -1).otherwise(F.col("hg")).alias("hg"), "ag")


_TEAMS = "(SELECT count(DISTINCT t) FROM (SELECT home AS t FROM dirty UNION ALL SELECT away FROM dirty))"
_HISTORY_CHECKS = check("dirty", [
    ("empty", "error", "count(*) = 0", "'history is empty'"),
    *[(f"null_{c}", "error", f"count(*) FILTER ({c} IS NULL)", f"'missing values in {c}'") for c in ("home", "away", "res")],
    ("result_codes", "error", "count(*) FILTER (res NOT IN ('0', '1', '2', 'A', 'D', 'H'))",
     "'rows with invalid codes'"),
    ("dates", "error", "count(*) FILTER (date IS NOT NULL AND TRY_CAST(date AS DATE) IS NULL)", "'unparseable dates'"),
    *[(f"negative_{c}", "error", f"count(*) FILTER ({c} < 0)", f"'negative values in {c}'") for c in ("hg", "ag")],
    ("total_matches", "stat", "count(*)",
     "CAST(min(TRY_CAST(date AS DATE)) AS VARCHAR) || ' to ' || CAST(max(TRY_CAST(date AS DATE)) AS VARCHAR)"),
    ("teams", "stat", f"any_value({_TEAMS})", "'distinct teams'")]) + """
UNION ALL SELECT 'result_code', 'detail', count(*), res FROM dirty WHERE res NOT IN ('0', '1', '2', 'A', 'D', 'H') GROUP BY res"""


@query("val_history", with_ctes(["dirty"], _HISTORY_CHECKS))
def val_history(spark, sf_dir):
    return Q.validate_history(dirty(spark, sf_dir))


_FIXTURE_CHECKS = check("dirty", [
    ("empty", "warning", "count(*) = 0", "'no fixtures'"),
    ("null_home", "error", "count(*) FILTER (home IS NULL)", "'fixtures without home team'"),
    ("null_away", "error", "count(*) FILTER (away IS NULL)", "'fixtures without away team'"),
    ("identical", "warning", "count(*) FILTER (upper(home) = upper(away))", "'fixtures of a team against itself'"),
    ("total_fixtures", "stat", "count(*)", "'fixtures'"),
    ("unique_teams", "stat", f"any_value({_TEAMS})", "'distinct teams'")])


@query("val_fixtures", with_ctes(["dirty"], _FIXTURE_CHECKS))
def val_fixtures(spark, sf_dir):
    return Q.validate_fixtures(dirty(spark, sf_dir))


_CHECKED = ["Home_Avg_GF", "Away_Avg_GF", "Home_Form", "Away_Form", "Odds_Home"]
CTES["raw_form"] = """
SELECT h.match_id, h.gf AS Home_Avg_GF, a.gf AS Away_Avg_GF, h.form + 1 AS Home_Form, a.form AS Away_Form, m.odds_h AS Odds_Home
FROM trail8 h JOIN trail8 a ON a.match_id = h.match_id AND NOT a.is_home JOIN matches m ON m.match_id = h.match_id WHERE h.is_home"""
DEPENDS["raw_form"] = ["trail8"]


def _feature_checks() -> str:
    rows = [("empty", "error", "count(*) = 0", "'no feature rows'")]
    for c in _CHECKED:
        rows += [(f"nulls:{c}", "warning", f"count(*) FILTER ({c} IS NULL)", "'null values'"),
                 (f"many_nulls:{c}", "error", f"count(*) FILTER ({c} IS NULL) > count(*) * 0.1", "'more than 10% null'"),
                 (f"infinite:{c}", "error", f"count(*) FILTER (isinf({c}))", "'infinite values'")]
        if c.endswith("Form"):
            rows.append((f"bounds:{c}", "warning", f"count(*) FILTER ({c} < 0 OR {c} > 3)", "'values outside [0, 3]'"))
    return check("raw_form", rows + [("total_samples", "stat", "count(*)", f"'rows with {len(_CHECKED)} features'")])


@query("val_features", with_ctes(["raw_form"], _feature_checks()))
def val_features(spark, sf_dir):
    """Checks of unimputed features; home form is shifted out of its bounds."""
    rows = W.with_trailing(batched(spark, sf_dir)).withColumn("Home_Form", F.col("Home_Form") + 1)
    return Q.validate_features(rows.withColumn("Odds_Home", F.col("odds_h")), _CHECKED)


def _frame_checks() -> str:
    rows = [("empty", "error", "count(*) = 0", "'no feature rows'")]
    for c in K.FEATURE_COLUMNS:
        rows += [(f"nulls:{c}", "warning", f"count(*) FILTER ({c} IS NULL)", "'null values'"),
                 (f"many_nulls:{c}", "error", f"count(*) FILTER ({c} IS NULL) > count(*) * 0.1", "'more than 10% null'"),
                 (f"infinite:{c}", "error", f"count(*) FILTER (isinf({c}))", "'infinite values'")]
        if c in Q.BOUNDS:
            low, high = Q.BOUNDS[c]
            rows.append((f"bounds:{c}", "warning", f"count(*) FILTER ({c} < {low} OR {c} > {high})", f"'values outside [{low:g}, {high:g}]'"))
    return check("frame", rows + [("total_samples", "stat", "count(*)", f"'rows with {len(K.FEATURE_COLUMNS)} features'")])


@query("val_model_frame", with_ctes(["outcome", "shin"], _frame_checks(), {"frame": "SELECT " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {n}" for n, e in ALL24.items()) + " FROM outcome JOIN (SELECT match_id, Shin_Prob_H, Shin_Prob_D, Shin_Prob_A FROM shin) USING (match_id)"}))
def val_model_frame(spark, sf_dir):
    """Checks of the stored 24-column model frame."""
    return Q.validate_features(feature_table(spark, sf_dir), K.FEATURE_COLUMNS)


@query("val_all", with_ctes(["gloss", "dirty"], """
SELECT bool_and(NOT bad) AS is_valid, count(*) FILTER (bad) AS n_errors, coalesce(string_agg(t, '; ' ORDER BY t) FILTER (bad), '') AS errors
FROM (SELECT severity = 'error' AND n_bad > 0 AS bad, src || '.' || "check" || ': ' || n_bad || ' ' || message AS t FROM all_)""", {
    "all_": f"SELECT 'glossary' AS src, * FROM ({_GLOSS_CHECKS}) UNION ALL SELECT 'history', * FROM ({_HISTORY_CHECKS}) "
            f"UNION ALL SELECT 'fixtures', * FROM ({_FIXTURE_CHECKS})"}))
def val_all(spark, sf_dir):
    rows = dirty(spark, sf_dir)
    return Q.validate_all({"glossary": Q.validate_glossary(glossary(spark, sf_dir)), "history": Q.validate_history(rows),
                           "fixtures": Q.validate_fixtures(rows)})


@query("val_min_rows", with_ctes(["matches"], "SELECT count(*) AS n_rows FROM matches"))
def val_min_rows(spark, sf_dir):
    return Q.require_rows(T.matches(spark, sf_dir), 1)


@query("val_dupes", with_ctes(["matches"], """
SELECT date, home, away, count(*) AS n FROM matches GROUP BY date, home, away HAVING count(*) > 1"""))
def val_dupes(spark, sf_dir):
    return Q.duplicate_keys(T.matches(spark, sf_dir))


@query("prf_days", with_ctes(["dirty"], """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (d IS NULL), 0) AS BIGINT) AS unparseable_dates, min(d) AS first_date, max(d) AS last_date,
       count(d) AS unique_dates, count(*) FILTER (d IS NOT NULL AND n > 1) AS dates_with_multiple,
       count(*) FILTER (d IS NOT NULL AND n >= 3) AS dates_with_3plus, max(n) FILTER (d IS NOT NULL) AS max_on_one_date
FROM (SELECT TRY_CAST(date AS DATE) AS d, count(*) AS n FROM dirty GROUP BY 1)"""))
def prf_days(spark, sf_dir):
    return Q.day_profile(dirty(spark, sf_dir).withColumn("date", F.col("date").try_cast("date")))


@query("prf_busiest_days", with_ctes(["matches"], """
SELECT date, count(*) AS matches FROM matches GROUP BY date HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def prf_busiest_days(spark, sf_dir):
    return Q.busiest_days(T.matches(spark, sf_dir))


@query("prf_time_quality", with_ctes(["matches"], r"""
SELECT round(avg(CASE WHEN coalesce(trim(kickoff), '') NOT IN ('', 'nan') THEN 1.0 ELSE 0.0 END), 4) AS nonempty_fraction,
       round(avg(CASE WHEN regexp_matches(coalesce(kickoff, ''), '^\d{1,2}[:.]\d{2}') THEN 1.0 ELSE 0.0 END), 4) AS parseable_fraction,
       avg(CASE WHEN coalesce(trim(kickoff), '') NOT IN ('', 'nan') THEN 1.0 ELSE 0.0 END) > 0.5 AS usable FROM matches"""))
def prf_time_quality(spark, sf_dir):
    return Q.time_quality(T.matches(spark, sf_dir))


@query("prf_season", with_ctes(["matches"], "SELECT season, count(*) AS n FROM matches GROUP BY season ORDER BY 2 DESC, 1 LIMIT 15"))
def prf_season(spark, sf_dir):
    return Q.season_rows(T.matches(spark, sf_dir))


@query("prf_day_examples", with_ctes(["matches"], """
SELECT * FROM (SELECT date, match_id, home, away, hg, ag, row_number() OVER (PARTITION BY date ORDER BY match_id) AS rank FROM matches
  WHERE date IN (SELECT date FROM matches GROUP BY date HAVING count(*) > 1 ORDER BY count(*) DESC, date LIMIT 5)) WHERE rank <= 8"""))
def prf_day_examples(spark, sf_dir):
    return Q.day_examples(T.matches(spark, sf_dir)).select("date", "match_id", "home", "away", "hg", "ag", "rank")


@query("prf_coverage", with_ctes(["matches"], f"""
SELECT level, value, count(*) AS matches, CAST(sum(hit) AS BIGINT) AS covered, {r('avg(hit)')} AS share FROM (
  SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM ref r WHERE r.season = m.season AND ((r.home = m.home AND r.away = m.away)
                               OR (r.home = m.away AND r.away = m.home))) THEN 1 ELSE 0 END AS hit FROM matches m) x,
  LATERAL (SELECT unnest(['overall', 'team', 'team', 'season']) AS level, unnest(['all', x.home, x.away, x.season]) AS value) l
GROUP BY level, value""", {"ref": "SELECT home, away, season FROM matches WHERE hg = 4 AND ag = 0"}))
def prf_coverage(spark, sf_dir):
    """Coverage of matches by pairs that saw a 4-0 in the season."""
    rows = T.matches(spark, sf_dir)
    out = Q.coverage(rows, rows.filter("hg = 4 and ag = 0"))
    return out.select("level", "value", "matches", "covered", F.round("share", 6).alias("share"))


@query("prf_source_health", f"""
SELECT source, {r('avg(ok) FILTER (n <= 10)')} AS success_rate, {r('avg(value) FILTER (n <= 10)')} AS avg_duration, count(*) AS total_runs, 10 AS recent_window
FROM (SELECT user_id AS source, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS ok, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY source""")
def prf_source_health(spark, sf_dir):
    runs = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration"), "ts", F.col("event_id").alias("run_id"))
    out = Q.source_health(runs)
    return out.select("source", F.round("success_rate", 6).alias("success_rate"),
                      F.round("avg_duration", 6).alias("avg_duration"), "total_runs", "recent_window")


_CANDIDATES = {"PPG5": "p5", "PPG10": "p10", "GD5": "g5", "GD10": "g10"}
_EXISTING = {"Form8": "f8", "GD8": "g8", "EWMA_F2": "ef2", "EWMA_F4": "ef4", "EWMA_GD2": "eg2", "EWMA_GD4": "eg4"}

_SIDED = {
    "w": """SELECT is_home, a.form AS p5, b.form AS p10, a.gf - a.ga AS g5, b.gf - b.ga AS g10, t.form AS f8, t.gf - t.ga AS g8,
      e.e2_Form AS ef2, e.e4_Form AS ef4, e.e2_GF - e.e2_GA AS eg2, e.e4_GF - e.e4_GA AS eg4
      FROM trail8 t JOIN trail5 a USING (match_id, is_home) JOIN trail10 b USING (match_id, is_home) JOIN ewma e USING (match_id, is_home)
      WHERE t.form IS NOT NULL""",
    "rs": " UNION ALL ".join(
        f"SELECT CASE WHEN is_home THEN 'home' ELSE 'away' END AS side, '{c}' AS candidate, '{o}' AS other, '{kind}' AS kind, abs(corr({x}, {y})) AS v FROM w GROUP BY is_home"
        for c, x in _CANDIDATES.items() for kind, group in (("existing", _EXISTING), ("candidate", _CANDIDATES)) for o, y in group.items() if o != c),
}
_BAND = "CASE WHEN v >= 0.95 THEN 'redundant' WHEN v >= 0.85 THEN 'marginal' ELSE 'incremental' END"


def _overlaps(spark, sf_dir) -> DataFrame:
    """Correlations of rolling windows with the existing form signals and with each other, for both sides."""
    rows = batched(spark, sf_dir)
    state = W.trailing_state(W.team_rows(rows), 8, halflives=(2, 4), rolling=(5, 10))
    cols = {"form": "Form8", "avg_gd": "GD8", "ewma2_form": "EWMA_F2", "ewma4_form": "EWMA_F4", "roll5_form": "PPG5",
            "roll10_form": "PPG10", "roll5_gd": "GD5", "roll10_gd": "GD10"}
    state = state.withColumns({f"EWMA_GD{h}": F.col(f"ewma{h}_gf") - F.col(f"ewma{h}_ga") for h in (2, 4)})
    cols = cols | {"EWMA_GD2": "EWMA_GD2", "EWMA_GD4": "EWMA_GD4"}
    state = materialize(state.select(*W.STATE_KEY, *cols))  # each side reads it more than once
    out = None
    for side in ("home", "away"):
        part = state.select("league", F.col("team").alias(side), "batch_ts", *[F.col(c).alias(n) for c, n in cols.items()])
        wide = rows.join(part, ["league", side, "batch_ts"]).dropna(subset=["Form8"])
        found = Q.feature_correlations(wide, [*_CANDIDATES, *_EXISTING])
        found = Q.overlap_report(found, list(_CANDIDATES), list(_EXISTING)).withColumn("side", F.lit(side))
        out = found if out is None else out.unionByName(found)
    return out


@query("prf_feature_overlap", with_ctes(["trail5", "trail8", "trail10", "ewma"], f"""
SELECT side, candidate, other, kind, round(v, 6) AS abs_r, {_BAND} AS band FROM rs""", _SIDED))
def prf_feature_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("side", "candidate", "other", "kind", F.round("abs_r", 6).alias("abs_r"), "band")


@query("prf_overlap_verdict", with_ctes(["trail5", "trail8", "trail10", "ewma"], f"""
SELECT side, candidate, round(v, 6) AS max_r, other AS nearest, {_BAND} AS verdict FROM (
  SELECT side, candidate, max(v) AS v, arg_max(other, v) AS other FROM rs WHERE kind = 'existing' GROUP BY side, candidate)""", _SIDED))
def prf_overlap_verdict(spark, sf_dir):
    """Per side and candidate, what it repeats most."""
    out = Q.overlap_verdicts(_overlaps(spark, sf_dir), "side")
    return out.select("side", "candidate", F.round("max_r", 6).alias("max_r"), "nearest", "verdict")


# --- statistic tables -----------------------------------------------------------

def stat_table(spark, sf_dir) -> DataFrame:
    """A scraped-looking table: rank prefixes, header repeats, dashes, empty columns."""
    head = F.col("k") % 50 == 0
    return cust(spark, sf_dir).select(
        F.when(head, "Team").otherwise(F.concat(F.col("k"), F.lit(". "), F.col("c_name"), F.lit(" (H)"))).alias("Team"),
        F.when(head, "MP").otherwise((F.col("k") % 38).cast("string")).alias("MP"),
        F.when(head, "GF").when(F.col("k") % 7 == 0, "-").otherwise((F.col("k") % 90).cast("string")).alias("GF"),
        F.when(head, "GA").otherwise(F.concat((F.col("k") % 60).cast("string"), F.lit(".5"))).alias("GA"),
        F.lit(None).cast("string").alias("Notes"), F.lit("n/a").alias("Extra"), F.col("k").cast("string").alias("Unnamed: 6"))


_CLEAN = """SELECT c_name AS "Squad", CAST(k % 38 AS DOUBLE) AS "MP", CASE WHEN k % 7 <> 0 THEN CAST(k % 90 AS DOUBLE) END AS "GF",
  k % 60 + CAST(0.5 AS DOUBLE) AS "GA" FROM cust WHERE k % 50 <> 0"""


@query("tbl_clean", with_ctes(["cust"], _CLEAN))
def tbl_clean(spark, sf_dir):
    return ST.clean_table(stat_table(spark, sf_dir))


@query("tbl_clean_enhanced", with_ctes(["cust"], _CLEAN.replace("c_name", "k || '. ' || c_name || ' (H)'")))
def tbl_clean_enhanced(spark, sf_dir):
    return ST.clean_table(stat_table(spark, sf_dir), "enhanced")


@query("tbl_clean_metrics", with_ctes(["cust"], f"SELECT *, CAST(NULL AS DOUBLE) AS \"Notes\", CAST(NULL AS DOUBLE) AS \"Extra\" FROM ({_CLEAN})"))
def tbl_clean_metrics(spark, sf_dir):
    return ST.clean_table(stat_table(spark, sf_dir), "metrics")


@query("tbl_key_col", with_ctes(["cust"], """
SELECT CASE WHEN k % 50 = 0 THEN 'Team' ELSE k || '. ' || c_name || ' (H)' END AS entity, 'Team' AS key_column FROM cust"""))
def tbl_key_col(spark, sf_dir):
    rows = stat_table(spark, sf_dir)
    name = ST.entity_column(rows, "enhanced")
    return rows.select(F.col(name).alias("entity"), F.lit(name).alias("key_column"))


@query("tbl_dedup_cols", with_ctes(["cust"], 'SELECT k AS "x", c_name AS "x_1", seg AS "x_2", n_name AS "y" FROM cust'))
def tbl_dedup_cols(spark, sf_dir):
    return ST.dedup_columns(cust(spark, sf_dir).select("k", "c_name", "seg", "n_name").toDF("x", "x", "x", "y"))


@query("tbl_kind", with_ctes(["cust"], "SELECT 'league_table' AS kind, 'league' AS metrics_kind, 'results' AS wide_kind, count(*) AS n FROM cust WHERE k % 50 <> 0"))
def tbl_kind(spark, sf_dir):
    rows = ST.clean_table(stat_table(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(ST.table_kind(rows.columns)).alias("kind"), F.lit(ST.table_kind(rows.columns, "metrics")).alias("metrics_kind"),
        F.lit(ST.table_kind(rows.columns, "enhanced")).alias("wide_kind"), "n")
