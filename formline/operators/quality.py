"""Validation and profiling: one pass of conditional aggregates per table.

Checks come out as rows (check, severity, n_bad, message); a table is valid when
no error row has a positive count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import text as T
from formline.operators import folded


def _report(row: DataFrame, checks: list[tuple[str, str, Column, Column]], carry: tuple[str, ...] = ()) -> DataFrame:
    """Turn one aggregate row into check rows."""
    items = [F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"),
                      n.cast("long").alias("n_bad"), message.alias("message"))
             for name, severity, n, message in checks]
    return row.select(*carry, F.inline(F.array(*items)))


def _note(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _team_count(teams: DataFrame, name: str) -> DataFrame:
    return _report(teams.agg(F.count_distinct("t").alias("n")), [(name, "stat", F.col("n"), F.lit("distinct teams"))])


def validate_glossary(glossary: DataFrame) -> DataFrame:
    key, value = F.col("variant"), F.col("target")
    row = glossary.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(key, F.lit("")) == "").alias("bad_key"),
        F.count_if(F.coalesce(value, F.lit("")) == "").alias("bad_value"),
        F.count_if(F.trim(T.upper(key)) == F.trim(T.upper(value))).alias("self"))
    return _report(row, [
        ("empty", "error", (F.col("total") == 0).cast("int"), F.lit("glossary is empty")),
        ("bad_key", "error", F.col("bad_key"), F.lit("invalid keys")),
        ("bad_value", "error", F.col("bad_value"), F.lit("invalid values")),
        ("self_mapping", "warning", F.col("self"), F.lit("entries map to themselves")),
        ("total_mappings", "stat", F.col("total"), F.lit("entries"))])


VALID_RESULTS = ["0", "1", "2", "A", "D", "H"]


def validate_history(matches: DataFrame, home: str = "home", away: str = "away", res: str = "res",
                     date: str = "date", hg: str | None = "hg", ag: str | None = "ag") -> DataFrame:
    """All checks of a match history in one scan. Distinct teams, and the invalid
    result codes as one row each, come from pre-aggregated scans of their own."""
    missing = [c for c in (home, away, res, date) if c not in matches.columns]
    if missing:
        return matches.sparkSession.range(1).select(
            F.lit("columns").alias("check"), F.lit("error").alias("severity"),
            F.lit(len(missing)).cast("long").alias("n_bad"),
            F.lit("missing required columns: " + ", ".join(missing)).alias("message"))
    code = F.col(res).cast("string")
    odd = F.coalesce(~code.isin(VALID_RESULTS), F.lit(False))
    day = F.col(date).try_cast("date")
    negative = [F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in (hg, ag) if c]
    teams = matches.select(F.explode(F.array(home, away)).alias("t")).filter(F.col("t").isNotNull())
    row = matches.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (home, away, res)],
        F.count_if(odd).alias("odd"),
        F.count_if(F.col(date).isNotNull() & day.isNull()).alias("bad_date"),
        F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last"), *negative)
    checks = [("empty", "error", (F.col("total") == 0).cast("int"), F.lit("history is empty"))]
    checks += [(f"null_{c}", "error", F.col(f"null_{c}"), F.lit(f"missing values in {c}")) for c in (home, away, res)]
    checks += [("result_codes", "error", F.col("odd"), F.lit("rows with invalid codes")),
               ("dates", "error", F.col("bad_date"), F.lit("unparseable dates"))]
    checks += [(f"negative_{c}", "error", F.col(f"neg_{c}"), F.lit(f"negative values in {c}")) for c in (hg, ag) if c]
    checks.append(("total_matches", "stat", F.col("total"),
                   _note(F.coalesce("first", F.lit("-")), " to ", F.coalesce("last", F.lit("-")))))
    codes = matches.filter(odd).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit("result_code").alias("check"), F.lit("detail").alias("severity"), "n_bad", F.col("code").alias("message"))
    return _report(row, checks).unionByName(_team_count(teams, "teams")).unionByName(codes)


def validate_fixtures(fixtures: DataFrame, home: str = "home", away: str = "away") -> DataFrame:
    teams = fixtures.select(F.explode(F.array(home, away)).alias("t")).filter(F.col("t").isNotNull())
    row = fixtures.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(home).isNull()).alias("no_home"),
        F.count_if(F.col(away).isNull()).alias("no_away"),
        F.count_if(T.upper(F.col(home)) == T.upper(F.col(away))).alias("same"))
    return _report(row, [
        ("empty", "warning", (F.col("total") == 0).cast("int"), F.lit("no fixtures")),
        ("null_home", "error", F.col("no_home"), F.lit("fixtures without home team")),
        ("null_away", "error", F.col("no_away"), F.lit("fixtures without away team")),
        ("identical", "warning", F.col("same"), F.lit("fixtures of a team against itself")),
        ("total_fixtures", "stat", F.col("total"), F.lit("fixtures"))]).unionByName(_team_count(teams, "unique_teams"))


# --- Fixed values: feature bounds, by exact column -----------------------------
BOUNDS = {c: (K.ELO_MIN, K.ELO_MAX) for c in ("Home_Elo", "Away_Elo")} | {
    c: (0.0, 3.0) for c in ("Home_Form", "Away_Form")} | {
    c: (0.0, 1.0) for c in ("Poisson_Home_Win", "Poisson_Draw", "Poisson_Away_Win",
                            "Shin_Prob_H", "Shin_Prob_D", "Shin_Prob_A")}
MAX_NULL_SHARE = 0.1


def validate_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: nulls, infinities and values out of bounds, in one scan."""
    missing = [c for c in columns if c not in features.columns]
    if missing:
        return features.sparkSession.range(1).select(
            F.lit("columns").alias("check"), F.lit("error").alias("severity"),
            F.lit(len(missing)).cast("long").alias("n_bad"),
            F.lit("missing features: " + ", ".join(missing)).alias("message"))

    def absent(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))

    infinite = F.lit(float("inf"))
    aggs, checks = [F.count(F.lit(1)).alias("total")], []
    for c in columns:
        aggs += [F.count_if(absent(c)).alias(f"nul_{c}"), F.count_if(F.abs(F.col(c)) == infinite).alias(f"inf_{c}")]
        many = F.col(f"nul_{c}") > F.col("total") * MAX_NULL_SHARE
        checks += [(f"nulls:{c}", "warning", F.col(f"nul_{c}"), F.lit("null values")),
                   (f"many_nulls:{c}", "error", many.cast("int"), F.lit("more than 10% null")),
                   (f"infinite:{c}", "error", F.col(f"inf_{c}"), F.lit("infinite values"))]
        if c in BOUNDS:
            low, high = BOUNDS[c]
            aggs.append(F.count_if(~absent(c) & ((F.col(c) < low) | (F.col(c) > high))).alias(f"out_{c}"))
            checks.append((f"bounds:{c}", "warning", F.col(f"out_{c}"), F.lit(f"values outside [{low:g}, {high:g}]")))
    checks.insert(0, ("empty", "error", (F.col("total") == 0).cast("int"), F.lit("no feature rows")))
    checks.append(("total_samples", "stat", F.col("total"), F.lit(f"rows with {len(columns)} features")))
    return _report(features.agg(*aggs), checks)


def validate_all(reports: dict[str, DataFrame]) -> DataFrame:
    """One row: whether all reports are free of errors, and their messages."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in reports.items()])
    bad = (F.col("severity") == "error") & (F.col("n_bad") > 0)
    text = F.when(bad, _note(F.col("source"), ".", F.col("check"), ": ", F.col("n_bad").cast("string"), " ", F.col("message")))
    return rows.agg((~F.bool_or(bad)).alias("is_valid"), F.count_if(bad).alias("n_errors"),
                    F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("errors"))


def require_rows(df: DataFrame, minimum: int) -> DataFrame:
    """Row count, or a failed job when it is below the minimum."""
    n = F.col("n_rows")
    short = F.raise_error(F.concat(F.lit(f"expected at least {minimum} rows, got "), n.cast("string"))).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.when(n < minimum, short).otherwise(n).alias("n_rows"))


def duplicate_keys(df: DataFrame, keys=("date", "home", "away")) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def matches_per_day(matches: DataFrame, date: str = "date") -> DataFrame:
    return matches.groupBy(date).agg(F.count(F.lit(1)).alias("matches"))


def day_profile(matches: DataFrame, date: str = "date") -> DataFrame:
    """Same-day crowding of a match table, one row. Unparseable dates are null."""
    n, d = F.col("matches"), F.col(date)
    known = d.isNotNull()
    return matches_per_day(matches, date).agg(
        F.sum("matches").alias("total_rows"), F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("unparseable_dates"),
        F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count_if(known).alias("unique_dates"),
        F.count_if(known & (n > 1)).alias("dates_with_multiple"), F.count_if(known & (n >= 3)).alias("dates_with_3plus"),
        F.max(F.when(known, n)).alias("max_on_one_date"))


def busiest_days(matches: DataFrame, top: int = 10, date: str = "date") -> DataFrame:
    """The dates with most matches (several at least); earlier dates first on ties."""
    days = matches_per_day(matches.filter(F.col(date).isNotNull()), date).filter(F.col("matches") > 1)
    return days.orderBy(F.desc("matches"), date).limit(top)


def time_quality(matches: DataFrame, kickoff: str = "kickoff") -> DataFrame:
    """Share of non-empty and of time-like kickoffs; usable above one half."""
    text = F.trim(F.coalesce(F.col(kickoff), F.lit("")))
    filled = ((text != "") & (F.lower(text) != "nan")).cast("double")
    timed = text.rlike(r"^\d{1,2}[:.]\d{2}").cast("double")
    return (matches.agg(F.round(F.avg(filled), 4).alias("nonempty_fraction"), F.round(F.avg(timed), 4).alias("parseable_fraction"))
            .withColumn("usable", F.col("nonempty_fraction") > 0.5))


def season_rows(matches: DataFrame, top: int = 15) -> DataFrame:
    return (matches.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "season").limit(top))


def day_examples(matches: DataFrame, days: int = 5, rows: int = 8, row_id: str = "match_id") -> DataFrame:
    """The first rows of each of the busiest dates. The rank filter runs before
    the shuffle, so a crowded date sends only ``rows`` rows per map task."""
    top = busiest_days(matches, days).select("date")
    w = Window.partitionBy("date").orderBy(row_id)
    return (matches.join(top, "date", "left_semi").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= rows))


def coverage(matches: DataFrame, reference: DataFrame, keys=("home", "away", "season")) -> DataFrame:
    """Share of matches whose pair and season occur, in either order, in a
    reference list: overall, per team and per season.

    Matches are counted per key before the join, and both lists are distinct, so
    a key that holds a third of the matches is one row.
    """
    home, away, season = keys
    listed = reference.select(F.col(home).alias("a"), F.col(away).alias("b"), F.col(season).alias("s")).distinct()
    either = listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).distinct()
    pairs = matches.groupBy(F.col(home).alias("a"), F.col(away).alias("b"), F.col(season).alias("s")).agg(
        F.count(F.lit(1)).alias("n"))
    marked = pairs.join(either.withColumn("hit", F.lit(1)), ["a", "b", "s"], "left").withColumn(
        "covered", F.col("n") * F.coalesce("hit", F.lit(0)))
    levels = F.array(F.struct(F.lit("overall").alias("level"), F.lit("all").alias("value")),
                     F.struct(F.lit("team").alias("level"), F.col("a").alias("value")),
                     F.struct(F.lit("team").alias("level"), F.col("b").alias("value")),
                     F.struct(F.lit("season").alias("level"), F.col("s").alias("value")))
    rows = marked.select("n", "covered", F.inline(levels))
    out = rows.groupBy("level", "value").agg(F.sum("n").alias("matches"), F.sum("covered").alias("covered"))
    return out.withColumn("share", F.col("covered") / F.col("matches"))


def source_health(runs: DataFrame, window: int = 10) -> DataFrame:
    """Success rate and mean duration of each source's last runs, and its run
    count. Runs: source, success, duration, ts, run_id.

    The rank filter runs before the shuffle, and counts are combined map-side, so
    a source with a third of all runs stays small.
    """
    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("run_id"))
    recent = (runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window).groupBy("source").agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("duration").alias("avg_duration")))
    totals = runs.groupBy("source").agg(F.count(F.lit(1)).alias("total_runs"))
    return totals.join(recent, "source").withColumn("recent_window", F.lit(window))


def feature_overlap(df: DataFrame, candidates: list[str], existing: list[str]) -> DataFrame:
    """|r| of every candidate with every existing feature, all in one aggregate."""
    pairs = [(c, e) for c in candidates for e in existing]
    row = df.agg(*[F.abs(F.corr(c, e)).alias(f"r{i}") for i, (c, e) in enumerate(pairs)])
    out = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.lit(e).alias("existing"), F.col(f"r{i}").alias("abs_r"))
        for i, (c, e) in enumerate(pairs)])))
    return out.withColumn("band", _overlap_band(F.col("abs_r")))


def feature_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, n, r`` of every two columns, over the rows where both are present.

    Tasks add up the products of their rows as matrices, about the first row found; the sums are reduced by cell, so
    their size depends on the number of columns only. A column that does not vary has r null.
    """
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    first = rows.first()
    about = np.array([0.0 if v is None else v for v in (first["x"] if first else [0.0] * len(columns))])
    k = len(columns)

    def part(batch):
        x = folded.matrix(batch.column("x")) - about
        there = ~np.isnan(x)
        x, m = np.where(there, x, 0.0), there.astype(float)
        return np.concatenate([g.ravel() for g in (m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m)])

    n, s, xy, xx = folded.summed(rows, part, 4 * k * k).reshape(4, k, k)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            if n[i, j]:
                top = xy[i, j] - s[i, j] * s[j, i] / n[i, j]
                left, right = xx[i, j] - s[i, j] ** 2 / n[i, j], xx[j, i] - s[j, i] ** 2 / n[i, j]
                flat = left <= 1e-12 * max(xx[i, j], 1e-300) or right <= 1e-12 * max(xx[j, i], 1e-300)
                out.append((columns[i], columns[j], int(n[i, j]), None if flat else float(top / np.sqrt(left * right))))
    return df.sparkSession.createDataFrame(out, "a string, b string, n long, r double")


def overlap_report(correlations: DataFrame, candidates: list[str], existing: list[str]) -> DataFrame:
    """``candidate, other, kind, abs_r, band`` of every candidate with existing features and with other candidates."""
    both = correlations.select("a", "b", "r").unionByName(correlations.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    kind = F.when(F.col("b").isin(existing), "existing").when(F.col("b").isin(candidates), "candidate")
    out = both.where(F.col("a").isin(candidates)).withColumn("kind", kind).where(F.col("kind").isNotNull())
    out = out.select(F.col("a").alias("candidate"), F.col("b").alias("other"), "kind", F.abs("r").alias("abs_r"))
    return out.withColumn("band", _overlap_band(F.col("abs_r")))


def overlap_verdicts(report: DataFrame, *keys: str) -> DataFrame:
    """The existing feature each candidate repeats most, and the verdict by that maximum."""
    best = report.where((F.col("kind") == "existing") & F.col("abs_r").isNotNull()).groupBy(*keys, "candidate").agg(
        F.max("abs_r").alias("max_r"), F.max_by("other", "abs_r").alias("nearest"))
    return best.withColumn("verdict", _overlap_band(F.col("max_r")))


def _overlap_band(r: Column) -> Column:
    return F.when(r >= 0.95, "redundant").when(r >= 0.85, "marginal").otherwise("incremental")
