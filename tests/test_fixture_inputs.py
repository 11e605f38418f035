"""What fixtures are scored with: standings, latest form and ratings."""

from datetime import date

from formline.catalog import shared, text
from formline.operators import ratings, windows as W
from formline.operators.batching import assign_batches


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_standings_take_the_season_along_without_joining_the_matches_again(spark, sf_dir):
    rows = text.standings_rows(spark, sf_dir)
    assert plan(rows).count("Join") <= 1  # the calendar's
    assert rows.agg({"played": "sum"}).first()[0] == 2 * spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_latest_form_orders_only_the_days_that_reach_the_window(spark):
    """Ten days of two matches: of 40 team rows, those of the last four days are ordered; ties of a day at the border are whole."""
    rows = [(i, "L", "2024", date(2024, 1, 1 + i // 2), None, "a", "b", i % 3, 1, 0, 2.0, 3.0, 4.0) for i in range(20)]
    names = "match_id long, league string, season string, date date, kickoff string, home string, away string, hg int, ag int, res int, odds_h double, odds_d double, odds_a double"
    batched = assign_batches(spark.createDataFrame(rows, names))
    got = {r["team"]: r for r in W.latest_state(batched, 7).collect()}
    last = [i % 3 for i in range(13, 20)]
    assert got["a"]["matches"] == 7 and abs(got["a"]["avg_gf"] - sum(last) / 7) < 1e-12 and abs(got["b"]["avg_ga"] - sum(last) / 7) < 1e-12
    assert "LeftSemi" in plan(W.latest_state(batched, 7))


def test_ratings_of_features_and_fixtures_are_walked_once(spark, sf_dir, monkeypatch):
    walked = []
    monkeypatch.setattr(ratings.EloWalk, "__init__", lambda self, *a, real=ratings.EloWalk.__init__, **k: walked.append(1) or real(self, *a, **k))
    monkeypatch.setattr(shared, "stored_once", lambda spark, build, *key, cache={}, **_: cache[key] if key in cache else cache.setdefault(key, build()))
    from formline.catalog import models
    shared.placed_features(spark, sf_dir)
    models._fixture_inputs(spark, sf_dir)
    assert len(walked) == 1
