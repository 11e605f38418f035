"""Batches, form windows, ratings: against plain walks, and under changes."""

import pytest
from pyspark.sql import functions as F

from formline.operators import ratings, windows as W
from formline.operators.batching import assign_batches, prepare_batches
from formline.plans.features import build_features, goal_features
from helpers import MATCH, elo_walk, form_walk, margin_walk, match, random_matches


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCH)


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.fixture(scope="module")
def sample():
    return random_matches(400, seed=7)


def test_form_equals_walk(spark, sample):
    batched = assign_batches(frame(spark, sample))
    base = {r["match_id"]: r for r in W.with_trailing(batched).collect()}
    ewma = {r["match_id"]: r for r in W.with_ewma(batched, (2,)).collect()}
    roll = {r["match_id"]: r for r in W.with_rolling(batched).collect()}
    venue = {r["match_id"]: r for r in W.with_venue(batched).collect()}
    want = form_walk(sample)
    assert len(base) == len(ewma) == len(roll) == len(venue) == len(want) == 400
    for i, sides in want.items():
        for side, name in (("home", "Home"), ("away", "Away")):
            w = sides[side]
            assert near(base[i][f"{name}_Avg_GF"], w["all"]["gf"]) and near(base[i][f"{name}_Form"], w["all"]["form"])
            assert base[i][f"{name}_Matches"] == w["all"]["n"]
            assert near(ewma[i][f"{name}_EWMA2_Form"], w["ewma"])
            assert near(roll[i][f"{name}_Roll5_Form"], w["r5"]["form"])
            assert near(venue[i][f"{name}_Venue_GA"], w["venue"]["ga"])


def test_attack_defence_equals_walk(spark, sample):
    got = {r["match_id"]: r for r in W.with_attack_defence(assign_batches(frame(spark, sample))).collect()}
    for i, sides in form_walk(sample).items():
        assert near(got[i]["DC_Home_Att"], sides["home"]["venue"]["gf"])
        assert near(got[i]["DC_Away_Def"], sides["away"]["venue"]["ga"])


def test_crowded_batch_keeps_order(spark):
    """More matches of one team in a batch than the window holds."""
    rows = [match(i, "2024-01-01", None, "A", f"B{i:02d}", i % 5, i % 3) for i in range(30)]
    rows += [match(100 + i, "2024-02-01", None, "A", f"B{i:02d}", 1, 0) for i in range(12)]
    rows += [match(200, "2024-03-01", "15:00", "A", "B00", 0, 0), match(201, "2024-03-01", "15:00", "B01", "A", 0, 0)]
    batched = assign_batches(frame(spark, rows))
    got = {r["match_id"]: r for r in W.with_trailing(batched).collect()}
    venue = {r["match_id"]: r for r in W.with_venue(batched).collect()}
    for i, sides in form_walk(rows).items():
        assert near(got[i]["Home_Avg_GF"], sides["home"]["all"]["gf"]), i
        assert near(venue[i]["Away_Venue_GF"], sides["away"]["venue"]["gf"]), i


def test_latest_uses_all_matches(spark, sample):
    got = {(r["league"], r["team"]): r for r in W.latest_state(assign_batches(frame(spark, sample))).collect()}
    assert all(1 <= r["matches"] <= 8 for r in got.values())
    rows = [match(1, "2024-01-01", "15:00", "A", "B", 2, 0), match(2, "2024-01-08", "15:00", "B", "A", 3, 1)]
    last = {r["team"]: r for r in W.latest_state(assign_batches(frame(spark, rows))).collect()}
    assert last["A"]["avg_gf"] == 1.5 and last["A"]["avg_ga"] == 1.5 and last["A"]["form"] == 1.5 and last["B"]["matches"] == 2


@pytest.mark.parametrize("chunk_rows", [200_000, 17])
def test_elo_equals_walk(spark, sample, chunk_rows):
    batched = assign_batches(frame(spark, sample))
    walk = ratings.EloWalk(batched, chunk_rows)
    got = W.attach_state(batched, walk.before(), {"elo": "h"}, {"elo": "a"}).collect()
    before, final = elo_walk(sample)
    assert len(got) == len(before)
    for r in got:
        assert near(r["h"], before[r["match_id"]][0]) and near(r["a"], before[r["match_id"]][1])
    ends = {(r["league"], r["team"]): r["elo"] for r in walk.final().collect()}
    assert ends.keys() == final.keys() and all(near(ends[k], final[k]) for k in final)


@pytest.mark.parametrize("chunk_rows", [200_000, 23])
def test_margin_ratings_equal_walk(spark, chunk_rows):
    rows = random_matches(300, seed=3)
    got = ratings.margin_ratings(assign_batches(frame(spark, rows)), chunk_rows).collect()
    want = margin_walk(rows)
    assert len(got) == len(want)
    for r in got:
        assert all(near(x, y) for x, y in zip(
            (r["home_before"], r["away_before"], r["home_after"], r["away_after"]), want[r["match_id"]]))


def test_repeated_results_count(spark):
    """Equal pairs and results of one batch are walked as one counted row."""
    rows = [match(i, "2024-01-01", None, "A", "B", 1, 0) for i in range(4)] + [match(9, "2024-02-01", None, "A", "B", 0, 0)]
    batched = assign_batches(frame(spark, rows))
    assert ratings.counted_results(batched).count() == 2
    got = W.attach_state(batched, ratings.EloWalk(batched).before(), {"elo": "h"}, {"elo": "a"})
    last = got.filter("match_id = 9").first()
    want = elo_walk(rows)[0][9]
    assert near(last["h"], want[0]) and near(last["a"], want[1])


def test_three_match_elo(spark):
    rows = [match(1, "2024-01-01", None, "A", "B", 1, 0), match(2, "2024-01-08", None, "B", "A", 0, 1),
            match(3, "2024-01-15", None, "A", "B", 1, 0)]
    ends = {r["team"]: r["elo"] for r in ratings.EloWalk(assign_batches(frame(spark, rows))).final().collect()}
    assert ends["A"] == pytest.approx(1538.87, abs=0.01) and ends["B"] == pytest.approx(1461.13, abs=0.01)


# --- changes that must, or must not, reach a match ---------------------------------

BASE = [
    match(1, "2024-01-01", "15:00", "A", "B", 2, 0), match(2, "2024-01-08", "15:00", "A", "C", 1, 1),
    match(3, "2024-01-08", "15:00", "B", "D", 0, 3), match(4, "2024-01-08", "18:00", "A", "D", 2, 2),
    match(5, "2024-01-15", "00:30", "A", "B", 1, 0), match(6, "2024-01-15", "20:00", "B", "C", 4, 0),
    match(7, "2024-01-22", "20:00", "C", "A", 0, 0),
]
SEEN = ["Home_Elo", "Away_Elo", "Home_Avg_GF", "Away_Avg_GF", "Home_Form", "Away_Form", "xG_home", "Poisson_Draw"]


def seen(spark, rows):
    return {r["match_id"]: tuple(round(r[c], 9) for c in SEEN) for r in goal_features(frame(spark, rows)).collect()}


def changed(row, hg, ag):
    return match(row[0], str(row[3]), row[4], row[5], row[6], hg, ag)


@pytest.fixture(scope="module")
def base_seen(spark):
    return seen(spark, BASE)


def test_peer_result_stays_unseen(spark, base_seen):
    rows = [changed(r, 9, 0) if r[0] == 3 else r for r in BASE]
    got = seen(spark, rows)
    assert got[2] == base_seen[2] and got[3] == base_seen[3] and got[4] != base_seen[4]


def test_future_stays_unseen(spark, base_seen):
    got = seen(spark, [changed(r, 0, 9) if r[0] == 7 else r for r in BASE])
    assert got == base_seen


def test_input_order_is_irrelevant(spark, base_seen):
    assert seen(spark, BASE[::-1]) == base_seen


def test_midnight_row_batches_the_day(spark, base_seen):
    rows = prepare_batches(frame(spark, BASE)).orderBy("row_no").collect()
    day = [r for r in rows if str(r["date"]) == "2024-01-15"]
    assert len({r["batch_ts"] for r in day}) == 1 and all(r["whole_day"] for r in day)
    assert [r["row_no"] for r in rows] == list(range(7))
    got = seen(spark, [changed(r, 0, 5) if r[0] == 5 else r for r in BASE])
    assert got[6] == base_seen[6] and got[7] != base_seen[7]


def test_missing_date_stops(spark):
    row = match(1, "2024-01-01", None, "A", "B", 1, 0)
    with pytest.raises(Exception, match="parseable date"):
        assign_batches(frame(spark, [row[:3] + (None,) + row[4:]])).collect()


def test_feature_frame_is_complete(spark):
    rows = frame(spark, random_matches(60, seed=5)).withColumns({o: F.lit(3.0) for o in ("odds_h", "odds_d", "odds_a")})
    out = build_features(rows)
    from formline.constants import FEATURE_COLUMNS
    assert out.count() == 60 and out.dropna(subset=FEATURE_COLUMNS).count() == 60


def test_segments(spark):
    rows = [match(1, "2024-01-01", None, "A", "B", 1, 0, season="1"), match(2, "2024-01-20", None, "A", "B", 1, 0, season="1"),
            match(3, "2024-02-15", None, "A", "B", 1, 0, season="1"), match(4, "2024-02-20", None, "A", "B", 1, 0, season="2")]
    got = W.season_segments(frame(spark, rows)).orderBy("date").collect()
    assert [r["segment"] for r in got] == [0, 0, 1, 2] and [r["first_row"] for r in got] == [0, 1, 2, 3]
