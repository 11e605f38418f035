"""Costs of the row kernels that every feature table pays."""

import re

import pytest
from pyspark.sql import functions as F

from formline.functions import scores

#: Longer generated methods are interpreted.
LARGEST_METHOD = 8000


def match_rows(spark):
    texts = [F.lit("x").alias(c) for c in ("league", "date", "season", "kickoff", "home", "away")]
    team = [(F.col("id") % 7 + k).cast("double").alias(f"{side}_{c}")
            for side in ("Home", "Away") for k, c in enumerate(("Elo", "Avg_GF", "Avg_GA", "Avg_GD", "Form", "Matches"))]
    odds = [F.when(F.col("id") % 3 != 0, 1.5 + F.col("id") % k / 10).alias(c) for c, k in (("odds_h", 17), ("odds_d", 7), ("odds_a", 23))]
    return spark.range(300).select(F.col("id").alias("match_id"), *texts, *odds, *team)


def plan_text(df):
    execution = df._jdf.queryExecution()
    return execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))


def test_feature_kernels_are_small_enough_to_be_compiled(spark):
    rows = scores.with_shin(scores.with_balances(scores.with_poisson_features(match_rows(spark))))
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan_text(rows))]
    assert sizes and max(sizes) < LARGEST_METHOD


def test_market_roots_are_not_searched_by_an_interpreted_expression(spark):
    rows = scores.with_shin(match_rows(spark))
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.where("odds_h is not null").collect():
        assert r["Shin_Prob_H"] + r["Shin_Prob_D"] + r["Shin_Prob_A"] == pytest.approx(1, abs=1e-12)


def test_market_roots_of_infinite_odds(spark):
    odd = spark.createDataFrame([(float("inf"), 1.5, 1.5)], "odds_h double, odds_d double, odds_a double")
    r = scores.with_shin(odd).first()
    assert (r["Shin_Prob_H"], r["Shin_Prob_D"], r["Shin_Prob_A"]) == pytest.approx((0, 0.5, 0.5), abs=1e-9)
