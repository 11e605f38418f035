"""Text outputs: prediction reports, fixture lists, importance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scores
from formline.functions import text as T

RULE = "=" * 60


def match_block() -> Column:
    """Report block of one scored fixture."""
    home = T.report_name(F.coalesce("Raw_Home", "HomeTeam"))
    away = T.report_name(F.coalesce("Raw_Away", "AwayTeam"))
    p_h, p_d, p_a = (F.col(f"Pred_Proba_{x}") for x in ("Home", "Draw", "Away"))
    market = scores.market_text(*(F.col(f"Shin_Prob_{x}") for x in "HDA"))
    return F.concat_ws(
        "\n", F.concat(F.lit("Match: "), home, F.lit(" vs "), away), scores.triple_text(p_a, p_d, p_h),
        F.concat(F.lit("Market Implied: "), market),
        F.concat(F.lit("Top Pick: "), scores.top_pick(p_h, p_d, p_a)), F.lit("---"))


def report_lines(scored: DataFrame, order: str, title: str = "PREDICCIONES") -> DataFrame:
    """(section, ord, value): header, one block per fixture, summary."""
    head = scored.sparkSession.range(1).select(
        F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"),
        F.lit(f"{RULE}\n  {title}\n{RULE}\n").alias("value"))
    body = scored.select(F.lit(1).alias("section"), F.col(order).cast("long").alias("ord"), match_block().alias("value"))
    foot = scored.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(2).alias("section"), F.lit(0).cast("long").alias("ord"),
        F.concat(F.lit(f"\n{RULE}\nRESUMEN\n{RULE}\nPartidos: "), F.col("n").cast("string")).alias("value"))
    return head.unionByName(body).unionByName(foot)


def fixture_lines(fixtures: DataFrame, order: str, label: str = "FECHA XX", home: str = "home",
                  away: str = "away") -> DataFrame:
    """(section, ord, value) of a fixture list with header and counter lines."""
    spark = fixtures.sparkSession
    head = spark.createDataFrame([(0, 0, label), (0, 1, "")], "section int, ord long, value string")
    named = fixtures.filter((F.coalesce(home, F.lit("")) != "") & (F.coalesce(away, F.lit("")) != ""))
    body = named.select(F.lit(1).alias("section"), F.col(order).cast("long").alias("ord"),
                        F.concat(F.col(home), F.lit(" - "), F.col(away), F.lit(":")).alias("value"))
    foot = spark.createDataFrame(
        [(2, 0, ""), (2, 1, "Cantidad de penales cobrados:"), (2, 2, "Cantidad de expulsados:"),
         (2, 3, "Cantidad de goles convertidos:")], "section int, ord long, value string")
    return head.unionByName(body).unionByName(foot)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered lines as text; a range sort keeps the part files in order."""
    lines.orderBy("section", "ord").select("value").write.mode("error").text(path)


def write_importance(table: DataFrame, path: str) -> None:
    table.orderBy(F.desc("importance"), "feature").write.mode("error").option("header", True).csv(path)
