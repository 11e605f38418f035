"""League standings from JSON documents of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import text as T
from formline.operators.entities import normalize_names

_NUMBERS = ["position", "points", "played", "won", "drawn", "lost", "goals_for", "goals_against", "goal_difference"]
_FLAT = ("name string, normalized string, " + ", ".join(f"{n} long" for n in _NUMBERS)
         + ", goalsFor long, goalsAgainst long, goalDifference long, rating double")
_ROW = ("team struct<name:string>, points long, matches long, played long, wins long, won long, draws long, "
        "drawn long, losses long, lost long, goalsFor long, goalsAgainst long, goal_difference long, goalDifference long")


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


DOCUMENT = (
    f"standings array<{_struct(_FLAT)}>, "
    f"teams array<{_struct(_FLAT)[:-1]}, standings:array<struct<rows:array<{_struct(_ROW)}>>>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): one row per standings document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def _first(*cols: Column) -> Column:
    return F.coalesce(*cols, F.lit(0))


def parse_standings(docs: DataFrame, glossary: DataFrame | None = None, doc: str = "file") -> DataFrame:
    """One row per document and team. Root standings come first, then the teams
    in order; a later entry for the same team replaces an earlier one."""
    parsed = docs.select(doc, F.from_json("json", DOCUMENT).alias("d")).filter(F.size("d.teams") > 0)
    x = F.col("x")
    root = parsed.select(doc, F.lit(0).alias("_a"), F.posexplode("d.standings").alias("_b", "x"))
    root = root.select(doc, "_a", "_b", F.lit(0).alias("_c"), F.lit(0).alias("_d"), x["normalized"].alias("name"),
                       *[_first(x[n]).alias(n) for n in _NUMBERS], F.lit(None).cast("double").alias("rating"))
    teams = parsed.select(doc, F.lit(1).alias("_a"), F.posexplode("d.teams").alias("_b", "x"))
    flat = teams.filter(x["standings"].isNull())
    alt = {"goals_for": "goalsFor", "goals_against": "goalsAgainst", "goal_difference": "goalDifference"}
    flat = flat.select(doc, "_a", "_b", F.lit(0).alias("_c"), F.lit(0).alias("_d"),
                       F.coalesce(F.when(x["name"] != "", x["name"]), x["normalized"]).alias("name"),
                       *[_first(x[n], *([x[alt[n]]] if n in alt else [])).alias(n) for n in _NUMBERS],
                       x["rating"].alias("rating"))
    tables = teams.select(doc, "_a", "_b", F.posexplode("x.standings").alias("_c", "t"))
    nested = tables.select(doc, "_a", "_b", "_c", F.posexplode("t.rows").alias("_d", "x"))
    nested = nested.select(
        doc, "_a", "_b", "_c", "_d", x["team"]["name"].alias("name"), (F.col("_d") + 1).cast("long").alias("position"),
        _first(x["points"]).alias("points"), _first(x["matches"], x["played"]).alias("played"),
        _first(x["wins"], x["won"]).alias("won"), _first(x["draws"], x["drawn"]).alias("drawn"),
        _first(x["losses"], x["lost"]).alias("lost"), _first(x["goalsFor"]).alias("goals_for"),
        _first(x["goalsAgainst"]).alias("goals_against"),
        _first(x["goal_difference"], x["goalDifference"]).alias("goal_difference"),
        F.lit(None).cast("double").alias("rating"))
    rows = root.unionByName(flat).unionByName(nested).filter(F.col("name") != "")
    rows = normalize_names(rows, "name", "team", glossary)
    latest = Window.partitionBy(doc, "team").orderBy(F.desc("_a"), F.desc("_b"), F.desc("_c"), F.desc("_d"))
    return (rows.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") == 1)
            .select(doc, "team", *_NUMBERS, "rating"))


_TEAM = ("name string, played long, won long, drawn long, lost long, goalsFor long, goalsAgainst long, "
         "goalDifference long, points long, position long")


def parse_raw_standings(items: DataFrame, doc: str = "item_id", json: str = "json") -> DataFrame:
    """Standings rows of raw feed items: the first present of ``standings``,
    ``table``, ``teams`` and ``data`` (a list or one object), else the item itself."""
    path = None
    for key in ("standings", "table", "teams", "data"):
        part = F.get_json_object(json, f"$.{key}")
        path = part if path is None else F.coalesce(path, part)
    body = F.coalesce(path, F.col(json))
    listed = F.when(F.ltrim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = items.select(doc, F.posexplode(F.from_json(listed, f"array<{_struct(_TEAM)}>")).alias("row", "t"))
    t = F.col("t")
    count = {"played": "played", "won": "won", "drawn": "drawn", "lost": "lost", "goals_for": "goalsFor",
             "goals_against": "goalsAgainst", "goal_difference": "goalDifference", "points": "points",
             "position": "position"}
    return rows.select(doc, "row", F.coalesce(t["name"], F.lit("")).alias("team"),
                       T.feed_club(F.coalesce(t["name"], F.lit(""))).alias("normalized"),
                       *[_first(t[s]).alias(n) for n, s in count.items()])
