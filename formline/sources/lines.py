"""Line-oriented feeds: glossaries, link lists, fixture lists.

Each parser takes a frame of lines and returns rows; ``files.read_lines`` numbers the
lines of text files of any size. All parsing is native expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import text as T
from formline.operators.entities import normalize_names
from formline.sources.files import read_lines  # noqa: F401


def _split_entry(line):
    """(key, target) around the first of ``->``, ``=``, ``:`` tried in that order."""
    sep = F.when(line.contains("->"), "->").when(line.contains("="), "=").when(line.contains(":"), ":")
    at = F.instr(line, "->")
    at = F.when(sep == "->", at).when(sep == "=", F.instr(line, "=")).otherwise(F.instr(line, ":"))
    key = F.trim(F.substring(line, F.lit(1), at - 1))
    target = F.trim(F.substring(line, at + F.length(sep), F.length(line)))
    return sep, key, target


def parse_glossary(lines: DataFrame, ord_col: str = "pos", plain: bool = False) -> DataFrame:
    """(variant, target, ord): one row per variant, the last line wins.

    ``plain`` is the report-side reading: no comment strip, upper case only. As
    in an ordered map, a variant keeps the place of its first line.
    """
    rows = lines.select(F.col(ord_col).alias("ord"), F.trim("line").alias("line"))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    sep, key, target = _split_entry(F.col("line"))
    rows = rows.select("ord", sep.alias("sep"), key.alias("key"), target.alias("target")).filter(F.col("sep").isNotNull())
    if plain:
        rows = rows.select("ord", T.upper(F.col("key")).alias("variant"), T.upper(F.col("target")).alias("target"))
    else:
        bare = F.trim(F.substring_index("target", "#", 1))
        rows = rows.select("ord", T.canonical(F.col("key")).alias("variant"), T.canonical(bare).alias("target"))
        rows = rows.filter((F.col("variant") != "") & (F.col("target") != ""))
    return rows.groupBy("variant").agg(
        F.max_by("target", "ord").alias("target"), F.min("ord").alias("ord"))


def raw_targets(lines: DataFrame) -> DataFrame:
    """Distinct targets as written, for name audits."""
    rows = lines.select(F.trim("line").alias("line"))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    sep, _, target = _split_entry(F.col("line"))
    return rows.select(sep.alias("sep"), target.alias("target")).filter(F.col("sep").isNotNull()).select("target").distinct()


def parse_links(lines: DataFrame, ord_col: str = "pos") -> DataFrame:
    """(name, url, club_id) of ``Name -> URL (id)`` lines; the last line wins."""
    line = F.trim("line")
    rows = lines.select(F.col(ord_col).alias("ord"), line.alias("line"))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("->"))
    at = F.instr("line", "->")
    rows = rows.select("ord", T.canonical(F.substring(F.col("line"), F.lit(1), at - 1)).alias("name"),
                       F.trim(F.substring(F.col("line"), at + 2, F.length("line"))).alias("rest"))
    pattern = r"^(https?://\S+)\s*\((\d+)\)?$"
    tagged = F.col("rest").rlike(pattern)
    rows = rows.select(
        "ord", "name",
        F.when(tagged, F.regexp_extract("rest", pattern, 1)).otherwise(F.col("rest")).alias("url"),
        F.when(tagged, F.regexp_extract("rest", pattern, 2).cast("long")).alias("club_id"))
    return rows.groupBy("name").agg(
        F.max_by(F.struct("url", "club_id"), "ord").alias("_last")).select("name", "_last.url", "_last.club_id")


def lookup_links(names: DataFrame, column: str, links: DataFrame) -> DataFrame:
    """Link and id of every name; unknown names and missing ids stay null."""
    keyed = names.withColumn("_key", T.canonical(F.col(column)))
    known = links.select(F.col("name").alias("_key"), "url", F.when(F.col("club_id") >= 0, F.col("club_id")).alias("club_id"))
    return keyed.join(known, "_key", "left").drop("_key")


COUNTERS = {"penales": "CANTIDAD DE PENALES", "expulsados": "CANTIDAD DE EXPULSADOS", "goles": "CANTIDAD DE GOLES"}
SCORE = r"(\d+)\s*[-:]\s*(\d+)"


def classify_fixture_lines(lines: DataFrame) -> DataFrame:
    """Add ``kind``: header, one of the counters, or match."""
    upper = F.upper("line")
    kind = F.when(upper.startswith("FECHA"), "header")
    for name, mark in COUNTERS.items():
        kind = kind.when(upper.startswith(mark), name)
    rows = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return rows.withColumn("kind", kind.otherwise("match"))


def parse_fixtures(lines: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Fixture rows: raw and normalised teams, and the score when one is given."""
    rows = classify_fixture_lines(lines).filter(F.col("kind") == "match")
    scored = F.col("line").rlike(SCORE)
    rows = rows.withColumns({
        "Home_Score": F.when(scored, F.regexp_extract("line", SCORE, 1).cast("int")),
        "Away_Score": F.when(scored, F.regexp_extract("line", SCORE, 2).cast("int")),
        "_left": F.trim(F.regexp_replace("line", SCORE, "")),
    })
    parts = F.split(F.regexp_replace("_left", r"[: ]+$", ""), "[-–]")
    rows = rows.withColumn("_parts", parts).filter(F.size("_parts") == 2)
    rows = rows.withColumns({"Raw_Home": F.trim(F.col("_parts")[0]), "Raw_Away": F.trim(F.col("_parts")[1])})
    rows = rows.drop("_left", "_parts", "kind", "line")
    rows = normalize_names(rows, "Raw_Home", "HomeTeam", glossary)
    return normalize_names(rows, "Raw_Away", "AwayTeam", glossary)


def fixture_summary(lines: DataFrame, doc: str = "file", pos: str = "pos") -> DataFrame:
    """Header line and counters of each document; the last line of a kind wins."""
    rows = classify_fixture_lines(lines).withColumn("_num", F.regexp_extract("line", r"(\d+)", 1).try_cast("int"))
    out = [F.max_by(F.when(F.col("kind") == "header", F.col("line")),
                    F.when(F.col("kind") == "header", F.col(pos))).alias("header")]
    for name in COUNTERS:
        hit = (F.col("kind") == name) & F.col("_num").isNotNull()
        last = F.max_by(F.when(hit, F.col("_num")), F.when(hit, F.col(pos)))
        out.append(F.coalesce(last, F.lit(0)).alias(name))
    return rows.groupBy(doc).agg(*out)


def clean_fixture_lines(lines: DataFrame) -> DataFrame:
    """Cleaned, non-empty fixture lines."""
    return lines.withColumn("line", T.clean_fixture_line(F.col("line"))).filter(F.col("line") != "")
