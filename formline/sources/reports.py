"""Round reports as text: result sections, result lines, squad lists.

A document is one row, so its lines are handled inside the row; nothing is
shuffled to keep the lines of a document together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import text as T
from formline.operators.entities import normalize_names

SCORE = r"(\d+)\s*[-–]\s*(\d+)"


def result_section(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """Add ``round_date`` and ``lines`` (array) of the results section.

    Pages 5 and 6 are searched when a document has more than five pages, all
    pages otherwise; the first page with the header line counts. The line after
    the header holds the date; lines follow up to the first stop word.
    """
    looked = F.when(F.size(pages) > 5, F.slice(F.col(pages), 5, 2)).otherwise(F.col(pages))
    page = F.get(F.filter(looked, lambda p: F.lower(p).contains(K.RESULT_HEADER)), F.lit(0))
    rows = docs.withColumn("_l", F.split(page, "\n"))
    flags = F.transform("_l", lambda x: F.lower(x).contains(K.RESULT_HEADER))
    rows = rows.withColumn("_at", F.array_position(flags, True).cast("int"))
    rows = rows.withColumns({
        "round_date": T.header_date(F.get("_l", F.col("_at"))),
        "_body": F.filter(F.transform(F.slice("_l", F.col("_at") + 2, F.greatest(F.size("_l"), F.lit(1))),
                                      lambda x: F.trim(x)), lambda x: x != ""),
    })
    stops = F.transform("_body", lambda x: T.has_any(x, K.RESULT_STOP_WORDS))
    stop = F.array_position(stops, True).cast("int")
    body = F.when(stop > 0, F.slice("_body", F.lit(1), stop - 1)).otherwise(F.col("_body"))
    return rows.withColumn("lines", body).drop("_l", "_at", "_body")


def parse_result_lines(rows: DataFrame, column: str = "line", glossary: DataFrame | None = None) -> DataFrame:
    """Rows of ``Home - Away h - a / Pn / Ex / X`` lines; other lines drop out.

    ``Home`` and ``Away`` are the names as a history spells them, by the glossary and
    the built-in aliases; the raw names stay beside them.
    """
    line = F.trim(column)
    parts = F.split(line, r"\s*/\s*")
    rows = rows.withColumns({"_parts": parts, "_code": F.upper(F.trim(F.element_at(parts, -1)))})
    keep = ((line != "") & ~T.has_any(F.col(column), K.RESULT_SKIP_WORDS)
            & (F.size("_parts") >= 4) & F.col("_code").isin(*K.REPORT_CODES))
    first = F.trim(F.col("_parts")[0])
    rows = rows.filter(keep).withColumn("_first", first).filter(F.col("_first").rlike(SCORE))
    teams = F.split(F.trim(F.regexp_replace("_first", SCORE, "")), r"\s*[-–]\s*")
    rows = rows.withColumn("_teams", teams).filter(F.size("_teams") == 2)
    rows = rows.withColumns({
        "Home_Raw": F.trim(F.col("_teams")[0]),
        "Away_Raw": F.trim(F.col("_teams")[1]),
        "HG": F.regexp_extract("_first", SCORE, 1).cast("int"),
        "AG": F.regexp_extract("_first", SCORE, 2).cast("int"),
        "Res": F.element_at(T.literal_map(K.REPORT_CODES), F.col("_code")),
    }).drop("_parts", "_code", "_first", "_teams")
    for side in ("Home", "Away"):
        rows = normalize_names(rows, f"{side}_Raw", side, glossary)
    return rows


def report_results(docs: DataFrame, pages: str = "pages", glossary: DataFrame | None = None) -> DataFrame:
    """Dated result rows of all report documents, with resolved teams.

    The outer explode keeps the optimizer from adding a size filter, for which
    it would work out every section a second time.
    """
    rows = result_section(docs, pages).withColumn("line", F.explode_outer("lines"))
    return parse_result_lines(rows.drop("lines", pages).filter(F.col("line").isNotNull()), glossary=glossary)


#: ``SQUAD_INLINE`` for Java's matcher, which recurses into groups that may give back: a run of names is taken whole,
#: with its bracket if it has one (a run that fails at its end fails from any of its names). Runs without one are left out.
INLINE_RUN = (K.SQUAD_INLINE.replace("]+(?:", "]++(?:").replace("]+)+)", "]++)++)")
              .replace(r"\s*\(", r"(?:\s*+\(").replace(r"\)", r"\))?+"))


def _pairs(text: Column, pattern: str, groups: list[tuple[str, int]], end: str = "") -> Column:
    """Array of structs with the named capture groups of every match that ends with ``end``.

    The text is searched once; the groups come from the short matches.
    """
    def entry(hit: Column) -> Column:
        return F.struct(*[F.regexp_replace(F.regexp_extract(hit, pattern, g), r"^\s+|\s+$", "").alias(n) for n, g in groups])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.filter(hits, lambda h: F.endswith(h, F.lit(end))) if end else hits, entry)


def squad_lists(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``structured`` and ``inline`` squad entries and the text assessment."""
    body = F.col(text)
    rows = docs.withColumns({
        "structured": _pairs(body, "(?iu)" + K.SQUAD_STRUCTURED, [("pos", 1), ("name", 2), ("club", 3)]),
        "inline": _pairs(body, INLINE_RUN, [("name", 1), ("club", 2)], ")"),
        "machine_readable": F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) > 200,
    })
    n_s, n_i = F.size("structured"), F.size("inline")
    club_s = F.exists("structured", lambda x: x["club"] != "")
    club_i = F.exists("inline", lambda x: x["club"] != "")
    return rows.withColumns({
        "has_player_names": F.when(n_s > 0, n_s >= 3).otherwise(n_i >= 3),
        "has_club_names": F.when(n_s > 0, club_s).otherwise(club_i),
        "structure": F.when(n_s > 0, K.SQUAD_LABELS["structured"]).when(n_i > 0, K.SQUAD_LABELS["inline"])
        .when(F.col("machine_readable"), K.SQUAD_LABELS["unmatched"]).otherwise(K.SQUAD_LABELS["unreadable"]),
    })


def squad_entries(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per squad entry; inline entries count where no structured one exists."""
    rows = squad_lists(docs, text)
    inline = F.transform("inline", lambda x: F.struct(
        F.lit(None).cast("string").alias("pos"), x["name"].alias("name"), x["club"].alias("club")))
    best = F.when(F.size("structured") > 0, F.col("structured")).otherwise(inline)
    return rows.select(key, F.inline(best))
