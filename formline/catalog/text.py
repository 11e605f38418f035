"""Queries on text feeds, names, headers and report texts.

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
from formline.catalog.probability import _OUT, flat
from formline.catalog.registry import ORACLES, query
from formline.catalog.sql import CTES, DEPENDS, with_ctes
from formline.functions import scores as S
from formline.functions import text as X
from formline.operators import entities as E
from formline.operators.windows import points, team_rows
from formline.session import new_path
from formline.sinks import history, reports as R
from formline.sources import lines as L, matches as M, pages as P, reports as RP, standings as ST


def quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def canon(x: str) -> str:
    """Canonical spelling in SQL."""
    s = rf"regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '^$', '')"
    s = rf"translate(upper({s}), '-–—ÁÉÍÓÚÜÑ.', '   AEIOUUN')"
    return rf"coalesce(trim(regexp_replace({s}, '\s+', ' ', 'g')), '')"


def choice(key: str, options: list[str], last: str) -> str:
    """``CASE key WHEN 0 THEN ...`` with SQL expressions, in both dialects."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + f" ELSE {last} END"


CTES["cust"] = "SELECT c_custkey AS k, c_name, n_name, c_nationkey, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey"


def cust(spark, sf_dir) -> DataFrame:
    return T.customers(spark, sf_dir).select(
        F.col("c_custkey").alias("k"), "c_name", "n_name", "c_nationkey", F.col("c_mktsegment").alias("seg"))


# Glossary lines: comments, blanks, all separators, inline notes and repeats
_GLINE = choice("k % 10", ["'# ' || c_name", "'   '", "c_name || ' = ' || n_name", "c_name || ' : ' || n_name",
                           "c_name || ' -> ' || n_name || ' # ' || seg", "'Club-' || seg || ' -> ' || n_name"],
                "c_name || ' -> ' || n_name")
CTES["glines"] = f"SELECT k AS pos, {_GLINE} AS line FROM cust"
CTES["gsplit"] = """
SELECT pos, trim(left(line, strpos(line, sep) - 1)) AS key, trim(substr(line, strpos(line, sep) + length(sep))) AS target FROM (
  SELECT pos, trim(line) AS line, CASE WHEN contains(line, '->') THEN '->' WHEN contains(line, '=') THEN '=' WHEN contains(line, ':') THEN ':' END AS sep
  FROM glines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) WHERE sep IS NOT NULL"""
CTES["gloss"] = f"""
SELECT variant, arg_max(target, pos) AS target, min(pos) AS ord FROM (
  SELECT pos, {canon('key')} AS variant, {canon("trim(split_part(target, '#', 1))")} AS target FROM gsplit)
WHERE variant <> '' AND target <> '' GROUP BY variant"""
CTES["alias"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(v)})" for k, v in K.CLUB_ALIASES.items()) + ") t(alias, club)"
# Raw names: spelling variants of customers, clubs and nations
CLUBS = ["Estudiantes (L.P.)", "Talleres (C)", "N.O.B.", "Unión", "Gimnasia", "Lanús", "Deportivo  Riestra"]
_CLUB = choice("c_nationkey % 7", [quoted(c) for c in CLUBS[:-1]], quoted(CLUBS[-1]))
_RAW = choice("k % 5", ["lower(c_name)", "'  ' || c_name || '.'", "'club ' || seg", _CLUB], "n_name")
CTES["names"] = f"SELECT k AS id, {_RAW} AS raw FROM cust"
CTES["normed"] = f"""
SELECT id, raw, coalesce(g.target, a.club, c) AS team FROM (SELECT id, raw, {canon('raw')} AS c FROM names)
LEFT JOIN gloss g ON g.variant = c LEFT JOIN alias a ON a.alias = c"""
DEPENDS |= {"glines": ["cust"], "gsplit": ["glines"], "gloss": ["gsplit"], "names": ["cust"], "normed": ["names", "gloss", "alias"]}


def glossary_lines(spark, sf_dir) -> DataFrame:
    return cust(spark, sf_dir).selectExpr("k AS pos", f"{_GLINE} AS line")


def glossary(spark, sf_dir) -> DataFrame:
    return L.parse_glossary(glossary_lines(spark, sf_dir))


def names(spark, sf_dir) -> DataFrame:
    return cust(spark, sf_dir).selectExpr("k AS id", f"{_RAW} AS raw")


@query("src_glossary", with_ctes(["gloss"], "SELECT * FROM gloss"))
def src_glossary(spark, sf_dir):
    return glossary(spark, sf_dir)


@query("src_glossary_plain", with_ctes(["gsplit"], """
SELECT upper(key) AS variant, arg_max(upper(target), pos) AS target, min(pos) AS ord FROM gsplit GROUP BY 1"""))
def src_glossary_plain(spark, sf_dir):
    return L.parse_glossary(glossary_lines(spark, sf_dir), plain=True)


@query("str_canonical", with_ctes(["names"], f"SELECT id, {canon('raw')} AS name FROM names"))
def str_canonical(spark, sf_dir):
    return names(spark, sf_dir).select("id", X.canonical(F.col("raw")).alias("name"))


@query("str_team_norm", with_ctes(["normed"], "SELECT id, raw, team FROM normed"))
def str_team_norm(spark, sf_dir):
    return E.normalize_names(names(spark, sf_dir), "raw", "team", glossary(spark, sf_dir))


_PNAME = choice("k % 4", ["'FC ' || lower(n_name) || ' II'", "substr(c_name, 10)", "n_name"], "seg")
CTES["pkeys"] = """
SELECT n_name AS variant, 'CLUB ' || n_nationkey AS target, CAST(n_nationkey AS BIGINT) AS ord FROM nation
UNION ALL SELECT upper(s_name), 'SIDE ' || s_suppkey, s_suppkey + 100 FROM supplier"""
CTES["pnames"] = f"SELECT k AS id, {_PNAME} AS raw FROM cust"
DEPENDS["pnames"] = ["cust"]


@query("str_team_partial", with_ctes(["pnames", "pkeys"], """
SELECT n.id, n.raw, coalesce(b.target, upper(trim(n.raw))) AS team FROM pnames n LEFT JOIN (
  SELECT raw, arg_min(target, CASE WHEN variant = u THEN -1 ELSE ord END) AS target
  FROM (SELECT DISTINCT raw, upper(trim(raw)) AS u FROM pnames), pkeys
  WHERE contains(u, variant) OR contains(variant, u) GROUP BY raw) b ON b.raw = n.raw"""))
def str_team_partial(spark, sf_dir):
    nation = T.table(spark, sf_dir, "nation").selectExpr(
        "n_name AS variant", "'CLUB ' || n_nationkey AS target", "CAST(n_nationkey AS BIGINT) AS ord")
    sides = T.table(spark, sf_dir, "supplier").selectExpr(
        "upper(s_name) AS variant", "'SIDE ' || s_suppkey AS target", "s_suppkey + 100 AS ord")
    rows = cust(spark, sf_dir).selectExpr("k AS id", f"{_PNAME} AS raw")
    return E.match_partial(rows, "raw", nation.unionByName(sides), "team")


_LABELS = list(K.CLUB_LABELS)
_LABEL = choice("c_nationkey", [quoted(c) for c in _LABELS[:24]], quoted(_LABELS[25]))
_FEED = choice("k % 3", [f"'CA ' || upper({_LABEL}) || ' ' || seg", f"{_LABEL} || ' (H)'"], "c_name")
CTES["feed"] = f"SELECT k AS id, {_FEED} AS raw FROM cust"
DEPENDS["feed"] = ["cust"]


def feed_club(x: str) -> str:
    def bare(e: str) -> str:
        return f"translate({e}, 'áéíóúñÁÉÍÓÚÑ', 'aeiounAEIOUN')"
    whens = " ".join(f"WHEN contains(lower({bare(x)}), lower({bare(quoted(k))})) THEN {quoted(v)}" for k, v in K.CLUB_LABELS.items())
    return f"CASE {whens} ELSE upper(trim({bare(x)})) END"


@query("str_team_contains", with_ctes(["feed"], f"SELECT id, raw, {feed_club('raw')} AS team FROM feed"))
def str_team_contains(spark, sf_dir):
    return E.match_feed_label(cust(spark, sf_dir).selectExpr("k AS id", f"{_FEED} AS raw"), "raw", "team")


_WEB = "'<b>' || c_name || '</b>  https://img.example.org/' || k || ' <img src=\"a\"> cdn.example.org/x ' || seg"
_RANK = "k || '. ' || c_name || CASE WHEN k % 2 = 0 THEN ' (H)' ELSE '  (A)' END"


@query("str_label_clean_web", with_ctes(["cust"], rf"""
SELECT k AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_WEB},
  'https?://\S+', '', 'g'), '<img[^>]*>', '', 'g'), 'cdn\.\S+', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS label FROM cust"""))
def str_label_clean_web(spark, sf_dir):
    return cust(spark, sf_dir).selectExpr("k AS id", f"{_WEB} AS raw").select("id", X.clean_web_label(F.col("raw")).alias("label"))


@query("str_label_clean_rank", with_ctes(["cust"], f"SELECT k AS id, c_name AS label FROM cust"))
def str_label_clean_rank(spark, sf_dir):
    rows = cust(spark, sf_dir).selectExpr("k AS id", f"{_RANK} AS raw")
    return rows.select("id", X.clean_rank_label(F.col("raw"), web=True).alias("label"))


_UP = "' ' || c_name || '-' || seg || '.  X '"


@query("str_upper_norm", with_ctes(["cust"], f"""
SELECT k AS id, replace(replace(replace(upper(trim({_UP})), '.', ''), '-', ' '), '  ', ' ') AS name FROM cust"""))
def str_upper_norm(spark, sf_dir):
    return cust(spark, sf_dir).selectExpr("k AS id", f"{_UP} AS raw").select("id", X.upper_norm(F.col("raw")).alias("name"))


@query("str_report_name", with_ctes(["cust"], "SELECT k AS id, c_name AS name FROM cust"))
def str_report_name(spark, sf_dir):
    rows = cust(spark, sf_dir).selectExpr("k AS id", "' ' || c_name || ' : ' || seg || ':x' AS raw")
    return rows.select("id", X.report_name(F.col("raw")).alias("name"))


_HEADERS = ["'fecha'", "'Home Team'", "' FTHG '", "'xG-home'", "'Pos.'", "'B365CH'", "'Visitante'", "'h_' || seg"]
_HEAD = choice("k % 9", _HEADERS, "c_name")
CTES["hnames"] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in K.HEADER_NAMES.items()) + ") t(h, name)"


@query("hdr_map", with_ctes(["cust", "hnames"], f"""
SELECT k AS feed, header, name AS canonical FROM (SELECT k, {_HEAD} AS header FROM cust) LEFT JOIN hnames ON h = {canon('header')}"""))
def hdr_map(spark, sf_dir):
    return E.map_headers(cust(spark, sf_dir).selectExpr("k AS feed", f"{_HEAD} AS header"))


@query("hdr_apply", with_ctes(["matches"], """
SELECT match_id AS match_key, date AS "Date", home AS "HomeTeam", away AS "AwayTeam", hg AS "HG", ag AS "AG", season AS "Unknown season" FROM matches"""))
def hdr_apply(spark, sf_dir):
    raw = T.matches(spark, sf_dir).select(
        F.col("match_id").alias("match_key"), F.col("date").alias("fecha"), F.col("home").alias("Home Team"),
        F.col("away").alias("visitante"), F.col("hg").alias("FTHG"), F.col("ag").alias("Away-Goals"),
        F.col("season").alias("Unknown season"))
    return E.apply_headers(raw)[0]


_AUDIT = f"""
SELECT u.name, u.team AS normalized, coalesce(s.suggestions, []) AS suggestions FROM unmapped u LEFT JOIN (
  SELECT name, list(target ORDER BY score DESC, target DESC) AS suggestions FROM (
    SELECT name, target, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, target DESC) AS place FROM (
      SELECT name, target, 1.0 - levenshtein(name, target)::DOUBLE / greatest(length(name), length(target)) AS score
      FROM unmapped CROSS JOIN rawtargets WHERE target <> '')
    WHERE score >= 0.4) WHERE place <= 3 GROUP BY name) s ON s.name = u.name"""
CTES["rawtargets"] = "SELECT DISTINCT target FROM gsplit"
CTES["unmapped"] = f"""
SELECT name, team FROM (SELECT DISTINCT trim(raw) AS name, team FROM normed) WHERE name <> '' AND NOT starts_with(name, '#')
  AND team NOT IN (SELECT target FROM rawtargets UNION ALL SELECT target FROM gloss) AND {canon('name')} NOT IN (SELECT {canon('target')} FROM rawtargets)"""
DEPENDS |= {"rawtargets": ["gsplit"], "unmapped": ["normed", "rawtargets", "gloss"]}


@query("ent_audit", with_ctes(["unmapped", "rawtargets"], _AUDIT))
def ent_audit(spark, sf_dir):
    """Unknown names with their closest targets by edits per character."""
    return E.audit_names(names(spark, sf_dir), "raw", glossary(spark, sf_dir), L.raw_targets(glossary_lines(spark, sf_dir)), "edits")


@query("ent_audit_blocks")
def ent_audit_blocks(spark, sf_dir):
    """The same by matching blocks, as the standard library's closest matches."""
    return E.audit_names(names(spark, sf_dir), "raw", glossary(spark, sf_dir), L.raw_targets(glossary_lines(spark, sf_dir)), "blocks")


@query("ent_unknown", with_ctes(["cust", "matches"], """
SELECT DISTINCT team FROM (SELECT n_name AS team FROM cust UNION ALL SELECT seg FROM cust)
WHERE team NOT IN (SELECT home FROM matches UNION ALL SELECT away FROM matches)"""))
def ent_unknown(spark, sf_dir):
    fixtures = cust(spark, sf_dir).select(F.col("n_name").alias("home"), F.col("seg").alias("away"))
    return E.unknown_teams(fixtures, T.matches(spark, sf_dir))


_BLOCK = " OR ".join(f"contains(lower(html), {quoted(p)})" for p in K.CHALLENGE_PHRASES)


@query("txt_blocked_page", f"""
SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, count(*) AS pages,
       CAST(sum(CASE WHEN {_BLOCK} THEN 1 ELSE 0 END) AS BIGINT) AS blocked_pages FROM pages GROUP BY 1""")
def txt_blocked_page(spark, sf_dir):
    return P.blocked_pages(T.table(spark, sf_dir, "pages"))


# --- match and fixture feeds ----------------------------------------------------

@query("src_matches", with_ctes(["matches"], """
SELECT match_id, date AS "Date", coalesce(trim(kickoff), '') AS "Time", upper(home) AS "Home", upper(away) AS "Away", hg AS "HG", ag AS "AG", res AS "Res"
FROM matches WHERE match_id % 37 <> 0 AND match_id % 29 <> 0"""))
def src_matches(spark, sf_dir):
    """Typed match rows from raw text rows with gaps and bad dates."""
    key, code = F.col("match_id"), F.when(F.col("res") == 2, "H").when(F.col("res") == 1, "D").otherwise("A")
    raw = T.matches(spark, sf_dir).select(
        "match_id", F.when(key % 37 == 0, "no date").otherwise(F.date_format("date", "dd/MM/yyyy")).alias("Date"),
        F.col("kickoff").alias("Time"), F.concat(F.lit(" "), F.lower("home")).alias("Home"), F.col("away").alias("Away"),
        F.col("hg").alias("HG"), F.col("ag").alias("AG"), F.when(key % 29 != 0, code).alias("Res"))
    return M.clean_matches(raw).select("match_id", "Date", "Time", "Home", "Away", "HG", "AG", "Res")


_FLINE = choice("match_id % 6", [
    "home || ' - ' || away || ':'", "home || ' - ' || away || ': ' || hg || '-' || ag", "home || ' ' || hg || '-' || ag || ' ' || away",
    "'  ' || home || ' – ' || away", "home || ' ' || away"], "home || ' - ' || away || ' - x'")


def fixture_feed(spark, sf_dir) -> DataFrame:
    """Fixture text lines, one document per date: header, matches, counters.
    Team names carry letters for digits, as a digit before a colon reads as a score."""
    rows = T.matches(spark, sf_dir).withColumns({
        c: F.translate(c, "0123456789", "ABCDEFGHIJ") for c in ("home", "away")})
    body = rows.selectExpr("CAST(date AS STRING) AS file", "match_id AS pos", f"{_FLINE} AS line")
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("hg").alias("g"), F.max("match_id").alias("last"))
    extra = F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("pos"), F.lit("Fecha vieja").alias("line")),
        F.struct(F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("FECHA "), F.month("date"), F.lit(" - "), F.col("date")).alias("line")),
        F.struct((F.col("last") + 1).alias("pos"), F.lit("").alias("line")),
        F.struct((F.col("last") + 2).alias("pos"), F.concat(F.lit("Cantidad de penales cobrados: "), F.col("n")).alias("line")),
        F.struct((F.col("last") + 3).alias("pos"), F.lit("Cantidad de expulsados:").alias("line")),
        F.struct((F.col("last") + 4).alias("pos"), F.concat(F.lit("Cantidad de goles convertidos: "), F.col("g")).alias("line"))))
    return body.unionByName(days.select(F.col("date").cast("string").alias("file"), extra))


@query("src_fixtures", with_ctes(["matches"], """
SELECT CAST(date AS VARCHAR) AS file, match_id AS pos, h AS "Raw_Home", a AS "Raw_Away", h AS "HomeTeam", a AS "AwayTeam",
       CASE WHEN match_id % 6 = 1 THEN hg END AS "Home_Score", CASE WHEN match_id % 6 = 1 THEN ag END AS "Away_Score"
FROM (SELECT *, translate(home, '0123456789', 'ABCDEFGHIJ') AS h, translate(away, '0123456789', 'ABCDEFGHIJ') AS a FROM matches)
WHERE match_id % 6 IN (0, 1, 3)"""))
def src_fixtures(spark, sf_dir):
    return L.parse_fixtures(fixture_feed(spark, sf_dir)).select(
        "file", "pos", "Raw_Home", "Raw_Away", "HomeTeam", "AwayTeam", "Home_Score", "Away_Score")


@query("src_fixture_summary", with_ctes(["matches"], """
SELECT CAST(date AS VARCHAR) AS file, 'FECHA ' || month(date) || ' - ' || CAST(date AS VARCHAR) AS header, count(*) AS penales,
       0 AS expulsados, CAST(sum(hg) AS BIGINT) AS goles FROM matches GROUP BY date"""))
def src_fixture_summary(spark, sf_dir):
    return L.fixture_summary(fixture_feed(spark, sf_dir))


_NOISY = "'\\t' || home || '  –  Unión & Ñandú/' || away || ' ¡' || hg || ':' || ag || '!'"


@query("src_fixture_clean", with_ctes(["matches"], """
SELECT match_id AS pos, replace(home, '_', '') || ' - Union Ñandu' || replace(away, '_', '') || ' ' || hg || ':' || ag AS line
FROM matches WHERE match_id % 10 <> 0""".replace("Ñandu'", "Ñandu'")))
def src_fixture_clean(spark, sf_dir):
    rows = T.matches(spark, sf_dir).selectExpr(
        "match_id AS pos", f"CASE WHEN match_id % 10 = 0 THEN ' ¡! ' ELSE {_NOISY} END AS line")
    return L.clean_fixture_lines(rows)


_CODE = "CASE res WHEN 2 THEN 'L' WHEN 1 THEN 'E' ELSE 'V' END"
_RLINE = f"home || ' - ' || away || ' ' || hg || ' - ' || ag || ' / 0 / 1 / ' || {_CODE}"


def report_docs(spark, sf_dir) -> DataFrame:
    """Round report documents: pages as an array, results on page 2 or 6."""
    rows = T.matches(spark, sf_dir)
    when = F.date_format("date", "d/M/yyyy")
    line = F.expr(_RLINE)
    results = F.concat_ws(
        "\n", F.lit("Resumen del torneo"), F.lit("RESULTADOS DE LA FECHA"),
        F.concat(F.lit("FECHA 1 - 22 AL "), when, F.lit(" Score / Pn / Ex / LEV")), line, F.lit(""),
        F.concat("away", F.lit(" – "), "home", F.lit(" 1-1 / 0 / 0 / e")), F.lit("Boca / 1 / 2"),
        F.lit("Cantidad de goles: 3"), F.concat("home", F.lit(" - X 9 - 0 / 0 / 0 / L")))
    blank, decoy = F.lit("sin datos"), F.lit("Resultados de la fecha\nFECHA 0 - 1/1/1999\nA - B 1 - 0 / 0 / 0 / L")
    long, short = F.array(decoy, blank, blank, blank, blank, results, decoy), F.array(blank, results)
    pages = F.when(F.col("match_id") % 2 == 0, long).otherwise(short)
    name = F.concat(F.when(F.col("match_id") % 9 == 0, "Parsed_").otherwise(""), F.lit("Resumen F"), F.month("date"), F.lit(".pdf"))
    return rows.select("match_id", "date", name.alias("file_name"), pages.alias("pages"))


CTES["rdocs"] = """
SELECT match_id, strftime(date, '%d/%m/%Y') AS round_date, home AS "Home_Raw", away AS "Away_Raw", hg AS "HG", ag AS "AG",
       CASE res WHEN 2 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS "Res" FROM matches
UNION ALL SELECT match_id, strftime(date, '%d/%m/%Y'), away, home, 1, 1, 'D' FROM matches"""
DEPENDS["rdocs"] = ["matches"]


@query("src_result_section", with_ctes(["matches"], f"""
SELECT match_id, strftime(date, '%d/%m/%Y') AS round_date, {_RLINE} || chr(10) || away || ' – ' || home || ' 1-1 / 0 / 0 / e' || chr(10)
       || 'Boca / 1 / 2' AS body FROM matches"""))
def src_result_section(spark, sf_dir):
    out = RP.result_section(report_docs(spark, sf_dir))
    return out.select("match_id", "round_date", F.array_join("lines", "\n").alias("body"))


@query("src_result_lines", with_ctes(["rdocs", "gloss", "alias"], f"""
SELECT match_id, round_date, "Home_Raw", "Away_Raw", "HG", "AG", "Res",
       coalesce(g.target, a.club, ch) AS "Home", coalesce(h.target, b.club, ca) AS "Away"
FROM (SELECT *, {canon('"Home_Raw"')} AS ch, {canon('"Away_Raw"')} AS ca FROM rdocs)
LEFT JOIN gloss g ON g.variant = ch LEFT JOIN alias a ON a.alias = ch LEFT JOIN gloss h ON h.variant = ca LEFT JOIN alias b ON b.alias = ca"""))
def src_result_lines(spark, sf_dir):
    return RP.report_results(report_docs(spark, sf_dir), glossary=glossary(spark, sf_dir)).select(
        "match_id", "round_date", "Home_Raw", "Away_Raw", "HG", "AG", "Res", "Home", "Away")


@query("src_date_range", with_ctes(["matches"], "SELECT match_id, strftime(date, '%d/%m/%Y') AS round_date FROM matches"))
def src_date_range(spark, sf_dir):
    header = F.concat(F.lit("FECHA 3 - 2 al "), F.date_format("date", "d/M/yyyy"), F.lit(" x"))
    return T.matches(spark, sf_dir).select("match_id", X.header_date(header).alias("round_date"))


@query("src_round_no", with_ctes(["matches"], """
SELECT match_id, CASE WHEN match_id % 9 <> 0 THEN CAST(month(date) AS INTEGER) END AS round_no FROM matches"""))
def src_round_no(spark, sf_dir):
    return report_docs(spark, sf_dir).select("match_id", X.round_number(F.col("file_name")).alias("round_no"))


def _skip(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quoted(w)})" for w in K.SCORE_SKIP_WORDS) + ")"


def _decode(x: str) -> str:
    for e, c in (("&nbsp;", "\u00a0"), ("&emsp;", "\u2003"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{e}', '{c}')"
    return x


# RE2 writes the same classes
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_MENTION = "'" + P.MENTION.replace(P.SPACE, _SPACE) + "'"
_HINT = P.HINT.replace(r"\s", _SPACE)
# The pages hold no nested containers, so a pattern finds them in SQL
_BOX = r"""(?is)<(?:div|article|section)\b[^>]*\bclass="[^"]*(?:match|partido|fixture|result)[^"]*"[^>]*>(.*?)</(?:div|article|section)>"""


def _mention(cte: str, col: str, source: str) -> str:
    def name(g: int) -> str:
        found = f"regexp_replace(regexp_extract({col}, {_MENTION}, {g}), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
        return rf"regexp_replace({found}, '{_SPACE}*\(.*?\){_SPACE}*$', '')" if source == "container" else found
    return f"""
SELECT page_id, {name(1)} AS "Home", {name(4)} AS "Away", TRY_CAST(regexp_extract({col}, {_MENTION}, 2) AS INTEGER) AS "Home_Score",
       TRY_CAST(regexp_extract({col}, {_MENTION}, 3) AS INTEGER) AS "Away_Score", '{source}' AS source
FROM {cte} WHERE regexp_matches({col}, '{_HINT}') AND regexp_matches({col}, {_MENTION})"""


# A match box, and text mentions with spaces of several kinds and a stray sign
_MARKS = ['<div class="match-row"><b>Boca Juniors (H)</b> 2 - 1 <i>River &amp; Plate</i></div>',
          "<p>Lanus FC&nbsp;3&nbsp;-&nbsp;0&nbsp;Banfield</p>", "<p>Tigre\u00a01 - 1&emsp;Colon SF</p> x < y"]


@query("src_page_scores", with_ctes(["gloss", "alias"], f"""
SELECT f.* EXCLUDE (ch, ca), coalesce(g.target, a.club, ch) AS "Home_Team", coalesce(h.target, b.club, ca) AS "Away_Team"
FROM (SELECT *, {canon('"Home"')} AS ch, {canon('"Away"')} AS ca FROM found) f
LEFT JOIN gloss g ON g.variant = ch LEFT JOIN alias a ON a.alias = ch LEFT JOIN gloss h ON h.variant = ca LEFT JOIN alias b ON b.alias = ca""", {
    "marked": f"SELECT page_id, html || {choice('page_id % 4', [quoted(x) for x in _MARKS], quoted(''))} AS html FROM pages",
    "inner_": rf"""SELECT page_id, trim(regexp_replace({_decode("regexp_replace(x, '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')) AS t
      FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_BOX}', 1)) AS x FROM marked)""",
    "boxed": f"""SELECT * FROM ({_mention('inner_', 't', 'container')}) WHERE length("Home") >= 3 AND length("Away") >= 3""",
    "nodes": f"SELECT page_id, {_decode('x')} AS t FROM (SELECT page_id, unnest(regexp_split_to_array(html, '<[^>]+>')) AS x FROM marked)",
    "loose": _mention("nodes", "t", "text"),
    "found": """SELECT * FROM boxed UNION ALL
      SELECT * FROM loose WHERE page_id NOT IN (SELECT page_id FROM boxed) AND length("Home") >= 3 AND length("Away") >= 3
      AND NOT """ + _skip('"Home"') + " AND NOT " + _skip('"Away"')}))
def src_page_scores(spark, sf_dir):
    """Score mentions in all pages; three of four pages also show one of the marks."""
    pages = T.table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    html = F.concat("html", F.when(kind == 0, _MARKS[0]).when(kind == 1, _MARKS[1]).when(kind == 2, _MARKS[2]).otherwise(""))
    return P.with_teams(P.page_scores(pages.withColumn("html", html)), glossary(spark, sf_dir))


_SQUADS = ["''", "chr(10) || 'GK' || chr(9) || 'Franco Armani' || chr(9) || 'River Plate' || chr(10) || 'df  Lucas PEREZ  Boca'",
           "chr(10) || 'Arqueros: Franco Armani (River Plate), Sergio Romero (Boca Juniors), Lionel Messi (Miami)'"]
_SQUAD = choice("doc_id % 4", _SQUADS, "chr(10) || 'Ana Díaz (Lanús)'")


@query("src_squad_lists", with_ctes([], f"""
SELECT doc_id, n_structured, n_inline, m AS machine_readable, CASE WHEN n_structured > 0 THEN n_structured >= 3 ELSE n_inline >= 3 END AS has_player_names,
  CASE WHEN n_structured > 0 THEN {quoted(K.SQUAD_LABELS['structured'])} WHEN n_inline > 0 THEN {quoted(K.SQUAD_LABELS['inline'])}
       WHEN m THEN {quoted(K.SQUAD_LABELS['unmatched'])} ELSE {quoted(K.SQUAD_LABELS['unreadable'])} END AS structure
FROM (SELECT doc_id, len(regexp_extract_all(text, {quoted('(?i)' + K.SQUAD_STRUCTURED)})) AS n_structured,
             len(regexp_extract_all(text, {quoted(K.SQUAD_INLINE)})) AS n_inline,
             length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200 AS m FROM d)""", {
    "d": f"SELECT doc_id, text || {_SQUAD} AS text FROM documents"}))
def src_squad_lists(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").selectExpr("doc_id", f"text || {_SQUAD} AS text")
    return RP.squad_lists(docs).select(
        "doc_id", F.size("structured").cast("long").alias("n_structured"), F.size("inline").cast("long").alias("n_inline"),
        "machine_readable", "has_player_names", "structure")


_ULINE = choice("k % 5", ["'# ' || c_name", "c_name || ' -> https://clubs.example.org/' || k"],
                "c_name || ' -> https://clubs.example.org/' || k || ' (' || k || ')'")


@query("src_url_lookup", with_ctes(["names", "cust"], f"""
SELECT n.id, n.raw, CASE WHEN c.k % 5 <> 0 THEN 'https://clubs.example.org/' || c.k END AS url, CASE WHEN c.k % 5 > 1 THEN c.k END AS club_id
FROM names n LEFT JOIN cust c ON upper(c.c_name) = {canon('raw')}"""))
def src_url_lookup(spark, sf_dir):
    links = L.parse_links(cust(spark, sf_dir).selectExpr("k AS pos", f"{_ULINE} AS line"))
    return L.lookup_links(names(spark, sf_dir), "raw", links)


# --- standings ----------------------------------------------------------------

CTES["table_"] = """
SELECT league, season, team, count(*) AS played, CAST(sum(pts) AS BIGINT) AS points, count(*) FILTER (pts = 3) AS won,
       count(*) FILTER (pts = 1) AS drawn, count(*) FILTER (pts = 0) AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against
FROM (SELECT l.*, m.season FROM long l JOIN matches m USING (match_id)) GROUP BY ALL"""
DEPENDS["table_"] = ["long"]


def standings_rows(spark, sf_dir) -> DataFrame:
    """Final table rows per league and season."""
    long = team_rows(batched(spark, sf_dir), keep=("season",)).withColumn("pts", points())
    return long.groupBy("league", "season", "team").agg(
        F.count(F.lit(1)).alias("played"), F.sum("pts").alias("points"), F.count_if(F.col("pts") == 3).alias("won"),
        F.count_if(F.col("pts") == 1).alias("drawn"), F.count_if(F.col("pts") == 0).alias("lost"),
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"))


def _ranked(rows: DataFrame) -> DataFrame:
    """One document per league and season: its table rows, best first. A table
    has one row per team, so the list is bounded by the size of a league."""
    entry = F.struct(-F.col("points").alias("p"), "team", "played", "points", "won", "drawn", "lost", "goals_for", "goals_against")
    return rows.groupBy("league", "season").agg(F.array_sort(F.collect_list(entry)).alias("rows"))


def standings_docs(spark, sf_dir) -> DataFrame:
    docs = _ranked(standings_rows(spark, sf_dir))
    root = F.transform("rows", lambda x: F.struct(x["team"].alias("normalized"), F.lit(99).alias("position")))
    flat_ = F.transform("rows", lambda x, i: F.struct(
        F.lower(x["team"]).alias("name"), (i + 1).alias("position"), x["points"].alias("points"), x["played"].alias("played"),
        x["won"].alias("won"), x["drawn"].alias("drawn"), x["lost"].alias("lost"), x["goals_for"].alias("goalsFor"),
        x["goals_against"].alias("goals_against")))
    nested = F.transform("rows", lambda x: F.struct(
        F.struct(x["team"].alias("name")).alias("team"), x["points"].alias("points"), x["played"].alias("matches"),
        x["won"].alias("wins"), x["drawn"].alias("draws"), x["lost"].alias("lost"), x["goals_for"].alias("goalsFor"),
        x["goals_against"].alias("goalsAgainst")))
    deep = F.array(F.struct(F.array(F.struct(nested.alias("rows"))).alias("standings")))
    even = F.col("season").cast("int") % 2 == 0
    json = F.when(even, F.to_json(F.struct(root.alias("standings"), deep.alias("teams")))).otherwise(
        F.to_json(F.struct(root.alias("standings"), flat_.alias("teams"))))
    return docs.select(F.concat_ws("/", "league", "season").alias("file"), json.alias("json"))


@query("src_standings", with_ctes(["table_"], """
SELECT league || '/' || season AS file, team, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, team) AS position,
       points, played, won, drawn, lost, goals_for, goals_against, 0 AS goal_difference FROM table_"""))
def src_standings(spark, sf_dir):
    return ST.parse_standings(standings_docs(spark, sf_dir)).drop("rating")


@query("src_standings_raw", with_ctes(["table_"], """
SELECT league || '/' || season AS item_id, team, team AS normalized, played, won, goals_for, points,
       row_number() OVER (PARTITION BY league, season ORDER BY points DESC, team) - 1 AS "row" FROM table_"""))
def src_standings_raw(spark, sf_dir):
    docs = _ranked(standings_rows(spark, sf_dir))
    body = F.to_json(F.transform("rows", lambda x: F.struct(
        x["team"].alias("name"), x["played"].alias("played"), x["won"].alias("won"), x["goals_for"].alias("goalsFor"),
        x["points"].alias("points"))))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("standings", "table", "teams", "data")]), F.col("season").cast("int") % 4 + 1)
    json = F.concat(F.lit('{"source": "x", "'), kind, F.lit('": '), body, F.lit("}"))
    items = docs.select(F.concat_ws("/", "league", "season").alias("item_id"), json.alias("json"))
    return ST.parse_raw_standings(items).select("item_id", "team", "normalized", "played", "won", "goals_for", "points", "row")


# --- text outputs -------------------------------------------------------------

@query("snk_report", with_ctes(["flat_outcome", "shin"], f"""
SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, repeat('=', 60) || chr(10) || '  PREDICCIONES' || chr(10) || repeat('=', 60) || chr(10) AS value
UNION ALL
SELECT 1, o.match_id, 'Match: ' || home || ' vs ' || away || chr(10) ||
  printf('P(Away): %.1f%% | P(Draw): %.1f%% | P(Home): %.1f%%', Poisson_Away_Win * 100, Poisson_Draw * 100, Poisson_Home_Win * 100) || chr(10) ||
  'Market Implied: ' || CASE WHEN abs(Shin_Prob_H - 1.0 / 3) < 1e-4 AND abs(Shin_Prob_A - 1.0 / 3) < 1e-4 THEN '[Not available]'
    ELSE printf('P(Away): %.1f%% | P(Draw): %.1f%% | P(Home): %.1f%%', Shin_Prob_A * 100, Shin_Prob_D * 100, Shin_Prob_H * 100) END || chr(10) ||
  'Top Pick: ' || CASE WHEN Poisson_Home_Win >= Poisson_Draw AND Poisson_Home_Win >= Poisson_Away_Win THEN 'Home'
       WHEN Poisson_Away_Win >= Poisson_Draw AND Poisson_Away_Win >= Poisson_Home_Win THEN 'Away' ELSE 'Draw' END || ' (' ||
  CASE WHEN greatest(Poisson_Home_Win, Poisson_Draw, Poisson_Away_Win) >= 0.55 THEN 'Strong'
       WHEN greatest(Poisson_Home_Win, Poisson_Draw, Poisson_Away_Win) >= 0.48 THEN 'Moderate' ELSE 'Marginal' END || ')' || chr(10) || '---'
FROM flat_outcome o JOIN (SELECT match_id, Shin_Prob_H, Shin_Prob_D, Shin_Prob_A FROM shin) s ON s.match_id = o.match_id
UNION ALL
SELECT 2, 0, chr(10) || repeat('=', 60) || chr(10) || 'RESUMEN' || chr(10) || repeat('=', 60) || chr(10) || 'Partidos: ' || (SELECT count(*) FROM matches)"""))
def snk_report(spark, sf_dir):
    rows = S.with_shin(S.with_outcome(flat(spark, sf_dir)))
    rows = rows.withColumnsRenamed(dict(zip(_OUT, ("Pred_Proba_Home", "Pred_Proba_Draw", "Pred_Proba_Away"))))
    rows = rows.withColumns({"HomeTeam": F.col("home"), "AwayTeam": F.col("away"), "Raw_Away": F.lit(None).cast("string"),
                             "Raw_Home": F.concat("home", F.lit(":x"))})
    return R.report_lines(rows, "match_id")


@query("snk_fixture_text", with_ctes(["matches"], """
SELECT 1 AS section, match_id AS ord, home || ' - ' || away || ':' AS value FROM matches
UNION ALL SELECT * FROM (VALUES (0, 0, 'FECHA XX'), (0, 1, ''), (2, 0, ''), (2, 1, 'Cantidad de penales cobrados:'),
  (2, 2, 'Cantidad de expulsados:'), (2, 3, 'Cantidad de goles convertidos:'))"""))
def snk_fixture_text(spark, sf_dir):
    return R.fixture_lines(T.matches(spark, sf_dir), "match_id")


def _history(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = T.matches(spark, sf_dir).withColumn("Date", F.date_format("date", "dd/MM/yyyy"))
    base = {"Date": "Date", "Home": "home", "Away": "away", "HG": "hg", "AG": "ag"}
    existing = rows.filter("odds_h is not null").select(*[F.col(s).alias(n) for n, s in base.items()], F.col("odds_h").alias("B365CH"))
    undated = F.when(F.col("match_id") % 15 != 0, F.col("Date"))
    incoming = rows.select(undated.alias("Date"), *[F.col(s).alias(n) for n, s in base.items() if n != "Date"],
                           F.col("league").alias("League"), F.concat(F.lit("Resumen F"), F.col("season"), F.lit(".pdf")).alias("source_file"))
    return existing, incoming


CTES["fresh"] = """
SELECT strftime(date, '%d/%m/%Y') AS "Date", home AS "Home", away AS "Away", hg AS "HG", ag AS "AG", league AS "League", season FROM matches m
WHERE match_id % 15 <> 0 AND NOT EXISTS (SELECT 1 FROM matches e WHERE e.odds_h IS NOT NULL AND e.date = m.date AND e.home = m.home AND e.away = m.away)"""
DEPENDS["fresh"] = ["matches"]


@query("snk_append_new", with_ctes(["fresh"], """
SELECT strftime(date, '%d/%m/%Y') AS "Date", home AS "Home", away AS "Away", hg AS "HG", ag AS "AG", odds_h AS "B365CH", CAST(NULL AS VARCHAR) AS "League"
FROM matches WHERE odds_h IS NOT NULL
UNION ALL SELECT "Date", "Home", "Away", "HG", "AG", NULL, "League" FROM fresh"""))
def snk_append_new(spark, sf_dir):
    """Two loads into a history, the second one repeated, and what is then read back."""
    path = new_path(spark)
    existing, incoming = _history(spark, sf_dir)
    history.append_batch(spark, path, existing, "before")
    for _ in range(2):
        history.append_batch(spark, path, incoming, "reports")
    return history.read_history(spark, path)


@query("snk_append_sorted", ORACLES["snk_append_new"])
def snk_append_sorted(spark, sf_dir):
    """The whole history with the new rows, sorted by date."""
    return history.append_new(*_history(spark, sf_dir))


@query("snk_append_loads", with_ctes(["fresh"], """
SELECT 'before' AS batch, count(*) AS n_new, 0 AS n_files FROM matches WHERE odds_h IS NOT NULL
UNION ALL SELECT 'reports', count(*), count(DISTINCT season) FROM fresh"""))
def snk_append_loads(spark, sf_dir):
    """What each load added; the repeated one added nothing."""
    path = new_path(spark)
    existing, incoming = _history(spark, sf_dir)
    loads = (("before", existing), ("reports", incoming), ("reports", incoming))
    added = [history.append_batch(spark, path, rows, name) for name, rows in loads]
    if added[2]:
        raise RuntimeError("a repeated load added rows")
    done = [(d["batch"], d["n_new"], len(d["files"])) for d in history.commits(spark, path)]
    return spark.createDataFrame(done, "batch string, n_new long, n_files int")


@query("snk_append_files", with_ctes(["fresh"], "SELECT DISTINCT 'Resumen F' || season || '.pdf' AS source_file FROM fresh"))
def snk_append_files(spark, sf_dir):
    return history.contributing_files(*_history(spark, sf_dir))
