"""Text feeds, names, tables and validation on small frames."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from formline.functions import text as X
from formline.operators import entities as E, quality as Q, stat_tables as ST
from formline.sinks import history, reports as R
from formline.sources import lines as L, matches as M, pages as P, reports as RP, standings as ST2


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def lines(spark, items):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(items)], "file string, pos int, line string")


def test_canonical(spark):
    got = col(spark, [None, "  Lanús ", "Estudiantes (L.P.)", "Gimnasia-LP", "Ñuñoa  Ü", "a – b"], X.canonical)
    assert got == ["", "LANUS", "ESTUDIANTES (LP)", "GIMNASIA LP", "NUNOA U", "A B"]


def test_labels(spark):
    assert col(spark, ["<b>Boca</b> https://a.b/c  <img src=x> cdn.x/y J"], X.clean_web_label) == ["Boca J"]
    assert col(spark, ["12. River Plate (H)", "River", None], X.clean_rank_label) == ["River Plate", "River", ""]
    assert col(spark, [" a.b-c   d"], X.upper_norm) == ["AB C  D"]
    assert col(spark, ["Boca: 2-1"], X.report_name) == ["Boca"]
    assert col(spark, ["Club LANÚS", "vélez sarsfield", "CA Newell's Old Boys", "Otro é"], X.feed_club) == [
        "LANUS", "VELEZ SARSFIELD", "NEWELLS OLD BOYS", "OTRO E"]
    assert col(spark, ["Resumen F12.pdf", "a/Parsed_Resumen F3.pdf", "b/Resumen.pdf"], X.round_number) == [12, None, None]
    assert col(spark, ["FECHA 1 - 22 AL 5/1/2026", "nada"], X.header_date) == ["05/01/2026", None]
    assert col(spark, ["Please verify you are HUMAN", "ok", None], X.blocked_page) == [True, False, False]


def test_glossary(spark):
    rows = lines(spark, ["# note", "", "Lanús -> LANUS # x", "a = b", "c : d", "A -> z", "x=y -> w", "  -> q", "k -> "])
    got = {r["variant"]: (r["target"], r["ord"]) for r in L.parse_glossary(rows).collect()}
    assert got == {"LANUS": ("LANUS", 2), "A": ("Z", 3), "C": ("D", 4), "X=Y": ("W", 6)}
    plain = {r["variant"]: r["target"] for r in L.parse_glossary(rows, plain=True).collect()}
    assert plain["LANÚS"] == "LANUS # X" and plain["A"] == "Z"


def test_team_norm(spark):
    gloss = L.parse_glossary(lines(spark, ["NOB -> ROSARIO X", "Boca -> BOCA JUNIORS"]))
    df = spark.createDataFrame([("n.o.b.",), ("boca",), ("Unión",), ("Otro",), (None,)], "n string")
    assert [r["t"] for r in E.normalize_names(df, "n", "t", gloss).orderBy("n").collect()] == [
        "", "OTRO", "UNION DE SANTA FE", "BOCA JUNIORS", "ROSARIO X"]
    assert E.normalize_names(df, "n", "t").filter("n = 'n.o.b.'").first()["t"] == "NEWELLS OLD BOYS"


def test_partial_match_against_brute_force(spark):
    keys = [("RACING", "R1"), ("RACING CLUB", "R2"), ("GIMNASIA (MZA.)", "G"), ("A", "AA"), ("INDEPENDIENTE", "I")]
    names = ["racing club", "Gimnasia", "CLUB RACING", "zzz", "Indep", "B", " racing ", "", None]
    gloss = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(keys)], "variant string, target string, ord int")
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["t"] for r in E.match_partial(df, "n", gloss, "t").collect()}

    def brute(n):
        if not n or not n.strip():
            return n
        up = n.strip().upper()
        for k, t in keys:
            if k == up:
                return t
        return next((t for k, t in keys if k in up or up in k), up)

    assert got == {n: brute(n) for n in names}


def test_audit_against_difflib(spark):
    targets = ["BOCA JUNIORS", "RIVER PLATE", "RACING CLUB", "ROSARIO CENTRAL", "BARRACAS CENTRAL", "LANUS"]
    gloss_lines = lines(spark, [f"v{i} -> {t}" for i, t in enumerate(targets)])
    names = ["Boca Jrs", "BOCA JUNIORS", "v1", "central", "RACING", "xyzw", "# c", "", "BARRACAS CENTRALES"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["name"]: r["suggestions"] for r in E.audit_names(
        df, "n", L.parse_glossary(gloss_lines), L.raw_targets(gloss_lines)).collect()}
    # "RACING" has no alias, "BARRACAS CENTRALES" none either
    want = {n: difflib.get_close_matches(n, targets, n=3, cutoff=0.4) for n in ("Boca Jrs", "central", "RACING", "xyzw", "BARRACAS CENTRALES")}
    assert got == want


def test_unknown_teams(spark):
    fixtures = spark.createDataFrame([("A", "Z"), (None, "B")], "home string, away string")
    known = spark.createDataFrame([("A", "B")], "home string, away string")
    assert [r["team"] for r in E.unknown_teams(fixtures, known).collect()] == ["Z"]


def test_fixture_lines(spark):
    rows = lines(spark, ["FECHA 8 - x", "FECHA 9 - 2 al 4/05/2026", "Boca - River:", "Boca 2-1 River", "Boca - River: 2-1", "sin guion",
                         "A - B - C", "Lanús – Unión", "Cantidad de penales cobrados: 3", "Cantidad de goles convertidos:", ""])
    got = [(r["Raw_Home"], r["HomeTeam"], r["AwayTeam"], r["Home_Score"], r["Away_Score"]) for r in L.parse_fixtures(rows).orderBy("pos").collect()]
    assert got == [("Boca", "BOCA", "RIVER", None, None), ("Boca", "BOCA", "RIVER", 2, 1), ("Lanús", "LANUS", "UNION DE SANTA FE", None, None)]
    s = L.fixture_summary(rows).first()
    assert (s["header"], s["penales"], s["expulsados"], s["goles"]) == ("FECHA 9 - 2 al 4/05/2026", 3, 0, 0)
    clean = [r["line"] for r in L.clean_fixture_lines(lines(spark, ["\tLanús –  Unión!!", " ¡! ", "Ñu: 1"])).orderBy("pos").collect()]
    assert clean == ["Lanus - Union", "Ñu: 1"]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x -> y\nz\n", encoding="utf-8")
    got = [(r["pos"], r["line"]) for r in L.read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got[:2] == [(0, "x -> y"), (1, "z")]


def test_links(spark):
    rows = lines(spark, ["# c", "River Plate -> https://x.org/209 (209)", "Estudiantes LP -> https://x.org/288", "Estudiantes L.P. -> https://x.org/289 (289)"])
    names = spark.createDataFrame([("river plate",), ("Estudiantes L.P.",), ("Nadie",)], "n string")
    got = {r["n"]: (r["url"], r["club_id"]) for r in L.lookup_links(names, "n", L.parse_links(rows)).collect()}
    assert got == {"river plate": ("https://x.org/209", 209), "Estudiantes L.P.": ("https://x.org/289", 289), "Nadie": (None, None)}


def test_result_reports(spark):
    page = "x\nResultados de la fecha\nFECHA 1 - 22 AL 5/01/2026 Score\nCentral Córdoba - Unión 1 - 0 / 0 / 0 / L\nA-B 2-2 / 0 / 0 / v\nbad / 0 / 0 / L\nA - B 1 - 0 / 0 / L\nTotal 3\nC - D 1 - 0 / 0 / 0 / E"
    docs = spark.createDataFrame([(1, ["", page]), (2, ["nothing"]), (3, [page] + ["-"] * 6), (4, ["-"] * 5 + [page, page]), (5, [])], "d int, pages array<string>")
    got = [(r["d"], r["round_date"], r["Home_Raw"], r["Away_Raw"], r["HG"], r["AG"], r["Res"]) for r in RP.report_results(docs).orderBy("d", "Home_Raw").collect()]
    want = [("05/01/2026", "A", "B", 2, 2, "A"), ("05/01/2026", "Central Córdoba", "Unión", 1, 0, "H")]
    assert got == [(1, *w) for w in want] + [(4, *w) for w in want]


def test_squads(spark):
    docs = [(1, "GK  Franco ARMANI  River Plate"), (2, "Arqueros: Franco Armani (River Plate), Sergio Romero (Boca), Lionel Messi (Miami)"), (3, "x" * 300), (4, "corto")]
    got = {r["doc_id"]: r for r in RP.squad_lists(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert len(got[1]["structured"]) == 1 and not got[1]["has_player_names"] and got[1]["has_club_names"]
    assert [x["name"] for x in got[2]["inline"]] == ["Franco Armani", "Sergio Romero", "Lionel Messi"] and got[2]["has_player_names"]
    assert got[3]["structure"].startswith("text present") and got[4]["structure"] == "not machine-readable"
    entries = RP.squad_entries(spark.createDataFrame(docs, "doc_id int, text string"))
    assert entries.filter("doc_id = 2").count() == 3


def test_page_scores(spark):
    pages = [(1, '<div class="partido x">Boca (H) <b>2</b> - 1 River</div><p>Lanús 3 - 3 Tigre</p>'), (2, "<p>Lanús 3:2 Tigre</p><p>Hora 1 - 0 Club</p>"), (3, "<p>nada</p>"),
             (4, "<div class='fixture'><div class='home'>Unión<br></div> <span>4</span>&nbsp;- 0 <div>Platense (A)</div></div><script>x 1 - 1 y</script>"),
             (5, "<section class='Results'><div class='match'>Uno Dos 1-0 Tres</div></section><!-- Aaa 2 - 2 Bbb -->"),
             (6, "<div class='x'>Aaa 1 - 0 Bbb</div><script>var q = 'Foo 9 - 9 Bar';</script>")]
    got = sorted((r["page_id"], r["Home"], r["Home_Score"], r["Away_Score"], r["Away"], r["source"]) for r in P.page_scores(spark.createDataFrame(pages, "page_id int, html string")).collect())
    assert got == [(1, "Boca", 2, 1, "River", "container"), (2, "Lanús", 3, 2, "Tigre", "text"),
                   (4, "Unión", 4, 0, "Platense", "container"), (5, "Uno Dos", 1, 0, "Tres", "container"),
                   (5, "Uno Dos", 1, 0, "Tres", "container"), (6, "Aaa", 1, 0, "Bbb", "text"),
                   (6, "var q = 'Foo", 9, 9, "Bar';", "text")]


def test_page_scores_with_any_white_space_and_stray_signs(spark):
    pages = [(1, "<p>Lanus FC&nbsp;3&nbsp;-&nbsp;0&nbsp;Banfield</p>"), (2, "<p>Boca\u00a02 - 1\u00a0Tigre</p>"),
             (3, "<p>Boca&emsp;2&emsp;-&emsp;1&emsp;Tigre</p>"), (4, "<p>Boca &nbsp; 2 - 1 &nbsp; Tigre</p>"),
             (5, "x < Boca 2 - 1 Tigre > y"), (6, "<div class=match>Boca <i>2</i>-<b>1</b> Tigre</div>"),
             (7, "<div class=match><div class=result>Boca 2 - 1 Tigre</div></div>"), (8, None), (9, "")]
    got = {}
    for r in P.page_scores(spark.createDataFrame(pages, "page_id int, html string")).collect():
        got.setdefault(r["page_id"], set()).add((r["Home"], r["Home_Score"], r["Away_Score"], r["Away"]))
    assert got.pop(1) == {("Lanus FC", 3, 0, "Banfield")}
    assert got.pop(5) == {("x < Boca", 2, 1, "Tigre > y")}
    assert got == {k: {("Boca", 2, 1, "Tigre")} for k in (2, 3, 4, 6, 7)}


def test_entity_column_looks_at_the_whole_column(spark):
    rows = [(str(i),) for i in range(5)] + [(f"Club {i}",) for i in range(995)]
    assert ST.entity_column(spark.createDataFrame(rows, "v string"), "enhanced") == "v"
    assert ST.entity_column(spark.createDataFrame([(None,)], "v string"), "enhanced") is None


def test_standings(spark):
    nested = {"standings": [{"normalized": "BOCA", "position": 9, "points": 1}],
              "teams": [{"standings": [{"rows": [{"team": {"name": "River"}, "points": 9, "matches": 3, "wins": 3, "goalsFor": 7}, {"team": {"name": "Boca"}, "points": 4}]}]}]}
    flat = {"teams": [{"name": "Unión", "goalsFor": 5, "goals_against": 2, "rating": 6.5}, {"normalized": "UNION DE SANTA FE", "goals_for": 6}]}
    empty = {"standings": [{"normalized": "X"}], "teams": []}
    docs = spark.createDataFrame([(n, json.dumps(d)) for n, d in (("n", nested), ("f", flat), ("e", empty))], "file string, json string")
    got = {(r["file"], r["team"]): r for r in ST2.parse_standings(docs).collect()}
    assert got.keys() == {("n", "BOCA"), ("n", "RIVER"), ("f", "UNION DE SANTA FE")}
    assert got["n", "BOCA"]["position"] == 2 and got["n", "RIVER"]["played"] == 3 and got["n", "RIVER"]["goals_for"] == 7
    assert got["f", "UNION DE SANTA FE"]["goals_for"] == 6 and got["f", "UNION DE SANTA FE"]["goals_against"] == 0
    items = [(1, json.dumps({"table": [{"name": "Lanús", "goalsFor": 3}]})), (2, json.dumps({"name": "Tigre", "points": 4})), (3, json.dumps({"data": {"name": "Otro"}}))]
    raw = {r["item_id"]: r for r in ST2.parse_raw_standings(spark.createDataFrame(items, "item_id int, json string")).collect()}
    assert raw[1]["normalized"] == "LANUS" and raw[1]["goals_for"] == 3 and raw[2]["points"] == 4 and raw[3]["team"] == "Otro"


def test_standings_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"teams": [{"name": "Tigre", "points": 3}]}, indent=1), encoding="utf-8")
    got = ST2.parse_standings(ST2.read_documents(spark, str(tmp_path))).first()
    assert got["team"] == "TIGRE" and got["points"] == 3 and got["position"] == 0


def test_history_goes_to_a_new_path(spark, tmp_path):
    df = spark.createDataFrame([("01/01/2024", "A", "B")], "Date string, Home string, Away string")
    history.write_history(df, str(tmp_path / "h"))
    assert spark.read.csv(str(tmp_path / "h"), header=True).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        history.write_history(df, str(tmp_path / "h"))


def test_match_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "Date,Time,Home,Away,HG,AG,Res,Season,League,B365CH,B365CD,B365CA\n"
        "05/03/2024, 18:00 ,Unión,Boca,1,0,H,2024,L,2.0,3.0,4.0\nbad,,A,B,1,0,H,2024,L,,,\n06/03/2024,,A,,1,0,H,2024,L,,,\n", encoding="utf-8")
    got = M.clean_matches(M.read_matches(spark, str(tmp_path / "m.csv"))).collect()
    assert len(got) == 1
    r = got[0]
    assert (str(r["Date"]), r["Time"], r["Home"], r["Res"]) == ("2024-03-05", "18:00", "UNION DE SANTA FE", 2)
    with pytest.raises(ValueError, match="lacks columns"):
        M.clean_matches(spark.createDataFrame([("a",)], "Home string"))


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Fecha int, `Home Goals` int, other int")
    out, left = E.apply_headers(df)
    assert out.columns == ["Date", "HG", "other"] and left == ["other"]


def test_stat_tables(spark):
    assert ST.distinct_names(["x", "x", "y", "x"]) == ["x", "x_1", "y", "x_2"]
    assert ST.flatten_headers([("Unnamed: 0", "Squad"), ("MP", "Unnamed: 1_level")]) == ["Squad", "MP"]
    df = spark.createDataFrame([("Team", "MP"), ("1. Boca (H)", "3"), ("River", "x"), ("", "4")], "Team string, MP string")
    got = sorted((r["Squad"], r["MP"]) for r in ST.clean_table(df).fillna(-1.0).collect())
    assert got == [("Boca", 3.0), ("River", -1.0)]
    numbers = spark.createDataFrame([("1",), ("2.5",), ("x",)], "v string")
    assert ST.entity_column(numbers, "enhanced") is None and ST.entity_column(numbers) == "v"
    assert ST.table_kind(["Squad", "MP", "GF", "GA"]) == "league_table" and ST.table_kind(["Squad", "xG"]) == "stats_advanced"
    assert ST.table_kind(["a"]) == "other"


def test_append_new(spark):
    old = spark.createDataFrame([("02/01/2024", "A", "B", 1, 2.0)], "Date string, Home string, Away string, HG int, B365CH double")
    new = spark.createDataFrame([("02/01/2024", "A", "B", 1, "f1"), ("01/01/2024", "C", "D", 2, "f2"), ("01/01/2024", "C", "D", 2, "f2"), (None, "E", "F", 0, "f3")],
                                "Date string, Home string, Away string, HG int, source_file string")
    out = history.append_new(old, new)
    assert out.columns == ["Date", "Home", "Away", "HG", "B365CH"]
    assert [r["Home"] for r in out.collect()] == ["C", "C", "A"]
    assert [r[0] for r in history.contributing_files(old, new).collect()] == ["f2"]


def test_report_text(spark, tmp_path):
    row = spark.createDataFrame([("Boca: x", "River", .2, .3, .5, .5, .3, .2)],
                                "Raw_Home string, Raw_Away string, Pred_Proba_Away double, Pred_Proba_Draw double, Pred_Proba_Home double, Shin_Prob_H double, Shin_Prob_D double, Shin_Prob_A double")
    row = row.withColumns({"HomeTeam": F.lit("h"), "AwayTeam": F.lit("a"), "n": F.lit(1)})
    R.write_lines(R.report_lines(row, "n"), str(tmp_path / "r"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "Match: Boca vs River" in text and "Top Pick: Home (Moderate)" in text and "Partidos: 1" in text


def test_validation(spark):
    df = spark.createDataFrame([(1500.0, 900.0), (None, 5000.0), (1500.0, float("inf"))], "Home_Elo double, Away_Elo double")
    got = {r["check"]: r for r in Q.validate_features(df, ["Home_Elo", "Away_Elo"]).collect()}
    assert got["many_nulls:Home_Elo"]["n_bad"] == 1 and got["infinite:Away_Elo"]["n_bad"] == 1 and got["bounds:Away_Elo"]["n_bad"] == 2
    assert Q.validate_features(df, ["nope"]).first()["severity"] == "error"
    assert Q.validate_history(df).first()["message"].startswith("missing required columns")
    with pytest.raises(Exception, match="expected at least 4 rows"):
        Q.require_rows(df, 4).collect()
    ok = Q.validate_all({"a": Q.validate_features(df.filter("Home_Elo is not null and Away_Elo < 1000"), ["Home_Elo"])}).first()
    assert ok["is_valid"] and ok["errors"] == ""


def test_source_health(spark):
    rows = [("s", i >= 5, float(i), i) for i in range(15)] + [("t", True, 2.0, 0)]
    df = spark.createDataFrame(rows, "source string, success boolean, duration double, run_id long").withColumn("ts", F.timestamp_seconds("run_id"))
    got = {r["source"]: r for r in Q.source_health(df).collect()}
    assert got["s"]["success_rate"] == 1.0 and got["s"]["avg_duration"] == 9.5 and got["s"]["total_runs"] == 15 and got["t"]["total_runs"] == 1


def test_coverage_in_either_order(spark):
    m = spark.createDataFrame([("A", "B", "1"), ("B", "A", "1"), ("A", "C", "1"), ("A", "B", "2")], "home string, away string, season string")
    ref = spark.createDataFrame([("B", "A", "1"), ("B", "A", "1")], "home string, away string, season string")
    got = {(r["level"], r["value"]): (r["matches"], r["covered"]) for r in Q.coverage(m, ref).collect()}
    assert got["overall", "all"] == (4, 2) and got["team", "C"] == (1, 0) and got["season", "1"] == (3, 2)


def test_long_runs_of_names(spark):
    docs = [(1, "Aa " * 60_000), (2, "Aa " * 20_000 + "(Club Name)"), (3, "Juan Perez Gomez (Boca) y Solo (X Y Z) Ana Paz ( a ) Eva Sol (ab) McDonald Lee(Foo)")]
    got = {}
    for r in RP.squad_entries(spark.createDataFrame(docs, "doc_id int, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["name"], r["club"]))
    assert 1 not in got and len(got[2]) == 1 and got[2][0][1] == "Club Name" and len(got[2][0][0]) == 59_999
    import re
    from formline import constants as K
    assert got[3] == [(m[1].strip(), m[2].strip()) for m in re.finditer(K.SQUAD_INLINE, docs[2][1])]


def test_containment_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choice("ABÑ ") for _ in range(rng.randint(low, high)))
    patterns = {word(0, 6) for _ in range(120)} | {"A", "AB", "ZZZ", "B" * 40}
    texts = {word(0, 25) for _ in range(80)} | {"B" * 39 + "A", "", "A" + "B" * 10_000}
    got = E.contained_in(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    found = [(r["pattern"], r["text"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(p, t) for p in patterns for t in texts if p and p in t}


def test_partial_match_of_long_names_keeps_file_order(spark):
    long = "X" * 5000 + " RACING CLUB " + "Y" * 5000
    gloss = spark.createDataFrame([("CLUB", "second", 7), ("RACING", "first", 3), (long.upper() + " MORE", "third", 1)], "variant string, target string, ord int")
    df = spark.createDataFrame([(long,), ("a racing b",), ("Y" * 400,)], "n string")
    got = {r["n"]: r["t"] for r in E.match_partial(df, "n", gloss, "t").collect()}
    assert got == {long: "third", "a racing b": "first", "Y" * 400: "third"}


def test_teams_of_page_scores(spark):
    scored = P.page_scores(spark.createDataFrame([(1, "<p>Unión 3 - 1 n.o.b. SF</p>")], "page_id int, html string"))
    gloss = L.parse_glossary(lines(spark, ["NOB SF -> ROSARIO X"]))
    r = P.with_teams(scored, gloss).first()
    assert (r["Home"], r["Home_Team"], r["Away_Team"]) == ("Unión", "UNION DE SANTA FE", "ROSARIO X")


def test_upper_case_keeps_the_length_of_a_text(spark):
    texts = ["Große Straße", "ŉ ǰ ﬁ ᾀ ᾈ ΰ և", "Ñandú xß", "plain", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.upper(F.col("t")).alias("u"), X.canonical(F.col("t")).alias("c"))
    got = {r["t"]: (r["u"], r["c"]) for r in rows.collect()}
    assert got["Große Straße"] == ("GROẞE STRAẞE", "GROẞE STRAẞE")
    assert got["ŉ ǰ ﬁ ᾀ ᾈ ΰ և"][0] == "ŉ ǰ ﬁ ᾈ ᾈ ΰ և"
    assert got["Ñandú xß"] == ("ÑANDÚ Xẞ", "NANDU Xẞ")
    assert got["plain"] == ("PLAIN", "PLAIN") and got[""] == ("", "") and got[None] == (None, "")
    scored = P.with_teams(P.page_scores(spark.createDataFrame([(1, "<p>Straße FC 3 - 1 Weiß SF</p>")], "page_id int, html string")))
    assert [(r["Home_Team"], r["Away_Team"]) for r in scored.collect()] == [("STRAẞE FC", "WEIẞ SF")]
