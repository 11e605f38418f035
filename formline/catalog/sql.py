"""Building blocks of the SQL statements the queries are checked against."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    """Round, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def pmf_list(lam: str) -> str:
    return f"list_transform(range(0, 9), lambda k: exp(-({lam})) * pow({lam}, k) / factorial(CAST(k AS INTEGER)))"


def expected(team: str, opp: str) -> str:
    return f"(1.0 / (1.0 + pow(10.0, (({opp}) - ({team})) / 400.0)))"


CTES: dict[str, str] = {}

CTES["matches"] = """
SELECT k AS match_id, league, season, date, kickoff, home, away, hg, ag, odds_h, odds_d, odds_a,
       CASE WHEN hg > ag THEN 2 WHEN hg = ag THEN 1 ELSE 0 END AS res
FROM (
  SELECT o_orderkey AS k, o_orderpriority AS league, CAST(year(o_orderdate) AS VARCHAR) AS season,
         CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '00:30'
              ELSE lpad(CAST(12 + o_orderkey % 10 AS VARCHAR), 2, '0') || ':'
                   || lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0') END AS kickoff,
         nh.n_name AS home, na.n_name AS away,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 5 AS INTEGER) AS hg,
         CAST((CAST(round(o_totalprice * 100) AS BIGINT) // 7) % 4 AS INTEGER) AS ag,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1.5 AS DOUBLE) + CAST(o_orderkey % 17 AS DOUBLE) / 10 END AS odds_h,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(3.0 AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE) / 10 END AS odds_d,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(2.0 AS DOUBLE) + CAST(o_orderkey % 23 AS DOUBLE) / 10 END AS odds_a
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation nh ON nh.n_nationkey = c_nationkey
  JOIN nation na ON na.n_nationkey = (c_nationkey + 1 + o_orderkey % 24) % 25)
"""

CTES["batched"] = r"""
SELECT *, CASE WHEN whole_day THEN CAST(date AS TIMESTAMP)
               ELSE CAST(date AS TIMESTAMP) + to_minutes(CAST(split_part(kickoff, ':', 1) AS INTEGER) * 60
                                                         + CAST(split_part(kickoff, ':', 2) AS INTEGER)) END AS batch_ts
FROM (SELECT *, bool_or(NOT (regexp_matches(coalesce(trim(kickoff), ''), '^([01]?\d|2[0-3]):([0-5]?\d)$')
                             AND NOT regexp_matches(coalesce(trim(kickoff), ''), '^00:[0-5][0-9]$')))
                OVER (PARTITION BY date) AS whole_day FROM matches)
"""

CTES["long"] = r"""
SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM (
  SELECT league, batch_ts, home || chr(31) || away AS ident, match_id, home AS team, TRUE AS is_home, hg AS gf, ag AS ga FROM batched
  UNION ALL
  SELECT league, batch_ts, home || chr(31) || away, match_id, away, FALSE, ag, hg FROM batched)
"""


def window_ctes(n: int) -> str:
    return f"""
SELECT match_id, is_home, first(n) OVER b AS n, first(gf) OVER b AS gf, first(ga) OVER b AS ga, first(form) OVER b AS form
FROM (SELECT league, team, batch_ts, ident, match_id, is_home, count(*) OVER w AS n, avg(gf) OVER w AS gf,
             avg(ga) OVER w AS ga, avg(pts) OVER w AS form
      FROM long WINDOW w AS (PARTITION BY league, team ORDER BY batch_ts, ident, match_id, is_home DESC
                             ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))
WINDOW b AS (PARTITION BY league, team, batch_ts ORDER BY ident, match_id, is_home DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


for _n in (5, 8, 10):
    CTES[f"trail{_n}"] = window_ctes(_n)

CTES["venue"] = """
SELECT match_id, is_home,
       CASE WHEN sn >= 3 THEN sform ELSE aform END AS form,
       CASE WHEN sn >= 3 THEN sgf ELSE agf END AS gf,
       CASE WHEN sn >= 3 THEN sga ELSE aga END AS ga
FROM (SELECT v.match_id, v.is_home, t.form AS aform, t.gf AS agf, t.ga AS aga,
             first(v.sn) OVER b AS sn, first(v.sform) OVER b AS sform, first(v.sgf) OVER b AS sgf, first(v.sga) OVER b AS sga
      FROM (SELECT league, team, batch_ts, ident, match_id, is_home,
                   count(*) OVER (PARTITION BY league, team, is_home ORDER BY batch_ts, ident, match_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sn,
                   avg(gf) OVER w AS sgf, avg(ga) OVER w AS sga, avg(pts) OVER w AS sform
            FROM long WINDOW w AS (PARTITION BY league, team, is_home ORDER BY batch_ts, ident, match_id
                                   ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) v
      JOIN trail8 t ON t.match_id = v.match_id AND t.is_home = v.is_home
      WINDOW b AS (PARTITION BY v.league, v.team, v.is_home, v.batch_ts ORDER BY v.ident, v.match_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
"""

# Elo as a fold over the batches of a league; the state is a list indexed by team
# number, and every batch appends the ratings it starts from.
CTES["teams"] = """
SELECT team, CAST(row_number() OVER (ORDER BY team) AS INTEGER) AS no FROM (SELECT DISTINCT team FROM long)
"""
CTES["elo_fold"] = f"""
SELECT league, batches, list_reduce(batches, lambda acc, x: struct_pack(
         ts := x.ts, ms := x.ms, log := list_append(acc.log, acc.cur),
         cur := list_transform(range(1, len(acc.cur) + 1), lambda t:
           CASE WHEN NOT list_contains(x.ts, CAST(t AS INTEGER)) THEN acc.cur[t] ELSE
           least(greatest(acc.cur[t] + list_sum(list_transform(x.ms, lambda m:
             CASE WHEN m.h = t THEN least(greatest(acc.cur[t] + 30.0 * (m.res / 2.0
                    - {expected('acc.cur[m.h] + 65.0', 'acc.cur[m.a]')}), 800.0), 2800.0) - acc.cur[t]
                  WHEN m.a = t THEN least(greatest(acc.cur[t] - 30.0 * (m.res / 2.0
                    - {expected('acc.cur[m.h] + 65.0', 'acc.cur[m.a]')}), 800.0), 2800.0) - acc.cur[t]
                  ELSE 0.0 END)), 800.0), 2800.0) END)),
         struct_pack(ts := CAST([] AS INTEGER[]), ms := CAST([] AS STRUCT(h INTEGER, a INTEGER, res INTEGER)[]),
                     log := CAST([] AS DOUBLE[][]),
                     cur := list_transform(range(0, (SELECT count(*) FROM teams)), lambda i: CAST(1500.0 AS DOUBLE)))) AS acc
FROM (SELECT league, list(struct_pack(ts := ts, ms := ms, log := CAST([] AS DOUBLE[][]), cur := CAST([] AS DOUBLE[]))
                          ORDER BY batch_ts) AS batches
      FROM (SELECT league, batch_ts, list(struct_pack(h := h.no, a := a.no, res := res)) AS ms,
                   list_concat(list(h.no), list(a.no)) AS ts
            FROM batched JOIN teams h ON h.team = home JOIN teams a ON a.team = away
            GROUP BY league, batch_ts)
      GROUP BY league)
"""
CTES["elo"] = """
SELECT b.match_id, log[bn.n][h.no] AS home_elo, log[bn.n][a.no] AS away_elo
FROM batched b JOIN teams h ON h.team = home JOIN teams a ON a.team = away
JOIN (SELECT league, batch_ts, dense_rank() OVER (PARTITION BY league ORDER BY batch_ts) AS n
      FROM (SELECT DISTINCT league, batch_ts FROM batched)) bn ON bn.league = b.league AND bn.batch_ts = b.batch_ts
JOIN (SELECT league, acc.log AS log FROM elo_fold) f ON f.league = b.league
"""

CTES["form"] = """
SELECT b.*, e.home_elo AS Home_Elo, e.away_elo AS Away_Elo,
       coalesce(h.gf, 1.11) AS Home_Avg_GF, coalesce(h.ga, 1.11) AS Home_Avg_GA, coalesce(h.form, 1.0) AS Home_Form,
       coalesce(a.gf, 1.11) AS Away_Avg_GF, coalesce(a.ga, 1.11) AS Away_Avg_GA, coalesce(a.form, 1.0) AS Away_Form
FROM batched b JOIN trail8 h ON h.match_id = b.match_id AND h.is_home
JOIN trail8 a ON a.match_id = b.match_id AND NOT a.is_home
LEFT JOIN elo e ON e.match_id = b.match_id
"""
# Without ratings: for queries on form alone (all teams at the base rating).
CTES["flat"] = CTES["form"].replace("e.home_elo", "1500.0").replace("e.away_elo", "1500.0").replace(
    "LEFT JOIN elo e ON e.match_id = b.match_id", "")


def goals_cte(source: str) -> str:
    return f"""
SELECT *, least(greatest((0.55 * Home_Avg_GF + 0.45 * Away_Avg_GA) * 1.15 * (1 + (Home_Elo - Away_Elo) / 5000.0), 0.3), 2.5) AS xG_home,
       least(greatest((0.55 * Away_Avg_GF + 0.45 * Home_Avg_GA) / (1 + (Home_Elo - Away_Elo) / 5000.0), 0.3), 2.5) AS xG_away
FROM {source}
"""


def grid_cte(source: str, lh: str, la: str, keep: str = "*") -> str:
    """Independent grid: normalised win/draw/loss mass and mean goals."""
    return f"""
SELECT *, win / mass AS w, tie / mass AS d, loss / mass AS l, gh / mass AS eh, ga_ / mass AS ea FROM (
  SELECT *, list_sum(ph) * list_sum(pa) AS mass,
    list_sum(list_transform(range(1, 9), lambda k: ph[k + 1] * list_sum(pa[1:k]))) AS win,
    list_sum(list_transform(range(1, 10), lambda k: ph[k] * pa[k])) AS tie,
    list_sum(list_transform(range(1, 9), lambda k: pa[k + 1] * list_sum(ph[1:k]))) AS loss,
    list_sum(list_transform(range(0, 9), lambda k: ph[k + 1] * k)) * list_sum(pa) AS gh,
    list_sum(list_transform(range(0, 9), lambda k: pa[k + 1] * k)) * list_sum(ph) AS ga_
  FROM (SELECT {keep}, {pmf_list(lh)} AS ph, {pmf_list(la)} AS pa FROM {source}))
"""


def calibrated_cte(source: str) -> str:
    return f"""
SELECT *, qh / (qh + qd + qa) AS Poisson_Home_Win, qd / (qh + qd + qa) AS Poisson_Draw, qa / (qh + qd + qa) AS Poisson_Away_Win
FROM (SELECT *, d * 1.11 AS qd, least(greatest(w / (w + l) * (1 - d * 1.11) + 0.02, 0), 1) AS qh,
             least(greatest(l / (w + l) * (1 - d * 1.11) - 0.01, 0), 1) AS qa FROM {source})
"""


CTES["flat_goals"] = goals_cte("flat")
CTES["flat_grid"] = grid_cte("flat_goals", "xG_home", "xG_away")
CTES["flat_outcome"] = calibrated_cte("flat_grid")
CTES["goals"] = goals_cte("form")
CTES["grid"] = grid_cte("goals", "xG_home", "xG_away")
CTES["outcome"] = calibrated_cte("grid")

_P = "pow((sqrt(z * z + 4 * (1 - z) * {p}) - z) / (2 * (1 - z)), 2)"


def shin_cte(source: str = "matches") -> str:
    """Insider share by bisection, as a fold over the halvings."""
    terms = " + ".join(
        f"pow((sqrt(m * m + 4 * (1 - m) * {p}) - m) / (2 * (1 - m)), 2)" for p in ("ph", "pd", "pa"))
    fold = ("list_reduce(list_transform(range(0, 60), lambda i: struct_pack(lo := CAST(0 AS DOUBLE), hi := CAST(0 AS DOUBLE), "
            "ph := ph, pd := pd, pa := pa)), lambda s, i: CASE WHEN ("
            + terms.replace("ph", "s.ph").replace("pd", "s.pd").replace("pa", "s.pa").replace("m", "((s.lo + s.hi) / 2)")
            + ") > 1 THEN struct_pack(lo := (s.lo + s.hi) / 2, hi := s.hi, ph := s.ph, pd := s.pd, pa := s.pa)"
            " ELSE struct_pack(lo := s.lo, hi := (s.lo + s.hi) / 2, ph := s.ph, pd := s.pd, pa := s.pa) END, "
            "struct_pack(lo := CAST(0 AS DOUBLE), hi := CAST(0.9999999999 AS DOUBLE), ph := ph, pd := pd, pa := pa))")
    p = {x: _P.format(p=x) for x in ("ph", "pd", "pa")}
    return f"""
SELECT *, CASE WHEN ph IS NULL THEN 1.0 / 3 WHEN z IS NULL THEN ph / (ph + pd + pa) ELSE {p['ph']} END AS Shin_Prob_H,
       CASE WHEN ph IS NULL THEN 1.0 / 3 WHEN z IS NULL THEN pd / (ph + pd + pa) ELSE {p['pd']} END AS Shin_Prob_D,
       CASE WHEN ph IS NULL THEN 1.0 / 3 WHEN z IS NULL THEN pa / (ph + pd + pa) ELSE {p['pa']} END AS Shin_Prob_A
FROM (SELECT *, CASE WHEN ph + pd + pa >= 1 AND ph * ph + pd * pd + pa * pa < 1 THEN ({fold}).lo END AS z
      FROM (SELECT *, CASE WHEN ok THEN 1.0 / odds_h END AS ph, CASE WHEN ok THEN 1.0 / odds_d END AS pd,
                   CASE WHEN ok THEN 1.0 / odds_a END AS pa
            FROM (SELECT *, coalesce(odds_h > 0 AND odds_d > 0 AND odds_a > 0, FALSE) AS ok FROM {source})))
"""


CTES["shin"] = shin_cte()

DEPENDS = {
    "batched": ["matches"], "long": ["batched"], "trail5": ["long"], "trail8": ["long"], "trail10": ["long"],
    "venue": ["trail8"], "teams": ["long"], "elo_fold": ["teams"], "elo": ["elo_fold"],
    "form": ["trail8", "elo"], "flat": ["trail8"], "flat_goals": ["flat"], "flat_grid": ["flat_goals"],
    "flat_outcome": ["flat_grid"], "goals": ["form"], "grid": ["goals"], "outcome": ["grid"], "shin": ["matches"],
}


def with_ctes(needed: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the needed blocks and what they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in order]
    parts += [f"{name} AS ({text.strip()})" for name, text in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
