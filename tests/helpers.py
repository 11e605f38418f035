"""Small frames and plain-Python walks the jobs are compared with."""

import random
from collections import defaultdict
from datetime import date, timedelta

MATCH = "match_id long, league string, season string, date date, kickoff string, home string, away string, hg int, ag int, res int"


def result(hg, ag):
    return 2 if hg > ag else 1 if hg == ag else 0


def match(i, day, clock, home, away, hg, ag, league="L", season=None):
    d = date.fromisoformat(day)
    return (i, league, season or str(d.year), d, clock, home, away, hg, ag, result(hg, ag))


def random_matches(n, seed=1, teams=6, leagues=("L", "M"), start=date(2020, 1, 1)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        home, away = rng.sample([f"T{k}" for k in range(teams)], 2)
        clock = rng.choice(["15:00", "15:00", "18:30", "00:10", None, "bad", "9:05"])
        day = start + timedelta(days=rng.randrange(max(2, n // 4)) * 3)
        hg, ag = rng.randrange(5), rng.randrange(4)
        rows.append((i, rng.choice(leagues), str(day.year), day, clock, home, away, hg, ag, result(hg, ag)))
    rng.shuffle(rows)
    return rows


def batches(rows):
    """[(batch key, rows)] in order, with the whole-day rule."""
    import re
    ok = {r[0]: bool(r[4] and re.match(r"^([01]?\d|2[0-3]):[0-5]?\d$", r[4]) and not re.match(r"^00:[0-5]\d$", r[4])) for r in rows}
    loose = {r[3] for r in rows if not ok[r[0]]}
    out = defaultdict(list)
    for r in rows:
        minutes = 0
        if r[3] not in loose:
            h, m = r[4].split(":")
            minutes = int(h) * 60 + int(m)
        out[(r[3], minutes)].append(r)
    return [(k, sorted(v, key=lambda r: r[0])) for k, v in sorted(out.items())]


def points(gf, ga):
    return 3 if gf > ga else 1 if gf == ga else 0


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def stats(history, n):
    last = history[-n:]
    return {"gf": mean([h[0] for h in last]), "ga": mean([h[1] for h in last]),
            "form": mean([points(h[0], h[1]) for h in last]), "n": len(last)}


def decayed(history, n, halflife):
    last = history[-n:]
    if not last:
        return None
    w = [0.5 ** ((len(last) - 1 - i) / halflife) for i in range(len(last))]
    return sum(a * points(h[0], h[1]) for a, h in zip(w, last)) / sum(w)


def form_walk(rows, window=8):
    """match_id -> pre-batch form of both sides, walked match by match."""
    out = {}
    for league in {r[1] for r in rows}:
        history = defaultdict(list)
        # whole-day batches look at all leagues
        for _, batch in batches(rows):
            mine = [r for r in batch if r[1] == league]
            for r in mine:
                sides = {}
                for side, team, at_home in (("home", r[5], True), ("away", r[6], False)):
                    h = history[team]
                    venue = [x for x in h if x[2] == at_home]
                    sides[side] = {"all": stats(h, window), "r5": stats(h, 5), "ewma": decayed(h, window, 2.0),
                                   "venue": stats(venue if len(venue) >= 3 else h, window)}
                out[r[0]] = sides
            for r in sorted(mine, key=lambda r: (r[5] + "\x1f" + r[6], r[0])):
                history[r[5]].append((r[7], r[8], True))
                history[r[6]].append((r[8], r[7], False))
    return out


def expected(a, b):
    return 1 / (1 + 10 ** ((b - a) / 400))


def elo_walk(rows):
    """(match_id -> ratings before, (league, team) -> final rating)."""
    before, final = {}, {}
    for league in {r[1] for r in rows}:
        elo = {}
        for _, batch in batches(rows):
            delta = defaultdict(float)
            for r in batch:
                if r[1] != league:
                    continue
                h, a = elo.get(r[5], 1500.0), elo.get(r[6], 1500.0)
                before[r[0]] = (h, a)
                gain = 30 * (r[9] / 2 - expected(h + 65, a))
                delta[r[5]] += min(max(h + gain, 800), 2800) - h
                delta[r[6]] += min(max(a - gain, 800), 2800) - a
            for t, d in delta.items():
                elo[t] = min(max(elo.get(t, 1500.0) + d, 800), 2800)
        final |= {(league, t): e for t, e in elo.items()}
    return before, final


def margin_walk(rows):
    """match_id -> (home before, away before, home after, away after)."""
    out = {}
    for league in {r[1] for r in rows}:
        elo, season = {}, None
        ordered = [r for _, b in batches(rows) for r in b if r[1] == league]
        for r in ordered:
            if season is not None and r[2] != season:
                elo = {t: 0.8 * e + 0.2 * 1500 for t, e in elo.items()}
            season = r[2]
            h, a = elo.get(r[5], 1500.0), elo.get(r[6], 1500.0)
            gap = abs(r[7] - r[8])
            mult = 1.0 if gap <= 1 else 1.5 if gap == 2 else (11 + gap) / 8
            k = 24 * mult * 2.2 / (abs(h + 65 - a) * 0.001 + 2.2)
            s = 1.0 if r[7] > r[8] else 0.5 if r[7] == r[8] else 0.0
            gain = k * (s - expected(h + 65, a))
            elo[r[5]], elo[r[6]] = min(max(h + gain, 800), 2400), min(max(a - gain, 800), 2400)
            out[r[0]] = (h, a, elo[r[5]], elo[r[6]])
    return out


def plain_bootstrap_weights(items, replicates, seed=42, prime=2 ** 31 - 1):
    """Poisson(1) weights of items in replicates, a row per item."""
    import math
    import numpy as np
    x = (items[:, None] % prime * 48271 + replicates[None, :] * 69621 + seed * 16807) % prime
    for add in (replicates[None, :] + 1, 104729):
        x = (x * x % prime * 40692 + x * 30269 + add) % prime
    limits = [int(prime * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, 10)]
    return sum((x >= limit).astype(int) for limit in limits)
