"""Searches, resampling and recalibration against plain Python."""

import datetime
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models, resampling, search, tuning
from touchline.operators.ratings import LeagueFold

SEASON = "date >= date '2024-01-01'"
GAINS, ADVANTAGES, BETAS, DECAYS, RHOS = (40, 60), (60, 110), (0.1, 0.13), (0.0005, 0.003), (-0.2, 0.0, 0.1)


def league_matches(seed=4):
    rng, rows, day = random.Random(seed), [], datetime.date(2023, 1, 1)
    for k in range(220):
        league = k % 2
        home, away = rng.sample(range(5 if day.year == 2023 else 6), 2)
        rows.append((k, league, day, home, away, None if k % 31 == 0 else float(rng.choice([0, 1, 1, 2, 3, home])), float(rng.choice([0, 0, 1, 2]))))
        if k % 3 == 0:
            day += datetime.timedelta(days=6)
    return rows


def matches_table(spark, rows):
    return spark.createDataFrame(rows, "match_id bigint, league int, date date, home_team int, away_team int, home_goals double, away_goals double").withColumns({f"{side}_{c}": F.lit(None).cast("double") for side in ("home", "away") for c in ("shots", "corners", "xg", "shots_target", "npxg", "xpts", "yellows", "reds")})


def chances(home, away, rho=0.0):
    grid = {}
    most = min((1 - 1e-6) / (home * away), 1 - 1e-6)
    r = max(-most, min(rho, most))
    for h in range(11):
        for a in range(11):
            p = math.exp(-home - away) * home**h / math.factorial(h) * away**a / math.factorial(a)
            p *= {(0, 0): 1 - home * away * r, (0, 1): 1 + home * r, (1, 0): 1 + away * r, (1, 1): 1 - r}.get((h, a), 1.0)
            grid[h, a] = max(0.0, p)
    total = sum(grid.values())
    return [sum(p for (h, a), p in grid.items() if f(h, a)) / total for f in (lambda h, a: h > a, lambda h, a: h == a, lambda h, a: h < a)]


def moved(home, away, diff, beta):
    return max(home * math.exp(beta * diff / 400), 0.05), max(away * math.exp(-beta * diff / 400), 0.05)


def result(r):
    return 0 if r[5] > r[6] else 1 if r[5] == r[6] else 2


def rated(rows, k, advantage, by_day):
    fold, out = LeagueFold(np.array([float(k)]), np.array([float(advantage)]), by_day), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        h, a, _, _ = fold.match(r[2], r[3], r[4], r[5], r[6])
        out[r[0]] = float(h[0] - a[0])
    return out


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def adjusted(rows, decay):
    end = max(r[2] for r in rows)
    w = {r[0]: math.exp(-decay * (end - r[2]).days) for r in rows}
    total = sum(w.values())
    home, away = sum(w[r[0]] * r[5] for r in rows) / total, sum(w[r[0]] * r[6] for r in rows) / total
    teams = list(dict.fromkeys([r[3] for r in rows] + [r[4] for r in rows]))
    attack, defence = dict.fromkeys(teams, 1.0), dict.fromkeys(teams, 1.0)
    for _ in range(10):
        for t in teams:
            base = sum(w[r[0]] * home * defence[r[4]] for r in rows if r[3] == t)
            if base > 0:
                attack[t] = sum(w[r[0]] * r[5] for r in rows if r[3] == t) / base
            base = sum(w[r[0]] * home * attack[r[3]] for r in rows if r[4] == t)
            if base > 0:
                defence[t] = sum(w[r[0]] * r[5] for r in rows if r[4] == t) / base
    return home, away, attack, defence


def rates_before(rows, day, home_team, away_team, decay):
    """As the season goes: from all matches of earlier days, weighed back from the last of them."""
    past = [r for r in rows if r[2] < day]
    if not past:
        return 1.35, 1.10
    end = max(r[2] for r in past)
    w = lambda r: math.exp(-decay * (end - r[2]).days)
    n = sum(map(w, past))
    mh, ma = sum(w(r) * r[5] for r in past) / n, sum(w(r) * r[6] for r in past) / n
    ratio = lambda own, goals, m: min(max((sum(w(r) * r[goals] for r in own) + 1e-9) / (m * sum(map(w, own)) + 1e-9), 0.3), 3.0)
    at_home, on_road = [r for r in past if r[3] == home_team], [r for r in past if r[4] == away_team]
    return max(mh * ratio(at_home, 5, mh) * ratio(on_road, 5, mh), 0.05), max(ma * ratio(on_road, 6, ma) * ratio(at_home, 6, ma), 0.05)


def plain_search(rows):
    rows = [r for r in rows if r[5] is not None]
    season = [r for r in rows if r[2] >= datetime.date(2024, 1, 1)]
    train = [r for r in rows if r[2] < min(r[2] for r in season)]
    home, away = mean(r[5] for r in train), mean(r[6] for r in train)
    scored, missed = defaultdict(list), defaultdict(list)
    for r in train:
        for t, f, a in ((r[3], r[5], r[6]), (r[4], r[6], r[5])):
            scored[t].append(f)
            missed[t].append(a)
    level = (home + away) / 2 + 1e-6
    attack, defence = {t: mean(v) / level for t, v in scored.items()}, {t: mean(v) / level for t, v in missed.items()}
    best = None
    for k in GAINS:
        for adv in ADVANTAGES:
            diff = rated(train + season, k, adv, False)
            for b in BETAS:
                loss = mean(-math.log(chances(*moved(home * attack.get(r[3], 1) * defence.get(r[4], 1), away * attack.get(r[4], 1) * defence.get(r[3], 1), diff[r[0]], b))[result(r)]) for r in season)
                if best is None or loss < best[0]:
                    best = (loss, k, adv, b)
    loss, k, adv, b = best
    diff, chosen = rated(train + season, k, adv, False), None
    for d in DECAYS:
        mh, ma, att, dfn = adjusted(train, d)
        x = mean(-math.log(chances(*moved(mh * att.get(r[3], 1) * dfn.get(r[4], 1), ma * att.get(r[4], 1) * dfn.get(r[3], 1), diff[r[0]], b))[result(r)]) for r in season)
        if chosen is None or x < chosen[0]:
            chosen = (x, d)
    diff, joint = rated(rows, k, adv, True), None
    for rho in RHOS:
        probs = [(chances(*moved(*rates_before(rows, r[2], r[3], r[4], chosen[1]), diff[r[0]], b), rho), result(r)) for r in season]
        at = lambda t: mean(-math.log(p[y] ** (1 / t) / sum(q ** (1 / t) for q in p)) for p, y in probs)
        t = min(tuning.TEMPERATURES, key=at)
        low, high = max(0.1, t - 0.1), min(10.0, t + 0.1)
        for _ in range(60):
            a, c = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, c) if at(a) < at(c) else (a, high)
        if joint is None or at(low) < joint[0] - 1e-12:
            joint = (at(low), rho, low)
    return (k, adv, b, loss, chosen[1], chosen[0], joint[1], joint[2], joint[0])


def test_parameter_search(spark):
    rows = league_matches()
    got = {r.league: tuple(r)[1:] for r in search.league_params(matches_table(spark, rows), SEASON, GAINS, ADVANTAGES, BETAS, DECAYS, RHOS).collect()}
    for league in (0, 1):
        want = plain_search([r for r in rows if r[1] == league])
        assert got[league] == pytest.approx(want, abs=2e-3) and got[league][3] == pytest.approx(want[3], abs=1e-9) and got[league][8] == pytest.approx(want[8], abs=1e-6)
    assert search.league_params(matches_table(spark, []), SEASON).collect() == []


def plain_mixed(x):
    m = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def plain_times(i, b, seed):
    u = (plain_mixed(plain_mixed((i + seed) & ((1 << 64) - 1)) ^ plain_mixed(b)) >> 11) * 2.0**-53
    k, total, term = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 19:
        k += 1
        term /= k
        total += term
    return k


def test_resampling(spark):
    rng = random.Random(3)
    rows = [(i, *[v for _ in "ab" for v in (rng.random(), rng.random() - 0.5, *((0.02, rng.choice([-0.02, 0.05]), rng.random() - 0.4) if rng.random() < 0.6 else (None, None, None)))]) for i in range(-3, 120)]
    names = [f"{v}_{m}" for m in "ab" for v in ("loss", "diff", "stake", "profit", "clv")]
    df = spark.createDataFrame(rows, "match_id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r.model: r for r in resampling.bounds(df, ["a", "b"], rounds=200, seed=11).collect()}
    weights = [[plain_times(r[0], b, 11) for r in rows] for b in range(1, 201)]
    assert 0.9 < mean(map(mean, weights)) < 1.1
    for j, m in enumerate("ab"):
        loss, diff, stake, profit, clv = ([r[1 + 5 * j + k] for r in rows] for k in range(5))
        d = [sum(w * x for w, x in zip(ws, diff)) / sum(ws) for ws in weights]
        roi = [100 * sum(w * (x or 0) for w, x in zip(ws, profit)) / sum(w * (x or 0) for w, x in zip(ws, stake)) for ws in weights]
        c = [100 * sum(w * x for w, x in zip(ws, clv) if x is not None) / sum(w for w, x in zip(ws, clv) if x is not None) for ws in weights]
        r = got[m]
        ends = lambda v: tuple(np.percentile(v, (2.5, 97.5)))
        assert (r.diff_low, r.diff_high) == pytest.approx(ends(d)) and (r.roi_low, r.roi_high) == pytest.approx(ends(roi)) and (r.clv_low, r.clv_high) == pytest.approx(ends(c))
        assert r.log_loss == pytest.approx(mean(loss)) and r.bets == sum(s is not None for s in stake) and r.roi_significant == (r.bets >= 50 and (r.roi_low > 0 or r.roi_high < 0))
    assert resampling.resampled_sums(df.limit(0), ["loss_a"], 3).count() in (0, 3)


def isotonic(x, y, at):
    """By the max-min formula, a line between the values at neighbouring x."""
    xs = sorted(set(x))
    hits, n = [sum(b for a, b in zip(x, y) if a == v) for v in xs], [sum(a == v for a in x) for v in xs]
    fit = [max(min(sum(hits[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    return float(np.interp(at, xs, fit))


def test_isotonic_out_of_fold(spark):
    rng, rows = random.Random(6), []
    for i in range(160):
        p = [rng.choice([0.2, 0.3, 0.5, rng.random() + 0.05]) for _ in range(3)]
        p = [v / sum(p) for v in p]
        y = 0 if i % 40 == 39 else rng.choices(range(3), p)[0] if i < 156 else None
        rows.append((i, "few" if i % 40 == 39 else f"l{i % 2}", y, *p))
    df = spark.createDataFrame(rows, "match_id bigint, league string, y int, p_home double, p_draw double, p_away double")
    got = {r.match_id: (r.p_home, r.p_draw, r.p_away) for r in models.cross_fitted_isotonic(df, 5, 9, "league").collect()}
    assert len(got) == len(rows)
    order = {r.match_id: (r.h, r.match_id) for r in df.select("match_id", F.xxhash64(F.lit(9), "match_id").alias("h")).collect()}
    for league in ("l0", "l1", "few"):
        own = [r for r in rows if r[1] == league and r[2] is not None]
        by_y = {y: sorted((r for r in own if r[2] == y), key=lambda r: order[r[0]]) for y in range(3)}
        splits = min(5, *map(len, by_y.values()))
        fold = {r[0]: k % splits for part in by_y.values() for k, r in enumerate(part)} if splits >= 2 else {}
        for r in [r for r in rows if r[1] == league]:
            if r[0] not in fold:
                assert got[r[0]] == pytest.approx(r[3:])
                continue
            known = [q for q in own if fold[q[0]] != fold[r[0]]]
            new = [isotonic([q[3 + j] for q in known], [float(q[2] == j) for q in known], r[3 + j]) for j in range(3)]
            want = [v / sum(new) for v in new] if sum(new) > 1e-15 else [v / sum(r[3:]) for v in r[3:]]
            assert got[r[0]] == pytest.approx(want)


def test_simplex():
    cells = tuning.simplex(4, 0.05)
    assert len(cells) == 1771 and len(set(cells)) == 1771 and all(abs(sum(c) - 1) < 1e-9 for c in cells) and cells == sorted(cells)
