"""What a query returns for every match, team and day, where a part would look as good."""

import math

import pytest

from tests.test_queries import SF, brute_elo
from touchline.operators import asof
from touchline.plans.catalog import QUERIES
from touchline.sources.fixture_sql import read_matches


@pytest.fixture(scope="module")
def matches(spark):
    return read_matches(spark, SF).cache()


def brute_strengths(rows, decay=0.001):
    """Means and the four strengths of ``rows`` (pandas), as the survey's A3 has them."""
    if rows.empty:
        return 1.35, 1.10, {}
    w = (-decay * (rows.date.max() - rows.date).map(lambda d: d.days)).map(math.exp)
    mh, ma = (w * rows.home_goals).sum() / w.sum(), (w * rows.away_goals).sum() / w.sum()
    out = {}
    for team in set(rows.home_team) | set(rows.away_team):
        h, a = rows.home_team == team, rows.away_team == team
        parts = [(h, rows.home_goals, mh), (h, rows.away_goals, ma), (a, rows.away_goals, ma), (a, rows.home_goals, mh)]
        out[team] = [min(max(((w * g)[side].sum() + 1e-9) / (mean * w[side].sum() + 1e-9), 0.3), 3.0) for side, g, mean in parts]
    return mh, ma, out


def test_rates_of_every_match(matches):
    m = matches.toPandas()
    got = {r.match_id: r for r in asof.rates_asof(matches).collect()}
    assert got.keys() == set(m.match_id)
    played = m[m.home_goals.notna() & m.away_goals.notna()]
    for x in m.sort_values("date").iloc[:: len(m) // 60].itertuples():
        mh, ma, s = brute_strengths(played[(played.league == x.league) & (played.date < x.date)])
        h, a = s.get(x.home_team, [1.0] * 4), s.get(x.away_team, [1.0] * 4)
        want = max(mh * h[0] * a[3], 0.05), max(ma * a[2] * h[1], 0.05)
        assert abs(got[x.match_id].home_rate - want[0]) < 1e-6 and abs(got[x.match_id].away_rate - want[1]) < 1e-6


def test_elo_moves_the_rates(spark, matches):
    m = matches.toPandas()
    rates = {r.match_id: r for r in asof.rates_asof(matches).collect()}
    elo = brute_elo(m[m.home_goals.notna() & m.away_goals.notna()], 50, 80, True)
    got = {r.match_id: r for r in QUERIES["elo_adjusted_lambdas_asof"](spark, SF).collect()}
    assert got.keys() == set(m.match_id)
    for i, (home, away) in elo.items():
        assert abs(got[i].home_rate - max(rates[i].home_rate * math.exp(0.11 * (home - away) / 400), 0.05)) < 1e-5


@pytest.mark.parametrize("name", ["poisson_outcome_asof", "dixon_coles_outcome_asof", "context_outer_merge_all"])
def test_one_row_a_match(spark, matches, name):
    ids = [r.match_id for r in QUERIES[name](spark, SF).select("match_id").collect()]
    assert sorted(ids) == sorted(r.match_id for r in matches.select("match_id").collect())


def test_strengths_of_every_team_and_day(spark, matches):
    m = matches.toPandas()
    keys = set(zip(m.league, m.home_team, m.date)) | set(zip(m.league, m.away_team, m.date))
    got = QUERIES["strength_decayed_split_asof"](spark, SF).collect()
    assert len(got) == len(keys) and {(r.league, r.team, r.date) for r in got} == keys


def test_strengths_at_the_end(matches):
    m = matches.toPandas()
    played = m[m.home_goals.notna() & m.away_goals.notna()]
    want = {(league, team): v for league, rows in played.groupby("league") for team, v in brute_strengths(rows)[2].items()}
    got = {(r.league, r.team): r[2:] for r in asof.decayed_strengths(matches).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k]))


def test_every_statistic(spark):
    assert len(QUERIES["rolling_form_5_all"](spark, SF).columns) == 4 + 12
    assert len(QUERIES["rolling_stats_diffs_all"](spark, SF).columns) == 1 + 12
    assert len(QUERIES["last_k_sequence_all"](spark, SF).columns) == 5 + 14


def test_a_cell_that_earns_in_one_half_of_the_time_fails(spark):
    from touchline.operators import betting

    # Wins in the first half of the days only; by parity of the id both halves would earn.
    days = [f"1996-{1 + k // 20:02d}-{1 + k % 20:02d}" for k in range(121)]
    rows = [(k, days[k], 0.2, 0.6, 2.5, int(k < 61), 0.1 if k < 61 else -0.05, 0.05) for k in range(121)]
    bets = spark.createDataFrame(rows, "match_id long, date string, ev double, bet_prob double, bet_odds double, won int, profit double, stake double")
    folded = betting.chrono_fold(bets)
    assert {r.match_id: r.fold for r in folded.collect()} == {k: 1 if k < 61 else 2 for k in range(121)}
    r = betting.choose_cell(folded, bets).collect()[0]
    assert (r.robust, r.eligible, r.cell, r.test_bets) == (False, 0, betting.FALLBACK, 121) and (r.edge, r.least_prob, r.low, r.high) == (0.05, 0.0, 1.01, 10.0)
    always = bets.selectExpr("match_id", "date", "ev", "bet_prob", "if(match_id % 2 = 0, 1.9, 2.5) as bet_odds", "won", "if(match_id % 2 = 0, 0.02, 0.01) as profit", "stake")
    r = betting.choose_cell(betting.chrono_fold(always), always.limit(0)).collect()[0]
    assert r.robust and r.low <= 1.9 <= r.high < 2.5 and (r.test_bets, r.test_roi) == (0, 0.0)


def test_a_correction_must_gain_in_each_fold(spark):
    from touchline.operators import metrics

    def verdict(rows):
        r = metrics.accept_correction(spark.createDataFrame(rows, "fold int, alpha double, loss double")).collect()[0]
        return r.alpha, r.accepted, r.reason

    base = [(None, 0.0, 1.0), (1, 0.0, 1.0), (2, 0.0, 1.0)]
    assert verdict(base + [(None, 0.1, 0.99), (1, 0.1, 0.98), (2, 0.1, 1.0)]) == (0.1, True, None)
    assert verdict(base + [(None, 0.1, 0.99), (1, 0.1, 0.97), (2, 0.1, 1.01)]) == (0.0, False, "failed_chronological_fold_gate")
    assert verdict(base + [(None, 0.1, 0.9996), (1, 0.1, 0.9), (2, 0.1, 0.9)]) == (0.0, False, "insufficient_late_validation_improvement")
