"""Operators without SQL, and rules that a whole table does not show."""

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from touchline.functions import validation as V  # noqa: N812
from touchline.functions.odds import corrected_market, effective_weights
from touchline.operators import joining, ratings, tuning
from touchline.sources import files
from touchline.sources.fixture_sql import read_matches


def brute_iterative(rows, decay=0.001, passes=10):
    rows = sorted(rows, key=lambda r: (r.date, r.match_id))
    end = max(r.date for r in rows)
    w = {r.match_id: math.exp(-decay * (end - r.date).days) for r in rows}
    mean = sum(w[r.match_id] * r.home_goals for r in rows) / sum(w.values())
    teams = list(dict.fromkeys([*(r.home_team for r in rows), *(r.away_team for r in rows)]))
    attack, defence = dict.fromkeys(teams, 1.0), dict.fromkeys(teams, 1.0)
    for _ in range(passes):
        for t in teams:
            home, away = [r for r in rows if r.home_team == t], [r for r in rows if r.away_team == t]
            base = mean * sum(w[r.match_id] * defence[r.away_team] for r in home)
            if base > 0:
                attack[t] = sum(w[r.match_id] * r.home_goals for r in home) / base
            base = mean * sum(w[r.match_id] * attack[r.home_team] for r in away)
            if base > 0:
                defence[t] = sum(w[r.match_id] * r.home_goals for r in away) / base
    return {t: (attack[t], defence[t]) for t in teams}


def test_iterative_strengths(spark):
    m = read_matches(spark, SF).where("home_goals is not null and away_goals is not null")
    got = {(r.league, r.team): (r.attack, r.defence) for r in ratings.iterative_strengths(m).collect()}
    rows = m.collect()
    want = {(league, t): v for league in {r.league for r in rows} for t, v in brute_iterative([r for r in rows if r.league == league]).items()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-8 for k in want for a, b in zip(got[k], want[k]))


def test_iterative_strengths_of_named_teams_without_goals(spark):
    rows = [(1, "l", "a", "b", "2024-01-01", 0.0, 1.0), (2, "l", "c", "a", "2024-01-02", 0.0, 0.0), (3, "l", "d", "b", "2024-01-02", 0.0, 2.0)]
    m = spark.createDataFrame(rows, "match_id bigint, league string, home_team string, away_team string, d string, home_goals double, away_goals double").withColumn("date", F.to_date("d"))
    # No home goals at all, so there is nothing to divide by and all stay at 1.
    assert {(r.team, r.attack, r.defence) for r in ratings.iterative_strengths(m).collect()} == {(t, 1.0, 1.0) for t in "abcd"}


def test_fuzzy_pairs(spark):
    local = [(1, "d", "Real Oviedo", "FC Porto"), (2, "d", "Ajax", "PSV"), (3, "e", "Ajax", "PSV"), (4, "d", None, "x")]
    theirs = [(10, "d", "R. Oviedo", "Porto"), (11, "d", "Real Oviedo", "Porto FC"), (12, "d", "Real Oviedo", "Porto FC"), (13, "d", "Ajacs", "PSW")]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, day string, home string, away string")
    got = {r.id: (r.other_id, r.score) for r in joining.fuzzy_pairs(frame(local), frame(theirs), ["day"]).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = {}
    for i, day, h, a in local:
        best = max([((ratio(h, x) + ratio(a, y)) / 2, -j) for j, d, x, y in theirs if d == day], default=(0, 0))
        if best[0] >= 0.72:
            want[i] = (-best[1], best[0])
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_tables_that_break_rules(spark):
    rows = spark.createDataFrame([(1, "key", 0), (1, "superstar", -1)], "id int, tier string, minutes int")
    with pytest.raises(ValueError, match="tier is not allowed: 1 rows.*superstar"):
        V.checked(rows, V.allowed("tier", ("key", "bench")))
    with pytest.raises(ValueError, match="repeated keys"):
        V.checked(rows, {}, ["id"])
    with pytest.raises(ValueError, match="missing columns"):
        V.require_columns(rows, ["id", "name"])
    with pytest.raises(ValueError):
        V.odds_source("later")
    assert V.checked(rows, V.not_empty("tier")).count() == 2


def test_league_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_league(spark, f"{tmp_path}/none/*.csv")
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,PSCH,PSCD,PSCA\n01/08/2024,  FC  X ,Y,2,1,1.5,3,4\n,Z,Y,1,1,2,3,4\n")
    (tmp_path / "b.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,PSCH\n2024-08-01,FC X,Y,9,9,9\n02/08/24,Y,FC X,,,x\n")
    got = sorted((str(r.date), r.home_team, r.home_goals, r.odds_home, r.is_played) for r in files.load_league(spark, f"{tmp_path}/*.csv").collect())
    assert got == [("2024-08-01", "FC X", 2.0, 1.5, True), ("2024-08-02", "Y", None, None, False)]
    # Each file by its own header: other columns, other order, a byte order mark, a name given twice or empty, no rows.
    (tmp_path / "c d.csv").write_text("\ufeffFTAG,FTHG,Date,,HomeTeam,AwayTeam,HS,HS,Avg>2.5,Avg<2.5\n1,4,03/08/2024,q,Y,Z,7,8,2.0,2.0\n")
    (tmp_path / "e.csv").write_text("AwayTeam,HomeTeam,Date,FTHG,FTAG,HST\n")
    got = sorted((str(r.date), r.home_team, r.home_goals, r.away_goals, r.home_shots, r.odds_home, r.ou25_over_prob) for r in files.load_league(spark, f"{tmp_path}/*.csv", {"Y": "Why"}).collect())
    assert got == [("2024-08-01", "FC X", 2.0, 1.0, None, 1.5, None), ("2024-08-02", "Why", None, None, None, None, None), ("2024-08-03", "Why", 4.0, 1.0, 7.0, None, 0.5)]
    (tmp_path / "f.csv").write_text("Date,HomeTeam,FTHG,FTAG\n")
    with pytest.raises(ValueError, match="f.csv without AwayTeam"):
        files.load_league(spark, f"{tmp_path}/*.csv")
    (tmp_path / "f.csv").write_text("")
    with pytest.raises(ValueError, match="f.csv without Date, HomeTeam"):
        files.load_league(spark, f"{tmp_path}/*.csv")
    assert files.read_optional(spark, f"{tmp_path}/none.csv", "a int, b string").columns == ["a", "b"]


def test_weights_and_corrections(spark):
    assert effective_weights({"a": 1, "b": 3, "c": 4}, ("c",)) == {"a": 0.25, "b": 0.75} and effective_weights({"a": 0}) == {"xgb": 1.0}
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(corrected_market([F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5)], [F.lit(0.2), F.lit(0.3), F.lit(0.5)], 7.0))]).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(row, (0.2, 0.3, 0.5)))


def test_temperature_is_refined(spark):
    """Probabilities too sure of themselves by a factor of 1.73 are scaled back by it."""
    import random

    rng, rows = random.Random(1), []
    for i in range(6000):
        z = [rng.gauss(0, 1) for _ in range(3)]
        true = [math.exp(x) for x in z]
        y = rng.choices(range(3), true)[0]
        sure = [math.exp(1.73 * x) for x in z]
        rows.append((y, *[x / sum(sure) for x in sure]))
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    t, loss = tuning.fit_temperature(df, [F.col(c) for c in "abc"])
    grid = tuning.least(tuning.temperature_losses(df, [F.col(c) for c in "abc"])).first()
    assert abs(t - 1.73) < 0.15 and loss <= grid.loss
