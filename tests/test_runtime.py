"""What users give: line-ups and absences, and matches that they add."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import joining, prematch, runtime, state
from touchline.sources.fixture_sql import read_matches

ABSENT = "match_id bigint, side string, player string, place int, kind string, status string"


def test_players_once_and_in_order(spark):
    rows = spark.createDataFrame([(1, "home", "b", 2), (1, "home", "a", 1), (1, "home", "b", 0), (1, "away", "b", 5), (1, "home", " ", 3), (1, "home", None, 4)], "match_id bigint, side string, player string, place int")
    assert sorted((r.side, r.player, r.place) for r in runtime.clean_players(rows).collect()) == [("away", "b", 5), ("home", "a", 1), ("home", "b", 0)]


def test_absences_are_checked(spark):
    rows = [(1, "home", "a", 0, None, None), (1, "home", "a", 1, "suspension", "out"), (1, "away", "c", 0, " REST ", "Doubtful")]
    good = runtime.clean_absences(spark.createDataFrame(rows, ABSENT)).collect()
    assert sorted((r.player, r.kind, r.status) for r in good) == [("a", "injury", "out"), ("c", "rest", "doubtful")]
    for bad in (("holiday", "out"), ("injury", "gone")):
        with pytest.raises(ValueError, match="z " + bad[0]):
            runtime.clean_absences(spark.createDataFrame([(1, "home", "z", 0, *bad)], ABSENT))
    assert runtime.clean_absences(spark.createDataFrame([], ABSENT)).count() == 0


def test_own_values_win(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "match_id bigint, a double, b double")
    own = spark.createDataFrame([(1, None, 9.0), (3, 5.0, 7.0)], "match_id bigint, a double, c double")
    assert sorted(tuple(r) for r in runtime.overridden(old, own).select("match_id", "a", "b", "c").collect()) == [(1, 1.0, 2.0, 9.0), (2, 3.0, None, None), (3, 5.0, None, 7.0)]


def test_weather_payloads(spark):
    rows = [(1, '{"hourly": {"time": ["2024-01-02T15:00", null, "soon", "2024-01-02T16:00"], "temperature_2m": [1.5]}}'), (2, "{}"), (3, None), (4, "[]"), (5, '{"hourly": {"time": []}}')]
    out = joining.hourly_weather(spark.createDataFrame(rows, "id int, payload string"), "payload").collect()
    assert [(r.id, str(r.date), r.kickoff_hour, r.temperature_c, r.wind_kph, r.weather_available) for r in out] == [(1, "2024-01-02", 15, 1.5, None, 1), (1, "2024-01-02", 16, None, None, 0)]


def test_state_in_many_steps(spark, tmp_path):
    """Season by season or at once, the state is the same; an empty season changes nothing; windows have a bound."""
    m = read_matches(spark, "/root/testdata/sf0.001").where("league < 2").cache()
    held = None
    for since, until in ((1990, 1994), (1994, 1994), (1994, 1996), (1996, 2100)):
        held = state.advance(m.where(f"year(date) >= {since} and year(date) < {until}"), held)
        held.write(f"{tmp_path}/{until}-{since}")
        held = state.LeagueState.read(spark, f"{tmp_path}/{until}-{since}")
    rounded = lambda s: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in state.standings(s).collect())
    assert rounded(held) == rounded(state.advance(m)) and held.teams.groupBy("league", "team").count().agg(F.max("count")).first()[0] == state.KEPT
    with pytest.raises(ValueError):
        state.sides(m, window=9)
    assert prematch.match_components(m.limit(0), state=held).count() == 0
