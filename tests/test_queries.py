"""Every match query against its SQL in DuckDB, and properties that SQL does not show."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from touchline.operators import asof, ratings
from touchline.plans.catalog import ORACLES, QUERIES
from touchline.sources.fixture_sql import TABLES, read_matches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v) -> str:
    """Days alike, whether they come as dates or as midnights; arrays as lists."""
    return str(pd.Timestamp(v).date()) if isinstance(v, (pd.Timestamp, datetime.date)) and pd.Timestamp(v) == pd.Timestamp(v).normalize() else str(list(v) if isinstance(v, np.ndarray) else v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        out.append(tuple(None if np.ndim(v) == 0 and pd.isna(v) else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else plain(v) for v in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows_of(got), rows_of(want)
        assert len(a) == len(b)
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        assert not wrong, (len(wrong), wrong[:3])
    else:
        assert len(got)


def brute_elo(m: pd.DataFrame, k, home_adv, by_day):
    out = {}
    for _, rows in m.groupby("league"):
        r, rows = {}, rows.sort_values(["date", "match_id"])
        frozen, day = {}, None
        for x in rows.itertuples():
            if x.date != day:
                frozen, day = dict(r), x.date
            seen = frozen if by_day else r
            start = lambda d: sum(sorted(d.values())[:3]) / 3 if len(d) >= 5 else 1500.0
            e = start(seen)
            h, a = seen.get(x.home_team, e), seen.get(x.away_team, e)
            out[x.match_id] = (h, a)
            e = start(r)
            r.setdefault(x.home_team, e)
            r.setdefault(x.away_team, e)
            d = x.home_goals - x.away_goals
            w = {0: 1, 1: 1, 2: 1.5, 3: 1.75}.get(abs(d), 2)
            s = k * w * ((d > 0) + 0.5 * (d == 0) - 1 / (1 + 10 ** (-(r[x.home_team] + home_adv - r[x.away_team]) / 400)))
            r[x.home_team] += s
            r[x.away_team] -= s
    return out


@pytest.mark.parametrize("by_day", [True, False])
def test_elo(spark, by_day):
    m = read_matches(spark, SF)
    want = brute_elo(m.where("home_goals is not null and away_goals is not null").toPandas(), 50, 80, by_day)
    got = {r.match_id: (r.home_elo, r.away_elo) for r in ratings.elo(m, 50, 80, by_day).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for i in got for a, b in zip(got[i], want[i]))


def test_future_rows_change_nothing(spark):
    m = read_matches(spark, SF)
    cut = "1996-01-01"
    early = asof.rolling_means(m.where(f"date < '{cut}'")).toPandas()
    both = asof.rolling_means(m).where(f"date < '{cut}'").toPandas()
    assert rows_of(early) == rows_of(both)


def test_empty_matches(spark):
    m = read_matches(spark, SF).limit(0)
    for f in (asof.rolling_means, asof.fixture_diffs, asof.points_form, asof.rest_days, asof.last_matches, asof.strengths, ratings.elo, ratings.momentum):
        assert f(m).count() == 0
