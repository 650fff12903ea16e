"""Six places as the SQL has them, at halves too."""

from pathlib import Path

import duckdb
import pytest

from touchline.plans.catalog import ORACLES, QUERIES
from touchline.plans.queries import r6
from touchline.sources.fixture_sql import MATCHES_CTE
from tests.test_queries import rows_of

SF = Path("/root/testdata/sf0.01")
TABLES = ("nation", "customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def two_teams(tmp_path_factory):
    """The tables of sf0.01 with the orders that are matches of two teams, some of whose players' strengths end in half a millionth."""
    folder, con = tmp_path_factory.mktemp("two_teams"), duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    con.execute(f"create table ids as with {MATCHES_CTE} select match_id from matches where home_team in (14, 73) or away_team in (14, 73)")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"copy (select * from {name} where {key} in (select match_id from ids)) to '{folder}/{name}.parquet' (format parquet)")
    for name in ("nation", "customer"):
        (folder / f"{name}.parquet").symlink_to(SF / f"{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["player_window_strength", "runtime_diagnostics"])
def test_strengths_of_two_teams(spark, two_teams, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{two_teams}/{table}.parquet'")
    got, want = rows_of(QUERIES[name](spark, str(two_teams)).toPandas()), rows_of(con.execute(ORACLES[name]).df())
    assert len(got) == len(want)
    wrong = [(x, y) for x, y in zip(got, want) if x != y]
    assert not wrong, (len(wrong), wrong[:3])


def test_halves(spark):
    values = [sign * (k + 0.5) / 1e6 for k in range(0, 1_000_000, 997) for sign in (1, -1)] + [None, float("nan"), float("inf"), 1e12 / 7, -0.0]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    want = duckdb.execute("select round(unnest(?::double[]), 6)", [values]).fetchall()
    assert [str(r.x + 0.0 if r.x is not None else None) for r in r6(rows).orderBy("i").collect()] == [str(w + 0.0 if w is not None else None) for w, in want]
