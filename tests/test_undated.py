"""Matches without a date, in which no player's window may be."""

import duckdb
import pytest

from touchline.plans.catalog import ORACLES, QUERIES
from tests.test_queries import rows_of

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def undated(tmp_path_factory):
    """The tables of sf0.001 with every seventh order's date missing."""
    folder = tmp_path_factory.mktemp("undated")
    for name in TABLES:
        columns = "* replace (case when o_orderkey % 7 = 2 then null else o_orderdate end as o_orderdate)" if name == "orders" else "*"
        duckdb.execute(f"copy (select {columns} from '{SF}/{name}.parquet') to '{folder}/{name}.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["runtime_diagnostics"])
def test_undated_matches(spark, undated, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{undated}/{table}.parquet'")
    got, want = rows_of(QUERIES[name](spark, str(undated)).toPandas()), rows_of(con.execute(ORACLES[name]).df())
    assert len(got) == len(want)
    wrong = [(x, y) for x, y in zip(got, want) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
