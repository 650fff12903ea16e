"""Consensus of books: odd odds, and code short enough for the JVM to compile."""

import re
from itertools import product

from touchline.functions import odds as O  # noqa: N812
from touchline.plans.catalog import QUERIES

NAN, INF = float("nan"), float("inf")


def test_odd_odds_of_books(spark):
    quotes = [(2.0, 3.5, 4.0), (1.5, 4.25, 7.0), (None, 3.0, 3.0), (NAN, 3.0, 3.0), (INF, 3.0, 3.0), (1.0001, 3.0, 3.0)]
    rows = [(i, *a, *b) for i, (a, b) in enumerate(product(quotes, quotes))]
    names = [f"{b}_{leg}" for b in ("x", "y") for leg in O.LEGS]
    df = spark.createDataFrame(rows, "match_id int, " + ", ".join(f"{n} double" for n in names))
    made = O.with_consensus(df, None, [O.legs("x"), O.legs("y")], ["h", "d", "a"])
    found = {r.match_id: (r.h, r.d, r.a) for r in made.collect()}
    for i, (a, b) in enumerate(product(quotes, quotes)):
        fair = [[1 / o / sum(1 / x for x in q) for o in q] for q in (a, b) if q in quotes[:2]]
        if not fair:
            assert found[i] == (None, None, None)
            continue
        mean = [sum(x) / len(fair) for x in zip(*fair)]
        assert all(abs(x - sum(mean) / p) < 1e-12 for x, p in zip(found[i], mean))
    own = O.with_consensus(df, O.legs("x"), [O.legs("y")], ["h", "d", "a"])
    assert {r.match_id: r.h for r in own.collect()}[2] == 2.0


def test_consensus_is_compiled(spark):
    """Beyond 8,000 bytes a method is left to the interpreter, as is each lambda: minutes on 14,743 matches."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["consensus_odds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "lambda" not in text
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
