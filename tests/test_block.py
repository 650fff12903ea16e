"""The block before a match: its ratings are folded once, and a single rating is a number."""

import random

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import prematch
from touchline.operators.ratings import LeagueFold
from touchline.plans.catalog import QUERIES
from touchline.plans.prematch_queries import _context
from touchline.functions.context import fill_context
from touchline.sources.fixture_sql import MORE_COLUMNS, read_matches


def test_ratings_are_folded_once(spark):
    m = read_matches(spark, "/root/testdata/sf0.001").where(F.col("match_id") < 300)
    block = prematch.matchday_block(m.selectExpr("*", *MORE_COLUMNS), fill_context(_context(m)))
    assert "InArrow" not in block._jdf.queryExecution().optimizedPlan().toString()  # else a fold for each use
    assert block.count() == m.count()


def test_long_methods_are_made_of_parts(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["fixtures_projection"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_numbers_and_vectors_are_rated_alike():
    rng = random.Random(3)
    one, many = LeagueFold(50.0, 80.0), LeagueFold(np.array([50.0]), np.array([80.0]))
    for day in range(60):
        for _ in range(3):
            home, away = rng.sample(range(12), 2)
            score = (None, None) if rng.random() < 0.1 else (rng.randrange(6), rng.randrange(6))
            a, b = one.match(day, home, away, *score), many.match(day, home, away, *score)
            assert all(x is y is None or isinstance(x, float) and abs(x - y[0]) < 1e-9 for x, y in zip(a, b))
