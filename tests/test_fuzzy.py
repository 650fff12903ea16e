"""Fuzzy pairs against brute force over many rows of few names, of which each two are compared once."""

import random
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from touchline.operators import joining


def test_names_are_compared_once(spark, monkeypatch):
    rng = random.Random(4)
    names = ["Club 1", "Club 2", "Club 12", "Real Club", "", None]
    theirs_of = ["club 1 fc", "club 21", "Club 2", "Real", "Club", None]
    local = [(i, rng.choice("de"), rng.choice(names), rng.choice(names)) for i in range(200)]
    theirs = [(i + 1000, rng.choice("def"), rng.choice(theirs_of), rng.choice(theirs_of)) for i in range(150)]
    local.append((7, "d", "Club 2", "Club 2"))  # an id on two days has the best of both
    calls = spark.sparkContext.accumulator(0)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    def counted(a, b):
        @F.pandas_udf("double")
        def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
            calls.add(len(x))
            return pd.Series([SequenceMatcher(None, s, t).ratio() if s and t else 0.0 for s, t in zip(x, y)], dtype="float64")

        return ratios(a, b)

    monkeypatch.setattr(joining, "similarity", counted)
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, day string, home string, away string")
    got = sorted((r.id, r.other_id, r.score) for r in joining.fuzzy_pairs(frame(local), frame(theirs), ["day"]).collect())
    best = {}
    for i, day, h, a in local:
        met = [((ratio(h, x) + ratio(a, y)) / 2, -j) for j, d, x, y in theirs if d == day]
        best[i] = max([best[i], *met]) if i in best else max(met)
    assert got == sorted((i, -j, s) for i, (s, j) in best.items() if s >= 0.72)
    assert len(got) > 20
    assert calls.value <= 2 * len(names) * len(theirs_of)
