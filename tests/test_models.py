"""Named sets of features, and boosted trees that learn what can be learnt."""

import random

import pytest

from touchline.operators import feature_sets, models


def test_feature_sets():
    assert len(feature_sets.EVERY) == len(set(feature_sets.EVERY)) == 89
    widths = {n: len(feature_sets.feature_set(n)) for n in (*feature_sets.CANDIDATES, *feature_sets.NETWORK_CANDIDATES, *feature_sets.ABLATIONS)}
    assert (len(feature_sets.CANDIDATES), len(feature_sets.NETWORK_CANDIDATES), len(set(feature_sets.ABLATIONS))) == (18, 15, 26)
    assert (widths["all"], widths["core"], widths["default"], widths["market_only"], widths["market_plus_odds_context"], widths["no_new_data"], widths["core_plus_external_context"]) == (89, 18, 13, 3, 8, 18, 48)
    assert feature_sets.feature_set("no_rest") == [c for c in feature_sets.EVERY if not c.startswith("rest_")]
    for wrong in ("no_such", "best_plus_stats", "core_plus_nothing"):
        with pytest.raises(ValueError):
            feature_sets.feature_set(wrong)


def test_boosted_trees(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, max(range(3), key=lambda k: x[k] + rng.gauss(0, 0.3)), *x))
    df = spark.createDataFrame(rows, "match_id int, y int, a double, b double, c double").coalesce(1).cache()
    fitted, held = df.where("match_id < 200"), df.where("match_id >= 200")
    scored = models.predict(held, models.fit_boosted(fitted, ["a", "b", "c"], 0.2, 2, 6))
    assert models.loss_of(scored) < 0.9  # 1.0986 without any knowledge
    assert all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 and min(r.p_home, r.p_draw, r.p_away) >= 0 for r in scored.collect())
    again = models.predict(held, models.fit_boosted(fitted, ["a", "b", "c"], 0.2, 2, 6))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
