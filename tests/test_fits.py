"""Fits share one reading of their rows, held in few partitions, and run a few at a time."""

import threading

from pyspark.sql import functions as F

from touchline.operators import models
from touchline.plans import model_queries as Q


def test_boosted_rows_are_made_once(spark, monkeypatch):
    made, fitted = [], []
    season = F.expr("case when match_id % 2 = 0 then date '1996-01-01' else date '1997-01-01' end")
    rows = spark.range(200, numPartitions=40).select(F.col("id").alias("match_id"), season.alias("date"), (F.col("id") % 3).cast("int").alias("y"))
    monkeypatch.setattr(Q, "_vectors", lambda m: made.append(1) or rows)
    monkeypatch.setattr(models, "best_boosted", lambda early, late, names: fitted.extend((early, late)) or (0.1, 2, 0.5))
    monkeypatch.setattr(models, "fit_boosted", lambda held, names, rate, depth: fitted.append(held))
    monkeypatch.setattr(models, "predict", lambda held, model: held.withColumns({p: F.lit(0.5) for p in models.P}))
    assert Q.boosted_probs(None).count() == 100
    assert made == [1] and [x.count() for x in fitted] == [50, 50, 100]
    assert max(x.rdd.getNumPartitions() for x in fitted) == 1


def test_fits_run_at_a_time(spark):
    met = threading.Barrier(3)

    def fit(rows, names):
        met.wait(60)  # broken unless three are on their way
        return len(names)

    monkey = {"loss_of": models.loss_of, "predict": models.predict}
    try:
        models.predict, models.loss_of = lambda rows, model: model, float
        found = models.subset_losses(spark.range(3), spark.range(3), {"c": ["x"] * 3, "a": ["x"], "b": ["x"]}, fit)
    finally:
        models.predict, models.loss_of = monkey["predict"], monkey["loss_of"]
    assert found == [("a", 1, 1.0), ("b", 1, 1.0), ("c", 3, 3.0)]
