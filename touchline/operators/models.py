"""Learned models of the outcome over the pre-match vector, with Spark ML, and their choice by log loss.

As in the base pipeline, models are fitted on the validation season: on its early half to choose by its late half, then on
all of it. Boosted trees are three ensembles, one against the others; the network is Spark's perceptron.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from touchline.functions.odds import LEGS
from touchline.operators import metrics

P = [f"p_{leg}" for leg in LEGS]
#: Inverse strengths of the logistic model's penalty that are tried.
PENALTIES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
Fit = Callable[[DataFrame, list[str]], PipelineModel]
#: Fits that run at a time: each is many small jobs, one after the other, which leave most cores idle.
AT_ONCE = 6


def _each(rows: DataFrame, make: Callable, cases: list) -> list:
    """What ``make`` gives for each case, in order, a few at a time."""
    with ThreadPool(min(AT_ONCE, max(len(cases), 1))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(make), cases, chunksize=1)


def _pipeline(names: list[str], classifier, scaled: bool = True, imputed: bool = False) -> Pipeline:
    held = [f"__i_{n}" for n in names] if imputed else names
    stages = [Imputer(strategy="median", inputCols=names, outputCols=held)] if imputed else []
    stages.append(VectorAssembler(inputCols=held, outputCol="__raw", handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, classifier.setFeaturesCol("__x" if scaled else "__raw").setLabelCol("y").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__o")])


def fit_logistic(rows: DataFrame, names: list[str], c: float = 1.0) -> PipelineModel:
    """Multinomial logistic regression on scaled features; ``c`` over the number of rows is the inverse penalty."""
    return _pipeline(names, LogisticRegression(family="multinomial", regParam=1.0 / (c * max(rows.count(), 1)), maxIter=60)).fit(rows)


def fit_forest(rows: DataFrame, names: list[str], trees: int = 40, depth: int = 5) -> PipelineModel:
    return _pipeline(names, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7), scaled=False).fit(rows)


class Boosted:
    """Boosted trees for three outcomes: an ensemble for each against the others, their probabilities made to sum to 1."""

    def __init__(self, assembled: PipelineModel, models: list):
        self.assembled, self.models = assembled, models

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.assembled.transform(rows)
        for k, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"__b{k}", F.get(vector_to_array(f"__q{k}"), F.lit(1)))
        total = F.greatest(F.col("__b0") + F.col("__b1") + F.col("__b2"), F.lit(1e-12))
        return out.withColumn("__p", array_to_vector(F.array(*[F.col(f"__b{k}") / total for k in range(3)])))


def fit_boosted(rows: DataFrame, names: list[str], rate: float = 0.1, depth: int = 2, trees: int = 20) -> Boosted:
    """Gradient-boosted trees by Spark ML, which has them for two classes; an outcome that no row has gets no probability."""
    assembled = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__raw", handleInvalid="keep")]).fit(rows)
    held = assembled.transform(rows).select("__raw", "y").persist()

    def one(k: int):
        label = held.withColumn("__y", (F.col("y") == k).cast("double"))
        gbt = GBTClassifier(featuresCol="__raw", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=7, subsamplingRate=1.0)
        return gbt.fit(label).setProbabilityCol(f"__q{k}").setRawPredictionCol(f"__v{k}").setPredictionCol(f"__o{k}")

    held.count()  # kept once, before three fits ask for it
    models = _each(held, one, [0, 1, 2])
    held.unpersist()
    return Boosted(assembled, models)


#: Learning rates and depths that are tried.
BOOSTED_CELLS = ((0.05, 2), (0.1, 2), (0.1, 3))


def best_boosted(early: DataFrame, late: DataFrame, names: list[str], cells: tuple[tuple[float, int], ...] = BOOSTED_CELLS, trees: int = 20) -> tuple[float, int, float]:
    """(rate, depth, log loss on the late half) of the least loss, of equal ones the first."""
    losses = [(loss_of(predict(late, fit_boosted(early, names, rate, depth, trees))), k) for k, (rate, depth) in enumerate(cells)]
    loss, k = min(losses)
    return (*cells[k], loss)


def fit_network(rows: DataFrame, names: list[str], hidden: int = 16) -> PipelineModel:
    return _pipeline(names, MultilayerPerceptronClassifier(layers=[len(names), hidden, 3], maxIter=60, seed=7)).fit(rows)


def fit_balanced(rows: DataFrame, names: list[str]) -> PipelineModel:
    """Logistic regression in which each outcome weighs the same, missing features replaced by their median."""
    n = rows.count()
    share = rows.groupBy("y").agg(F.count(F.lit(1)).alias("__n"))
    weighed = rows.join(F.broadcast(share), "y").withColumn("__w", n / (3.0 * F.col("__n")))  # a row an outcome
    return _pipeline(names, LogisticRegression(family="multinomial", weightCol="__w", maxIter=60), imputed=True).fit(weighed)


def predict(rows: DataFrame, model: PipelineModel | Boosted) -> DataFrame:
    """``rows`` with p_home, p_draw, p_away."""
    scored = model.transform(rows)
    each = vector_to_array("__p")
    return scored.withColumns({c: each[k] for k, c in enumerate(P)}).select(*[c for c in rows.columns if c not in P], *P)


def loss_of(scored: DataFrame) -> float:
    return scored.where("y is not null").agg(metrics.log_loss([F.col(c) for c in P]).alias("l")).first().l


def best_penalty(early: DataFrame, late: DataFrame, names: list[str], grid: tuple[float, ...] = PENALTIES) -> tuple[float, float]:
    """(penalty, log loss on the late half) of the least loss, of equal ones the first."""
    losses = _each(early, lambda c: loss_of(predict(late, fit_logistic(early, names, c))), list(grid))
    loss, _, c = min((loss, k, c) for k, (loss, c) in enumerate(zip(losses, grid)))
    return c, loss


def subset_losses(early: DataFrame, late: DataFrame, subsets: dict[str, list[str]], fit: Fit = fit_logistic) -> list[tuple[str, int, float]]:
    """(name, width, log loss on the late half) of each named set of features, the least loss first."""
    losses = _each(early, lambda names: loss_of(predict(late, fit(early, names))), list(subsets.values()))
    return sorted(((name, len(names), loss) for (name, names), loss in zip(subsets.items(), losses)), key=lambda x: (x[2], x[0]))


def pooled(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float]]:
    """Isotonic regression by pooling adjacent violators: (first x, last x, mean) of each block. ``x`` ascends; ``total`` and ``n``
    are what the labels at it sum to, and how many they are."""
    blocks: list[list[float]] = []
    for a, t, k in zip(x.tolist(), total.tolist(), n.tolist()):
        blocks.append([a, a, t, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]
    return [(a, b, t / k) for a, b, t, k in blocks]


def cross_fitted_isotonic(rows: DataFrame, folds: int = 5, seed: int = 20260602, group: str | None = None) -> DataFrame:
    """``rows`` (match_id, y, p_home, p_draw, p_away, and ``group``, such as a league) with each outcome's probability recalibrated by
    an isotonic regression fitted on the other folds of its group, made to sum to 1.

    Folds are stratified: the matches of each outcome are dealt in turn, in the order of a hash of match_id and ``seed``. A group
    has as many folds as its rarest outcome has matches, ``folds`` at most; with fewer than two it stays as it is, as does a row
    whose three new values are 0. Between two blocks a line runs; beyond the first and last value, these hold.

    Labels are summed by probability before they meet; then one task has a group and outcome and fits all folds.
    """
    own = rows.withColumn("__g", F.col(group).cast("string") if group else F.lit("all"))
    per = Window.partitionBy("__g", "y").orderBy(F.xxhash64(F.lit(seed), "match_id"), "match_id")
    counts = own.where("y is not null").groupBy("__g", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("__g").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("outcomes"))
    splits = counts.select("__g", F.when(F.col("outcomes") == 3, F.least("least", F.lit(folds))).otherwise(0).cast("int").alias("__s"))
    folded = own.join(splits, "__g", "left").withColumn("__fold", F.when((F.col("__s") >= 2) & F.col("y").isNotNull(), (F.row_number().over(per) - 1) % F.col("__s")))
    each = F.inline(F.array(*[F.struct(F.lit(j).alias("outcome"), F.col(c).alias("x"), (F.col("y") == j).cast("double").alias("hit")) for j, c in enumerate(P)]))
    sums = folded.where("__fold is not null").select("__g", "__s", "__fold", each).groupBy("__g", "__s", "__fold", "outcome", "x").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))

    def fit(held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(int(held["__s"].iloc[0])):
            known = held[held["__fold"] != k].groupby("x", sort=True)[["hits", "n"]].sum()
            blocks = pooled(known.index.to_numpy(), known.hits.to_numpy(), known.n.to_numpy())
            ends = [(x, v) for a, b, v in blocks for x in ((a, b) if a < b else (a,))]
            lines = [(float("-inf"), ends[0][0], ends[0][1], ends[0][1]), *((*p, *q) for p, q in zip(ends, ends[1:])), (ends[-1][0], float("inf"), ends[-1][1], ends[-1][1])]
            lines = [lines[0], *((x0, x1, v0, v1) for x0, v0, x1, v1 in lines[1:-1]), lines[-1]]
            out.append((held["__g"].iloc[0], k, int(held.outcome.iloc[0]), [dict(zip(("x0", "x1", "v0", "v1"), map(float, line))) for line in lines]))
        return pd.DataFrame(out, columns=["__g", "__fold", "outcome", "lines"])

    fits = sums.groupBy("__g", "outcome").applyInPandas(fit, "__g string, __fold int, outcome int, lines array<struct<x0:double,x1:double,v0:double,v1:double>>")
    wide = fits.groupBy("__g", "__fold").agg(*[F.first(F.when(F.col("outcome") == j, F.col("lines")), ignorenulls=True).alias(f"__l{j}") for j in range(3)])
    joined = folded.join(wide, ["__g", "__fold"], "left")

    def value(j: int, c: str) -> Column:
        x, at = F.col(c), F.get(F.filter(f"__l{j}", lambda s: (F.col(c) >= s["x0"]) & (F.col(c) <= s["x1"])), F.lit(0))
        flat = at["v0"] == at["v1"]
        return F.when(flat, at["v0"]).otherwise(at["v0"] + (at["v1"] - at["v0"]) * ((x - at["x0"]) / (at["x1"] - at["x0"])))

    new = joined.withColumns({f"__n{j}": value(j, c) for j, c in enumerate(P)})
    total = F.col("__n0") + F.col("__n1") + F.col("__n2")
    kept = F.col("__fold").isNull() | F.coalesce(total < 1e-15, F.lit(True))
    old = F.col(P[0]) + F.col(P[1]) + F.col(P[2])
    return new.select(*[c for c in rows.columns if c not in P], *[F.when(F.col("__fold").isNull(), F.col(c)).when(kept, F.col(c) / old).otherwise(F.col(f"__n{j}") / total).alias(c) for j, c in enumerate(P)])


def step_scaler(sequences: DataFrame, features: list[str]) -> DataFrame:
    """Mean and deviation of each feature over the steps that are there: feature, mean, std. ``sequences`` has ``steps``."""
    steps = sequences.select(F.explode("steps").alias("s")).select("s.*").where("there = 1")
    wide = steps.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std")) for f in features])))


def sequence_dataset(matches: DataFrame, sequences: DataFrame) -> DataFrame:
    """Each played match with both sides' steps as they stood before its day: match_id, y, home_steps, away_steps."""
    rows = matches
    for side in ("home", "away"):
        rows = rows.join(sequences.select("league", "date", F.col("team").alias(f"{side}_team"), F.col("steps").alias(f"{side}_steps")), ["league", "date", f"{side}_team"])
    return rows.select("match_id", "y", "home_steps", "away_steps")
