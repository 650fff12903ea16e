"""Quality of probabilities, and tuning over small grids, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip, col, first_max
from touchline.functions.odds import Triplet, probability_of, safe, temperature

EPS = 1e-15
#: Why a correction is not accepted.
TOO_LITTLE, LOST_IN_A_FOLD = "insufficient_late_validation_improvement", "failed_chronological_fold_gate"


def log_loss(probs: Triplet, y: Column | str = "y") -> Column:
    """Mean of -ln(probability of the outcome)."""
    return F.avg(-F.ln(clip(probability_of(probs, y), EPS, 1.0)))


def brier(probs: Triplet, y: Column | str = "y") -> Column:
    terms = [F.pow(p - (col(y) == k).cast("double"), F.lit(2.0)) for k, p in enumerate(probs)]
    return F.avg(terms[0] + terms[1] + terms[2])


def accuracy(probs: Triplet, y: Column | str = "y") -> Column:
    return F.avg((first_max(*probs) == col(y)).cast("double"))


def calibration_error(rows: DataFrame, probs: Triplet, y: str = "y", bins: int = 10) -> DataFrame:
    """One row, ece: the mean distance of confidence and accuracy over bins of the confidence."""
    conf = F.greatest(*probs)
    binned = rows.where(F.col(y).isNotNull()).select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"), conf.alias("conf"), (first_max(*probs) == F.col(y)).cast("double").alias("hit"))
    per_bin = binned.groupBy("bin").agg(F.sum("conf").alias("c"), F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return per_bin.agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))


def class_metrics(rows: DataFrame, probs: Triplet, y: str = "y") -> DataFrame:
    """Precision, recall and F1 of each outcome; 0 where there is nothing to divide by."""
    pred = first_max(*probs)
    classes = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    long = rows.where(F.col(y).isNotNull()).select(pred.alias("pred"), F.col(y).alias("y"), classes.alias("class"))
    count = lambda test: F.sum(test.cast("long"))
    hit = count((F.col("pred") == F.col("class")) & (F.col("y") == F.col("class")))
    out = long.groupBy("class").agg(hit.alias("tp"), count(F.col("pred") == F.col("class")).alias("n_pred"), count(F.col("y") == F.col("class")).alias("n_true"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_true"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(rows: DataFrame, probs: Triplet, y: str = "y") -> DataFrame:
    return rows.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("y"), first_max(*probs).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_marginals(rows: DataFrame, probs: Triplet, y: str = "y") -> DataFrame:
    """Mean probability, rate and share of picks of each outcome."""
    pick = first_max(*probs)
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), probs[k].alias("p"), (F.col(y) == k).cast("double").alias("hit"), (pick == k).cast("double").alias("picked")) for k in range(3)]))
    long = rows.where(F.col(y).isNotNull()).select(per.alias("c"))
    return long.groupBy("c.class").agg(F.avg("c.p").alias("mean_prob"), F.avg("c.hit").alias("rate"), F.avg("c.picked").alias("pick_rate"))


def temperature_grid(rows: DataFrame, probs: Triplet, grid: list[float], y: str = "y") -> DataFrame:
    """Log loss at each temperature of a grid: one pass, one column a temperature, then unpivoted."""
    wide = rows.where(F.col(y).isNotNull()).agg(*[log_loss(temperature(probs, t), y).alias(f"t{k}") for k, t in enumerate(grid)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"t{k}").alias("loss")) for k, t in enumerate(grid)])).alias("g")).select("g.t", "g.loss")


def blend_grid(rows: DataFrame, a: Triplet, b: Triplet, steps: int = 20, y: str = "y") -> DataFrame:
    """Log loss of w * a + (1 - w) * b for w on a grid of ``steps`` + 1."""
    pa, pb = probability_of(a, y), probability_of(b, y)
    losses = [F.avg(-F.ln(clip(pa * (k / steps) + pb * (1 - k / steps), EPS, 1.0))).alias(f"w{k}") for k in range(steps + 1)]
    wide = rows.where(F.col(y).isNotNull()).agg(*losses)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k / steps).alias("w"), F.col(f"w{k}").alias("loss")) for k in range(steps + 1)])).alias("g")).select("g.w", "g.loss")


#: Strengths of the market's correction.
ALPHAS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)


def correction_grid(rows: DataFrame, market: Triplet, source: Triplet, y: str = "y") -> DataFrame:
    """Log loss at each strength of the correction of the market by a source, overall and in each fold."""
    scored = rows.where(F.col(y).isNotNull()).select("fold", F.col(y).alias("y"), *[p.alias(f"{s}{k}") for s, probs in (("m", safe(market)), ("s", safe(source))) for k, p in enumerate(probs)])
    # Logarithms once a row; a strength is then a weighted sum of two.
    logs = scored.select("fold", *[F.ln(f"{s}{k}").alias(f"l{s}{k}") for s in "ms" for k in range(3)], *[F.ln(probability_of([F.col(f"{s}{k}") for k in range(3)], "y")).alias(f"l{s}y") for s in "ms"])
    names = [f"a{k}" for k in range(len(ALPHAS))]
    mixed = lambda k, alpha: F.col(f"lm{k}") * (1 - alpha) + F.col(f"ls{k}") * alpha
    loss = lambda alpha: F.ln(F.exp(mixed(0, alpha)) + F.exp(mixed(1, alpha)) + F.exp(mixed(2, alpha))) - mixed("y", alpha)
    wide = logs.rollup("fold").agg(*[F.avg(loss(alpha)).alias(n) for n, alpha in zip(names, ALPHAS)])
    return wide.select("fold", F.explode(F.array(*[F.struct(F.lit(alpha).alias("alpha"), F.col(n).alias("loss")) for n, alpha in zip(names, ALPHAS)])).alias("g")).select("fold", "g.alpha", "g.loss")


def accept_correction(losses: DataFrame, least_gain: float = 0.0005, least_fold_gain: float = 0.0) -> DataFrame:
    """One row of ``correction_grid``'s: the strength of least loss (of equal ones the smallest), its loss and the
    market's, and whether it is accepted: a gain of more than ``least_gain`` overall and ``least_fold_gain`` or more in
    each fold. Otherwise alpha is 0 and reason says why."""
    market = losses.where("alpha = 0").select(F.col("fold").alias("of"), F.col("loss").alias("market"))
    gains = losses.join(market, F.col("fold").eqNullSafe(F.col("of"))).select("fold", "alpha", "loss", "market")
    best = gains.where("fold is null").agg(F.min(F.struct("loss", "alpha", "market")).alias("b")).select("b.*")
    folds = gains.where("fold is not null").groupBy("alpha").agg(F.min((F.col("loss") <= F.col("market") - least_fold_gain).cast("int")).alias("held"))
    enough, held = F.col("loss") < F.col("market") - least_gain, F.coalesce("held", F.lit(1)) == 1
    reason = F.when(~enough, TOO_LITTLE).when(~held, LOST_IN_A_FOLD)
    accepted = enough & held
    return best.join(folds, "alpha", "left").select(F.col("alpha").alias("best_alpha"), F.when(accepted, F.col("alpha")).otherwise(0.0).alias("alpha"), F.when(accepted, F.col("loss")).otherwise(F.col("market")).alias("loss"), F.col("market").alias("market_loss"), accepted.alias("accepted"), reason.alias("reason"))


def agreement(rows: DataFrame, a: Triplet, b: Triplet) -> DataFrame:
    """How two sets of probabilities agree: share of equal picks, mean distance, mean confidences."""
    distance = sum((F.abs(x - y) for x, y in zip(a[1:], b[1:])), F.abs(a[0] - b[0])) / 3.0
    return rows.agg(F.avg((first_max(*a) == first_max(*b)).cast("double")).alias("agree"), F.avg(distance).alias("mean_diff"), F.avg(F.greatest(*a)).alias("conf_a"), F.avg(F.greatest(*b)).alias("conf_b"))
