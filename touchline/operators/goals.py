"""Goals of both sides as Poisson numbers, with the correction of low scores: all column expressions."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip
from touchline.functions.odds import Triplet

MAX_GOALS = 10


def poisson(k: int | Column, mean: Column) -> Column:
    """Probability of ``k``; all on 0 for a mean of 0 or less."""
    if isinstance(k, int):
        return F.when(mean <= 0, F.lit(1.0 if k == 0 else 0.0)).otherwise(F.exp(-mean) * F.pow(mean, F.lit(float(k))) / float(factorial(k)))
    return F.when(mean <= 0, (k == 0).cast("double")).otherwise(F.exp(-mean) * F.pow(mean, k.cast("double")) / F.factorial(k.cast("int")))


def low_score_factor(h: Column, a: Column, home: Column, away: Column, rho: float | Column) -> Column:
    """The factor of a score among 0-0, 1-0, 0-1 and 1-1, else 1. ``rho`` is held where no factor is negative."""
    most = F.least((1 - 1e-6) / F.greatest(home * away, F.lit(1e-12)), F.lit(1 - 1e-6))
    r = F.greatest(F.least(F.lit(rho), most), -most)
    return (
        F.when((h == 0) & (a == 0), 1 - home * away * r)
        .when((h == 0) & (a == 1), 1 + home * r)
        .when((h == 1) & (a == 0), 1 + away * r)
        .when((h == 1) & (a == 1), 1 - r)
        .otherwise(1.0)
    )


def _side_probs(rates: DataFrame, most: int) -> DataFrame:
    """Adds __h and __a: the probabilities of 0 to ``most`` goals of both sides, as arrays."""
    return rates.withColumns({f"__{s}": F.array(*[poisson(k, F.col(f"{side}_rate")) for k in range(most + 1)]) for s, side in (("h", "home"), ("a", "away"))})


def scores(rates: DataFrame, rho: float = 0.0, most: int = MAX_GOALS) -> DataFrame:
    """Per row of ``rates`` (home_rate, away_rate) its (most + 1)^2 scores: cells of hg, ag and a weight p, which
    must be divided by the sum of them all (not here, where it would be summed up anew for each cell)."""
    home, away = F.col("home_rate"), F.col("away_rate")
    cell = lambda h, a, p: F.struct(F.lit(h).alias("hg"), F.lit(a).alias("ag"), F.greatest(F.lit(0.0), p).alias("p"))
    factor = lambda h, a: low_score_factor(F.lit(h), F.lit(a), home, away, rho) if h < 2 and a < 2 else F.lit(1.0)
    cells = F.array(*[cell(h, a, F.get("__h", F.lit(h)) * F.get("__a", F.lit(a)) * factor(h, a)) for h in range(most + 1) for a in range(most + 1)])
    return _side_probs(rates, most).withColumn("cells", cells).drop("__h", "__a")


def _total():
    """Sum of the weights of all cells."""
    return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["p"])


def outcome_probs(rates: DataFrame, rho: float | Column = 0.0, most: int = MAX_GOALS) -> DataFrame:
    """``rates`` with p_home, p_draw, p_away.

    Home wins are the sum of home goals' probabilities times those of fewer away goals; only the four low scores
    are corrected one by one.
    """
    home, away = F.col("home_rate"), F.col("away_rate")
    h, a = [F.col(f"__h{k}") for k in range(most + 1)], [F.col(f"__a{k}") for k in range(most + 1)]
    sided = rates.withColumns({f"__{s}{k}": poisson(k, rate) for s, rate in (("h", home), ("a", away)) for k in range(most + 1)})
    total = lambda terms: reduce(lambda x, y: x + y, terms)
    sums = {"__win": total([h[k] * total(a[:k]) for k in range(1, most + 1)]), "__draw": total([x * y for x, y in zip(h, a)]), "__loss": total([a[k] * total(h[:k]) for k in range(1, most + 1)])}
    if isinstance(rho, Column) or rho:
        moved = lambda i, j: F.greatest(F.lit(0.0), h[i] * a[j] * low_score_factor(F.lit(i), F.lit(j), home, away, rho)) - h[i] * a[j]
        sums = {"__win": sums["__win"] + moved(1, 0), "__draw": sums["__draw"] + moved(0, 0) + moved(1, 1), "__loss": sums["__loss"] + moved(0, 1)}
    summed = sided.select(*rates.columns, *[c.alias(n) for n, c in sums.items()])
    all_of_it = F.col("__win") + F.col("__draw") + F.col("__loss")
    return summed.select(*rates.columns, *[(F.col(c) / all_of_it).alias(n) for n, c in (("p_home", "__win"), ("p_draw", "__draw"), ("p_away", "__loss"))])


def top_scores(rates: DataFrame, k: int = 5, rho: float = 0.0, most: int = MAX_GOALS) -> DataFrame:
    """The ``k`` most probable scores of each row: rank, hg, ag, p; of equal ones the lower score first."""
    ordered = F.array_sort(F.transform("cells", lambda c: F.struct((-c["p"]).alias("n"), c["hg"].alias("hg"), c["ag"].alias("ag"))))
    top = F.slice(ordered, 1, k)
    kept = [c for c in rates.columns if c not in ("home_rate", "away_rate")]
    out = scores(rates, rho, most).select(*kept, _total().alias("__total"), F.posexplode(top).alias("pos", "c"))
    return out.select(*kept, (F.col("pos") + 1).alias("rank"), F.col("c.hg").alias("hg"), F.col("c.ag").alias("ag"), (-F.col("c.n") / F.col("__total")).alias("p"))


def with_elo(home: Column, away: Column, diff: Column, beta: float) -> tuple[Column, Column]:
    """Goal rates moved by a difference of ratings, 0.05 at least."""
    return F.greatest(home * F.exp(beta * diff / 400.0), F.lit(0.05)), F.greatest(away * F.exp(-beta * diff / 400.0), F.lit(0.05))


def over_25(total: Column) -> Column:
    """Probability of three goals or more."""
    t = clip(total, 0.01, 8.0)
    return clip(1 - F.exp(-t) * (1 + t + t * t / 2), 1e-6, 1 - 1e-6)


def probs_of(prefix: str = "p") -> Triplet:
    return [F.col(f"{prefix}_{leg}") for leg in ("home", "draw", "away")]
