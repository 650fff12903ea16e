"""The search for a league's parameters on its validation season, as a chain of grids.

1. Gain, home advantage and weight of ratings (64 cells): goal rates from plain strengths of the matches before the
   season, ratings from one pass over those matches and the season's own.
2. Decay of strengths (4), with strengths adjusted to each other in turn.
3. Correction of low scores and temperature together: 21 corrections, each with its own best temperature, over
   probabilities as they stood before each day.

Each grid is one pass over the season's rows, for all leagues at once; a few numbers a league and cell come out of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import outcome
from touchline.operators import asof, ratings
from touchline.operators import state as known
from touchline.operators.tuning import BETAS, DECAYS, GAINS, HOME_ADVANTAGES, RHOS, TEMPERATURES, grid_means, scaled_loss
from touchline.sources.shared import stored

MAX_GOALS, LEAST_RATE, EPS = 10, 0.05, 1e-12
#: Points between two temperatures when they are looked at more closely, and how often.
CLOSER, TIMES_CLOSER = 32, 3


def _pmf(rate: np.ndarray) -> np.ndarray:
    """Chances of 0 to ``MAX_GOALS`` goals, along a new last axis."""
    k = np.arange(MAX_GOALS + 1)
    factorials = np.cumprod(np.maximum(k, 1).astype(float))
    return np.exp(-rate)[..., None] * rate[..., None] ** k / factorials


def outcome_chances(home: np.ndarray, away: np.ndarray, rho: np.ndarray | float = 0.0) -> np.ndarray:
    """Chances of a home win, a draw and an away win, along a new last axis, for goal rates and a correction of low scores,
    which is held to where no chance is negative."""
    h, a = _pmf(home), _pmf(away)
    fewer = lambda p: np.cumsum(p, axis=-1) - p
    win, draw, loss = (h * fewer(a)).sum(-1), (h * a).sum(-1), (a * fewer(h)).sum(-1)
    most = np.minimum((1 - 1e-6) / (home * away), 1 - 1e-6)
    r = np.clip(rho, -most, most)
    moved = lambda i, j, factor: np.maximum(0.0, h[..., i] * a[..., j] * factor) - h[..., i] * a[..., j]
    out = np.stack([win + moved(1, 0, 1 + away * r), draw + moved(0, 0, 1 - home * away * r) + moved(1, 1, 1 - r), loss + moved(0, 1, 1 + home * r)], axis=-1)
    return out / out.sum(-1, keepdims=True)


def _moved(home: np.ndarray, away: np.ndarray, diff: np.ndarray, beta: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    power = beta * diff / 400.0
    return np.maximum(home * np.exp(power), LEAST_RATE), np.maximum(away * np.exp(-power), LEAST_RATE)


def _loss(chances: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = y.astype(int).reshape(-1, *[1] * (chances.ndim - 1))
    return -np.log(np.clip(np.take_along_axis(chances, at, axis=-1)[..., 0], 1e-15, 1.0))


def _rates(season: DataFrame, strengths: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """``season`` with home_rate and away_rate from attack and defence (1 for a team that has none) and the league's means."""
    side = lambda s: strengths.select(*keys, F.col("team").alias(f"{s}_team"), F.col("attack").alias(f"{s}_attack"), F.col("defence").alias(f"{s}_defence"))
    rows = season.join(means, keys).join(side("home"), [*keys, "home_team"], "left").join(side("away"), [*keys, "away_team"], "left")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return rows.withColumns({"home_rate": F.col("mean_home") * one("home_attack") * one("away_defence"), "away_rate": F.col("mean_away") * one("away_attack") * one("home_defence")})


def _first_least(losses: DataFrame, keys: list[str]) -> list:
    """Of each group the place of least loss, of equal ones the first."""
    return losses.groupBy(*keys).agg(F.min(F.struct("loss", "place")).alias("b")).select(*keys, "b.*").collect()


def league_params(matches: DataFrame, season: str, gains: tuple = GAINS, advantages: tuple = HOME_ADVANTAGES, betas: tuple = BETAS, decays: tuple = DECAYS, rhos: tuple = RHOS) -> DataFrame:
    """Per league k, home_adv, beta with their loss, decay with its loss, rho and t with the loss of both.

    ``season``: a condition (SQL) that the days of the validation season meet; they follow all days that count as training.
    Leagues without played matches before or in the season have no row. Of equal losses the first in the grid is taken.
    """
    spark, kind = matches.sparkSession, dict(matches.dtypes)["league"]
    played = stored(matches.where("home_goals is not null and away_goals is not null"), "search-matches")
    start = played.where(season).agg(F.min("date")).first()[0]
    names = f"league {kind}, k double, home_adv double, beta double, loss double, decay double, decay_loss double, rho double, t double, joint_loss double"
    if start is None:
        return spark.createDataFrame([], names)
    fitted = played.where(F.col("date") < F.lit(start))
    rows = played.where(season).select("match_id", "league", "date", "home_team", "away_team", outcome("home_goals", "away_goals").cast("double").alias("y"))

    # Ratings, row by row, through training and season.
    cells = ratings.elo_cells(fitted.unionByName(played.where(season)), gains, advantages, by_day=False).select("match_id", "diffs")
    n = len(gains) * len(advantages)
    season_rows = stored(rows.join(cells, "match_id").select("*", *[F.get("diffs", F.lit(c)).alias(f"d{c}") for c in range(n)]).drop("diffs"), "search-season")
    means = fitted.groupBy("league").agg(F.avg("home_goals").alias("mean_home"), F.avg("away_goals").alias("mean_away"))
    first = _rates(season_rows, asof.strengths(fitted), means, ["league"]).select("league", "home_rate", "away_rate", "y", *[f"d{c}" for c in range(n)])
    beta = np.array(betas, float)

    def by_rating(x: dict[str, np.ndarray], _: tuple) -> np.ndarray:
        diff = np.stack([x[f"d{c}"] for c in range(n)], axis=1)[:, :, None]
        home, away = _moved(x["home_rate"][:, None, None], x["away_rate"][:, None, None], diff, beta)
        return _loss(outcome_chances(home, away), x["y"]).reshape(len(x["y"]), -1)

    best = {r.league: r for r in _first_least(grid_means(first, ["league"], n * len(betas), by_rating, 2 * (MAX_GOALS + 1)), ["league"])}
    cell = {g: (r.place // len(betas), float(betas[r.place % len(betas)])) for g, r in best.items()}

    # Decay: strengths of each league for each decay, then all decays of a row in one group a decay.
    ends = fitted.groupBy("league").agg(F.max("date").alias("__end"))
    parts = []
    for d in decays:
        w = F.exp(-d * F.datediff("__end", "date"))
        weighed = fitted.join(F.broadcast(ends), "league").groupBy("league").agg((F.sum(w * F.col("home_goals")) / F.sum(w)).alias("mean_home"), (F.sum(w * F.col("away_goals")) / F.sum(w)).alias("mean_away"))  # a row a league
        parts.append(_rates(season_rows, ratings.iterative_strengths(fitted, d), weighed, ["league"]).withColumn("decay", F.lit(float(d))))
    spread = parts[0]
    for p in parts[1:]:
        spread = spread.unionByName(p)

    def by_decay(x: dict[str, np.ndarray], key: tuple) -> np.ndarray:
        at, b = cell[key[0]]
        home, away = _moved(x["home_rate"], x["away_rate"], x[f"d{at}"], b)
        return _loss(outcome_chances(home, away), x["y"])[:, None]

    losses = grid_means(spread.select("league", "decay", "home_rate", "away_rate", "y", *[f"d{c}" for c in range(n)]), ["league", "decay"], 1, by_decay, 2 * (MAX_GOALS + 1))
    order = {float(d): k for k, d in enumerate(decays)}
    decay: dict = {}
    for r in sorted(losses.collect(), key=lambda r: (r.loss, order[r.decay])):
        decay.setdefault(r.league, (r.decay, r.loss))

    # As things stood before each day, with each league's own parameters.
    found = None
    for d in sorted({d for d, _ in decay.values()}):
        own = [g for g, (x, _) in decay.items() if x == d]
        part = known.sides(played.where(F.col("league").isin(own)), d).where(season)
        found = part if found is None else found.unionByName(part)
    day_cells = ratings.elo_cells(played, gains, advantages).select("match_id", *[F.get("diffs", F.lit(c)).alias(f"d{c}") for c in range(n)])
    rate = lambda *c: F.greatest(F.col(c[0]) * F.col(c[1]) * F.col(c[2]), F.lit(LEAST_RATE))
    stood = found.select("match_id", "league", rate("mean_home", "home_home_attack", "away_away_defence").alias("home_rate"), rate("mean_away", "away_away_attack", "home_home_defence").alias("away_rate"), outcome("home_goals", "away_goals").cast("double").alias("y"))
    stood = stored(stood.join(day_cells, "match_id").drop("match_id"), "search-days")
    rho = np.array(rhos, float)
    at = {(g, k): np.array(TEMPERATURES, float) for g in decay for k in range(len(rhos))}
    joint: dict = {}
    for _ in range(1 + TIMES_CLOSER):
        width = len(next(iter(at.values()))) if at else 0

        def by_temperature(x: dict[str, np.ndarray], key: tuple, at=at) -> np.ndarray:
            d, b = cell[key[0]]
            home, away = _moved(x["home_rate"], x["away_rate"], x[f"d{d}"], b)
            chances = np.clip(outcome_chances(home[:, None], away[:, None], rho), EPS, 1.0)
            logs = np.log(chances / chances.sum(-1, keepdims=True))
            columns = []
            for k in range(len(rho)):
                own = {f"l{j}": logs[:, k, j] for j in range(3)} | {"ly": logs[np.arange(len(logs)), k, x["y"].astype(int)]}
                columns.append(scaled_loss(own, at[key[0], k]))
            return np.concatenate(columns, axis=1)

        cells_found = grid_means(stood.select("league", "home_rate", "away_rate", "y", *[f"d{c}" for c in range(n)]), ["league"], width * len(rhos), by_temperature)
        per_rho = cells_found.groupBy("league", F.expr(f"place div {width}").alias("rho")).agg(F.min(F.struct("loss", "place")).alias("b"))
        closer = {}
        for r in per_rho.collect():
            grid, j = at[r.league, r.rho], r.b.place % width
            joint[r.league, r.rho] = min(joint.get((r.league, r.rho), (float("inf"), 0.0)), (r.b.loss, float(grid[j])))
            closer[r.league, r.rho] = np.linspace(grid[max(0, j - 1)], grid[min(width - 1, j + 1)], CLOSER + 1)
        at = closer
    out = []
    for g in sorted(decay):
        (loss, t), k = min(((joint[g, k][0], joint[g, k][1]), k) for k in range(len(rhos)) if (g, k) in joint)
        place, b = cell[g]
        out.append((g, float(gains[place // len(advantages)]), float(advantages[place % len(advantages)]), b, best[g].loss, decay[g][0], decay[g][1], float(rhos[k]), t, loss))
    return spark.createDataFrame(out, names)
