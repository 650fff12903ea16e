"""The vector of numbers that describes a fixture before it is played, for every fixture, played or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.columns import finite, first_max
from touchline.functions.context import context_features
from touchline.operators import goals
from touchline.operators import state as known
from touchline.sources.shared import stored

#: Means of the last matches that stand in the vector, each for both sides and as a difference, in order.
LOCAL = ("goals_for", "goals_against", "shots_for", "shots_against", "shots_target_for", "shots_target_against", "corners_for", "corners_against", "cards_for")
XG = ("xg_for", "npxg_for", "xpts_for")


def _sided(names: tuple[str, ...]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in names:
        out |= {f"{n}_home_5": F.col(f"home_{n}_mean"), f"{n}_away_5": F.col(f"away_{n}_mean"), f"{n}_diff_5": F.col(f"home_{n}_mean") - F.col(f"away_{n}_mean")}
    return out


def _extras(rows: DataFrame, movement: bool) -> dict[str, Column]:
    """The 71 columns, of what ``state.sides`` knows of a match joined with its context."""
    move = O.market_move(O.legs("open_odds"), O.legs("close_odds"), movement)
    over, _, _ = O.over_under([(F.col("over_odds"), F.col("under_odds"))])
    features = _sided(LOCAL) | {f"market_move_{leg}": m for leg, m in zip(O.LEGS, move)}
    features |= {"ou25_over_prob": F.coalesce(over, F.lit(0.5)), "ah_line": F.coalesce(finite("ah_line"), F.lit(0.0))}
    return features | _sided(XG) | context_features(rows)


def extra_features(matches: DataFrame, context: DataFrame, window: int = 5, movement: bool = True) -> DataFrame:
    """match_id and 71 columns: form of both sides, market movement, lines, expected goals, context.

    ``context`` has a row per match_id at most; what it lacks counts neutral. Only matches of earlier days are seen.
    """
    rows = known.sides(matches, window=window).join(context, "match_id", "left")
    return rows.select("match_id", *[c.alias(n) for n, c in _extras(rows, movement).items()])


def _components(rows: DataFrame, beta: float, rho: float) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` of ``state.sides`` over rated matches with the base model's p_home, p_draw, p_away, and its twelve numbers."""
    rate = lambda *c: F.greatest(F.col(c[0]) * F.col(c[1]) * F.col(c[2]), F.lit(0.05))
    rows = rows.withColumns({"home_rate": rate("mean_home", "home_home_attack", "away_away_defence"), "away_rate": rate("mean_away", "away_away_attack", "home_home_defence")})
    home, away = goals.with_elo(F.col("home_rate"), F.col("away_rate"), F.col("home_elo") - F.col("away_elo"), beta)
    rows = goals.outcome_probs(rows.withColumns({"home_rate": home, "away_rate": away}), rho)
    numbers = {"elo_diff": (F.col("home_elo") - F.col("away_elo")) / 400.0, "rate_sum": F.col("home_rate") + F.col("away_rate"), "rate_diff": F.col("home_rate") - F.col("away_rate")}
    for short, c in (("mom", "momentum"), ("rest", "rest"), ("form", "form")):
        numbers |= {f"{short}_home": F.col(f"home_{c}"), f"{short}_away": F.col(f"away_{c}"), f"{short}_diff": F.col(f"home_{c}") - F.col(f"away_{c}")}
    return rows, numbers


def match_components(matches: DataFrame, k: float = 50.0, home_adv: float = 80.0, beta: float = 0.11, rho: float = -0.08, decay: float = 0.001, state: known.LeagueState | None = None) -> DataFrame:
    """match_id, the base model's p_home, p_draw, p_away and twelve numbers: ratings, goal rates, momentum, rest and
    form of both sides and their differences, as they stood before the day. Every fixture has a row.

    With a ``state``, whose parameters then count, ``matches`` are those after it, and the history before isn't read.
    """
    if state:
        k, home_adv, decay = state.k, state.home_adv, state.decay
    rows, numbers = _components(known.sides(known.rated(matches, k, home_adv, state), decay, state), beta, rho)
    return rows.select("match_id", "p_home", "p_draw", "p_away", *[c.alias(n) for n, c in numbers.items()])


def matchday_block(matches: DataFrame, context: DataFrame, k: float = 50.0, home_adv: float = 80.0, beta: float = 0.11, rho: float = -0.08, decay: float = 0.001, movement: bool = True, state: known.LeagueState | None = None) -> DataFrame:
    """All that scores and bets need of each fixture: the model's and the market's probabilities, the numbers of both
    vectors, the odds to bet at, and the outcome y (null if not played).

    ``matches`` are written once to the shared folder, and again with their ratings, which are a pass over a league's matches
    in order; what is known of both sides is found in one pass.
    """
    if state:
        k, home_adv, decay = state.k, state.home_adv, state.decay
    once = stored(matches, "matches")
    rated = stored(known.rated(once, k, home_adv, state), "rated")
    rows, numbers = _components(known.sides(rated, decay, state), beta, rho)
    rows = rows.join(context, "match_id", "left")
    market = O.fair_probs(O.snapshot("closing"))
    return rows.select(
        "match_id", "date", "league", O.outcome("home_goals", "away_goals").alias("y"), *[p.alias(f"market_{leg}") for p, leg in zip(market, O.LEGS)], *[o.alias(f"bet_odds_{leg}") for o, leg in zip(O.snapshot("closing"), O.LEGS)],
        "p_home", "p_draw", "p_away", *[c.alias(n) for n, c in numbers.items()], *[c.alias(n) for n, c in _extras(rows, movement).items()],
    )


def feature_vector(block: DataFrame, names: list[str]) -> DataFrame:
    """``block`` as match_id and an array of the columns ``names``, in their order; ValueError for an unknown name."""
    if unknown := [n for n in names if n not in block.columns]:
        raise ValueError(f"unknown features: {unknown}")
    return block.select("match_id", F.array(*[F.col(n).cast("double") for n in names]).alias("features"))


def upcoming_picks(matches: DataFrame, today: str, max_days: int = 4, **params: float) -> DataFrame:
    """The next matchday of each league from ``today`` on: match_id, p_home, p_draw, p_away and the pick."""
    coming = next_matchday(matches, today, max_days)
    scored = coming.select("match_id").join(match_components(matches, **params), "match_id")
    pick = F.element_at(F.array(*[F.lit(leg) for leg in O.LEGS]), first_max("p_home", "p_draw", "p_away") + 1)
    return scored.select("match_id", "p_home", "p_draw", "p_away", pick.alias("pick"))


def next_matchday(matches: DataFrame, today: str, max_days: int = 4) -> DataFrame:
    """Unplayed matches from ``today`` on, within ``max_days`` of the first of their league."""
    coming = matches.where("home_goals is null or away_goals is null").where(F.col("date") >= F.lit(today).cast("date"))
    first = coming.groupBy("league").agg(F.min("date").alias("__first"))
    return coming.join(first, "league").where(F.col("date") <= F.date_add("__first", max_days)).drop("__first")
